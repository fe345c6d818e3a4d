"""Text rules and scores against cases worked out by hand."""

import html
import random
import time
from difflib import SequenceMatcher
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from editfray.functions import align, diff, entities, scores
from editfray.functions import text as T
from editfray.operators import evidence


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first().asDict()


def test_rollback_comment_names_the_user(spark):
    c, tags = F.lit("Reverted edits by [[Special:Contributions/Bob|Bob]] to revision 77"), F.array(F.lit("mw-undo"), F.lit("mw-rollback"))
    got = one(spark, d=T.revert_detector(tags, c), who=T.reverted_user(c), rev=T.reverted_revision(c))
    assert got["d"].asDict() == {"detector": "mw-rollback", "confidence": 0.95}
    assert (got["who"], got["rev"]) == ("Bob", 77)


@pytest.mark.parametrize(("comment", "flags"), [("opened an RfC", (1, 0, 0)), ("ArbCom case", (0, 1, 0)), ("Undid revision 5", (0, 0, 0)), ("page protection, please", (0, 0, 1)), (None, (0, 0, 0))])
def test_talk_flags(spark, comment, flags):
    got = one(spark, **T.talk_flags(F.lit(comment)))
    assert tuple(got.values()) == flags


def test_first_shot_skips_clean_up_and_generated_comments(spark):
    words = ["The lead must name the founder. More later.", "rvv spam by somebody here", "Undid revision 12 by Bob", "fix", ""]
    got = [r["s"] for r in spark.createDataFrame([(x,) for x in words], "c string").select(T.first_shot(F.col("c")).alias("s")).collect()]
    assert got == ["The lead must name the founder.", "", "", "", ""]


def test_clean_wikitext(spark):
    raw = "'''Bold''' [[A|b]] {{t|x}} <ref name=x>note</ref> == Head == <b>c</b> https://x.org/y d"
    assert one(spark, t=T.clean_wikitext(F.lit(raw)))["t"] == "Bold b Head. c d" == diff.plain_text(raw)


def test_period_bounds(spark):
    rows = spark.createDataFrame([("history:2026-05:2007-09",), ("history-year:2026-05:2007",), ("none",)], "p string").select(T.period_bounds(F.col("p")).alias("b"), T.period_year(F.col("p")).alias("y")).collect()
    assert [(str(r["b"]["start"])[:10], str(r["b"]["end"])[:10]) for r in rows[:2]] == [("2007-09-01", "2007-10-01"), ("2007-01-01", "2008-01-01")]
    assert rows[2]["b"] is None and rows[0]["y"] == "history-year:2026-05:2007"


def test_live_score_of_a_hot_hour(spark):
    n = lambda x: F.lit(float(x))
    got = one(spark, s=scores.live_score(2.0, n(8), n(3), n(4), n(0.5), n(1), n(2), n(10)))
    assert got["s"] == pytest.approx(10 + 40 + 25 + 20 + 3 + 5)
    assert one(spark, s=scores.severity(F.lit(75.0)), q=scores.severity(F.lit(39.99))) == {"s": "war", "q": "quiet"}


def test_insertion_and_swap():
    got = diff.changed_segments("one two three four five six seven eight", "one two three strongly four five six seven eight")
    assert [(x["segment"], x["change_type"]) for x in got] == [("strongly", "addition")]
    assert got[0]["context_before"] == "one two three"
    swap = diff.changed_segments("the old leader spoke today", "the old dictator spoke today")
    assert swap[0]["change_type"] == "swap" and swap[0]["swap_values"] == ["leader", "dictator"]
    assert diff.changed_segments("same words", "same words") == [] == diff.changed_segments("", "x")


def test_graffiti():
    assert diff.is_graffiti("ha" * 30) and diff.is_graffiti("spam " * 9) and not diff.is_graffiti("an ordinary line of words")


def test_talk_sentences(spark):
    old = "The article is about a town. It has many sources to cite here."
    new = old + " We need consensus on the wording of the lead now."
    got = one(spark, old=T.talk_sentences(F.lit(old)), new=T.talk_sentences(F.lit(new)), lists=T.talk_sentences(F.lit("Archives  talk of many years, one and all. Archive 1 and Archive 2 and archive 3 are here. Short one.")))
    assert got["lists"] == []
    places = diff.added([s.lower() for s in got["old"]], [s.lower() for s in got["new"]])
    assert [got["new"][i] for i in places] == ["We need consensus on the wording of the lead now."]

    def matched(sentence, *terms):
        d = one(spark, d=evidence.disputes(F.array(F.lit(sentence)), F.lit(None).cast("string"), F.array(*map(F.lit, terms)).cast("array<string>")))["d"]
        return [x["matched"] for x in d]

    assert matched("We need consensus") == [[]]
    assert matched("a reliable Source", "source") == [["source"]] and matched("a reliable source") == []


def test_alignment_is_that_of_longest_blocks():
    # The same steps as the standard library's matcher, on random lists of few and many words.
    rng = random.Random(3)
    for _ in range(10_000):
        words = "abcdefghij"[: rng.randint(1, 10)]
        a = [rng.choice(words) for _ in range(rng.randrange(30))]
        b = a[:] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(6) if b else 0):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(4)] = [rng.choice(words) for _ in range(rng.randrange(3))]
        want = [(w, x, y, z) for kind, w, x, y, z in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if kind != "equal"]
        assert list(align.changes(a, b)) == want


def test_alignment_of_a_rewritten_text_is_fast():
    rng = random.Random(4)
    a, b = ([f"w{int(rng.paretovariate(1)) % 3000}" for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    assert len(list(align.changes(a, b))) > 100
    assert time.process_time() - began < 10


def test_entities_as_the_standard_library_decodes_them(spark):
    rng, names = random.Random(1), sorted(html5)

    def piece():
        numbers = [0, 13, 65, 128, 150, 233, 0xD800, 0x110000, 0x1F600, 0xFFFE, 0xFDD0, 1, 11, 10**12]
        return rng.choice([
            f"&{rng.choice(names)}", f"&{rng.choice(names)[:-1]}", f"&#{rng.choice(numbers)};", f"&#x{rng.choice(numbers):x}", "&#xZ;", "&", "&amp", "&notit;", "& amp;", "text ", "é;", "&" + "a" * 40, "&#00000000000065;", "&&lt;", "&amp;lt;",
        ])

    texts = ["".join(piece() for _ in range(rng.randrange(8))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = {r["i"]: r["u"] for r in rows.select("i", entities.unescape(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(3000)] == [html.unescape(t) for t in texts] and got[3000] is None
