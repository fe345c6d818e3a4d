"""Evidence, stored months, live sums and feeds, on small tables worked out by hand."""

import itertools
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from editfray.functions import align, diff
from editfray.functions import text as T
from editfray.operators import evidence, governance, graph, lookups, pages, windows
from editfray.plans import serving
from editfray.plans.live_queries import QUERIES
from editfray.sources import sse
from editfray.streaming import live, sinks

START = datetime(2024, 1, 1)
TALK = "page_id long, ts timestamp, rev_id long, user_text string, comment string, content string"


def talk(spark, *texts, comment="reply"):
    return spark.createDataFrame([(1, START + timedelta(hours=i), i, f"U{i % 2}", comment, t) for i, t in enumerate(texts)], TALK)


def terms(spark, *own):
    return spark.createDataFrame([(1, list(own))], "page_id long, terms array<string>")


OLD, NEW, LAST = "This wording is not neutral at all here.", "We need consensus before that change.", "The source says nothing of the kind, see the lead."


def test_a_revision_goes_on_to_the_next_sentence(spark):
    # The third revision brings the old sentence back, and a new one with it.
    got = evidence.talk_evidence(talk(spark, OLD, "Nothing of note was said in here today.", f"{OLD} {NEW}"), terms(spark, "lead"), ["page_id"]).orderBy("place").collect()
    assert [(r["place"], r["user"], r["sentence"]) for r in got] == [(1, "U0", OLD), (2, "U0", NEW)]


def test_disputes_by_terms_comments_and_last_texts(spark):
    got = evidence.talk_evidence(talk(spark, LAST, "x"), terms(spark, "nothing of the kind"), ["page_id"]).collect()
    assert [(r["sentence"], r["matched"]) for r in got] == [(LAST, ["nothing of the kind"])]
    assert evidence.talk_evidence(talk(spark, LAST, "x"), terms(spark, "other"), ["page_id"]).count() == 0
    # No sentence is new: the comment stands for it.
    got = evidence.talk_evidence(talk(spark, "a", "b", comment="Please discuss this first, on the talk page."), terms(spark), ["page_id"]).collect()
    assert [r["sentence"] for r in got] == ["Please discuss this first, on the talk page."]
    # Entities and markup go before sentences are cut.
    got = evidence.talk_evidence(talk(spark, "The [[POV|wording]] is &quot;biased&quot;, and no consensus is there."), terms(spark), ["page_id"]).collect()
    assert [r["sentence"] for r in got] == ['The wording is "biased", and no consensus is there.']


def brute_choice(revisions, most=5):
    seen, out = set(), []
    for user, sentences in revisions:
        for s in sentences:
            if s not in seen:
                seen.add(s)
                out.append((user, s))
                break
        if len(out) == most:
            break
    return out


def test_choice_of_disputes_by_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for page in range(40):
        revisions = [(f"U{i}", rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(0, 4))) for i in range(rng.randint(0, 25))]
        rows += [(page, i, u, k, s, s.upper(), []) for i, (u, ss) in enumerate(revisions) for k, s in enumerate(ss)]
        if chosen := brute_choice(revisions):
            want[page] = chosen
    hits = spark.createDataFrame(rows, "page_id int, rev_id int, user string, pos int, key string, sentence string, matched array<string>")
    got = {}
    for r in evidence.first_unseen(hits, ["page_id"], ("rev_id",)).orderBy("page_id", "place").collect():
        got.setdefault(r["page_id"], []).append((r["x"]["user"], r["x"]["key"]))
    assert got == want


def test_graffiti_in_both_forms(spark):
    texts = ["ha" * 30, "HA ha! " * 20, "no no no no no no no yes", "plain words that say a thing or two here", "a1" * 30, "x" * 45 + " end", "", None, "abcdefghijklmnopqrstuvwxyz" * 2, "word " * 7]
    got = [r["g"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.is_graffiti(F.col("t")).alias("g")).orderBy("i").collect()]
    assert got == [diff.is_graffiti(t) for t in texts] == [True, True, True, False, True, True, False, False, False, False]


def test_title_words_across_of():
    side = diff.Side("The Great King of Northern Lands went home")
    assert side.widened(3, 4) == (3, 4)
    w = side.words.index("of")
    assert side.widened(w + 1, w + 2) == (0, w + 2) and side.widened(w - 1, w) == (w - 1, w + 3)
    assert side.widened(0, 4) == (0, 4)


def whole_changes(before, after):
    """changed_segments() with all words of both texts."""
    old, new = diff.Side(before), diff.Side(after)
    a, b = old.words, new.words
    if not a or not b or a == b:
        return []
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[start:][::-1], b[start:][::-1], strict=False)) if x != y), min(len(a), len(b)) - start)
    out = {}
    for i, j, k, m in align.changes(a[start : len(a) - tail], b[start : len(b) - tail]):
        gone, come = old.candidate(i + start, j + start), new.candidate(k + start, m + start)
        found = diff._swap(gone, come) if gone and come else gone | {"change_type": "deletion"} if gone else come and come | {"change_type": "addition"}
        if found:
            found.setdefault("key", diff.normal(found["segment"]))
            if found["key"]:
                out.setdefault(found["key"], found)
    return list(out.values())[:20]


def test_changes_are_those_of_whole_texts():
    rng, some = random.Random(5), 0
    signs = ["of", "Of", "The", "King", "Great", "lands", "went", "don't", "x", "é", "[[a|Link]]", "{{t}}", "&amp;", "=", "''", "\n", "ha" * 25, "日本"]
    text = lambda n: "".join(rng.choice(signs) + rng.choice((" ", " ", " ", ", ", "-")) for _ in range(n))
    for _ in range(600):
        a = b = text(rng.choice((0, 2, 9, 60, 900)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b = b[:at] + text(rng.choice((0, 1, 3, 50))) + b[at + rng.choice((0, 1, 7, 90, 700)) :]
        got = diff.changed_segments(a, b)
        assert got == whole_changes(a, b), (a, b)
        some += bool(got)
    assert some > 200


def test_words_are_made_about_changes_alone(monkeypatch):
    words = [f"word{i}" for i in range(20000)]
    made, init = [], diff.Words.__init__
    monkeypatch.setattr(diff.Words, "__init__", lambda self, text, low, high: (init(self, text, low, high), made.append(self))[0])
    got = diff.changed_segments(" ".join(words), " ".join([*words[:9000], "Dictator", *words[9001:]]))
    assert [x["swap_values"] for x in got] == [["word9000", "Dictator"]] and got[0]["context_after"] == " ".join(words[9001:9007])
    assert sum(len(x.spans) for x in made if "spans" in vars(x)) < 200


def test_texts_brought_back_are_cleaned_once(spark, monkeypatch):
    cleaned = []
    monkeypatch.setattr(evidence, "changed", lambda old, new: cleaned.append((old.text, new.text)) or [])
    rows = pa.RecordBatch.from_pylist([{"page_id": p, "user_text": "u", "comment": "", "content": f"text {k % 2}"} for p in (1, 2) for k in range(8)])
    schema = spark.createDataFrame([], "page_id long, user_text string, comment string, content string").schema
    frame = SimpleNamespace(schema=schema, mapInArrow=lambda run, _: run)
    out = list(evidence._aligned(frame, ["page_id"], ["page_id", "user_text", "comment"], ends=True)(iter([rows])))
    assert cleaned == [("text 0", "text 1"), ("text 1", "text 0")] * 2
    assert [(r["page_id"], r["end"], r["content"]) for b in out for r in b.to_pylist()] == [(p, e, c) for p in (1, 2) for e, c in ((1, "text 0"), (2, "text 1"))]


def test_pages_stream_through_the_choice_of_phrases(spark):
    # A page is no group of its own in pandas, and its best phrases that don't overlap stay.
    rows = [(p, f"k{i}", f"{w} {p}", float(90 - i), 4, 3, 2, START + timedelta(hours=i)) for p in range(50) for i, w in enumerate(("red house", "red house roof", "blue river", "green tree", "old road"))]
    stats = spark.createDataFrame(rows, "page_id long, key string, segment string, score double, changes long, reverts long, editors long, at timestamp").withColumns(
        {"changed_text": F.col("segment"), "change_type": F.lit("change"), "swap_values": F.array().cast("array<string>"), "first_shot_comment": F.lit(""), "first_ord": F.struct("at"), "editor_names": F.array(F.lit("A"), F.lit("B")), "revision_ids": F.array(F.lit(1)), "revert_revision_ids": F.array(F.lit(1))}
        | {c: F.lit(1) for c in ("changed_word_count", "comment_count", "cleanup_comment_count")}
    )
    found = evidence.battles(stats, ["page_id"])
    assert "InPandas" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("page_id", "place").collect():
        got.setdefault(r["page_id"], []).append(r["segment"].rsplit(" ", 1)[0])
    assert got == {p: ["red house", "blue river", "green tree"] for p in range(50)}


def test_controversy_reranks(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "page_id long, peak_score double")
    found = spark.createDataFrame([(1, 5.0, 1, 0), (2, 0.0, 0, 0), (3, 5.0, 2, 0), (4, 5.0, 2, 1), (5, None, 0, 0)], "page_id long, score double, battles long, talk_evidence long")
    assert [(r["rank"], r["page_id"]) for r in evidence.rerank(rows, found, ["page_id"], 2).orderBy("rank").collect()] == [(1, 4), (2, 3)]
    assert evidence.rerank(rows, found, ["page_id"], 9).count() == 3


def test_payload(spark):
    page = spark.createDataFrame([(1, "T", "p"), (2, "U", "p")], "page_id long, page_title string, period string")
    found = spark.createDataFrame([(1, 2, "b", "swap", 3.0, 3, 3, 2), (1, 1, "a", "swap", 4.0, 3, 3, 2)], "page_id long, place int, segment string, change_type string, score double, changes long, reverts long, editors long")
    said = spark.createDataFrame([(1, 1, "U", "s.", ["t"])], "page_id long, place int, user string, sentence string, matched array<string>")
    scores = spark.createDataFrame([(1, 9.0, 5.0, 3.0, 1.0, 0.0, 2, 1)], "page_id long, score double, battle_score double, talk_score double, metadata_score double, cleanup_penalty double, battles long, talk_evidence long")
    got = {r["page_id"]: r for r in evidence.payload(page, found, said, scores, ["page_id"]).collect()}
    assert [x["segment"] for x in got[1]["segments"]] == ["a", "b"] and got[1]["talk"][0]["sentence"] == "s." and got[1]["controversy"]["score"] == 9.0
    assert got[2]["segments"] == [] and got[2]["controversy"] is None


def test_a_year_runs_on_over_its_months(spark):
    # Four reverts each way, but half of them on either side of midnight between two months.
    end = datetime(2024, 1, 31, 23, 0)
    rows = [("w", 1, "T", i, end + timedelta(minutes=8 * i), f"E{i % 2}", i % 2 == 0, i % 2 == 1, 100) for i in range(16)]
    edits = spark.createDataFrame(rows, "wiki string, page_id long, page_title string, rev_id long, ts timestamp, user_text string, is_reverted boolean, is_revert boolean, text_bytes long")
    edits = edits.withColumn("month", F.date_format("ts", "yyyy-MM"))
    edges = edits.where("rev_id >= 0").select("wiki", "page_id", "rev_id", "ts", F.col("user_text").alias("src"), F.when(F.col("user_text") == "E0", "E1").otherwise("E0").alias("dst"))
    records = pages.month_records(edits, edges)
    stored = {r["month"]: r for r in records.collect()}
    assert sorted(stored) == ["2024-01", "2024-02"] and sum(r["edit_count"] for r in stored.values()) == 16
    assert stored["2024-01"]["buckets"][0]["editors"] == {"E0": 4, "E1": 4}
    months = {r["month"]: r for r in pages.rescored(records).collect()}
    year = pages.year_rollup(records.withColumn("year", F.lit("2024"))).first()
    whole = pages.score_pages(edits, edges).first()
    assert year["revert_count"] == whole["revert_count"] == 16 and year["unique_editors"] == 2
    assert (year["peak_score"], year["episode_count"], year["candidate_score"]) == (whole["peak_score"], whole["episode_count"], whole["candidate_score"])
    assert all(r["peak_score"] < year["peak_score"] for r in months.values())


def test_stored_months_are_admitted(spark):
    rows = [("w", p, "T", p * 100 + i, START + timedelta(minutes=i), f"E{i}", False, False, 1) for p in (1, 2) for i in range(3)]
    edits = spark.createDataFrame(rows, "wiki string, page_id long, page_title string, rev_id long, ts timestamp, user_text string, is_reverted boolean, is_revert boolean, text_bytes long")
    edits = edits.withColumn("month", F.lit("2024-01")).withColumn("is_revert", F.col("page_id") == 2)
    edges = edits.limit(0).select("wiki", "page_id", "rev_id", "ts", F.lit("a").alias("src"), F.lit("b").alias("dst"))
    assert [r["page_id"] for r in pages.month_records(edits, edges).collect()] == [2]


def test_signals_by_page_and_title(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, None), (3, "c")], "page_id long, page_title string")
    admin = spark.createDataFrame([(1, 4)], "page_id long, restriction_count int")
    titles = spark.createDataFrame([("A_b", 2), ("c", 5)], "page_title string, protection_events int")
    got = {r["page_id"]: (r["restriction_count"], r["protection_events"]) for r in governance.with_signals(rows, admin, titles, ["page_id"]).collect()}
    assert got == {1: (4, 2), 2: (None, None), 3: (None, 5)}


def test_shards_by_brute_force(spark):
    rng = random.Random(1)
    for _ in range(4):
        shards = [(f"f{i}", a, a + rng.choice([0, 3, 30, 200])) for i, a in enumerate(rng.sample(range(1, 400), 25))] + [("f99", 17, 600)]
        got = {r["page_id"]: r["filename"] for r in lookups.shards_of(spark.range(-2, 700).withColumnRenamed("id", "page_id"), spark.createDataFrame(shards, "filename string, start_id long, end_id long")).collect()}
        want = {}
        for i in range(1, 700):
            held = sorted((a, f) for f, a, b in shards if a <= i <= b)
            if held:
                want[i] = held[0][1]
        assert got == want
    assert lookups.shards_of(spark.range(3).withColumnRenamed("id", "page_id"), spark.createDataFrame([], "filename string, start_id long, end_id long")).count() == 0


def test_sums_over_days_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), rng.randint(0, 9 * 86400) * 1_000_000, rng.randint(0, 3), i) for i in range(300)]
    rows += [(1, rows[0][1], 5, 900), (1, rows[0][1] + 3600 * 1_000_000, 1, 901)]
    df = spark.createDataFrame(rows, "k int, at long, n int, i int")
    got = {r["i"]: r["n"] for r in windows.trailing_sums(df, ["k"], 86400, ["n"]).collect()}
    assert got == {i: sum(n for k2, b, n, _ in rows if k2 == k and a - 86400 * 1_000_000 <= b <= a) for k, a, _, i in rows}


def test_talk_before_the_first_article_waits_for_it(spark):
    article = spark.createDataFrame([("w", "t", START + timedelta(hours=h), h, 10 + h) for h in (5, 9)], "wiki string, title string, ts timestamp, rev_id long, page_id long")
    said = spark.createDataFrame([("w", t, START + timedelta(hours=h), 100 + h) for t, h in (("t", 1), ("t", 2), ("t", 7), ("t", 9), ("u", 3))], "wiki string, title string, ts timestamp, rev_id long")
    assert {(r["rev_id"], r["article_id"]) for r in pages.talk_pages(article, said).collect()} == {(101, 15), (102, 15), (107, 15), (109, 19)}


def test_substantive_talk(spark):
    texts = ["RfC on this", "ok", "Reverted edits by X, see the RfC", " Undid revision 5", "rollback: RfC", "Automated RfC", None]
    got = [r["s"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.substantive_talk(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [True, False, False, False, False, False, False]


def test_two_episodes_in_one_batch():
    class State:
        exists = False

        def update(self, x):
            self.get, self.exists = x, True

    state = State()
    rows = pd.DataFrame([(START + timedelta(minutes=i), i, s, 1, 1) for i, s in enumerate([70.0, 30.0, 65.0, 50.0])], columns=["ts", "rev_id", "score", "reverts", "pairs"])
    out = pd.concat(live._episodes(("w", 1), iter([rows]), state))
    assert out[["episode", "status", "peak_score"]].values.tolist() == [[1, "ended", 70.0], [2, "active", 65.0]]
    more = pd.concat(live._episodes(("w", 1), iter([rows.iloc[1:2]]), state))
    assert more[["episode", "status"]].values.tolist() == [[2, "ended"]]


def feed(n, start=0):
    for i in itertools.count(start) if n is None else range(start, start + n):
        yield from (f"id: {i}", f'data: {{"i": {i}}}', "")


def test_an_endless_feed_gives_frames_as_they_come():
    assert [x[0] for x in itertools.islice(sse.frames(feed(None)), 3)] == ["0", "1", "2"]


def test_a_feed_is_opened_again_from_the_last_id():
    asked, waits = [], []

    def open_feed(last):
        asked.append(last)
        if len(asked) in (2, 3, 4):
            raise OSError("no")
        start = int(last) + 1 if last else 0
        yield from feed(2, start)
        if len(asked) == 5:
            raise OSError("broken")

    got = list(itertools.islice(sse.retried(open_feed, sleep=waits.append, most=3.0), 7))
    assert [x[0] for x in got] == [str(i) for i in range(7)] and asked == [None, "1", "1", "1", "1", "3", "5"]
    assert waits == [1.0, 2.0, 3.0, 1.0]

    def dead(last):
        raise OSError("gone")

    with pytest.raises(OSError):
        list(sse.retried(dead, sleep=waits.append, tries=3))


def test_landed_feed_streams(spark, tmp_path):
    folder = str(tmp_path / "feed")
    assert sse.land(sse.frames([*feed(5), ": hi", "data: no json", "", 'data: {"a":', "data: 1}", ""]), folder, frames_per_file=2) == 3
    want = [(str(i), f'{{"i": {i}}}') for i in range(5)] + [(None, '{"a":\n1}')]
    key = lambda x: (x[0] or "", x[1])
    assert sorted(((r["stream_id"], r["payload"]) for r in sse.landed(spark, folder, stream=False).collect()), key=key) == sorted(want, key=key)
    got = []
    run = lambda: sse.landed(spark, folder).writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    sse.land(sse.frames(feed(2, 9)), folder)
    run()
    assert sorted(((r["stream_id"], r["payload"]) for r in got), key=key) == sorted([*want, ("9", '{"i": 9}'), ("10", '{"i": 10}')], key=key)


def test_partitions_and_status(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a b", 1), ("c", 2)], "p string, k long")
    sinks.replace_partitions(rows, path, "p")
    sinks.replace_partitions(rows.limit(0), path, "p", only={"p": "a b"})
    assert [(r["p"], r["k"]) for r in spark.read.parquet(path).collect()] == [("c", 2)]
    assert sinks.holds(spark.read.parquet(path), p="c") and not sinks.holds(spark.read.parquet(path), p="a b")
    sinks.upsert_partition(spark.createDataFrame([("c", 3)], "p string, k long"), path, ["p", "k"], "p")
    assert spark.read.parquet(path).count() == 2 and [x.name for x in tmp_path.iterdir()] == ["t"]
    for n in (1, 2):
        sinks.write_status(spark, str(tmp_path / "s"), "job", done=n)
    assert [(r["job"], r["state"]) for r in sinks.status(spark, str(tmp_path / "s")).collect()] == [("job", '{"done": 2}')]
    listed = spark.createDataFrame([("x", "2020-01"), ("y", "2020-02"), ("z", "2020"), ("w", "2021")], "name string, partition string")
    names = lambda p: sorted(r["name"] for r in sinks.files_of(listed, p).collect())
    assert names("history:2026-05:2020-01") == ["x", "z"] and names("history-year:2026-05:2020") == ["x", "y", "z"]


def test_the_latest_board(spark):
    rows = spark.createDataFrame([("2024-01", 1, 5), ("2024-02", 2, 6), ("2024-02", 1, 7)], "period string, rank int, page_id long")
    assert [r["page_id"] for r in serving.historical_board(rows).collect()] == [7, 6]
    assert [r["page_id"] for r in serving.historical_board(rows, "2024-01").collect()] == [5] and serving.historical_board(rows.limit(0)).count() == 0
    assert serving.latest_period(rows) == "2024-02"


def test_identity_edges_still_feed_the_graph(spark):
    h = spark.createDataFrame([("w", 1, i, START + timedelta(minutes=i), f"E{i % 2}", i + 1 if i < 9 else None) for i in range(10)], "wiki string, page_id long, rev_id long, ts timestamp, user_text string, first_reverting long")
    assert graph.identity_edges(h).count() == 9


@pytest.mark.parametrize("name", ["controversy", "talk_evidence"])
def test_phrases_are_chosen_once(spark, name):
    # What is said asks for a page's terms more than once: a written table tells them.
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "InPandas" not in plan
