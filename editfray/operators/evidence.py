"""Contested phrases of pages, the debate on their talk pages, and the controversy they add up to."""

from __future__ import annotations


from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import patterns as P
from ..functions.diff import Side, added, changed
from ..functions.entities import bound
from ..functions.scores import battle_score
from ..functions.text import clean_comment, clean_wikitext, first_sentence, first_shot, is_cleanup, is_graffiti, is_revert_like, normal, talk_sentences
from ..shipping import ship_package
from ..tables import cut
from .evidence_rows import chosen
from .lookups import adjacent

_TEXTS = ("segment", "changed_text", "highlight_before", "highlight_after", "context_before", "context_after", "change_type")
#: Texts of a page that are held, in case a revert brings them back.
KEPT = 4
SEGMENT = ", ".join(f"{c}: string" for c in (*_TEXTS, "key")) + ", swap_values: array<string>, changed_word_count: long"


def _aligned(rows: DataFrame, by: list[str], names: list[str], ends: bool) -> DataFrame:
    """Rows as they stand sorted, each with the changes (found) from the one before it that has the same `by`, and whose user and comment that has. A revision's text is cleaned
    once, for all its pairs, and no more than KEPT texts are held at a time.

    With `ends`, the first and the last of a group keep their content, and say so in `end` (1, 2; 3 for both): what stands beside the next group. Without, only the first ones of
    groups (end 1 and 3) are aligned, and none keeps it."""
    kept = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.schema if f.name in names])
    found_type, out_names = to_arrow_type(T.ArrayType(T._parse_datatype_string(f"struct<{SEGMENT}>"))), [*names, "prev_user", "prev_comment", "found", "content", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row before: its key, text, user and comment, and the batch and place of the output it still lacks an end in.
        key, before, user, comment = None, None, None, None
        late: list | None = None
        # The last texts of a group, and what changed between them: a text that a revert brings back isn't taken apart again.
        sides: dict[str | None, Side] = {}
        known: dict[tuple, list[dict]] = {}

        def side_of(text: str | None) -> Side:
            sides[text] = sides.pop(text) if text in sides else Side(text)
            return sides[text]

        def changes_of(old: str | None, new: str | None) -> list[dict]:
            if (old, new) not in known:
                known[old, new] = changed(side_of(old), side_of(new))
                while len(sides) > KEPT:
                    gone = next(iter(sides))
                    del sides[gone]
                    for pair in [p for p in known if gone in p]:
                        del known[pair]
            return known[old, new]

        def batch_of(lines: list) -> pa.RecordBatch:
            columns = list(zip(*lines, strict=True))
            arrays = [pa.array(c, kept.field(n).type) for n, c in zip(names, columns, strict=False)]
            arrays += [pa.array(c, t) for c, t in zip(columns[len(names) :], (pa.string(), pa.string(), found_type, pa.string(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, out_names)

        def full(line: list) -> bool:
            return bool(line[-3]) or line[-1] > 0

        for batch in batches:
            out: list[list] = []
            columns = {n: batch.column(n).to_pylist() for n in {*names, *by, "content", *(() if ends else ("end",))}}
            for k in range(batch.num_rows):
                now = tuple(columns[c][k] for c in by)
                begins, content = now != key, columns["content"][k]
                wanted = not begins and (ends or columns["end"][k] in (1, 3))
                if begins:
                    sides, known = {}, {}
                line = [*(columns[c][k] for c in names), user if wanted else None, comment if wanted else None, changes_of(before, content) if wanted else [], content if ends else None, int(ends and begins)]
                if late is not None:
                    if ends and begins:
                        late[-1] += 2
                    if late[-1] == 0:
                        late[-2] = None
                    if full(late):
                        out.append(late)
                key, before, user, comment, late = now, content, columns["user_text"][k], columns["comment"][k], line
                if len(out) >= 200:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
        if late is not None:
            late[-1] += 2 * ends
            if full(late):
                yield batch_of([late])

    fields = [rows.schema[n] for n in names]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in ("prev_user", "prev_comment")), T.StructField("found", T.ArrayType(T._parse_datatype_string(f"struct<{SEGMENT}>"))), T.StructField("content", T.StringType()), T.StructField("end", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def pair_segments(revisions: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """revisions: keys, order (a time first), rev_id, user_text, comment, tags, content. A row for each change of each adjacent pair, with its place.

    A page's revisions stream, sorted, through a task for each of its years: each text is shuffled once, and aligned with the one before it. What stands at the ends of years
    meets in a second pass over these rows alone, of pages with several years."""
    ship_package(revisions.sparkSession)
    rest = [c for c in order if c not in keys]
    names = [*keys, *rest, *[c for c in ("rev_id", "user_text", "comment") if c not in (*keys, *rest)], "is_revert"]
    rows = revisions.withColumn("is_revert", is_revert_like(F.col("tags"), F.col("comment"))).select(*names, "content", F.year(order[0]).alias("__year"))
    dealt = rows.repartition(*keys, "__year").sortWithinPartitions(*keys, "__year", *order)
    within = cut(_aligned(dealt, [*keys, "__year"], names, ends=True), "aligned")
    several = cut(within.where("end IN (1, 3)").groupBy(*keys).count().where("count > 1").select(*keys), "several")
    ends = within.where("end > 0").drop("found", "prev_user", "prev_comment").join(several, keys, "left_semi")
    across = _aligned(ends.repartition(*keys).sortWithinPartitions(*keys, *order), keys, names, ends=False)
    found = within.where("size(found) > 0").unionByName(across)
    return found.select(*keys, *rest, *[c for c in ("rev_id", "user_text", "comment") if c not in (*keys, *rest)], "is_revert", "prev_user", "prev_comment", F.posexplode("found").alias("pos", "s")).select("*", "s.*").drop("s")


def segment_stats(found: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Counts and first values of each phrase of a page; phrases of three changes or three reverts, and a score, stay.

    Of change types as frequent and as early, as repeated rows make them, the first by name is taken."""
    rows = found.withColumn("ord", F.struct(*order, "pos")).withColumn("shot", first_shot(F.when(F.col("is_revert"), F.col("prev_comment")).otherwise(F.col("comment"))))
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    first = lambda c: F.coalesce(F.min_by(F.when(given(c), F.col(c)), F.when(given(c), F.col("ord"))), F.lit("")).alias(c)
    comments = sum((given(c).cast("int") for c in ("prev_comment", "comment")), F.lit(0))
    cleanups = sum(((given(c) & is_cleanup(F.col(c))).cast("int") for c in ("prev_comment", "comment")), F.lit(0))
    by = [*keys, "key"]
    types = rows.groupBy(*by, "change_type").agg(F.count("*").alias("n"), F.min("ord").alias("o")).groupBy(*by).agg(F.min_by("change_type", F.struct(-F.col("n"), F.col("o"), F.col("change_type"))).alias("change_type"))
    swaps = rows.select(*by, "ord", F.posexplode("swap_values").alias("i", "v")).groupBy(*by, "v").agg(F.count("*").alias("n"), F.min(F.struct("ord", "i")).alias("o"))
    swaps = swaps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "o", "v"))).alias("s")).select(*by, F.transform("s", lambda x: x["v"]).alias("swap_values"))
    users = F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(F.col("user_text"), F.when(F.col("is_revert") & (F.col("prev_user") != F.col("user_text")), F.col("prev_user"))), lambda u: u.isNotNull() & (u != "")))))
    stats = rows.groupBy(*by).agg(
        *[first(c) for c in _TEXTS[:-1]], first("shot"), F.max("changed_word_count").alias("changed_word_count"), F.count("*").alias("changes"), F.count_if("is_revert").alias("reverts"),
        F.sum(comments).alias("comment_count"), F.sum(cleanups).alias("cleanup_comment_count"), users.alias("editor_names"), F.collect_set("rev_id").alias("revision_ids"),
        F.collect_set(F.when(F.col("is_revert"), F.col("rev_id"))).alias("revert_revision_ids"), F.min("ord").alias("first_ord"),
    )
    out = stats.withColumnRenamed("shot", "first_shot_comment").where("changes >= 3 OR reverts >= 3").join(types, by).join(swaps, by, "left").withColumn("editors", F.size("editor_names").cast("long"))
    out = out.withColumn("swap_values", F.coalesce("swap_values", F.array().cast("array<string>")))
    return out.withColumn("score", battle_score(F.col("changes"), F.col("reverts"), F.col("editors"), F.col("changed_word_count"), F.col("change_type"))).where("score > 0")


def battles(stats: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The `limit` best phrases of each page that don't overlap; phrases reverted together are one.

    Greedy in the order of score, so one page is held at a time, of those that stream sorted through a task; what reaches it are phrases of three changes and more."""
    ship_package(stats.sparkSession)
    numbers = ["score", "changes", "reverts", "editors", "changed_word_count", "comment_count", "cleanup_comment_count"]
    names = [*keys, "place", "segment", "changed_text", "change_type", "swap_values", "first_shot_comment", *numbers, "group_size"]
    kinds = {c.name: c.dataType.simpleString() for c in stats.schema} | {"place": "int", "group_size": "int", "score": "double"}
    order = F.struct(*[(-F.col(c)).alias(c) for c in ("score", "reverts", "changes", "editors")], "first_ord")
    rows = stats.repartition(*keys).sortWithinPartitions(*keys, order).drop("first_ord")
    schema = T._parse_datatype_string(", ".join(f"`{c}` {kinds[c]}" for c in names))
    found_type = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in batch.to_pylist())
        out: list[dict] = []
        for _, page in groupby(lines, lambda x: tuple(x[k] for k in keys)):
            out += chosen(list(page), limit)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, found_type)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, found_type)

    found = rows.mapInArrow(run, schema)
    merged = battle_score(F.col("changes"), F.col("reverts"), F.col("editors"), F.col("changed_word_count"), F.col("change_type"))
    return found.withColumn("score", F.when(F.col("group_size") > 1, merged).otherwise(F.col("score")))


def usable(found: DataFrame) -> DataFrame:
    text = F.when(F.coalesce("changed_text", F.lit("")) != "", F.col("changed_text")).otherwise(F.col("segment"))
    return found.where("editors >= 2 AND (reverts >= 3 OR changes >= 3)").where(~is_graffiti(text))


def terms(found: DataFrame, keys: list[str]) -> DataFrame:
    """Up to 18 distinct terms of a page's five first phrases, of four characters or more."""
    own = F.concat(F.coalesce("swap_values", F.array().cast("array<string>")), F.array("changed_text", "segment"))
    clean = F.transform(own, lambda t: F.btrim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"(?U)\s+", " ")))
    lists = found.where("place <= 5").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", clean.alias("t")))).alias("l"))
    flat = F.array_distinct(F.flatten(F.transform("l", lambda x: x["t"])))
    good = F.filter(flat, lambda t: (F.char_length(t) >= 4) & ~t.isin("this", "that", "with", "from", "have"))
    return lists.select(*keys, F.slice(good, 1, 18).alias("terms"))


def disputes(sentences: Column, comment: Column, own: Column) -> Column:
    """array of struct(sentence, matched, key): of sentences said under a comment, those of a dispute: by its words, or by those of sources with a term of the page."""
    said = lambda x: normal(F.concat_ws(" ", comment, x))
    matched = lambda x: F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda t: (t != "") & F.contains(said(x), t))
    every = F.transform(F.filter(sentences, lambda x: x != ""), lambda x: F.struct(x.alias("sentence"), F.slice(matched(x), 1, 5).alias("matched"), normal(x).alias("key"), said(x).alias("said")))
    return F.filter(every, lambda d: d["said"].rlike(P.STRONG_DEBATE) | (d["said"].rlike(P.SOURCE_DEBATE) & (F.size(d["matched"]) > 0)))


def first_unseen(hits: DataFrame, keys: list[str], order: tuple[str, ...], most: int = 5) -> DataFrame:
    """keys, x (user, sentence, matched), place: revision after revision the first disputed sentence that none before it gave, `most` of a page.

    hits: keys, order, user, pos, key, sentence, matched. What a page's choice can look at is bounded before it meets: the revision after which `most` have brought
    a sentence of their own is the last that counts, and no sentence counts more than `most` times."""
    by_key, by_page = Window.partitionBy(*keys, "key").orderBy(*order, "pos"), Window.partitionBy(*keys).orderBy(*order)
    once = hits.dropDuplicates([*keys, *order, "key"])
    rows = once.withColumn("again", F.row_number().over(by_key)).where(F.col("again") <= most)
    fresh = rows.where("again = 1").select(*keys, *order).distinct().withColumn("n", F.row_number().over(by_page)).where(F.col("n") <= most)
    upto = fresh.where(F.col("n") == most).select(*keys, F.struct(*order).alias("upto"))
    near = rows.join(upto, keys, "left").where(F.col("upto").isNull() | (F.struct(*order) <= F.col("upto")))
    one = near.groupBy(*keys, *order).agg(F.min("user").alias("user"), F.sort_array(F.collect_list(F.struct("pos", "key", "sentence", "matched"))).alias("all"))
    page = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "user", "all"))).alias("revisions"))
    kind = "array<struct<user: string, sentence: string, matched: array<string>, key: string>>"

    def take(chosen, r):
        new = F.filter(r["all"], lambda x: ~F.array_contains(F.transform(chosen, lambda c: c["key"]), x["key"]))
        given = F.transform(F.slice(new, 1, 1), lambda x: F.struct(F.coalesce(r["user"], F.lit("")).alias("user"), x["sentence"].alias("sentence"), x["matched"].alias("matched"), x["key"].alias("key")))
        return F.when(F.size(chosen) < most, F.concat(chosen, given)).otherwise(chosen)

    chosen = F.aggregate("revisions", F.array().cast(kind), take)
    return page.select(*keys, F.posexplode(chosen).alias("p", "x")).select(*keys, (F.col("p") + 1).alias("place"), "x")


def talk_evidence(talk: DataFrame, page_terms: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts", "rev_id")) -> DataFrame:
    """keys, place, user, sentence, matched: up to five disputes of a talk page, one a revision at most; of pages without, up to three from the last text.

    Python decodes entities and aligns lists of sentences, in Arrow batches; texts are cut into sentences once, and
    only sentences meet those of the revision before."""
    ship_package(talk.sparkSession)

    @F.pandas_udf("array<int>")
    def places(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([added(list(a), list(b)) for a, b in zip(before, after, strict=True)])

    by = Window.partitionBy(*keys).orderBy(*order)
    c = clean_comment(F.col("comment"))
    rows = talk.select(*keys, *[x for x in order if x not in keys], "user_text", c.alias("said"), first_sentence(F.col("comment")).alias("spare"), bound(clean_wikitext(F.col("content")), talk_sentences).alias("sentences"))
    rows = cut(rows, "talk")
    rows = rows.withColumn("before", F.coalesce(F.lag("sentences").over(by), F.array().cast("array<string>"))).withColumn("is_last", F.lead(order[-1]).over(by).isNull()).join(page_terms, keys, "left")
    new = F.transform(places(F.transform("before", normal), F.transform("sentences", normal)), lambda i: F.get("sentences", i))
    rows = rows.withColumn("new", new).withColumn("new", F.when((F.size("new") == 0) & (F.col("said") != ""), F.array("spare")).otherwise(F.col("new")))
    found = rows.withColumn("d", disputes(F.col("new"), F.col("said"), F.col("terms"))).where(F.size("d") > 0)
    hits = found.select(*keys, *[x for x in order if x not in keys], F.col("user_text").alias("user"), F.posexplode("d").alias("pos", "d")).select("*", "d.key", "d.sentence", "d.matched").drop("d")
    chosen = first_unseen(hits, keys, order).select(*keys, "place", "x.user", "x.sentence", "x.matched")
    rest = rows.where("is_last").join(found.select(*keys).distinct(), keys, "left_anti").withColumn("d", disputes(F.col("sentences"), F.lit(None).cast("string"), F.col("terms")))
    # The first of each repeat, three at most.
    once = F.filter("d", lambda x, i: F.array_position(F.transform("d", lambda y: y["key"]), x["key"]) == i + 1)
    rest = rest.select(*keys, F.posexplode(F.slice(once, 1, 3)).alias("p", "x"))
    return chosen.unionByName(rest.select(*keys, (F.col("p") + 1).alias("place"), F.lit("").alias("user"), "x.sentence", "x.matched"))


def talk_scores(evidence: DataFrame, keys: list[str]) -> DataFrame:
    users = F.count_distinct(F.when(F.col("user") != "", F.col("user")))
    total = F.least(F.lit(35.0), users * 7.0) + F.sum(F.lit(24.0) + F.when(F.size("matched") > 0, 18.0).otherwise(0.0))
    return evidence.groupBy(*keys).agg(F.round(F.least(F.lit(160.0), total), 2).alias("talk_score"), F.count("*").alias("talk_evidence"))


def controversy(pages: DataFrame, found: DataFrame, talk: DataFrame, keys: list[str]) -> DataFrame:
    """pages: keys, peak_score, revert_count, mutual_revert_pairs; found: usable battles with place; talk: talk_scores()."""
    weight = F.when(F.col("place") == 1, 1.0).when(F.col("place") == 2, 0.55).when(F.col("place") == 3, 0.25).otherwise(0.0)
    by_page = found.groupBy(*keys).agg(
        F.sum(weight * F.col("score") * F.when(F.col("change_type") == "swap", 1.18).otherwise(1.0)).alias("battle"), F.count("*").alias("battles"),
        (F.sum("cleanup_comment_count") / F.nullif(F.sum("comment_count"), F.lit(0))).alias("cleanup_share"),
    )
    rows = pages.join(by_page, keys, "left").join(talk, keys, "left").fillna(0, ["battle", "battles", "cleanup_share", "talk_score", "talk_evidence"])
    share, t, battle = F.col("cleanup_share"), F.col("talk_score"), F.col("battle")
    meta = F.least(F.lit(35.0), F.sqrt(F.greatest(F.lit(0.0), "peak_score")) * 1.35) + F.least(F.lit(15.0), F.sqrt(F.col("revert_count").cast("double")) * 0.75) + F.least(F.lit(10.0), F.greatest(F.lit(0), F.col("mutual_revert_pairs") - 1) * 4.0)
    penalty = F.when((share >= 0.7) & (t < 20), battle * 0.9).when((share >= 0.45) & (t < 35), battle * 0.5).otherwise(0.0)
    score = (battle - penalty) * (F.lit(1.0) + F.least(F.lit(0.75), t / 160)) + t * 2.2 + meta
    score = F.when((share >= 0.7) & (t < 20), F.least(score, F.lit(25.0))).otherwise(score)
    score = F.when((F.col("battles") == 1) & (t < 20), F.least(score, battle * 0.18 + meta)).otherwise(score)
    some = F.col("battles") > 0
    out = {"score": score, "battle_score": battle, "metadata_score": meta, "cleanup_penalty": penalty}
    return rows.select(*keys, "battles", "talk_evidence", "talk_score", *[F.when(some, F.round(F.greatest(F.lit(0.0), x), 2)).otherwise(0.0).alias(name) for name, x in out.items()])


def positive(rows: DataFrame, score: str = "controversy_score") -> DataFrame:
    return rows.where(F.coalesce(score, F.lit(0.0)) > 0)


def rerank(rows: DataFrame, found: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first `limit` rows (keys, peak_score) that have a controversy, ranked by it; found: controversy()."""
    order = [F.desc(c) for c in ("controversy_score", "battle_count", "talk_evidence_count", "peak_score")] + [F.col(k) for k in keys]
    fields = found.select(*keys, F.col("score").alias("controversy_score"), F.col("battles").alias("battle_count"), F.col("talk_evidence").alias("talk_evidence_count"))
    first = positive(rows.join(fields, keys)).orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def payload(pages: DataFrame, found: DataFrame, talk: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """A row a page with its evidence as a dashboard takes it: pages (keys, page_title, period), its usable battles and disputes as lists, and its scores."""
    segments = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "segment", "change_type", "score", "changes", "reverts", "editors"))).alias("segments"))
    said = talk.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "user", "sentence", "matched"))).alias("talk"))
    rows = pages.join(segments, keys, "left").join(said, keys, "left").join(scores.select(*keys, F.struct("score", "battle_score", "talk_score", "metadata_score", "cleanup_penalty", "battles", "talk_evidence").alias("controversy")), keys, "left")
    return rows.withColumns({c: F.coalesce(c, F.array()) for c in ("segments", "talk")})
