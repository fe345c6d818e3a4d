"""Hard-negative mining by a secondary-sort shuffle.

Anchors stand in blocks, rows in stripes; a block meets a stripe as a stream, and keeps, for each anchor, the few
best rows in each window of scores. First those of the same label, which gives the positives; then
those of other labels, in the window that each positive opens. What the stripes keep goes, with the key (anchor, descending score,
id), through one shuffle that sorts within partitions; an iterator reads an anchor's rows as they come, opens a
window at each positive, and emits the negatives that fall into open windows. It holds one anchor's
open windows, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import cut, quoted, release, table
from .topk_search import usable

#: Anchors of a block, and rows of a stripe, at least and at most: a task holds a block with its windows; a stripe streams by.
BLOCK, STRIPE, LONGEST = 8192, 2048, 1 << 20
#: Meetings of a block with a stripe that give a cluster work enough, where there are rows enough.
MEETINGS = 96
#: Scores held at once.
SCORES = 1 << 21
NONE = np.iinfo(np.int64).min


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class BestInWindows:
    """Of the rows seen so far, the k best in each window of scores of each anchor of a block: by score descending, then id, then row."""

    def __init__(self, anchors: pa.Table, k: int, same: bool) -> None:
        self.k, self.same = k, same
        self.row, self.label = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        self.v = _matrix(anchors.column("v"))
        low, high = anchors.column("low").combine_chunks(), anchors.column("high").combine_chunks()
        # Anchors have up to `wide` windows; those they lack hold nothing.
        ends = low.offsets.to_numpy()
        held = np.diff(ends)
        wide = max(1, int(held.max()))
        self.low, self.high = np.full((len(held), wide), np.iinfo(np.int64).max), np.full((len(held), wide), NONE)
        at = np.repeat(np.arange(len(held)), held), np.arange(len(low.flatten())) - np.repeat(ends[:-1] - ends[0], held)
        self.low[at], self.high[at] = low.flatten().to_numpy(), high.flatten().to_numpy()
        self.best = [np.full((len(held), wide, k), NONE, dtype=np.int64) for _ in range(3)]  # score, id, row
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", self.v.astype(np.float64), self.v.astype(np.float64)).max()))

    def see(self, rows: pa.Table) -> None:
        c, label, ids, row = _matrix(rows.column("v")), *(rows.column(x).to_numpy() for x in ("label", "id", "row"))
        most = self.norm * float(np.sqrt(np.einsum("ij,ij->i", c.astype(np.float64), c.astype(np.float64)).max()))
        # Sums of products of whole numbers are exact in a float type while they stay under its mantissa.
        kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
        v, c = self.v.astype(kind), c.astype(kind)
        step = max(1, SCORES // len(v))
        for i in range(0, len(c), step):
            scores = (v @ c[i : i + step].T).astype(np.int64)
            met = (self.label[:, None] == label[None, i : i + step]) == self.same
            if self.same:
                met &= self.row[:, None] != row[None, i : i + step]
            for w in range(self.low.shape[1]):
                # What is under the k-th score so far can't get in; what equals it may have a smaller id.
                least = np.maximum(self.low[:, w], self.best[0][:, w, -1])
                a, b = np.nonzero(met & (scores >= least[:, None]) & (scores <= self.high[:, w][:, None]))
                if len(a):
                    self._merge(w, a, scores[a, b], ids[i + b], row[i + b])

    def _merge(self, w: int, a: np.ndarray, *new: np.ndarray) -> None:
        own = np.unique(a)
        held = [x[own, w].reshape(-1) for x in self.best]
        a = np.concatenate((np.repeat(own, self.k), a))
        score, ids, row = (np.concatenate(x) for x in zip(held, new, strict=True))
        order = np.lexsort((row, ids, ~score, a))  # ~score falls as score rises, and has no overflow
        a = a[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < self.k
        for x, y in zip(self.best, (score, ids, row), strict=True):
            x[a[top], w, place[top]] = y[order][top]

    def kept(self) -> pa.Table:
        """Each row kept once for its anchor, however many windows hold it."""
        a, w, k = np.nonzero(self.best[0] > NONE)
        found = np.unique(np.stack((self.row[a], *(x[a, w, k] for x in self.best))), axis=1)
        return pa.table(dict(zip(("anchor", "score", "id", "row"), found, strict=True)))


def _meet(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor (row), score, id, row: for each stripe, the k best of each window (low to high) of each anchor, of the same label or of others. Vectors meet those of their own length.

    anchors: row, id, label, dim, v, low, high. rows: row, id, label, dim, v."""
    ship_package(rows.sparkSession)
    # Anchors meet rows of their own label in blocks of one label, or else of any.
    part = ["dim", "label"] if same else ["dim"]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("held")).join(anchors.groupBy(*part).agg(F.count("*").alias("asked")), part)
    blocks = F.ceil(F.col("asked") / BLOCK)
    stripes = F.greatest(F.ceil(F.col("held") / LONGEST), F.least(F.ceil(F.col("held") / STRIPE), F.ceil(F.lit(MEETINGS) / blocks)))
    # A row a length and label.
    sizes = cut(sizes.select(*part, blocks.cast("int").alias("blocks"), stripes.cast("int").alias("stripes")), "meetings")
    meetings = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("stripes")).alias("n")).first()["n"] or 1
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, none = [*part, "block", "stripe"], F.lit(None).cast("array<bigint>")
    asked = anchors.join(sizes, part).withColumn("block", own("row", "blocks")).withColumn("stripe", every("stripes")).withColumn("kind", F.lit(0))
    met = rows.withColumns({"low": none, "high": none}).join(sizes, part).withColumn("stripe", own("row", "stripes")).withColumn("block", every("blocks")).withColumn("kind", F.lit(1))
    cols = ["kind", "row", "id", "label", "dim", "v", "low", "high"]
    both = asked.select(F.xxhash64(*key).alias("key"), *cols).unionByName(met.select(F.xxhash64(*key).alias("key"), *cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, best = None, [], None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            ends = np.flatnonzero(np.diff(keys)) + 1
            for begin, end in zip((0, *ends), (*ends, len(keys)), strict=True):
                own = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if keys[begin] != at:
                    if best:
                        yield from best.kept().to_batches()
                    at, first, best = keys[begin], [], None
                kind = own.column("kind").to_numpy()
                asked = int((kind == 0).sum())  # anchors come first
                if asked:
                    first.append(own.slice(0, asked))
                if asked < len(kind):
                    best = best or BestInWindows(pa.concat_tables(first).combine_chunks(), k, same)
                    first = []
                    best.see(own.slice(asked))
        if best:
            yield from best.kept().to_batches()
        release()

    # More tasks than meetings, since hashes of keys put several into one.
    dealt = both.repartition(max(1, min(2 * int(meetings), 100_000)), "key").sortWithinPartitions("key", "kind")
    return dealt.mapInArrow(run, "anchor long, score long, id long, row long")


def _stream(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor_row, anchor_id, score, kind, id), sorted by anchor, score descending, kind (0: same label), id: each positive opens its window, each negative goes into those open."""
    anchor, opened = None, []
    for batch in batches:
        out: list[tuple] = []
        for a, name, score, kind, i in zip(*(batch.column(x).to_pylist() for x in ("anchor", "anchor_id", "score", "kind", "id")), strict=True):
            if a != anchor:
                anchor, opened, seen = a, [], 0
            if kind == 0:
                if seen < positives:
                    seen += 1
                    opened.append([i, score, 0])
                continue
            for window in opened:
                positive, p, n = window
                if n < negatives and low * p <= 100 * score <= high * p:
                    window[2] = n + 1
                    out.append((name, positive, n + 1, i, p, score))
            # A window that is full, or that scores have fallen out of, is closed.
            opened = [w for w in opened if w[2] < negatives and (100 * score >= low * w[1])]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, is_anchor: Column | None = None, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); the score is the integer inner product with the anchor; higher ones come first, ties go to the smaller id, then
    to the row that was read first. An anchor's positives are its first `positives` other rows of its label; of each, the first `negatives` rows of other labels are returned whose
    score is `low` to `high` per cent of the positive's (so none for a positive below zero). is_anchor is a condition on the columns of vectors, by default an id
    that 100 divides; label is an expression, by default the column label. Rows with a null id or label, or a vector that is null, empty or holds null or
    non-finite components take no part; vectors meet those of their own length. Rows that repeat an id are rows of their own: anchors each, with a list each, and positives and negatives
    of each other. Products beyond 2^63 are not defined. An empty table gives an empty one. Only the named columns are read."""
    cond = quoted(id_col) % 100 == 0 if is_anchor is None else is_anchor
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("x"), (quoted("label") if label is None else label).alias("label"), F.coalesce(cond, F.lit(False)).alias("asked"))
    rows = rows.where(usable(F.col("x")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    v = F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    # Labels are compared alone: a hash of 64 bits stands for one of any type, a whole number for itself.
    name = F.col("label").cast("long") if rows.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("label")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", name.alias("label"), F.size("x").alias("dim"), v.alias("v"), "asked"), "vectors")
    anchors, rows = rows.where("asked").drop("asked"), rows.drop("asked")
    bounds = [F.array(F.lit(x).cast("long")) for x in (NONE + 1, -(NONE + 1))]
    near = _meet(anchors.withColumns({"low": bounds[0], "high": bounds[1]}), rows, positives, same=True)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    near = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")
    # Whole scores of a window's ends: the least and the largest n with low * p <= 100 * n <= high * p.
    part = lambda p, share, off: F.call_function("div", p, F.lit(100)) * share + off(p % 100 * share / 100).cast("long")
    ends = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("p")).select(
        "row", F.transform("p", lambda p: part(p, low, F.ceil)).alias("low"), F.transform("p", lambda p: part(p, high, F.floor)).alias("high")
    )
    far = _meet(anchors.join(ends, "row"), rows, negatives, same=False)
    # The secondary sort: what the stripes kept of an anchor comes to one task, in order.
    keyed = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1))).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    keyed = keyed.select("anchor", "anchor_id", "score", "kind", "id", "row").repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id", "row")
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return keyed.mapInArrow(lambda batches: _stream(batches, positives, negatives, low, high), names)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, label=label)


ORACLE = r"""
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM good a JOIN good c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT * FROM ranked WHERE rank <= 10
"""
