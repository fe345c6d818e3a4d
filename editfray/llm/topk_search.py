"""Exact top-k search by pivot-table elimination.

Every vector's distances to the same pivots are computed once. By the triangle
inequality, the largest |d(q, p) - d(c, p)| over pivots p is a lower bound of d(q, c), and
so (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of the inner product. Rows go to
the cell of their nearest pivot, cells to blocks, and neighbours in a block to small runs that share
the intervals of their distances, so that one bound stands for a run. A block of queries meets its
own cells first, which gives each query a k-th score; then only blocks whose
bound reaches the least of those. In a block, runs are evaluated in the order of their bounds until the
next bound is under every query's k-th score. Tops of blocks are merged by a partial top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, drop_cut, quoted, table

PIVOTS = 64
#: Rows of a block of queries and of candidates; of a run of candidates; queries that share the order of runs.
BLOCK, RUN, BATCH = 16384, 64, 64
#: Parts that pairs of blocks are bounded in.
PARTS = 64
#: Runs evaluated before the first look at k-th scores.
FIRST = 16


def usable(vector):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(np.maximum(_norms(x)[:, None] + _norms(pivots)[None, :] - 2 * (x @ pivots.T), 0))


def _slack(*norms: float) -> float:
    """More than what rounding can add to squares of distances."""
    return 1e-9 * sum(norms) + 1e-6


def _with_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with cell, their nearest pivot, by the pivots of their length."""

    def make():
        def f(batch):
            size, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                cell[at] = _far(_matrix(batch.column("v").take(pa.array(at))).astype(np.float64), pivots[int(dim)]).argmin(axis=1)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        return f

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema)
    return arrow_map(rows, make, schema + ", cell int")


def _intervals(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """block, dim, norm (largest square), low and high (of the distances to each pivot): what a block's bound takes."""

    def make():
        def f(batch):
            block, size = batch.column("block").to_numpy(), batch.column("dim").to_numpy()
            out = []
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                dim = int(size[at[0]])
                x = _matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                far = _far(x, pivots[dim])
                out.append((b, dim, _norms(x).max(), far.min(axis=0), far.max(axis=0)))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "dim", "norm", "low", "high"])

        return f

    found = arrow_map(rows.select("block", "dim", "v"), make, "block long, dim int, norm double, low array<double>, high array<double>")
    # One row a batch and block: minima and maxima by place.
    flat = found.select("block", "dim", "norm", F.posexplode(F.arrays_zip("low", "high")).alias("p", "x"))
    by_pivot = flat.groupBy("block", "dim", "p").agg(F.max("norm").alias("norm"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    lists = by_pivot.groupBy("block", "dim").agg(F.max("norm").alias("norm"), F.sort_array(F.collect_list(F.struct("p", "low", "high"))).alias("l"))
    return lists.select("block", "dim", "norm", F.transform("l", lambda x: x["low"]).alias("low"), F.transform("l", lambda x: x["high"]).alias("high"))


def _tops(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the places of the k best in order, ties to the smaller id, and their scores."""
    n = scores.shape[1]
    by_id = np.argsort(ids, kind="stable")
    ordered = scores[:, by_id]
    if n > k and np.abs(ordered, where=ordered > -np.inf, out=np.zeros_like(ordered)).max() < 2.0 ** 52 / n:
        # A score above its place is one number, and exact: no two are alike.
        keys = np.where(ordered > -np.inf, ordered * n - np.arange(n), -np.inf)
        places = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        places = np.take_along_axis(places, np.argsort(-np.take_along_axis(keys, places, axis=1), axis=1, kind="stable"), axis=1)
    else:
        places = np.argsort(-ordered, axis=1, kind="stable")[:, :k]
    return by_id[places], np.take_along_axis(ordered, places, axis=1)


def _merged(held: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of scores and ids in each row."""
    scores, ids = (np.concatenate(x, axis=1) for x in zip(held, new, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def block_tops(queries: pa.Table, rows: pa.Table, k: int, pivots: np.ndarray) -> pa.Table:
    """The k best candidates of each query in one block that can still be among its k best of all (queries carry least, a score that k others reach)."""
    c_id, c_row, c = rows.column("id").to_numpy(), rows.column("row").to_numpy(), _matrix(rows.column("v"))
    q_id, q_row, q, least = queries.column("id").to_numpy(), queries.column("row").to_numpy(), _matrix(queries.column("v")), queries.column("least").to_numpy()
    far, q_far = _far(c.astype(np.float64), pivots), _far(q.astype(np.float64), pivots)
    order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
    c_id, c_row, c, far = c_id[order], c_row[order], c[order], far[order]
    norms, q_norms = _norms(c.astype(np.float64)), _norms(q.astype(np.float64))
    # Sums of products of integers are exact in a float type while they stay under its mantissa.
    most = float(np.sqrt(q_norms.max() * norms.max()))
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    whole = kind == np.int64
    none = np.iinfo(np.int64).min + 1 if whole else -np.inf
    if whole:  # no double holds the k-th scores of other blocks
        least = np.full(len(q_id), -np.inf)
    starts = np.arange(0, len(c), RUN)
    low, high, norm = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts), np.maximum.reduceat(norms, starts)
    slack = _slack(q_norms.max(), norms.max())
    alike = np.argsort(q_far.argmin(axis=1), kind="stable")
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(0, len(alike), BATCH):
        own = alike[i : i + BATCH]
        apart = np.zeros((len(own), len(starts)))
        for p in range(len(pivots)):
            d = q_far[own, p][:, None]
            np.maximum(apart, low[None, :, p] - d, out=apart)
            np.maximum(apart, d - high[None, :, p], out=apart)
        bound = np.minimum((q_norms[own][:, None] + norm[None, :] - apart * apart) * 0.5, np.sqrt(q_norms[own][:, None] * norm[None, :])) + slack
        todo = np.argsort(-bound.max(axis=0), kind="stable")
        best = np.full((len(own), k), none), np.full((len(own), k), np.iinfo(np.int64).max)
        at, step = 0, FIRST
        while at < len(todo):
            kth = np.maximum(best[0][:, -1], least[own])
            # Runs whose bound is under every k-th score hold nothing; equal scores may have smaller ids.
            alive = todo[at:][(bound[:, todo[at:]] >= kth[:, None]).any(axis=0)]
            if not len(alive):
                break
            todo = np.concatenate((todo[:at], alive))
            runs = todo[at : at + step]
            at, step = at + len(runs), min(2 * step, max(FIRST, BLOCK // RUN // 4))
            spots = (starts[runs][:, None] + np.arange(RUN)[None, :]).reshape(-1)
            spots = spots[spots < len(c)]
            if whole:
                best = _merged(best, _exact(q[own], c[spots], q_row[own], c_row[spots], c_id[spots], k), k)
                continue
            scores = (q[own] @ c[spots].T).astype(np.float64)
            scores[q_row[own][:, None] == c_row[spots][None, :]] = -np.inf
            places, tops = _tops(scores, c_id[spots], k)
            best = _merged(best, (tops, c_id[spots][places]), k)
        there = (best[0] > none) & (best[0] >= least[own][:, None])
        at, _ = np.nonzero(there)
        for x, y in zip(out, (q_row[own][at], q_id[own][at], best[1][there], best[0][there].astype(np.int64)), strict=True):
            x.append(y)
    none = [np.zeros(0, dtype=np.int64)]
    return pa.table({name: np.concatenate(none + x) for name, x in zip(("q_row", "query_id", "vec_id", "score"), out, strict=True)})


def _exact(q: np.ndarray, c: np.ndarray, q_row: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best for products that no float type holds: one query at a time, in whole numbers."""
    scores, ids = np.full((len(q), k), np.iinfo(np.int64).min + 1), np.full((len(q), k), np.iinfo(np.int64).max)
    for i in range(len(q)):
        own = np.flatnonzero(c_row != q_row[i])
        s = c[own] @ q[i]
        top = np.lexsort((c_id[own], -s))[:k]
        scores[i, : len(top)], ids[i, : len(top)] = s[top], c_id[own][top]
    return scores, ids


def _blocks(rows: DataFrame, by: str, at: str) -> DataFrame:
    """rows with block: cells of one length in their order, in blocks of about BLOCK rows; a large cell fills several."""
    sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("held"))
    # One row a length and pivot from here on.
    before = F.sum("held").over(Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    spans = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64(by), F.col("held"))
    return rows.join(spans, ["dim", "cell"]).withColumn(at, F.col("dim").cast("long") * F.lit(1 << 36) + F.floor(place / F.lit(BLOCK))).drop("held", "before")


def topk_search(vectors: DataFrame, k: int = 20, is_query=None, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query row, itself left out.

    Components become floor(scale * x), the score is their integer inner product; ties
    go to the smaller id. is_query is a condition on the columns of vectors, by default an id that 20 divides. Vectors that are
    null, empty or hold null or non-finite components take no part, nor rows with a null id. Vectors meet those of their own
    length alone. Rows that repeat an id are rows of their own: each is a candidate, for the other ones of its id, too, and each
    query row has a list. Fewer than k others give fewer rows. Products beyond 2^63
    are not defined. An empty table gives an empty one. Only the named columns and those of is_query are read."""
    cond = quoted(id_col) % 20 == 0 if is_query is None else is_query
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("x"), F.coalesce(cond, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("x")) & F.col("id").isNotNull())
    v = F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "q", F.size("x").alias("dim"), v.alias("v")), "vectors")
    # Of each length a few rows by hash, the same in every run: they come to the driver.
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "row")
    picked: dict[int, list] = {}
    for r in rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots).select("dim", "v").collect():
        picked.setdefault(r["dim"], []).append(r["v"])
    chosen = {dim: np.array(x, dtype=np.float64) for dim, x in picked.items()}
    celled = cut(_with_cells(rows, chosen), "cells")
    drop_cut(rows)
    kept = ["row", "id", "v", "dim", "cell"]
    candidates = cut(_blocks(celled.select(*kept), "row", "block"), "candidates")
    queries = cut(_blocks(celled.where("q").select(*kept), "row", "block").withColumnRenamed("block", "q_block"), "queries")
    drop_cut(celled)

    def tops(key, a, b):
        if a.num_rows and b.num_rows:
            return block_tops(a, b, k, chosen[a.column("dim")[0].as_py()])
        return pa.table({x: pa.array([], pa.int64()) for x in ("q_row", "query_id", "vec_id", "score")})

    def met(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """Tops of the pairs (q_block, block), asked: queries with least."""
        by, cols = ("q_block", "block"), ("row", "id", "v", "dim")
        a = asked.join(pairs, "q_block").select(*by, *cols, "least")
        b = candidates.join(pairs, "block").select(*by, *cols)
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(tops, "q_row long, query_id long, vec_id long, score long")

    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    # Each block of queries meets the one block of candidates that holds most of its cells: then each query has a k-th score.
    held = candidates.groupBy("dim", "cell", "block").agg(F.count("*").alias("n"))
    own = queries.groupBy("dim", "cell", "q_block").agg(F.count("*").alias("m")).join(held, ["dim", "cell"])
    own = own.groupBy("q_block").agg(F.max_by("block", F.struct(F.col("m") * F.col("n"), F.col("block"))).alias("block"))
    own = cut(own, "own")
    first = cut(met(queries.withColumn("least", F.lit(float("-inf"))), own), "tops")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").cast("double").alias("least"))
    asked = cut(queries.join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "asked")
    # Bounds of all pairs of blocks, from a row a block; what can't reach the least k-th score of its queries isn't met.
    q_box = _intervals(queries.withColumnRenamed("q_block", "block"), chosen).withColumnRenamed("block", "q_block")
    q_box = q_box.join(asked.groupBy("q_block").agg(F.min("least").alias("least")), "q_block")
    # A length is one key, so its blocks of queries are dealt to parts, and the rows of candidates' blocks, which are few numbers, go to each.
    box = _intervals(candidates, chosen).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    q_box = q_box.withColumn("part", F.pmod(F.xxhash64("q_block"), F.lit(PARTS)).cast("int"))
    both = q_box.select("q_block", "dim", "part", *[F.col(c).alias(f"q_{c}") for c in ("norm", "low", "high")], "least").join(box, ["dim", "part"])
    apart = F.array_max(F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda p: F.greatest(F.get("q_low", p) - F.get("high", p), F.get("low", p) - F.get("q_high", p), F.lit(0.0))))
    bound = F.least((F.col("q_norm") + F.col("norm") - apart * apart) / 2, F.sqrt(F.col("q_norm") * F.col("norm"))) + (F.col("q_norm") + F.col("norm")) * 1e-9 + 1e-6
    pairs = both.where(bound >= F.col("least")).select("q_block", "block").join(own, ["q_block", "block"], "left_anti")
    found = first.unionByName(met(asked, cut(pairs, "block-pairs")))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
