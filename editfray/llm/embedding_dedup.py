"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, so that cosine c is distance sqrt(2 - 2c). A hash is
floor((a . v + b) / w) with Gaussian a; `k` of them make a bucket of a table, and there
are as many tables as keep the chance to miss a pair right at the threshold under
`miss`. k follows the number of vectors of the largest label, so that buckets don't grow with it. Buckets
stream through tasks sorted, small ones many at a time; large ones are cut into tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import arrow_map, cut, drop_cut, quoted, release, table
from .components import components

WIDTH = 2.0
#: Vectors on each side of a tile: a bucket of any size is compared in tiles.
TILE = 1024
#: Tiles up to this size are compared together with others.
SMALL = 48
#: Chance neighbours that a vector may have in one bucket.
STRANGERS = 256


def meeting(distance: float, width: float = WIDTH) -> float:
    """The chance that one hash puts two vectors at this distance into one cell."""
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Hashes for a bucket, and tables."""
    strange, near = meeting(math.sqrt(2)), meeting(math.sqrt(2 - 2 * threshold))
    k = max(4, math.ceil(math.log(max(1.0, n / STRANGERS)) / -math.log(strange)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # so that squares of very small or large numbers stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector):
    """Not null, of some length, all components finite and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _buckets(reps: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Each row of reps with codes: its bucket in every table, as 64-bit hashes of the k cells."""

    def make():
        rng = np.random.default_rng(seed)
        b, by = rng.uniform(0, WIDTH, tables * k), rng.integers(1, 2**62, tables * k, dtype=np.int64) | 1
        directions: dict[int, np.ndarray] = {}

        def coded(v):
            dim = v.shape[1]
            if dim not in directions:
                directions[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * k))
            with np.errstate(over="ignore"):
                cells = np.floor((v @ directions[dim] + b) / WIDTH).astype(np.int64) * by
                codes = cells.reshape(len(v), tables, k).sum(axis=2)
            return codes ^ (codes >> 31)

        def f(batch):
            size, codes = batch.column("dim").to_numpy(), np.zeros((batch.num_rows, tables), dtype=np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                codes[at] = coded(_unit(_matrix(batch.column("vector").take(pa.array(at)))))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.reshape(-1)))], [*batch.schema.names, "codes"])

        return f

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in reps.schema)
    return arrow_map(reps, make, schema + ", codes array<long>")


def _linked_rows(n: int, left: np.ndarray, right: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> pa.Table:
    """Of links (pairs of places among n rows): for each row in one its number of vectors linked, and the smallest id reachable."""
    count, low = np.zeros(n, dtype=np.int64), ids.copy()
    np.add.at(count, left, weight[right])
    np.add.at(count, right, weight[left])
    while True:
        new = low.copy()
        np.minimum.at(new, left, low[right])
        np.minimum.at(new, right, low[left])
        if (new == low).all():
            break
        low = new
    some = np.flatnonzero(count)
    return pa.table({"id": ids[some], "n": count[some], "low": low[some]})


def _first_met(codes: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The places of pairs that have no earlier table in common: a pair that meets in several tables counts in the first of them alone."""
    ends, values = codes.offsets.to_numpy(), codes.values.to_numpy()
    keep, t = np.arange(len(left)), 0
    done = [keep[:0]]
    while len(keep):
        on = ends[left[keep] + 1] - ends[left[keep]] > t
        done.append(keep[~on])
        keep = keep[on]
        keep = keep[values[ends[left[keep]] + t] != values[ends[right[keep]] + t]]
        t += 1
    return np.concatenate(done)


def _tiles_links(rows: pa.Table, threshold: float) -> pa.Table:
    """Links within the tiles of rows, which stand by tile: see _linked_rows()."""
    tile, dims = rows.column("tile").to_numpy(), rows.column("dim").to_numpy()
    ids, weight, side = (rows.column(x).to_numpy() for x in ("id", "copies", "side"))
    whole = rows.column("whole").to_numpy()  # a tile of a block with itself: all its pairs count, else those across its sides
    begin = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (dims[1:] != dims[:-1]))))
    size = np.diff(np.append(begin, len(tile)))
    vectors, sizes = rows.column("vector").combine_chunks(), np.repeat(size, size)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for dim in np.unique(dims):
        own = np.flatnonzero((dims == dim) & (sizes <= SMALL) & (sizes > 1))
        v, t = _unit(_matrix(vectors.take(pa.array(own)))) if len(own) else None, tile[own]
        live, step = np.arange(len(own)), 1
        while len(live):
            live = live[live + step < len(own)]
            live = live[t[live] == t[live + step]]
            near = live[np.einsum("ij,ij->i", v[live], v[live + step]) >= threshold]
            left.append(own[near])
            right.append(own[near + step])
            step += 1
    for a, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        v = _unit(_matrix(vectors.slice(a, n)))
        i, j = np.nonzero(np.triu(v @ v.T >= threshold, 1))
        left.append(a + i)
        right.append(a + j)
    left, right = np.concatenate(left), np.concatenate(right)
    across = np.flatnonzero(whole[left] | (side[left] != side[right]))
    left, right = left[across], right[across]
    first = _first_met(rows.column("earlier").combine_chunks(), left, right)
    left, right = left[first], right[first]
    return _linked_rows(len(ids), left, right, ids, weight)


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """_tiles_links() over rows (tile, whole, side, dim, id, copies, vector, earlier), whole tiles at a time."""
    ship_package(tiles.sparkSession)

    def run(batches):
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < 8 * TILE:
                continue
            tile = held.column("tile").to_numpy()
            ended = np.flatnonzero(tile != tile[-1])
            if len(ended):
                yield from _tiles_links(held.slice(0, int(ended[-1]) + 1).combine_chunks(), threshold).to_batches()
                held = held.slice(int(ended[-1]) + 1)
        if held is not None and held.num_rows:
            yield from _tiles_links(held.combine_chunks(), threshold).to_batches()
        release()

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "id long, n long, low long")


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.93, miss: float = 0.01, seed: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> DataFrame:
    """id, n_links, component_id and kept for each row of vectors.

    Rows of the same label that is not null (all rows, without label_col) and of one length link when their
    cosine in double precision is at least the threshold; no pair below it is linked,
    and a pair right at it is missed with a chance of at most `miss`, a closer one with
    far less. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a
    null id. Equal vectors are found by grouping, never missed, and count as one below, with their number. Rows that repeat an id
    count as so many vectors. Ids are integers. An empty table gives an empty one. Only the named columns are read."""
    label = quoted(label_col) if label_col else F.lit(0)
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector"), label.alias("label"))
    good = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # Each distinct vector has a number of its own: rows of several may share an id.
    reps = good.groupBy("label", "vector").agg(F.min("id").alias("name"), F.count("*").alias("copies"))
    reps = cut(reps.withColumns({"dim": F.size("vector"), "id": F.monotonically_increasing_id()}), "distinct")
    most = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    k, tables = plan(most, threshold, miss)
    coded = cut(_buckets(reps.select("id", "copies", "vector", "dim", F.xxhash64("label", "dim").alias("l")), k, tables, seed), "buckets")
    spots = coded.select("id", "l", F.posexplode("codes").alias("t", "code"))
    full = spots.groupBy("l", "t", "code").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / F.lit(TILE)).cast("int")
    placed = spots.join(full, ["l", "t", "code"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # The vector goes to buckets that hold two and more alone, and with it the codes of earlier tables.
    tiles = placed.join(coded.select("id", "copies", "vector", "dim", "codes"), "id").select(
        F.xxhash64("l", "t", "code", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), (F.col("block") == F.col("other")).alias("whole"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "dim", "id", "copies", "vector", F.slice("codes", F.lit(1), F.col("t")).alias("earlier"),
    )
    links = cut(_links(tiles, threshold), "links")
    found = components(links.select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    # A component goes by the smallest id of its vectors.
    members = found.join(reps.select("id", "name"), "id")
    smallest = members.groupBy("component").agg(F.min("name").alias("smallest"))
    members = members.join(smallest, "component").select(F.col("id").alias("f_id"), F.col("smallest").alias("component"))
    tops = reps.select(F.col("id").alias("rep"), "name", "copies", "vector", "label").join(counts.withColumnRenamed("id", "c_id"), F.col("rep") == F.col("c_id"), "left").join(
        members, F.col("rep") == F.col("f_id"), "left"
    ).select("name", "copies", "n", "component", F.col("vector").alias("r_vector"), F.col("label").alias("r_label"))
    drop_cut(coded)
    ok = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    joined = rows.join(tops, ok & (F.col("label") == F.col("r_label")) & (F.col("vector") == F.col("r_vector")), "left")
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("n") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "name", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
