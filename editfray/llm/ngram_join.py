"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. A sketch of all shingles, of fixed size, orders them from rare to frequent. Any
   order that all documents share keeps the prefix rule exact: two sets of Jaccard t
   share one of the first n - ceil(t n) + 1 shingles of each.
2. Each set gets its size, a key for exact copies, a bitmap with a bit or so for each
   shingle, and its prefix. Copies meet in their smallest id.
3. Sets that share a prefix shingle meet in the smallest of them, their hub. Each set is tied to
   the hub it meets most often: a tree, not all pairs. Sizes, then bitmaps bound the
   overlap from above; what passes is settled by an exact intersection of sorted arrays.
4. Where sets that share a shingle are still in several components, those rows alone go
   into tiles of bounded size with their bitmaps, in the order of size, so that each row
   meets only the band of sizes it can link with, and only rows of other components. Rows of a
   shingle's largest component meet the others, not each other. If these pairs are few they are settled at once.
   Else a first round settles each row's nearest one alone, so that few components are left; the second settles all that is apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import arrow_map, cut, drop_cut, free, named, numbered_nulls, quoted, release, slices, table
from .components import components
from .shingles import mix, shingle_hashes, shingle_sets

#: Counters of the sketch: 2^22, summed on the way to the driver (16 MB), and sent out as 4 MB of levels.
SKETCH_BITS = 22
_CHUNKS = 1024
#: Levels for each doubling of a count.
STEPS = 8
#: Documents that meet in one group, by the sketch.
HOT = 4096
#: Texts held against one hub's in one group.
LINKS = 128
#: Rows on each side of a tile.
TILE = 1024
#: Pairs for each row of a tile that the first round writes; of a tile with more of them, each row's nearest alone.
FEW = 64
#: Sets for each pair of tiles, where these pairs count as few: to ship their texts costs less than to bound them, or than a second round.
SETS = 8
#: Of each set's prefix, so many least shingles go with it into tiles: two sets that share some of these need not meet again in a later tile.
LEAST = 16
#: Bits of a bitmap: about two for each shingle. Tiles take bitmaps folded to the least; a pair that passes is held against the full ones.
BITS_LEAST, BITS_MOST = 1024, 1 << 16


def _pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after a byte that tells how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.uint64)


def _sum_sketches(parts: DataFrame) -> np.ndarray:
    """Sum rows of (chunk, counts binary) chunk by chunk, as they stream past; at most 32 MB reach the driver."""

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, np.uint64(0)) + _unpack(counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([_pack(x) for x in totals.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint64).reshape(_CHUNKS, -1)
    for row in parts.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[row["chunk"]] = _unpack(row["counts"])
    return out.reshape(-1)


def shingle_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all texts fall into each of 2^SKETCH_BITS counters."""
    ship_package(docs.sparkSession)

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for b in batches:
            for s in slices(b, "text"):
                hashes, _ = shingle_hashes(s.column("text"), words)
                np.add.at(counts, (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), np.uint32(1))
        rows = counts.reshape(_CHUNKS, -1)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pack(rows[k]) for k in some], pa.binary())], ["chunk", "counts"])

    return _sum_sketches(docs.select("text").mapInArrow(run, "chunk int, counts binary"))


def _bitmap(own: np.ndarray, bits: int) -> bytes:
    """The parity of the number of shingles that fall on each bit: two bitmaps differ in no more bits than their sets in shingles."""
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _bits_for(n: int) -> int:
    return min(max(BITS_LEAST, 1 << (2 * n - 1).bit_length()), BITS_MOST)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64), pa.int64())


def signatures(docs: DataFrame, levels, threshold: int, words: int) -> DataFrame:
    """doc_id, n, k1, k2, bits, narrow (bits folded), least (shingles of the prefix) and prefix (shingle, salts) of each row; levels is a broadcast of the order."""

    def make():
        order = levels.value

        def f(batch):
            ns, k1s, k2s, bits, narrow, lows, shingles, salts, ends = [], [], [], [], [], [], [], [], [0]
            for own in shingle_sets(batch.column("text"), words):
                n = len(own)
                ns.append(n)
                k1s.append(own.sum(dtype=np.uint64))
                k2s.append(np.bitwise_xor.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D))) if n else np.uint64(0))
                bits.append(_bitmap(own, _bits_for(n)) if n else b"")
                narrow.append(_bitmap(own, BITS_LEAST) if n else b"")
                if n:
                    level = order[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = np.argsort(level, kind="stable")[: n - (threshold * n + 99) // 100 + 1]
                    shingles.append(own[first])
                    lows.append(np.sort(own[first].view(np.int64))[:LEAST].tobytes())
                    salts.append(np.maximum(1, np.exp2(level[first] / STEPS) / HOT).astype(np.int32))
                    ends.append(ends[-1] + len(first))
                else:
                    lows.append(b"")
                    ends.append(ends[-1])
            none = np.zeros(0, dtype=np.uint64)
            pairs = pa.StructArray.from_arrays([_longs(np.concatenate([none, *shingles])), pa.array(np.concatenate([none.astype(np.int32), *salts]), pa.int32())], ["shingle", "salts"])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), _longs(k1s), _longs(k2s), pa.array(bits, pa.binary()), pa.array(narrow, pa.binary()), pa.array(lows, pa.binary()), prefix], ["doc_id", "n", "k1", "k2", "bits", "narrow", "least", "prefix"])

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, make, f"doc_id {kind}, n long, k1 long, k2 long, bits binary, narrow binary, least binary, prefix array<struct<shingle:long,salts:int>>", "text")


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer folded to the shorter."""
    p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if len(p) < len(q):
        p, q = q, p
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _can_link(n, m, apart, threshold: int):
    """Whether sets of sizes n and m that differ in `apart` shingles at least can reach the threshold: their overlap is (n + m - apart) / 2 at most."""
    return 100 * (n + m - apart) >= threshold * (n + m + apart)


def _bounded_pairs(pairs: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps let them link."""
    both = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a").join(
        bits.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b"
    )

    def make():
        def f(batch):
            a, b = (batch.column(x).to_pylist() for x in ("bits_a", "bits_b"))
            keep = []
            for n, m, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), a, b, strict=True):
                keep.append(_can_link(n, m, _apart(x, y), threshold))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return f

    kind = pairs.schema["a"].dataType.simpleString()
    return arrow_map(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), make, f"a {kind}, b {kind}")


def _met_before(tiles: pa.Table):
    """A test whether rows a and b of tiles share one of their least shingles below that of this tile. They met in its tile then: as
    their components differ, so do those of its sets."""
    least = np.full((tiles.num_rows, LEAST), np.iinfo(np.int64).max)
    for k, x in enumerate(tiles.column("least").to_pylist()):
        least[k, : len(x) // 8] = np.frombuffer(x, dtype=np.int64)
    shingle = tiles.column("shingle").to_numpy()

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for k in range(LEAST):
            y = least[a, k]
            out |= (y < np.minimum(shingle[a], shingle[b])) & (least[b] == y[:, None]).any(axis=1)
        return out

    return test


def _meet(tiles: pa.Table, threshold: int, nearest: bool, few: int = 0) -> pa.Table:
    """Pairs of rows of the same tile (rows stand by tile, then size), in different components, that sizes and bitmaps let link;
    with nearest, of each row of a tile with over `few` pairs a row only the pair of which they promise most, and these say that there is more.
    A pair is near if it is such a pair of one of its rows, and wide if both its full bitmaps are longer than those of tiles, and tell more."""
    n, comp, ids, tile = (tiles.column(x).to_numpy() for x in ("n", "component", "id", "tile"))
    words = np.frombuffer(b"".join(tiles.column("narrow").to_pylist()), dtype=np.uint64).reshape(len(n), -1)
    before = _met_before(tiles) if "least" in tiles.column_names else None
    left, right, far = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    live = np.arange(len(n) - 1)
    step = 1
    while len(live):
        live = live[live + step < len(n)]
        other = live + step
        # Sizes rise within a tile: a row that has left its band, or its tile, is done.
        on = (tile[other] == tile[live]) & (threshold * n[other] <= 100 * n[live])
        live, other = live[on], other[on]
        cross = comp[live] != comp[other]
        a, b = live[cross], other[cross]
        if len(a):
            apart = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
            ok = _can_link(n[a], n[b], apart, threshold)
            if before and ok.any():
                ok[ok] = ~before(a[ok], b[ok])
            left.append(a[ok])
            right.append(b[ok])
            far.append(apart[ok] / (n[a[ok]] + n[b[ok]]))
        step += 1
    left, right, far = map(np.concatenate, (left, right, far))
    near, more = np.zeros((2, len(far)), dtype=bool)
    if nearest and len(far):
        least = np.full(len(n), np.inf)
        np.minimum.at(least, left, far)
        np.minimum.at(least, right, far)
        both = np.concatenate((np.flatnonzero(far == least[left]), np.flatnonzero(far == least[right])))
        row = np.concatenate((left[far == least[left]], right[far == least[right]]))
        near[both[np.unique(row, return_index=True)[1]]] = True
        _, of = np.unique(tile, return_inverse=True)
        more = (np.bincount(of[left], minlength=len(n)) > few * np.bincount(of, minlength=len(n)))[of[left]]
        keep = near | ~more
        left, right, near, more = left[keep], right[keep], near[keep], more[keep]
    wide = np.minimum(n[left], n[right]) > BITS_LEAST // 2
    return pa.table({"a": ids[left], "b": ids[right], "wide": wide, "near": near, "more": more})


def _tile_pairs(rows: DataFrame, threshold: int, nearest: bool) -> DataFrame:
    """_meet() over rows (tile, shingle, id, component, n, narrow, least), whole tiles at a time; small tiles share a call. Each pair (a < b) once."""
    ship_package(rows.sparkSession)

    def run(batches):
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < 4096:
                continue
            tile = held.column("tile").to_numpy()
            ended = np.flatnonzero(tile != tile[-1])
            if len(ended):
                whole = int(ended[-1]) + 1
                yield from _meet(held.slice(0, whole).combine_chunks(), threshold, nearest, FEW).to_batches()
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _meet(held.combine_chunks(), threshold, nearest, FEW).to_batches()

    found = rows.repartition("tile").sortWithinPartitions("tile", "n").mapInArrow(run, "a long, b long, wide boolean, near boolean, more boolean")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*(F.max(x).alias(x) for x in ("wide", "near", "more")))


def _spot(ids: str) -> Column:
    """The bit of an id in the bitmap of _id_bits()."""
    return F.pmod(F.xxhash64(ids), F.lit(8 << SKETCH_BITS)).cast("int").alias("spot")


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^SKETCH_BITS * 8 bits (4 MB) with the hashes of ids: all of them, and few others. At most 2^SKETCH_BITS / 8 rows reach the driver."""
    words = ids.select(_spot("id")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, spot & 63)")).alias("bits")).toArrow()
    out = np.zeros((1 << SKETCH_BITS) // 8, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def exact_links(docs: DataFrame, pairs: DataFrame, threshold: int, words: int) -> DataFrame:
    """Of distinct pairs (a, b), those with 100 * intersection >= threshold * union of their shingle sets; written.

    Each text is sent to the groups of a that need it, about LINKS of them in one; a group streams past with a's text first."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(LINKS)).alias("salts"))
    tails = pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("id"), F.lit(1).alias("role"))
    heads = counted.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("role"))
    members = cut(tails.unionByName(heads), "members")
    wanted = spark.sparkContext.broadcast(_id_bits(members))

    def only_wanted(batches):
        at = wanted.value
        for b in batches:
            spots = b.column("spot").to_numpy()
            yield b.select(["doc_id", "text"]).filter(pa.array((at[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)))

    texts = docs.where("doc_id is not null").select("doc_id", "text", _spot("doc_id")).mapInArrow(only_wanted, docs.select("doc_id", "text").schema)
    sent = members.join(texts, F.col("id") == F.col("doc_id")).select("a", "salt", "role", "id", "text")
    grouped = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id")

    def run(batches):
        hub = own = None
        for b in batches:
            for s in slices(b, "text"):
                sets = shingle_sets(s.column("text"), words)
                left, right = [], []
                for a, salt, role, i, x in zip(*(s.column(c).to_pylist() for c in ("a", "salt", "role", "id")), sets, strict=True):
                    if role == 0:
                        hub, own = (a, salt), x
                    elif hub == (a, salt):
                        both = len(np.intersect1d(own, x, assume_unique=True))
                        if 100 * both >= threshold * (len(own) + len(x) - both) and both:
                            left.append(a)
                            right.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(left, s.schema.field("a").type), pa.array(right, s.schema.field("a").type)], ["a", "b"])
        release()

    found = cut(grouped.mapInArrow(run, f"a {kind}, b {kind}"), "links")
    wanted.destroy()
    drop_cut(members)
    return found


def _tiles(met: DataFrame, found: DataFrame, sigs: DataFrame) -> DataFrame:
    """tile, shingle, id, component, n, narrow, least: the rows of shingles whose sets are in several components, in tiles of bounded size."""
    comp = met.join(found, F.col("doc_id") == F.col("id"), "left").select("shingle", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = comp.groupBy("shingle", "component").agg(F.count("*").alias("rows"))
    apart = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("rows", "component")).alias("major"), F.max("rows").alias("major_rows"), F.sum("rows").alias("all_rows")).where("all_rows > major_rows")
    blocks = lambda rows: F.ceil(rows / F.lit(TILE)).cast("int")
    apart = apart.select("shingle", "major", blocks(F.col("major_rows")).alias("majors"), blocks(F.col("all_rows") - F.col("major_rows")).alias("minors"))
    left = comp.join(apart, "shingle")
    is_major = F.col("component") == F.col("major")
    # A tile is a block of the others with a block of the largest component, or with one of the others.
    block = F.pmod(F.xxhash64("doc_id"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))).cast("int")
    others = F.sequence(F.lit(0), F.col("minors") - 1)
    own = F.transform(others, lambda i: F.struct(F.least(F.col("block"), i).alias("t0"), F.greatest(F.col("block"), i).alias("t1")))
    major = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: F.struct(F.col("block").alias("t0"), (-1 - j).alias("t1")))
    places = F.when(is_major, F.transform(others, lambda i: F.struct(i.alias("t0"), (-1 - F.col("block")).alias("t1")))).otherwise(F.concat(own, major))
    placed = left.withColumn("block", block).select("shingle", "doc_id", "component", F.explode(places).alias("t"))
    # Tiles of different shingles that fall on one number only compare more than they must.
    return placed.join(sigs.select("doc_id", "n", "narrow", "least"), "doc_id").select(F.xxhash64("shingle", "t.t0", "t.t1").alias("tile"), "shingle", F.col("doc_id").alias("id"), "component", "n", "narrow", "least")


def ngram_join(docs: DataFrame, threshold: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Rows link when 100 * intersection >= threshold * union of their sets of `words`-word shingles
    (A-Z lower-cased; a text of fewer words is one shingle). component_id is the smallest
    id reachable by links, the row's own if there is none. Null and blank texts have
    an empty set and link with nothing. Rows that repeat an id are linked by the id, whatever their texts; rows
    with a null id carry the component of their copies, null if alone. Ids are integers. An empty table gives an empty one. Only the
    two named columns are read."""
    spark = docs.sparkSession
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    counts = shingle_sketch(docs, words)
    levels = spark.sparkContext.broadcast(np.minimum(255, np.log2(counts.astype(np.float64) + 1) * STEPS).astype(np.uint8))
    sigs = cut(signatures(docs, levels, threshold, words), "signatures")
    levels.destroy()
    keys = ["n", "k1", "k2"]
    tops = cut(sigs.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")), "copies")
    reps = sigs.join(tops.select(F.col("rep").alias("doc_id"), *keys), ["doc_id", *keys], "left_semi").dropDuplicates(["doc_id", *keys])
    rows = reps.select("doc_id", "n", F.explode("prefix").alias("p")).select(
        F.col("p.shingle").alias("shingle"), F.pmod(F.xxhash64("doc_id"), F.col("p.salts")).cast("int").alias("salt"), F.col("p.salts").alias("salts"), "doc_id", "n"
    )
    # Groups here are bounded: the sketch's count, never under the true one, sets the number of salts.
    by = Window.partitionBy("shingle", "salt")
    met = cut(rows.withColumn("hub", F.min("doc_id").over(by)).withColumn("held", F.count("*").over(by)).where("held > 1 or salts > 1"), "met")
    hubs = met.where("salts > 1").groupBy("shingle", "salt").agg(F.min("hub").alias("hub"))
    tied = hubs.join(hubs.groupBy("shingle").agg(F.min("hub").alias("top")), "shingle").select(F.col("top").alias("a"), F.col("hub").alias("b"))
    # Each set's most frequent hub, the smallest of several.
    often = met.where("hub <> doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("times"))
    best = often.groupBy("doc_id").agg(F.min_by("hub", F.struct(-F.col("times"), F.col("hub"))).alias("hub"))
    pairs = best.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).unionByName(tied.where("a <> b")).distinct()
    bits = sigs.select("doc_id", "n", "bits")
    bounded = cut(_bounded_pairs(pairs, bits, threshold), "pairs")
    links = exact_links(docs, bounded, threshold, words)
    drop_cut(bounded)
    found = components(links)

    # What is still apart and shares a shingle meets in tiles. Few pairs are settled at once; of many, each set takes the nearest one of
    # each tile first, which joins most components; then every pair that is apart still is settled.
    few = sigs.count() // SETS
    for nearest in (True, False):
        met_pairs = cut(_tile_pairs(_tiles(met, found, sigs), threshold, nearest), "tiles")
        n, more = met_pairs.agg(F.count("*"), F.max("more")).first()
        close = met_pairs.where("near") if nearest and n > few else met_pairs
        if n > few:
            # A bitmap that isn't wide has been compared in full.
            bounded = _bounded_pairs(close.where("wide").select("a", "b"), bits, threshold)
            close = cut(close.where("not wide").select("a", "b").unionByName(bounded), "pairs")
        if n:
            links = links.unionByName(exact_links(docs, close.select("a", "b"), threshold, words))
            found = components(links)
            if n > few:
                drop_cut(close)
        drop_cut(met_pairs)
        if n <= few and not more:
            break
    drop_cut(met)
    final = sigs.select("doc_id", "n", "k1", "k2").join(tops, keys, "left").join(found, F.col("rep") == F.col("id"), "left")
    return final.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs whose id is their component's, columns as they are.

    A row with a null id is a document of its own: it stays if it has no copy, and so does one of each group of copies without ids."""
    number, row, kept = free(docs, "number", "row", "kept")
    nulls = numbered_nulls(docs, id_col, row)

    def tops(rows, own):
        return ngram_join(rows, id_col=own, **how).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()

    if nulls is None:
        return docs.join(tops(docs, id_col), quoted(id_col) == F.col(kept), "left_semi")
    # They are numbered after the greatest id, so that a copy with an id goes first (before the least, if there is no room).
    ids = docs.agg(F.min(quoted(id_col).cast("long")), F.max(quoted(id_col).cast("long"))).first()
    n = nulls.count()
    start = 0 if ids[1] is None else ids[1] + 1 if ids[1] + n < 1 << 63 else ids[0] - n
    given = docs.where(quoted(id_col).isNotNull()).withColumn(number, quoted(id_col).cast("long"))
    rows = given.unionByName(nulls.withColumn(number, F.col(row) + F.lit(start)).drop(row))
    return rows.join(tops(rows, number), F.col(number) == F.col(kept), "left_semi").select(*named(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), sets AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingles) WHERE len(s) > 0 GROUP BY s
), flat AS (
  SELECT rep, n, unnest(s) AS x FROM sets
), rare AS (
  SELECT x FROM flat GROUP BY x HAVING count(*) > 1
), shared AS (
  SELECT rep, n, x FROM flat WHERE x IN (SELECT x FROM rare)
), links AS (
  SELECT p.rep AS a, q.rep AS b FROM shared p JOIN shared q ON p.x = q.x AND p.rep <> q.rep
    AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY p.rep, q.rep, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT rep AS node, rep AS top FROM sets
  UNION
  SELECT l.b AS node, r.top FROM reach r JOIN links l ON r.node = l.a
), tops AS (
  SELECT node, min(top) AS top FROM reach GROUP BY node
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(t.top, d.doc_id) AS component_id
FROM (SELECT doc_id, list_sort(s) AS s FROM shingles) d LEFT JOIN sets s ON d.s = s.s LEFT JOIN tops t ON s.rep = t.node
"""
