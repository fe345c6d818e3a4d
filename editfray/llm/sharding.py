"""Sharding (native) by sampled splitters: shards near equal in bytes, equal texts side by side.

DataFrame functions alone. Rows stand in the order of a digest of their text, then of their id. A
sample of keys, drawn with a chance in proportion to size, gives quantile boundaries of many small ranges;
exact sums of the ranges follow, and a range that the sample left overfull is drawn from and divided again. Within a
range a window has what comes before each row, and sums of the ranges before make that exact for the
whole table: shards end where their bytes do, not where a sample says.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, named, quoted, table

#: Ranges a shard, and sampled keys a range: the sample is SHARDS * PIECES * DRAWN keys on average, whatever the table's size.
PIECES, DRAWN = 16, 128
#: A group of equal texts of up to this share of a shard stays whole; a larger one may be divided between neighbours.
WHOLE = 0.04


def text_key(text: Column) -> Column:
    """60 bits of the text's md5: equal texts are neighbours, others stand in no order of meaning."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _uniform(*key: Column) -> Column:
    """In [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(29), *key), 11) / F.lit(float(1 << 53))


def _not_above(value: Column, sorted_: Column, n: int) -> Column:
    """How many of the n sorted values are not above this one: by halves."""
    steps = [1 << i for i in range(n.bit_length())][::-1]
    return F.aggregate(
        F.array(*map(F.lit, steps or [0])), F.lit(0),
        lambda below, step: F.when((below + step <= n) & (F.get(sorted_, below + step - 1) <= value), below + step).otherwise(below),
    )


def _range(key: Column, splitters: Sequence) -> Column:
    """The number of a key's range: 0 before the first splitter."""
    if not splitters:
        return F.lit(0)
    # One literal, however many there are: Spark folds it once.
    held = json.dumps([{x: s[x] for x in ("h", "id", "at")} for s in splitters], default=str)
    return _not_above(key, F.from_json(F.lit(held), f"array<struct<h: bigint, id: {splitters[0]['id_type']}, at: bigint>>"), len(splitters))


def _longs(values: Sequence[int]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<bigint>")


def _drawn(rows: DataFrame, range_of: Column, sizes: Sequence, pieces: Sequence, drawn: int) -> list:
    """New splitters for the ranges that are to be cut into pieces (None: not), of given bytes: quantiles of a sample of keys, drawn by size.

    A text that several quantiles fall on is large, and divided by id; any other is left whole, by a splitter before its first row."""
    here = rows.withColumn("range", range_of).withColumns({"bytes": F.get(_longs(sizes), F.col("range")), "pieces": F.get(_longs(pieces), F.col("range"))}).where("pieces IS NOT NULL")
    sample = here.where(_uniform("h", "id", "at") * F.col("bytes") < F.col("size") * F.col("pieces") * drawn)
    # About drawn * pieces rows a range, of a bounded number of ranges: ranked range by range.
    spot = F.row_number().over(Window.partitionBy("range").orderBy("h", "id", "at"))
    ranked = sample.withColumn("spot", spot).withColumn("drawn", F.count("*").over(Window.partitionBy("range")))
    piece = F.floor(F.col("spot") * F.col("pieces") / (F.col("drawn") + 1))
    ends = ranked.withColumn("piece", piece).withColumn("before", F.lag("piece", 1, 0).over(Window.partitionBy("range").orderBy("h", "id", "at"))).where("piece > before")
    ends = ends.withColumn("again", F.lag("h").over(Window.partitionBy("range").orderBy("h", "id", "at"))).withColumn("id_type", F.typeof("id"))
    same = F.coalesce(F.col("again") == F.col("h"), F.lit(False))
    return ends.select("h", F.when(same, F.col("id")).alias("id"), F.when(same, F.col("at")).alias("at"), "id_type").distinct().collect()


def _splitters(rows: DataFrame, shards: int) -> tuple[list, list]:
    """Sorted splitters, and (bytes, rows) of the ranges between them: one row a range is all that the driver sees."""
    key = F.struct("h", "id", "at")
    split: list = []
    drawn = DRAWN
    sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("held")).withColumn("range", F.lit(0))
    found = {r["range"]: r for r in sums.collect()}
    fair = max(1, found[0]["bytes"] // (shards * PIECES))
    while True:
        # Ranges over twice their share are overfull.
        sizes = [found[i]["bytes"] if i in found else 0 for i in range(len(split) + 1)]
        pieces = [-(-sizes[i] // fair) if i in found and sizes[i] > 2 * fair and found[i]["held"] > 1 else None for i in range(len(sizes))]
        if not any(pieces):
            break
        more = set(_drawn(rows, _range(key, split), sizes, pieces, drawn)) - set(split)
        if not more:
            if all(p is None or p * drawn >= size for p, size in zip(pieces, sizes, strict=True)):
                break  # all keys were drawn: what is left is single records above the size of a range
            drawn *= 16
            continue
        # Null before all: the splitter before a text's first row.
        split = sorted({*split, *more}, key=lambda s: (s["h"], s["at"] is not None, s["id"] is not None, s["id"] if s["id"] is not None else 0, s["at"] or 0))
        found = {r["range"]: r for r in rows.groupBy(_range(key, split).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("held")).collect()}
    return split, [(found[i]["bytes"], found[i]["held"]) if i in found else (0, 0) for i in range(len(split) + 1)]


def shards_of(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard for each row of docs; columns of `also` pass through.

    Size is the text's bytes in UTF-8 and `overhead`; the law is `bytes`. Rows stand by (md5 of the text, id), null ids first; a shard takes
    the rows whose middle, in bytes, falls in its part of the whole, so its bytes are the fair share but for half of a record at each end, or half of a group of equal
    texts that WHOLE of a shard holds: such groups stay in one shard; of larger ones, only the parts at a boundary are divided. slot counts a shard's rows from 0, in
    that order. A null text has no bytes, crc32 0, and is one with empty ones. Rows that repeat an id are rows of their own. With fewer rows than shards some shards are empty; an empty
    table gives an empty one. Only the named columns are read."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(quoted(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("crc"), text_key(text).alias("h"), *also)
    # A few numbers a row from here on: texts are read once.
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "keys")
    split, sums = _splitters(rows, shards)
    bytes_before, rows_before = [0], [0]
    for size, held in sums:
        bytes_before.append(bytes_before[-1] + size)
        rows_before.append(rows_before[-1] + held)
    total = max(1, bytes_before[-1])
    # The text that ranges divide is large: its rows go by their own middle.
    cut_texts = sorted({s["h"] for s in split if s["at"] is not None})
    large = F.col("h").isin(*cut_texts) if cut_texts else F.lit(False)
    start = lambda sums_: F.get(_longs(sums_), F.col("range"))
    order = Window.partitionBy("range").orderBy("h", "id", "at")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("range", _range(F.struct("h", "id", "at"), split)).withColumn("upto", upto).withColumn("place", F.row_number().over(order))
    same = Window.partitionBy("range", "h").orderBy("id", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumn("group_end", F.last("upto").over(same)).withColumn("group", F.sum("size").over(same))
    kept = ~large & (F.col("group") <= F.lit(int(WHOLE * total / shards)))
    middle = F.when(kept, 2 * F.col("group_end") - F.col("group")).otherwise(2 * F.col("upto") - F.col("size")) + 2 * start(bytes_before)
    # Where shards begin, doubled as the middle is: whole numbers, however large the table.
    begins = [-(-2 * total * k // shards) for k in range(1, shards)]
    shard = _not_above(middle, _longs(begins), len(begins)) if begins else F.lit(0)
    placed = cut(placed.select("id", "size", "crc", shard.alias("shard"), (start(rows_before) + F.col("place") - 1).alias("row"), *rows.columns[4:-1]), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *rows.columns[4:-1],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, parts: int = 4, **how) -> None:
    """Write the rows of docs, with their columns, as Parquet under path, a folder shard=N each: in `parts` files by slot, so that no task writes a whole shard.

    The files of a shard, by name, hold its rows in the order of their slots. A column named shard or slot of docs keeps its name; those of the shard then end in _."""
    shard, slot, part, row = free(docs, "shard", "slot", "part", "row")
    placed = shards_of(docs, shards, also=(F.struct(*named(docs)).alias("whole_row"),), **how)
    most = placed.groupBy("shard").agg((F.max("slot") + 1).alias("held"))
    placed = placed.join(F.broadcast(most), "shard").select(
        F.col("whole_row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot), F.floor(F.col("slot") * parts / F.col("held")).cast("int").alias(part)
    )
    dealt = placed.repartitionByRange(shards * parts, shard, part).sortWithinPartitions(shard, part, slot)
    dealt.select(f"{row}.*", shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return shards_of(table(spark, sf_dir, "documents"))


def _nibbles() -> list[int]:
    """CRC-32 of four bits at a time: what each of their 16 values does to the rest."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        out.append(x)
    return out


ORACLE = rf"""
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(xor(c >> 4, {_nibbles()}[(xor(c, b) & 15) + 1]) >> 4, {_nibbles()}[(xor(xor(c >> 4, {_nibbles()}[(xor(c, b) & 15) + 1]), b >> 4) & 15) + 1])), 4294967295) AS text_crc32
  FROM keyed
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY h) AS held, sum(size) OVER () AS total FROM keyed
), grouped AS (
  SELECT *, max(upto) OVER (PARTITION BY h) AS group_end FROM summed
), placed AS (
  SELECT *, ((CASE WHEN held <= floor({WHOLE} * total / 40) THEN 2 * group_end - held ELSE 2 * upto - size END) * 40 // (2 * total))::INTEGER AS shard FROM grouped
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN crcs USING (doc_id)
"""
