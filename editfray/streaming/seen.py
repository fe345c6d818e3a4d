"""Repeats of a stream's events, however late: sketches of each day's keys, and an exact look where a sketch says perhaps."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sinks

#: Bits of a row of a sketch, as bitmap_construct_agg() makes them.
ROW = 4096 * 8


class Seen:
    """Keys that have come, under a path: `keys` by day of arrival and batch, and `sketches`, Bloom filters of each.

    slots: rows of ROW bits of a day's sketch, at least 24 bits for each key that a day brings make false hits rare (slots = 256: 350,000 keys a day with 8 hashes). False
    hits cost a look at a day's keys, and drop nothing."""

    def __init__(self, path: str, slots: int = 256, hashes: int = 8) -> None:
        self.path, self.slots, self.hashes = path, slots, hashes

    def _keys(self, rows: DataFrame, *also: str) -> DataFrame:
        """A row for each key of each row: of its revision, and of its place in the feed, if it has one."""
        rev = F.when(F.col("wiki").isNotNull() & F.col("rev_id").isNotNull(), F.concat(F.lit("r:"), F.col("wiki"), F.lit(":"), F.col("rev_id").cast("string")))
        keys = F.array_compact(F.array(rev, F.concat(F.lit("s:"), F.col("stream_id"))))
        return rows.select(*also, F.explode(keys).alias("key"))

    def _spots(self, keys: DataFrame) -> DataFrame:
        """Each key's bits: row of the sketch and place in it, by two hashes that make all."""
        h1, h2 = F.xxhash64("key"), F.xxhash64(F.lit(3), "key").bitwiseOR(F.lit(1))
        spot: Callable[[Column], Column] = lambda i: F.pmod(h1.bitwiseAND((1 << 56) - 1) + i * h2.bitwiseAND((1 << 50) - 1), F.lit(self.slots * ROW))
        rows = keys.withColumn("spot", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.hashes - 1).cast("long")), spot)))
        return rows.withColumns({"slot": F.floor(F.col("spot") / ROW), "bit": F.pmod("spot", F.lit(ROW))}).drop("spot")

    def fresh(self, batch: DataFrame, number: int) -> DataFrame:
        """Rows of a batch none of whose keys has come with another batch; of those that share a key, one. A batch that is run again finds the same."""
        place = F.coalesce("stream_id", F.concat(F.lit("r:"), F.coalesce("wiki", F.lit("")), F.lit(":"), F.coalesce(F.col("rev_id").cast("string"), F.lit(""))))
        rows = batch.dropDuplicates(["wiki", "rev_id"]).withColumn("__place", place).dropDuplicates(["__place"]).drop("__place")
        spark = batch.sparkSession
        if not sinks.exists(spark, f"{self.path}/sketches"):
            return rows
        own = self._keys(rows, "wiki", "rev_id", "stream_id")
        sketches = spark.read.parquet(f"{self.path}/sketches").where(F.col("batch") < number)
        # A byte of a sketch's row, and in it the bit.
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1
        met = self._spots(own.select("key").distinct()).join(sketches, "slot").where(there)
        hits = met.groupBy("key", "day", "batch").agg(F.count_distinct("slot", "bit").alias("n"))
        wanted = self._spots(own.select("key").distinct()).groupBy("key").agg(F.count_distinct("slot", "bit").alias("all"))
        perhaps = hits.join(wanted, "key").where("n = all").select("key", "day", "batch").persist()
        try:
            folders = [(r["day"], r["batch"]) for r in perhaps.select("day", "batch").distinct().collect()]  # a row a day and batch at most
            if not folders:
                return rows
            days, batches = sorted({d for d, _ in folders}), sorted({b for _, b in folders})
            known = spark.read.parquet(f"{self.path}/keys").where(F.col("day").isin(days) & F.col("batch").isin(batches))
            known = known.join(perhaps.select("key", "day", "batch"), ["key", "day", "batch"], "left_semi").select("key").distinct()
            gone = own.join(known, "key", "left_semi").select("wiki", "rev_id", "stream_id").distinct()
            same = rows["wiki"].eqNullSafe(gone["wiki"]) & rows["rev_id"].eqNullSafe(gone["rev_id"]) & rows["stream_id"].eqNullSafe(gone["stream_id"])
            from ..tables import cut

            return cut(rows.join(gone, same, "left_anti"), "fresh")
        finally:
            perhaps.unpersist()

    def add(self, rows: DataFrame, number: int, day: date) -> None:
        """Keys and sketch of a batch; a batch that is run again writes its own anew."""
        both = {"day": F.lit(day), "batch": F.lit(number).cast("long")}
        keys = self._keys(rows).distinct()
        sinks.replace_partitions(keys.withColumns(both), f"{self.path}/keys", "day", "batch")
        bits = self._spots(keys).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
        sinks.replace_partitions(bits.withColumns(both), f"{self.path}/sketches", "day", "batch")

    def merge_day(self, spark, day: date) -> None:
        """The sketches and keys of a day's batches as one, under the last batch's number: fewer files to look at, the same answers for later batches."""
        for name, one in (("keys", lambda t: t.groupBy("key").agg(F.max("batch").alias("batch"))), ("sketches", lambda t: t.groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits")))):
            from ..tables import cut

            there = spark.read.parquet(f"{self.path}/{name}").where(F.col("day") == F.lit(day))
            last = there.agg(F.max("batch").alias("b")).first()["b"]
            if last is None:
                continue
            whole = cut(one(there).drop("batch").withColumns({"day": F.lit(day), "batch": F.lit(last).cast("long")}), "day")
            old = [r["batch"] for r in there.select("batch").distinct().collect()]
            sinks.replace_partitions(whole, f"{self.path}/{name}", "day", "batch")
            for b in old:
                if b != last:
                    sinks.drop_partition(spark, f"{self.path}/{name}", day=day, batch=b)


def once(seen: Seen, work: Callable[[DataFrame, int], None], today: Callable[[], date] = lambda: datetime.now(timezone.utc).date()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: work(rows that have not come before, number), however long ago the others came."""

    def run(batch: DataFrame, number: int) -> None:
        rows = seen.fresh(batch, number)
        seen.add(rows, number, today())
        work(rows, number)

    return run
