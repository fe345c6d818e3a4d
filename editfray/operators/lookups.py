"""Joins by range, by several keys in turn, and on what is already there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut


def shards_of(ids: DataFrame, shards: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id and the first shard (by start, then file name) whose range start_id..end_id holds it. shards is a listing of files.

    Of overlapping shards the first keeps the ids; then ranges are disjoint, and are dealt to slots of their mean
    width: an equi-join, in which a range has two slots on average."""
    by_start = Window.orderBy("start_id", "filename").rowsBetween(Window.unboundedPreceding, -1)
    # A row a file: this window holds the listing, not ids.
    own = shards.withColumn("start_id", F.greatest("start_id", F.coalesce(F.max("end_id").over(by_start) + 1, F.col("start_id")))).where("start_id <= end_id")
    width = own.agg(F.ceil(F.avg(F.col("end_id") - F.col("start_id") + 1)).cast("long").alias("w")).first()["w"] or 1
    slot = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    dealt = own.select("filename", "start_id", "end_id", F.explode(F.sequence(slot("start_id"), slot("end_id"))).alias("slot"))
    met = ids.where(F.col(id_col) > 0).withColumn("slot", slot(id_col)).join(dealt, "slot")
    return met.where(F.col(id_col).between(F.col("start_id"), F.col("end_id"))).select(id_col, "filename").distinct()


def match_candidates(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """pages (title, namespace, page_id) with the candidate they belong to: by title, else by id. Two equi-joins, never one on either key."""
    by_title = candidates.select(F.col("title").alias("title"), F.col("candidate").alias("c1")).dropDuplicates(["title"])
    by_id = candidates.select("page_id", F.col("candidate").alias("c2")).dropDuplicates(["page_id"])
    joined = pages.join(by_title, "title", "left").join(by_id, "page_id", "left")
    return joined.withColumn("candidate", F.coalesce("c1", "c2")).where("candidate IS NOT NULL").drop("c1", "c2")


def first_hits(rows: DataFrame, wanted: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Of each wanted key, the value of its first row in an order."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def first_hits_in_waves(wanted: DataFrame, units: Sequence[str], read: Callable[[list[str]], DataFrame], key: str, value: str, *order: str, wave: int = 1) -> DataFrame:
    """first_hits() over units that are read in their order, a few at a time, twice as many each time: what is found is no longer wanted, and when nothing is, no more is read.

    A key's row comes from the first wave that has one; `order` decides in a wave, so it begins with what the units are ordered by."""
    left, found = cut(wanted.select(key).distinct(), "wanted"), None
    todo = list(units)
    while todo and not left.isEmpty():
        now, todo, wave = todo[:wave], todo[wave:], 2 * wave
        hits = cut(first_hits(read(now), left, key, value, *order), "hits")
        found = hits if found is None else found.unionByName(hits)
        left = cut(left.join(hits, key, "left_anti"), "wanted")
    return found if found is not None else left.withColumn(value, F.lit(None))


def adjacent(revisions: DataFrame, keys: list[str], order: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Each revision with `columns` of the one before it; the first has none and is left out."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = revisions.withColumn("prev", F.lag(F.struct(*columns)).over(by))
    return rows.where("prev IS NOT NULL")


def revert_pairs(meta: DataFrame, content: DataFrame, keys: list[str], order: tuple[str, ...], is_revert, full_limit: int = 220) -> DataFrame:
    """Adjacent pairs with content. Pages of more than full_limit revisions keep the pairs that revert alone: adjacency is settled before, content is joined after."""
    n = F.count("*").over(Window.partitionBy(*keys))
    pairs = adjacent(meta.withColumn("n", n).withColumn("is_revert", is_revert), keys, order, ["rev_id", "user_text", "comment"]).where((F.col("n") <= full_limit) | F.col("is_revert"))
    full = content.where("content <> ''").select("rev_id", "content")
    out = pairs.join(full, "rev_id").join(full.select(F.col("rev_id").alias("p_rev"), F.col("content").alias("prev_content")), F.col("prev.rev_id") == F.col("p_rev")).drop("p_rev")
    return out


def pending(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return listed.join(done.select(key), key, "left_anti")


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Insert-or-ignore: rows of batch whose key is not there yet, the first of each key; a null key never counts as a repeat."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = batch.where(known).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return first.join(existing.select(*keys), keys, "left_anti").select(*batch.columns).unionByName(batch.where(~known))


def preferred_formats(files: DataFrame, prefer: list[str]) -> DataFrame:
    """files (base, suffix, name): of each base the best suffix; all of them if none is preferred, and whatever stands alone."""
    rank = F.coalesce(F.when(F.size(F.lit(prefer)) > 0, F.array_position(F.lit(prefer), F.col("suffix"))), F.lit(0))
    by = Window.partitionBy("base")
    rows = files.withColumn("p", F.when(rank > 0, rank)).withColumn("best", F.min("p").over(by)).withColumn("n", F.count("*").over(by))
    return rows.where("n = 1 OR best IS NULL OR p = best").select("base", "suffix", "name")
