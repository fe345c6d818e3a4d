"""Listings of dumps: links of index pages, partitions by month, shards by page range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(html: Column) -> Column:
    """Targets of all links, their entities as they are."""
    return F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda x: x != "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def partitions(names: DataFrame, snapshot: str, wiki: str, first: str = "", last: str = "~") -> DataFrame:
    """partition (a month or year) of history files (name), within inclusive bounds, in order."""
    part = F.regexp_extract(file_name(F.col("name")), rf"^{snapshot}\.{wiki}\.(.+)\.tsv\.bz2$", 1)
    return names.withColumn("partition", part).where((F.col("partition") != "") & (F.col("partition") >= first) & (F.col("partition") <= last))


def shards(names: DataFrame, snapshot_id: str, wiki: str, prefer: list[str] | None = None) -> DataFrame:
    """filename, start_id and end_id of revision shards, one compression of each: the smallest that can be read here (7z is listed where there is nothing else, and must be unpacked first)."""
    from ..operators.lookups import preferred_formats

    files = names.select(file_name(F.col("name")).alias("name")).distinct().withColumn("suffix", F.regexp_extract("name", r"\.(7z|bz2|gz)$", 1))
    files = files.withColumn("base", F.regexp_replace("name", r"\.(7z|bz2|gz)$", ""))
    pattern = rf"^{wiki}-{snapshot_id}-pages-meta-history\d+\.xml-p(\d+)p(\d+)$"
    kept = preferred_formats(files.where(F.col("base").rlike(pattern)), prefer or ["bz2", "gz"])
    return kept.select(F.col("name").alias("filename"), F.regexp_extract("base", pattern, 1).cast("long").alias("start_id"), F.regexp_extract("base", pattern, 2).cast("long").alias("end_id"))
