"""History dumps: headerless TSV, plain or compressed, to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HISTORY, HISTORY_WIDTH


def read(spark: SparkSession, path: str | list[str], namespace: int = 0) -> DataFrame:
    """All files of a path or glob, with the part of their names before .tsv as `month`: SNAPSHOT.WIKI.MONTH.tsv.bz2. bz2 is split by Spark, gz is not."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"([^.]+)\.tsv", 1).alias("month"))
    return parse(lines, namespace, ["month"])


def parse(lines: DataFrame, namespace: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Revisions that people created, of lines (value). Namespace 0 takes its talk pages (1) along; any other takes itself alone.

    Lines that are too short, without page, revision or a time that parses go; other numbers default to 0."""
    # Generated, the cells of a line are cut once: conditions on them aren't pushed below, each with a cut of its own.
    cells = lines.select(F.explode(F.array(F.split("value", "\t", -1))).alias("c"), *(keep or [])).where(F.size("c") >= HISTORY_WIDTH)
    c = {name: F.get("c", F.lit(i)) for name, i in HISTORY.items()}
    number = lambda name: F.coalesce(c[name].try_cast("bigint"), F.lit(0))
    true = lambda name: F.lower(c[name]) == "true"
    some = lambda *x: F.coalesce(*[F.when(v != "", v) for v in x])
    ns = c["namespace"].try_cast("int")
    bot = (c["bot_by_historical"] != "") | (c["bot_by"] != "") | true("bot")
    ts = F.try_to_timestamp(c["timestamp"], F.lit("yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"))
    kept = cells.where((c["entity"] == "revision") & (c["type"] == "create") & (ns.isin(0, 1) if namespace == 0 else ns == namespace) & ~bot & (number("page_id") != 0) & (number("rev_id") != 0) & ts.isNotNull())
    return kept.select(
        c["wiki"].alias("wiki"), number("page_id").alias("page_id"), F.coalesce(some(c["title"], c["title_historical"]), F.concat(F.lit("page:"), number("page_id").cast("string"))).alias("page_title"), ns.alias("namespace"),
        number("rev_id").alias("rev_id"), ts.alias("ts"), F.coalesce(some(c["user"], c["user_historical"]), F.lit("unknown")).alias("user_text"), c["comment"].alias("comment"), number("bytes").alias("text_bytes"),
        number("bytes_diff").alias("bytes_diff"), true("is_reverted").alias("is_reverted"), F.when(number("first_reverting") != 0, number("first_reverting")).alias("first_reverting"), true("is_revert").alias("is_revert"), *(keep or []),
    )
