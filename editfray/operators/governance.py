"""Signals of administration: page restrictions and protected time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lookup_title

START_ACTIONS = ("protect", "modify", "move_prot")


def restrictions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, type, level, cascade, expiry. Sorted distinct types and levels, flags, and the last expiry; infinity is after any date."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("restriction_count"), F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("restriction_types"),
        F.array_join(F.sort_array(F.collect_set("level")), ", ").alias("restriction_levels"), F.bool_or(F.col("level") == "extendedconfirmed").alias("has_extendedconfirmed"),
        F.bool_or(F.col("level") == "sysop").alias("has_sysop"), F.bool_or(F.col("cascade") > 0).alias("has_cascade"),
        F.when(F.bool_or(F.col("expiry") == "infinity"), "infinity").otherwise(F.max("expiry")).alias("restriction_expiry"),
    )


def protected_time(events: DataFrame, keys: list[str], open_until, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """events: keys, ts, action. Number of events, days under protection, first and last event.

    An interval starts with the first event of START_ACTIONS after an unprotect, ends with the next unprotect, and is closed at open_until
    if none comes. Islands are the running number of unprotects before. Where a protect and an unprotect share a time, their order in
    `order` settles which comes first, and an interval without length adds no days."""
    known = events.where(F.col("action").isin(*START_ACTIONS, "unprotect"))
    by = Window.partitionBy(*keys).orderBy(*order)
    ends = (F.col("action") == "unprotect").cast("int")
    rows = known.withColumn("island", F.coalesce(F.sum(ends).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    islands = rows.groupBy(*keys, "island").agg(
        F.min(F.when(F.col("action") != "unprotect", F.unix_timestamp("ts"))).alias("start"), F.max(F.when(F.col("action") == "unprotect", F.unix_timestamp("ts"))).alias("end"),
        F.count("*").alias("n"), F.min(F.when(F.col("action") != "unprotect", F.col("ts"))).alias("first"), F.max("ts").alias("last"),
    )
    stop = F.coalesce("end", F.unix_timestamp(open_until))
    return islands.groupBy(*keys).agg(
        F.sum("n").alias("protection_events"), F.round(F.coalesce(F.sum(F.when(stop > F.col("start"), stop - F.col("start"))), F.lit(0)) / 86400, 2).alias("protection_days"),
        F.min("first").alias("first_protection_at"), F.max("last").alias("last_protection_at"),
    )


def with_signals(rows: DataFrame, admin: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the restrictions of their page (by keys) and the protection of their title, in its one form for look-ups; no row is lost or doubled.

    titles: page_title in that form, and its signals, a row a title."""
    known = titles.withColumnRenamed("page_title", "__title")
    return rows.join(admin, keys, "left").join(known, lookup_title(F.col("page_title")) == F.col("__title"), "left").drop("__title")
