"""The directed graph of reverts between users, and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import pair_strength
from ..schema import EFFECTIVE_EDGE


def identity_edges(history: DataFrame) -> DataFrame:
    """One edge for each reverting revision: its user reverts the user whom it undid most often, the first of several.

    history: wiki, page_id, rev_id, ts, user_text, first_reverting. Only earlier revisions of the same page count; self edges go."""
    undone = history.where(F.col("first_reverting").isNotNull()).select(
        "wiki", "page_id", F.col("first_reverting").alias("rev_id"), F.col("user_text").alias("dst"), F.col("ts").alias("o_ts"), F.col("rev_id").alias("o_rev")
    )
    doing = history.select("wiki", "page_id", "rev_id", "ts", F.col("user_text").alias("src"))
    met = undone.join(doing, ["wiki", "page_id", "rev_id"]).where((F.col("o_ts") < F.col("ts")) | ((F.col("o_ts") == F.col("ts")) & (F.col("o_rev") < F.col("rev_id"))))
    keys = ["wiki", "page_id", "rev_id", "ts", "src"]
    counted = met.groupBy(*keys, "dst").agg(F.count("*").alias("n"), F.min(F.struct("o_ts", "o_rev")).alias("first"))
    # The order of struct fields is the order of the choice: most often, then first seen.
    mode = counted.groupBy(*keys).agg(F.min_by("dst", F.struct(-F.col("n"), F.col("first"))).alias("dst"))
    return mode.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))


def edge_counts(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """keys, src, dst, n; null, empty and self edges are left out."""
    good = (F.col(src) != "") & (F.col(dst) != "") & (F.col(src) != F.col(dst))
    return edges.where(good).groupBy(*keys, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("n"))


def effective_edges(counts: DataFrame, least: int = EFFECTIVE_EDGE) -> DataFrame:
    return counts.where(F.col("n") >= least)


def pairs(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u1 < u2, ab (u1 reverts u2) and ba: edges in both directions, put together by a group instead of a self join."""
    ends = {"u1": F.least("src", "dst"), "u2": F.greatest("src", "dst")}
    both = counts.withColumns(ends).groupBy(*keys, "u1", "u2").agg(
        F.sum(F.when(F.col("src") == F.col("u1"), F.col("n")).otherwise(0)).alias("ab"), F.sum(F.when(F.col("src") == F.col("u2"), F.col("n")).otherwise(0)).alias("ba")
    )
    return both.where("ab > 0 AND ba > 0")


def mutual_edges(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of counts, the edges whose reverse is there, too."""
    found = pairs(counts, keys)
    there = found.select(*keys, F.col("u1").alias("src"), F.col("u2").alias("dst"), F.col("ab").alias("n"))
    return there.unionByName(found.select(*keys, F.col("u2").alias("src"), F.col("u1").alias("dst"), F.col("ba").alias("n")))


def pair_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the mutual pairs under each key: pairs, mutual (sum of smaller directions), reverts (both), best and total strength,
    ends (users in pairs), top_share (of the busiest reverter) and strongest_share (of the busiest pair)."""
    found = pairs(counts, keys)
    by_pair = found.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.sum(F.least("ab", "ba")).alias("mutual"), F.sum(F.col("ab") + F.col("ba")).alias("reverts"),
        F.max(pair_strength(F.col("ab"), F.col("ba"))).alias("best"), F.sum(pair_strength(F.col("ab"), F.col("ba"))).alias("total"),
        F.max(F.col("ab") + F.col("ba")).alias("strongest"),
    )
    users = found.select(*keys, F.explode(F.array(F.struct(F.col("u1").alias("u"), F.col("ab").alias("n")), F.struct(F.col("u2").alias("u"), F.col("ba").alias("n")))).alias("x"))
    by_user = users.groupBy(*keys, F.col("x.u").alias("u")).agg(F.sum("x.n").alias("n")).groupBy(*keys).agg(F.count("*").alias("ends"), F.max("n").alias("top"))
    return by_pair.join(by_user, keys).select(
        *keys, "pairs", "mutual", "reverts", "best", "total", "ends", (F.col("top") / F.col("reverts")).alias("top_share"), (F.col("strongest") / F.col("reverts")).alias("strongest_share")
    )


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
