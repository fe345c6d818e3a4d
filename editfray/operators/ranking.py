"""Scoreboards: admission, order and rank of scored pages by four methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scores import governance_score, page_war_score, routine_penalty

ORDERS = {
    "edit-war": ("candidate_score", "mutual_revert_pairs", "revert_count", "peak_score"),
    "page-war": ("candidate_score", "raw_activity", "talk_bytes", "edit_count"),
    "most-discussed": ("candidate_score", "talk_edits", "raw_activity"),
    "governance": ("candidate_score", "evidence", "talk_bytes", "raw_activity"),
}


def top(rows: DataFrame, method: str, limit: int, ties: tuple[str, ...] = ("wiki", "page_id")) -> DataFrame:
    """The first `limit` rows in a method's order, ranked from 1. The limit comes first, so only its rows meet in the window."""
    order = [F.desc(c) for c in ORDERS[method]] + [F.col(c) for c in ties]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def passes(rows: DataFrame, min_score: float) -> DataFrame:
    score = F.coalesce("candidate_score", "peak_score", F.lit(0.0)) if "peak_score" in rows.columns else F.coalesce("candidate_score", F.lit(0.0))
    return rows.where(score >= min_score)


def cleanup_only(columns=None):
    """Whether a row is probably nothing but clean-up by reverts."""
    return (F.col("revert_density") >= 0.82) & (F.col("mutual_revert_pairs") <= 8) & (F.col("unique_editors") <= 40)


def edit_war(rows: DataFrame, limit: int, min_score: float = 0.0, drop_cleanup: bool = False) -> DataFrame:
    kept = passes(rows, min_score)
    return top(kept.where(~cleanup_only()) if drop_cleanup else kept, "edit-war", limit)


def page_war(rows: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    """rows: yearly statistics. Scored by raw activity, damped by the penalty."""
    scored = rows.withColumn("peak_score", F.round(page_war_score(), 2)).withColumn("raw_activity", F.col("reverted_count") + F.col("reverting_count"))
    scored = scored.withColumn("routine_penalty", F.round(routine_penalty(set(scored.columns)), 4))
    scored = scored.withColumn("candidate_score", F.round(F.col("peak_score") * (1 - F.col("routine_penalty")), 2))
    strong = F.replace(F.coalesce("page_title", F.lit("")), F.lit("_"), F.lit(" ")).rlike(P.STRONG_ROUTINE_TITLE)
    return top(passes(scored, min_score).where(~(strong & (F.col("talk_bytes") < 10000) & (F.col("raw_activity") < 45))), "page-war", limit)


def most_discussed(rows: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    scored = rows.where("talk_bytes > 0 OR talk_edits > 0").withColumn("candidate_score", F.col("talk_bytes").cast("double")).withColumn("raw_activity", F.col("reverted_count") + F.col("reverting_count"))
    return top(passes(scored, min_score), "most-discussed", limit)


def governance(rows: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    """rows: yearly statistics with admin and title signals joined (nulls count as none)."""
    parts = governance_score()
    scored = rows.withColumns(parts).withColumn("raw_activity", F.col("reverted_count") + F.col("reverting_count"))
    scored = scored.withColumn("peak_score", F.round(F.col("debate") + F.col("protection") + F.col("article"), 2))
    scored = scored.withColumn("routine_penalty", F.round(routine_penalty(set(scored.columns)) * F.when(F.col("evidence") > 0, 0.35).otherwise(1.0), 4))
    scored = scored.withColumn("candidate_score", F.round(F.col("peak_score") * (1 - F.col("routine_penalty")), 2))
    return top(passes(scored, min_score).where("evidence > 0"), "governance", limit)


def pre_rank(rows: DataFrame, method: str, limit: int) -> DataFrame:
    """The candidates that a method looks at, before scores: it shows in the result once there are more pages than the limit."""
    raw = F.col("reverted_count") + F.col("reverting_count")
    order = {
        "page-war": [F.desc(raw), F.desc("mutual_reverts"), F.desc("talk_bytes"), F.desc("edit_count")],
        "most-discussed": [F.desc("talk_bytes"), F.desc("talk_edits"), F.desc(raw)],
        "governance": [F.desc(F.col("rfc") * 18 + F.col("arb") * 24 + F.col("restriction") * 20 + F.col("talk_edits") + raw), F.desc("talk_bytes"), F.desc(raw)],
        "edit-war": [F.desc("mutual_revert_pairs"), F.desc("mutual_reverts"), F.desc(raw)],
    }[method]
    return rows.orderBy(*order, "wiki", "page_id").limit(limit)


def overlay(rows: DataFrame, evidence: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """rows with the columns of evidence where it has their key, as they are where not."""
    there = evidence.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("has_evidence"))
    joined = rows.join(there, keys, "left")
    new = {c: F.when(F.col("has_evidence"), F.col(f"__{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c in columns}
    return joined.withColumns(new).withColumn("has_evidence", F.coalesce("has_evidence", F.lit(False))).drop(*[f"__{c}" for c in columns])
