"""The scores as column expressions, shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTRA_PAIR_WEIGHT, SEVERITIES
from . import patterns as P


def _num(name: str, columns) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in columns else F.lit(0)


def severity(score: Column) -> Column:
    out = F.lit("quiet")
    for name, least in reversed(SEVERITIES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def live_score(factor: float, human: Column, users: Column, reverts: Column, top_share: Column, pairs: Column, mutual: Column, recent: Column) -> Column:
    """The seven terms of a live window; not rounded."""
    density = F.when(human > 0, reverts / human).otherwise(0.0)
    cleanup = F.when((top_share >= 0.75) & (reverts >= 3), 15.0).otherwise(0.0)
    raw = (
        F.least(F.lit(10.0), human * F.lit(factor * 0.75)) + reverts * F.lit(factor * 5) + F.least(F.lit(25.0), density * 100) + pairs * 12 + mutual * 4
        + F.least(F.lit(10.0), F.greatest(F.lit(0), users - 2) * 3.0) + F.least(F.lit(5.0), recent * 0.5) - cleanup
    )
    return F.greatest(F.lit(0.0), raw)


def window_score(edits: Column, users: Column, reverts: Column, best: Column, total: Column, ends: Column, top_share: Column, current: Column) -> Column:
    """Score of a trailing day. best and total: of pair strengths; ends: users in pairs; current: reverts of the last hour."""
    weighted = best + F.lit(EXTRA_PAIR_WEIGHT) * (total - best)
    factor = F.lit(0.25) + F.least(F.lit(0.75), F.when(edits > 0, reverts / edits).otherwise(1.0) * 0.9)
    combat = F.least(F.lit(12.0), F.greatest(F.lit(0), ends - 2) * 4.0)
    clean = F.when((top_share >= 0.75) & (reverts >= 8), 0.55).otherwise(1.0)
    score = (weighted * factor + combat + F.least(F.lit(4.0), current.cast("double"))) * clean
    return F.when((users < 2) | (reverts == 0) | best.isNull(), 0.0).otherwise(score)


def pair_strength(n: Column, m: Column) -> Column:
    return F.sqrt(F.least(n, m).cast("double")) * 42 + F.greatest(n, m) * 2


def routine_penalty(columns) -> Column:
    """Of a ranking row with columns (names), missing ones counting as 0: how much looks like routine upkeep, 0 to 0.85."""
    at = lambda name: _num(name, columns)
    title = F.replace(F.coalesce(F.col("page_title"), F.lit("")), F.lit("_"), F.lit(" "))
    strong, routine, season = title.rlike(P.STRONG_ROUTINE_TITLE), title.rlike(P.ROUTINE_TITLE), title.rlike(P.SEASON_TITLE)
    rc, pairs, users, edits, mutual = at("revert_count"), at("mutual_revert_pairs"), at("unique_editors"), at("edit_count"), at("mutual_revert_count")
    top, strongest, density, peak = at("top_reverter_share"), at("strongest_pair_share"), at("revert_density"), at("peak_score")
    return F.greatest(F.lit(0.0), F.least(F.lit(0.85), (
        F.when(strong, 0.32).otherwise(0.0) + F.when(routine, 0.20).otherwise(0.0) + F.when(season, 0.14).otherwise(0.0)
        + F.when((top >= 0.78) & (rc >= 8), 0.24).when((top >= 0.65) & (rc >= 8), 0.12).otherwise(0.0)
        + F.when((strongest >= 0.88) & (pairs <= 1) & (users <= 6), 0.16).when((strongest >= 0.75) & (pairs <= 2) & (users <= 10), 0.08).otherwise(0.0)
        + F.when((edits >= 80) & (mutual <= 2), 0.16).when((edits >= 45) & (mutual <= 1), 0.10).otherwise(0.0)
        + F.when(strong & (pairs <= 4), 0.16).when(routine & (pairs <= 2), 0.12).otherwise(0.0)
        + F.when(routine & (density < 0.25) & (peak < 160), 0.10).otherwise(0.0)
    )))


def page_war_score() -> Column:
    root = lambda name: F.sqrt(F.col(name).cast("double"))
    return (
        root("reverted_count") * 24 + root("reverting_count") * 18 + root("mutual_reverts") * 16 + F.least(F.lit(42.0), F.col("mutual_revert_pairs") * 8.0)
        + F.least(F.lit(50.0), F.log1p("edit_count") * 6) + F.least(F.lit(35.0), root("unique_editors") * 4.2)
        + F.least(F.lit(45.0), F.log1p("talk_bytes") * 3.2) + F.least(F.lit(25.0), root("talk_edits") * 4)
    )


def governance_score() -> dict[str, Column]:
    """debate, protection, article and evidence of a row with talk, admin and title signals."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    root = lambda x: F.sqrt(x.cast("double"))
    events, days = c("protection_events"), c("protection_days")
    return {
        "debate": c("rfc") * 90.0 + c("arb") * 120 + c("restriction") * 70 + F.least(F.lit(110.0), root(c("talk_edits")) * 10)
        + F.least(F.lit(95.0), F.log1p(c("talk_bytes")) * 6) + F.least(F.lit(45.0), root(c("talk_users")) * 4),
        "protection": c("restriction_count") * 70.0 + c("has_sysop").cast("int") * 130 + c("has_extendedconfirmed").cast("int") * 100
        + c("has_cascade").cast("int") * 35 + F.least(F.lit(180.0), events * 18.0) + F.least(F.lit(160.0), root(days) * 9),
        "article": F.least(F.lit(180.0), root(c("reverted_count") + c("reverting_count")) * 17) + F.least(F.lit(90.0), root(c("mutual_reverts")) * 11)
        + F.least(F.lit(80.0), c("mutual_revert_pairs") * 12.0),
        "evidence": (c("rfc") + c("arb") + c("restriction") + c("restriction_count") + events).cast("long"),
    }


def battle_score(changes: Column, reverts: Column, editors: Column, words: Column, change_type: Column) -> Column:
    size = F.when(words <= 0, 1.0).when(words <= 6, 1.12).when(words <= 14, 1.0).when(words <= 28, 0.72).when(words <= 50, 0.45).otherwise(0.25)
    base = reverts * 12.0 + changes * 2.0 + F.least(F.lit(10.0), F.greatest(F.lit(0), editors - 1) * 3.0)
    base = base + F.when((change_type == "swap") & (words <= 6), 8.0).otherwise(0.0)
    base = base * F.when(reverts < 3, 0.45).otherwise(1.0)
    return F.when(editors < 2, 0.0).otherwise(F.round(base * size, 2))
