"""What a dashboard asks for, as functions of tables. Times are given, never taken from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import pages, ranking
from ..operators.graph import first_by
from ..operators.windows import PAGE, last_per_page


def live_candidates(windows: DataFrame, limit: int = 50) -> DataFrame:
    """The latest 24h row of each page, by score and reverts."""
    latest = first_by(windows.where("`window` = '24h'"), PAGE, F.desc("ts"), F.desc("rev_id"))
    return latest.orderBy(F.desc("score"), F.desc("reverts"), *PAGE).limit(limit)


def active_episodes(episodes: DataFrame, limit: int = 50) -> DataFrame:
    return episodes.where("status = 'active'").orderBy(F.desc("peak_score"), F.desc("started_at"), *PAGE).limit(limit)


def episode_scoreboard(episodes: DataFrame, now, hours: int = 24, limit: int = 50) -> DataFrame:
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return episodes.where(F.col("started_at") >= since).orderBy(F.desc("reverts"), F.desc("pairs"), F.desc("peak_score"), F.desc("score_area"), *PAGE).limit(limit)


def periods(aggregates: DataFrame, snapshots: DataFrame) -> DataFrame:
    return aggregates.select("period").union(snapshots.select("period")).distinct().where("startswith(period, 'history')").orderBy(F.desc("period"))


def scoreboard(rows: DataFrame, method: str, limit: int, min_score: float = 0.0, month: bool = False, evidence: DataFrame | None = None) -> DataFrame:
    """The board of a period: a month has one method, a year four. Evidence overlays the edit-war board after its order is settled."""
    if month or method == "edit-war":
        board = ranking.edit_war(rows, min(200, max(3 * limit, 30)), min_score, drop_cleanup=not month)
        if evidence is not None:
            board = ranking.overlay(board, evidence, ["segments", "controversy_score"], PAGE)
        return board.orderBy("rank").limit(limit)
    return {"page-war": ranking.page_war, "most-discussed": ranking.most_discussed, "governance": ranking.governance}[method](rows, limit, min_score)


def latest_period(snapshots: DataFrame) -> str | None:
    """The period of a board that is asked for without one."""
    return snapshots.agg(F.max("period").alias("p")).first()["p"]


def historical_board(snapshots: DataFrame, period: str | None = None, limit: int = 50) -> DataFrame:
    """The stored rows (period, rank, ...) of a period, of the latest by default, by rank."""
    ends = snapshots.agg(F.max("period").alias("__latest")) if period is None else None
    rows = snapshots.where(F.col("period") == period) if period is not None else snapshots.join(ends, F.col("period") == F.col("__latest"), "left_semi")
    return rows.orderBy("rank").limit(limit)


def page_detail(edits: DataFrame, windows: DataFrame, wiki: str, page_id: int) -> tuple[DataFrame, DataFrame]:
    """The last 50 edits and the last 60 windows of a page."""
    one = lambda df: df.where((F.col("wiki") == wiki) & (F.col("page_id") == page_id))
    return last_per_page(one(edits), 50, F.desc("ts"), F.desc("rev_id")), last_per_page(one(windows), 60, F.desc("ts"), F.desc("rev_id"))


def month_board(history: DataFrame, edges: DataFrame, limit: int, min_score: float) -> DataFrame:
    return ranking.edit_war(pages.score_pages(history, edges), limit, min_score)


def page_edits(edits: DataFrame, wiki: str, page_id: int, since=None) -> DataFrame:
    """A page's rows since a time; all conditions reach the scan."""
    one = edits.where((F.col("wiki") == wiki) & (F.col("page_id") == page_id))
    return one if since is None else one.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def page_links(title: Column, rev_id: Column, site: str = "https://en.wikipedia.org") -> Column:
    """struct(article, history, talk, diff): where a page is read; no diff without a revision."""
    name = F.replace(F.coalesce(title, F.lit("")), F.lit(" "), F.lit("_"))
    url = lambda *x: F.concat(F.lit(site), *[F.lit(y) if isinstance(y, str) else y for y in x])
    diff = F.when(F.coalesce(rev_id, F.lit(0)) != 0, url("/w/index.php?diff=", rev_id.cast("string"))).otherwise(F.lit(""))
    return F.struct(url("/wiki/", name).alias("article"), url("/w/index.php?title=", name, "&action=history").alias("history"), url("/wiki/Talk:", name).alias("talk"), diff.alias("diff"))


def segments(payloads: DataFrame, states: DataFrame, wiki: str, page_id: int, period: str) -> DataFrame:
    """The stored evidence of a page and period; without any, a row that says how far the job on the period is (states: sinks.status())."""
    found = payloads.where((F.col("period") == period) & (F.col("wiki") == wiki) & (F.col("page_id") == page_id)).withColumn("source", F.lit("local_revision_dump"))
    phase = F.get_json_object("state", "$.phase")
    message = F.when(phase == "running", "Evidence for this period is still being collected.").when(phase == "complete", "Evidence for this period is complete, but has none for this page.")
    asked = payloads.sparkSession.range(1).select(F.lit(period).alias("period"))
    state = asked.join(states.where(F.col("job") == period).select(F.col("job").alias("period"), "state"), "period", "left")
    none = state.select("period", F.lit(wiki).alias("wiki"), F.lit(page_id).cast("long").alias("page_id"), F.lit("local_evidence_missing").alias("source"), F.coalesce(message, F.lit("Evidence for this period hasn't been collected yet.")).alias("message"))
    none = none.join(found.select("period"), "period", "left_anti")
    return found.withColumn("message", F.lit("")).unionByName(none, allowMissingColumns=True)
