"""Whole jobs over dumps and stored tables: months in, boards and evidence out. Each can be run again: what is done is
listed in a manifest, and partitions are replaced whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as ev
from ..operators import governance, graph, lookups, pages, ranking
from ..operators.windows import PAGE
from ..sources import history_rows, sql_dump, wiki_dump, wiki_xml
from ..streaming import sinks
from ..tables import cut

ORDER = ("ts", "rev_id")


def boards(rows: DataFrame, limit: int, min_score: float, by: str = "period") -> DataFrame:
    """The first `limit` rows of every period, ranked: a period's rows are cut by tasks before they meet."""
    order = Window.partitionBy(by).orderBy(*[F.desc(c) for c in ranking.ORDERS["edit-war"]], *PAGE)
    return ranking.passes(rows, min_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def talk_of(history: DataFrame) -> DataFrame:
    """Talk rows of a history with the page of the article that their title belongs to."""
    titled = history.withColumn("title", T.history_title(F.col("page_title")))
    routed = pages.talk_pages(titled.where("namespace = 0"), titled.where("namespace = 1"))
    return titled.where("namespace = 1").drop("page_id").join(routed.select("wiki", "title", *ORDER, F.col("article_id").alias("page_id")), ["wiki", "title", *ORDER])


def store_months(spark: SparkSession, history: DataFrame, records: str, board: str, limit: int = 100, min_score: float = 40.0, period: str | None = None) -> None:
    """Months of a history (history_rows.read(), with period): their records and boards, written by period. With `period` the history is all of that
    one: what it doesn't hold any more goes, too."""
    articles = history.where("namespace = 0")
    stored = pages.month_records(articles, graph.identity_edges(articles), talk_of(history), "period")
    only = {"period": period} if period else None
    sinks.replace_partitions(stored, records, "period", only=only)
    # The boards of these months alone: those of others may be at work.
    written = [period] if period else [r["period"] for r in history.select("period").distinct().collect()]
    for one in sorted(p for p in written if p):
        recompute_boards(spark, records, board, limit, min_score, one)


def process_history(spark: SparkSession, files: DataFrame, snapshot: str, records: str, board: str, manifest: str, workers: int = 3, **how) -> int:
    """Files (name, partition: YYYY-MM or YYYY) of a snapshot that the manifest doesn't list yet. How many partitions there were.

    Several are at work at a time, each with jobs of its own; one that fails is named at the end, and leaves the others listed."""
    names = {}
    for r in files.select("partition", "name").collect():  # names of files, not their rows
        names.setdefault(r["partition"], []).append(r["name"])

    def work(partition: str) -> None:
        rows = history_rows.read(spark, names[partition]).withColumn("period", F.concat(F.lit(f"history:{snapshot}:"), "month"))
        store_months(spark, rows, records, board, period=f"history:{snapshot}:{partition}" if len(partition) == 7 else None, **how)

    return sinks.run_pending_each(spark, files, manifest, "partition", work, workers)


def recompute_boards(spark: SparkSession, records: str, board: str, limit: int = 100, min_score: float = 40.0, period: str | None = None) -> None:
    """Score stored months anew, all or one, and replace their boards; a board that nothing reaches any more is emptied."""
    if period and not sinks.exists(spark, sinks.partition_path(records, period=period)):
        return sinks.drop_partition(spark, board, period=period)
    stored = spark.read.parquet(records)
    stored = stored.where(F.col("period") == period) if period else stored
    rows = boards(pages.rescored(stored, "period"), limit, min_score)
    sinks.replace_partitions(rows, board, "period", only={"period": period} if period else None)
    return None


def year_board(records: DataFrame, year_period: str, limit: int, min_score: float = 0.0) -> DataFrame:
    """A year's edit-war board from its stored months (period as history:SNAPSHOT:YYYY-MM)."""
    rows = records.withColumn("year", T.period_year(F.col("period"))).where(F.col("year") == year_period)
    return ranking.edit_war(pages.year_rollup(rows), limit, min_score, drop_cleanup=True)


def import_restrictions(spark: SparkSession, path: str, table: str, wiki: str) -> None:
    rows = governance.restrictions(sql_dump.restrictions(spark, path), ["page_id"]).withColumn("wiki", F.lit(wiki))
    sinks.replace_partitions(rows, table, "wiki", only={"wiki": wiki})


def import_protection(spark: SparkSession, path: str, table: str, wiki: str, until: Column) -> None:
    rows = governance.protected_time(wiki_xml.protection_events(spark, path), ["page_title"], until).withColumn("wiki", F.lit(wiki))
    sinks.replace_partitions(rows, table, "wiki", only={"wiki": wiki})


def evidence_inputs(rows: DataFrame) -> DataFrame:
    """Rows of a board that evidence can be sought for: with a page and a title."""
    return rows.where("coalesce(page_id, 0) > 0 AND coalesce(page_title, '') <> ''")


def missing_talk(rows: DataFrame, talk: DataFrame) -> DataFrame:
    return rows.join(talk.select("page_id").distinct(), "page_id", "left_anti")


def talk_page_ids(spark: SparkSession, files: DataFrame, wanted: DataFrame, wave: int = 1) -> DataFrame:
    """title and talk_page_id of the wanted pages (page_title) from history files (name, partition), in the order of their partitions: those after the last one that is found aren't opened."""
    listed = [(r["partition"], r["name"]) for r in files.orderBy("partition", "name").select("partition", "name").collect()]  # names of files, not their rows
    titles = wanted.select(T.history_title(F.col("page_title")).alias("title"))

    def read(names: list[str]) -> DataFrame:
        rows = history_rows.read(spark, names).where("namespace = 1")
        return rows.select(T.history_title(F.col("page_title")).alias("title"), F.col("page_id").alias("talk_page_id"), *ORDER)

    return lookups.first_hits_in_waves(titles, [name for _, name in listed], read, "title", "talk_page_id", *ORDER, wave=wave)


def merged_revisions(*lists: DataFrame) -> DataFrame:
    """Revisions of several shards as one table, each once."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.dropDuplicates(["page_id", "rev_id"])


def page_evidence(rows: DataFrame, revisions: DataFrame, period: str) -> DataFrame:
    """Payloads of pages (board rows: wiki, page_id, page_title, peak_score, revert_count, mutual_revert_pairs) from the revisions of
    their articles (namespace 0) and talk pages (1), both with the page's id as candidate."""
    own = revisions.withColumn("page_id", F.col("candidate"))
    bounds = T.period_bounds(F.lit(period))
    articles, talk = wiki_xml.in_period(own.where("namespace = 0"), bounds["start"], bounds["end"]), wiki_xml.in_period(own.where("namespace = 1"), bounds["start"], bounds["end"])
    # Written on the way: three aggregates read the changes, and what reads the phrases plans from a table.
    changes = cut(ev.pair_segments(articles, ["page_id"], ORDER), "changes")
    found = cut(ev.usable(ev.battles(cut(ev.segment_stats(changes, ["page_id"], ORDER), "stats"), ["page_id"])), "phrases")
    said = cut(ev.talk_evidence(talk, cut(ev.terms(found, ["page_id"]), "terms"), ["page_id"]), "said")
    scores = ev.controversy(rows.select("page_id", "peak_score", "revert_count", "mutual_revert_pairs"), found, ev.talk_scores(said, ["page_id"]), ["page_id"])
    return ev.payload(rows.select("wiki", "page_id", "page_title", F.lit(period).alias("period")), found, said, scores, ["page_id"])


def backfill_evidence(spark: SparkSession, board: DataFrame, dumps: list[str], period: str, table: str, status: str, work: str | None = None) -> None:
    """Evidence for the pages of a period's board, from XML shards, into a table by period; a line on its state before and after.

    What a shard gives is kept in the folder `work` with a record: a run that was stopped goes on with the shards that have none. A record holds for the
    candidates it was made for; others read the shard anew."""
    rows = evidence_inputs(board.where(F.col("period") == period)).drop("period")
    sinks.write_status(spark, status, period, phase="running")
    wanted = rows.select(F.col("page_id").alias("candidate"), "page_title", "page_id", F.lit(0).alias("talk_page_id"))
    bounds = T.period_bounds(F.lit(period))
    since, until = spark.range(1).select(*[F.date_format(bounds[x], "yyyy-MM-dd'T'HH:mm:ss'Z'") for x in ("start", "end")]).first()
    folder = f"{work or table + '.work'}/{period.replace(':', '_')}"
    shards = sinks.resumed(spark, folder, sinks.fingerprint(wanted), dumps, lambda d: wiki_xml.candidate_revisions(wiki_dump.pieces(spark, d), wanted, since, until))
    sinks.replace_partitions(page_evidence(rows, merged_revisions(*shards), period), table, "period", only={"period": period})
    sinks.write_status(spark, status, period, phase="complete", shards=len(shards))


def known_periods(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    return lookups.pending(listed, manifest, "period")
