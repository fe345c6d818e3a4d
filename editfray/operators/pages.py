"""Page and talk aggregates, talk routing, admission, and roll-ups to years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import routine_penalty
from ..functions.text import substantive_talk, talk_flags
from .graph import edge_counts, effective_edges, pair_metrics
from .windows import PAGE, bucket_scores, episodes, hour_edges, hour_edits

ORD = ("ts", "rev_id")


def page_aggregate(edits: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Counts of each page; the title last seen, in the order of time and revision."""
    return edits.groupBy(*keys).agg(
        F.max_by("page_title", F.struct(*ORD)).alias("page_title"), F.count("*").alias("edit_count"), F.count_distinct("user_text").alias("unique_editors"),
        F.min("ts").alias("first_edit"), F.max("ts").alias("last_edit"), F.count_if("is_reverted").alias("reverted_count"), F.count_if("is_revert").alias("reverting_count"),
    )


def talk_aggregate(talk: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Of talk revisions: counts, the largest size that wasn't reverted, and comments on disputes."""
    said = substantive_talk(F.col("comment"))
    flags = {name: F.when(said, c).otherwise(0) for name, c in talk_flags(F.col("comment")).items()}
    return talk.groupBy(*keys).agg(
        F.count("*").alias("talk_edits"), F.count_distinct("user_text").alias("talk_users"),
        F.coalesce(F.max(F.when(~F.col("is_reverted"), F.greatest(F.lit(0), F.col("text_bytes")))), F.lit(0)).alias("talk_bytes"),
        *[F.sum(c).alias(name) for name, c in flags.items()],
    )


def talk_pages(articles: DataFrame, talk: DataFrame) -> DataFrame:
    """talk with page_id of the article of its title: the last article seen under the title before, else the first seen after.

    Both: wiki, title (normalised), ts, rev_id; articles have page_id. An as-of join by two fills over the title's union, with no self join."""
    both = articles.select("wiki", "title", *ORD, "page_id", F.lit(0).alias("is_talk")).unionByName(talk.select("wiki", "title", *ORD, F.lit(None).cast("long").alias("page_id"), F.lit(1).alias("is_talk")))
    order = Window.partitionBy("wiki", "title").orderBy(*ORD, "is_talk")
    before = F.last("page_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Talk before any article waits for the first one: the title's first, once for all of its rows.
    first = both.where("is_talk = 0").groupBy("wiki", "title").agg(F.min_by("page_id", F.struct(*ORD)).alias("first_id"))
    return both.withColumn("before", before).join(first, ["wiki", "title"]).withColumn("article_id", F.coalesce("before", "first_id")).where("is_talk = 1 AND article_id IS NOT NULL").select("wiki", "title", *ORD, "article_id")


def score_pages(edits: DataFrame, edges: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The ranking row of each page: aggregate, mutual reverts over the whole period, peak of the trailing days, episodes, penalty and score."""
    return score_buckets(page_aggregate(edits, keys), hour_edits(edits, keys), hour_edges(edges, keys), keys)


def score_buckets(base: DataFrame, hours: DataFrame, by_hour: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """score_pages() of what is kept of a page: its counts (base: keys, page_title, edit_count, unique_editors, reverted_count, reverting_count), and its hours and their edges."""
    counts = by_hour.groupBy(*keys, "src", "dst").agg(F.sum("n").alias("n"))
    metrics = pair_metrics(effective_edges(counts), keys)
    days = episodes(bucket_scores(hours, by_hour, keys), keys)
    rows = base.join(metrics, keys, "left").join(days, keys, "left").fillna(0, ["pairs", "mutual", "reverts", "top_share", "strongest_share", "peak_score", "episode_count", "war_minutes"])
    rows = rows.select(
        *keys, "page_title", "edit_count", "unique_editors", "reverted_count", "reverting_count", F.col("reverts").alias("revert_count"), F.col("pairs").alias("mutual_revert_pairs"),
        F.col("mutual").alias("mutual_revert_count"), F.round("top_share", 4).alias("top_reverter_share"), F.round("strongest_share", 4).alias("strongest_pair_share"),
        F.round(F.col("reverts") / F.col("edit_count"), 4).alias("revert_density"), "peak_score", "episode_count", "war_minutes",
    )
    penalty = routine_penalty(set(rows.columns))
    return rows.withColumn("routine_penalty", F.round(penalty, 4)).withColumn("candidate_score", F.round(F.col("peak_score") * (1 - penalty), 2))


TALK = ("talk_edits", "talk_users", "talk_bytes", "rfc", "arb", "restriction")


def month_records(edits: DataFrame, edges: DataFrame, talk: DataFrame | None = None, period: str = "month") -> DataFrame:
    """What is stored of a page and month: counts, and its hours as an array of struct(bucket, edit_count, editors: a map, edges: src, dst, n).

    edits and talk: with the column `period`; edges: of identity_edges(), in the period of the edit that reverts. Months that aren't admitted are left out."""
    keys = [period, *PAGE]
    edges = edges.join(edits.select(*keys, "rev_id"), [*PAGE, "rev_id"])
    by_user = edits.groupBy(*keys, F.date_trunc("hour", "ts").alias("bucket"), "user_text").agg(F.count("*").alias("n"))
    hours = by_user.groupBy(*keys, "bucket").agg(F.sum("n").alias("edit_count"), F.map_from_entries(F.collect_list(F.struct("user_text", "n"))).alias("editors"))
    by_hour = hour_edges(edges, keys)
    lists = by_hour.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "n"))).alias("edges"))
    none = F.array().cast("array<struct<src: string, dst: string, n: bigint>>")
    hour = F.struct("bucket", "edit_count", "editors", F.coalesce("edges", none).alias("edges"))
    buckets = hours.join(lists, [*keys, "bucket"], "left").groupBy(*keys).agg(F.collect_list(hour).alias("buckets"))
    metrics = pair_metrics(effective_edges(edge_counts(edges, keys)), keys).select(*keys, F.col("reverts").alias("revert_count"), F.col("pairs").alias("mutual_revert_pairs"))
    said = talk_aggregate(talk, keys) if talk is not None else edits.select(*keys).limit(0).withColumns({c: F.lit(0) for c in TALK})
    rows = page_aggregate(edits, keys).join(metrics, keys, "left").join(said, keys, "left").fillna(0, ["revert_count", "mutual_revert_pairs", *TALK])
    return admitted(rows.withColumn("mutual_revert_count", F.col("revert_count"))).drop("mutual_revert_count").join(buckets, keys)


def stored_hours(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The hours of month_records() and their edges, as score_buckets() takes them: a key's records, of several months perhaps, are merged."""
    flat = records.select(*keys, F.explode("buckets").alias("h")).select(*keys, "h.*")
    hours = flat.groupBy(*keys, "bucket").agg(F.sum("edit_count").alias("edit_count"), F.array_distinct(F.flatten(F.collect_list(F.map_keys("editors")))).alias("editors"))
    edges = flat.select(*keys, "bucket", F.explode("edges").alias("e")).groupBy(*keys, "bucket", "e.src", "e.dst").agg(F.sum("e.n").alias("n"))
    return hours, edges


def rescored(records: DataFrame, period: str = "month") -> DataFrame:
    """The ranking rows of stored months, scored anew from their hours: what a change of the rules takes."""
    keys = [period, *PAGE]
    return score_buckets(records, *stored_hours(records, keys), keys)


def year_rollup(records: DataFrame, year: str = "year") -> DataFrame:
    """The ranking rows of years, from stored months (month_records() with a column `year`): counts are summed, users are counted anew
    from the hours, and trailing days run on over the ends of months."""
    keys = [year, *PAGE]
    hours, edges = stored_hours(records, keys)
    users = hours.select(*keys, F.explode("editors").alias("u")).groupBy(*keys).agg(F.count_distinct("u").alias("unique_editors"))
    total = ["edit_count", "reverted_count", "reverting_count", "talk_edits", "talk_users", "rfc", "arb", "restriction"]
    base = records.groupBy(*keys).agg(F.max("page_title").alias("page_title"), *[F.sum(c).alias(c) for c in total], F.max("talk_bytes").alias("talk_bytes"), F.min("first_edit").alias("first_edit"), F.max("last_edit").alias("last_edit"))
    return score_buckets(base.join(users, keys), hours, edges, keys)


def admitted(rows: DataFrame) -> DataFrame:
    """Pages whose aggregates are worth keeping."""
    return rows.where(
        "mutual_revert_count > 0 OR mutual_revert_pairs > 0 OR reverted_count >= 3 OR reverting_count >= 3 "
        "OR (edit_count >= 40 AND unique_editors >= 8 AND reverted_count + reverting_count >= 2) OR talk_edits >= 3 OR talk_bytes >= 12000 OR rfc + arb + restriction > 0"
    )


def year_stats(months: DataFrame) -> DataFrame:
    """Sums of a page's months in a year; users are summed over months, talk size is the largest."""
    total = ["edit_count", "unique_editors", "reverted_count", "reverting_count", "mutual_reverts", "mutual_revert_pairs", "talk_edits", "talk_users", "rfc", "arb", "restriction"]
    return months.groupBy("year", *PAGE).agg(F.max_by("page_title", "month").alias("page_title"), *[F.sum(c).alias(c) for c in total], F.max("talk_bytes").alias("talk_bytes"))
