"""Driver tables as domain tables, deterministically. For tests and benches; operators take domain schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Titles by page, so that the title rules have something to find.
TITLES = ("Example page", "List of episodes", "1998 cup season", "Results and statistics", "Talkative place")
#: Comments by rev_id modulo their number.
COMMENTS = (
    "Copyedit of the lead", "Reverted edits by [[Special:Contributions/U1|U1]] to last revision", "undid revision 4711 by U2 (talk)",
    "rvv obvious nonsense", "see the RfC on page protection", "arbitration enforcement notice", "restored sourced wording, please discuss first",
    "added a reliable source for the birth place",
)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from events, one an event: half of them on 5 busy pages of few users, the rest on pages whose number grows with the
    table; error and purchase events revert."""
    e = read(spark, sf_dir, "events")
    half = F.floor(F.col("event_id") / 2)
    page = F.when(F.col("event_id") % 2 == 0, half * 7919 % 5).otherwise(5 + F.floor(half / 200) * 2 + half * 7919 % 3)
    return e.select(
        F.lit("enwiki").alias("wiki"), page.alias("page_id"), F.element_at(F.array(*map(F.lit, TITLES)), (page % 5 + 1).cast("int")).alias("page_title"),
        F.col("event_id").alias("rev_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), (F.col("user_id") % (2 + page % 3)).cast("string")).alias("user_text"),
        F.element_at(F.array(*map(F.lit, COMMENTS)), (F.col("event_id") % len(COMMENTS) + 1).cast("int")).alias("comment"),
        F.col("event_type").isin("error", "purchase").alias("is_revert"), (F.col("event_id") % 11 == 0).alias("user_is_bot"), (F.col("event_id") % 5000).alias("text_bytes"),
        F.date_format("ts", "yyyy-MM").alias("month"),
    )


def page_order() -> Window:
    return Window.partitionBy("wiki", "page_id").orderBy("ts", "rev_id")


def reverts(edits_: DataFrame) -> DataFrame:
    """Reverts of the page's previous edit."""
    return edits_.withColumn("reverted_user", F.lag("user_text").over(page_order())).where("is_revert").select(
        "wiki", "page_id", "rev_id", "ts", F.col("user_text").alias("reverter_user"), "reverted_user"
    )


def history(edits_: DataFrame) -> DataFrame:
    """Identity reverts as in a history dump: an edit is reverted by the first revert among the page's next two edits."""
    ahead = page_order().rowsBetween(1, 2)
    first = F.first(F.when(F.col("is_revert"), F.col("rev_id")), ignorenulls=True).over(ahead)
    return edits_.withColumn("first_reverting", first).withColumn("is_reverted", F.col("first_reverting").isNotNull())


# The same views for the oracle.
SQL_EDITS = """
d_edits AS (
  SELECT 'enwiki' AS wiki, page_id,
         list_extract(['Example page', 'List of episodes', '1998 cup season', 'Results and statistics', 'Talkative place'], (page_id % 5 + 1)::INT) AS page_title,
         event_id AS rev_id, ts, 'U' || (user_id % (2 + page_id % 3))::VARCHAR AS user_text, event_type IN ('error', 'purchase') AS is_revert,
         list_extract(['Copyedit of the lead', 'Reverted edits by [[Special:Contributions/U1|U1]] to last revision', 'undid revision 4711 by U2 (talk)',
           'rvv obvious nonsense', 'see the RfC on page protection', 'arbitration enforcement notice', 'restored sourced wording, please discuss first',
           'added a reliable source for the birth place'], (event_id % 8 + 1)::INT) AS comment,
         event_id % 11 = 0 AS user_is_bot, event_id % 5000 AS text_bytes, strftime(ts, '%Y-%m') AS month
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN (event_id // 2) * 7919 % 5 ELSE 5 + (event_id // 2 // 200) * 2 + (event_id // 2) * 7919 % 3 END AS page_id FROM events)
)"""
SQL_REVERTS = """
d_reverts AS (
  SELECT wiki, page_id, rev_id, ts, user_text AS reverter_user, reverted_user FROM (
    SELECT *, lag(user_text) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id) AS reverted_user FROM d_edits) WHERE is_revert
)"""
SQL_HISTORY = """
d_history AS (
  SELECT *, first_reverting IS NOT NULL AS is_reverted FROM (
    SELECT *, first_value(CASE WHEN is_revert THEN rev_id END IGNORE NULLS) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS first_reverting
    FROM d_edits)
)"""
