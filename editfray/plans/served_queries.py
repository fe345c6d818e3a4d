"""Queries of keyed state, of repeats, of waves over files, of feeds, and of what a dashboard and its jobs ask for; and the SQL they are held against."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import evidence as ev
from ..operators import lookups
from ..operators.windows import PAGE
from ..sources import sse
from ..streaming import live_state, seen, sinks
from ..tables import new_path
from . import jobs, serving
from . import live_queries as L

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("state_windows", L.ORACLES["live_windows"])
def state_windows(spark, sf: str) -> DataFrame:
    """Live windows through the keyed state of streams, over the whole table as one batch."""
    before = {k: spark.conf.get(k, None) for k in live_state.STORE}
    for k, v in live_state.STORE.items():
        spark.conf.set(k, v)
    spark.streams.active  # noqa: B018: state stores need the session's manager of streams, which starts when it is first asked
    try:
        e = A.edits(spark, sf)
        told = A.reverts(e).select(*PAGE, "rev_id", "reverted_user", F.lit(True).alias("reverts"))
        out = live_state.live_stream(e.join(told, [*PAGE, "rev_id"], "left").fillna(False, ["reverts"])).drop("ts")
        path = new_path(spark, "state-windows")
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@query("fresh_events", "SELECT DISTINCT event_id % 1000 AS rev_id, 'w' || (event_id % 3)::VARCHAR AS wiki, true AS fresh FROM events")
def fresh_events(spark, sf: str) -> DataFrame:
    """Events in four batches, each with revisions that an earlier one had: those that come for the first time."""
    known, out = seen.Seen(new_path(spark, "seen"), slots=8, hashes=4), None
    e = A.read(spark, sf, "events").select(F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("wiki"), (F.col("event_id") % 1000).alias("rev_id"), F.lit(None).cast("string").alias("stream_id"), (F.floor(F.col("event_id") / 700) % 4).alias("b"))
    for number in range(4):
        rows = known.fresh(e.where(F.col("b") == number).drop("b"), number)
        known.add(rows, number, date(2024, 1, 1 + 3 * number))
        out = rows if out is None else out.unionByName(rows)
    return out.select("rev_id", "wiki", F.lit(True).alias("fresh"))


@query("hits_in_waves", f"WITH {A.SQL_EDITS} SELECT page_title, arg_min(rev_id, (month, ts, rev_id)) AS rev_id FROM d_edits WHERE page_title <> 'Example page' GROUP BY ALL")
def hits_in_waves(spark, sf: str) -> DataFrame:
    """The first revision under each title, month by month, until none is wanted."""
    e = A.edits(spark, sf)
    months = sorted(r["month"] for r in e.select("month").distinct().collect())
    read = lambda names: e.where(F.col("month").isin(names))
    return lookups.first_hits_in_waves(e.where("page_title <> 'Example page'"), months, read, "page_title", "rev_id", "month", "ts", "rev_id")


@query("feed_frames", """SELECT CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id::VARCHAR END AS stream_id, event_id AS n, event_type AS kind FROM events WHERE event_id % 7 <> 0""")
def feed_frames(spark, sf: str) -> DataFrame:
    """Events as frames of a feed, landed as files: comments, payloads over two lines, some without ids, and some that are no JSON."""
    i, path = F.col("event_id"), new_path(spark, "feed")
    body = F.concat(F.lit('data: {"n": '), i.cast("string"), F.when(i % 2 == 0, F.lit(',\ndata: "kind": "')).otherwise(F.lit(', "kind": "')), F.col("event_type"), F.lit('"}\n'))
    frame = F.concat(F.when(i % 5 == 0, F.lit(": a comment\n")).otherwise(""), F.when(i % 3 != 0, F.concat(F.lit("id: e"), i.cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 7 == 0, F.lit("data: none\n")).otherwise(body))
    events = A.read(spark, sf, "events").groupBy(F.floor(i / 500).alias("file")).agg(F.array_join(F.collect_list(frame), "\n").alias("value"))
    events.select("value").repartition("value").write.option("lineSep", "\n\n").text(path)
    rows = sse.landed(spark, path, stream=False)
    return rows.select("stream_id", F.get_json_object("payload", "$.n").cast("long").alias("n"), F.get_json_object("payload", "$.kind").alias("kind"))


_EPISODES = """e AS (SELECT o_custkey AS page_id, o_orderkey AS episode, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'ended' END AS status, o_orderdate::TIMESTAMP AS started_at, (o_orderkey % 97)::DOUBLE AS peak_score FROM orders)"""


def _episodes(spark, sf: str) -> DataFrame:
    return A.read(spark, sf, "orders").select(
        F.lit("w").alias("wiki"), F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("episode"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("ended").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderkey") % 97).cast("double").alias("peak_score"),
    )


@query("active_episodes", f"WITH {_EPISODES} SELECT page_id, started_at, peak_score FROM e WHERE status = 'active' ORDER BY peak_score DESC, started_at DESC, page_id LIMIT 50")
def active_episodes(spark, sf: str) -> DataFrame:
    return serving.active_episodes(_episodes(spark, sf)).select("page_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "peak_score")


def _boards(spark, sf: str) -> DataFrame:
    """A board a month of orders: its customers by what they spent."""
    o = A.read(spark, sf, "orders").groupBy(F.concat(F.lit("history:2026-05:"), F.date_format("o_orderdate", "yyyy-MM")).alias("period"), F.col("o_custkey").alias("page_id")).agg(F.count("*").alias("edits"), F.max("o_orderkey").alias("last"))
    order = Window.partitionBy("period").orderBy(F.desc("edits"), F.desc("last"))
    return o.withColumn("rank", F.row_number().over(order)).where("rank <= 100")


_BOARDS = """b AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY edits DESC, last DESC)::INT AS rank FROM (
 SELECT 'history:2026-05:' || strftime(o_orderdate, '%Y-%m') AS period, o_custkey AS page_id, count(*) AS edits, max(o_orderkey) AS last FROM orders GROUP BY ALL) QUALIFY rank <= 100)"""


@query("historical_board", f"WITH {_BOARDS} SELECT period, page_id, edits, rank FROM b WHERE period = (SELECT max(period) FROM b) ORDER BY rank LIMIT 50")
def historical_board(spark, sf: str) -> DataFrame:
    return serving.historical_board(_boards(spark, sf)).select("period", "page_id", "edits", "rank")


@query("missing_talk", f"WITH {_BOARDS} SELECT period, page_id, rank FROM b WHERE page_id % 5 <> 0 AND page_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_talk(spark, sf: str) -> DataFrame:
    """Rows of boards that evidence can be sought for and that no talk page is known of."""
    rows = _boards(spark, sf).withColumn("page_title", F.when(F.col("page_id") % 5 != 0, F.lit("A title")).otherwise(""))
    talk = A.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("page_id"))
    return jobs.missing_talk(jobs.evidence_inputs(rows), talk).select("period", "page_id", "rank")


@query("merged_revisions", "SELECT l_orderkey AS page_id, l_partkey AS rev_id FROM lineitem WHERE l_linenumber % 2 = 0 OR l_partkey % 3 = 0 GROUP BY ALL")
def merged_revisions(spark, sf: str) -> DataFrame:
    """Revisions of shards that overlap, each once."""
    rows = A.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("rev_id"), "l_linenumber")
    return jobs.merged_revisions(rows.where("l_linenumber % 2 = 0"), rows.where("rev_id % 3 = 0").drop("l_linenumber")).select("page_id", "rev_id")


@query("period_files", """WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS partition FROM orders UNION SELECT DISTINCT year(o_orderdate)::VARCHAR FROM orders)
 SELECT 'month' AS asked, partition FROM f WHERE partition IN ('1996-03', '1996') UNION ALL SELECT 'year', partition FROM f WHERE partition = '1996' OR partition LIKE '1996-%'""")
def period_files(spark, sf: str) -> DataFrame:
    """The files that a month and a year are read from."""
    d = A.read(spark, sf, "orders").select("o_orderdate")
    files = d.select(F.date_format("o_orderdate", "yyyy-MM").alias("partition")).union(d.select(F.year("o_orderdate").cast("string"))).distinct()
    of = lambda name, period: sinks.files_of(files, period).select(F.lit(name).alias("asked"), "partition")
    return of("month", "history:2026-05:1996-03").unionByName(of("year", "history-year:2026-05:1996"))


@query("page_detail", f"""WITH {A.SQL_EDITS}, p AS (SELECT *, row_number() OVER (PARTITION BY wiki, page_id ORDER BY ts DESC, rev_id DESC) AS r FROM d_edits WHERE page_id = 1) SELECT page_id, rev_id, r::INT AS recency FROM p WHERE r <= 50""")
def page_detail(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf)
    return serving.page_detail(e, e, "enwiki", 1)[0].select("page_id", "rev_id", "recency")


@query("revert_pairs_full", f"""WITH {A.SQL_EDITS}, n AS (SELECT *, count(*) OVER (PARTITION BY wiki, page_id) AS n, lag(rev_id) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id) AS prev FROM d_edits)
 SELECT page_id, rev_id, prev AS prev_rev, n > 60 AS reverts_alone FROM n WHERE prev IS NOT NULL AND (n <= 60 OR is_revert) AND rev_id % 5 <> 0 AND prev % 5 <> 0""")
def revert_pairs_full(spark, sf: str) -> DataFrame:
    """Adjacent pairs with content: all of pages with up to 60 revisions, those that revert of others."""
    e = A.edits(spark, sf)
    content = e.select("rev_id", F.when(F.col("rev_id") % 5 == 0, "").otherwise("text").alias("content"))
    out = lookups.revert_pairs(e.withColumnRenamed("is_revert", "undoes"), content, PAGE, ("ts", "rev_id"), F.col("undoes"), full_limit=60)
    return out.select("page_id", "rev_id", F.col("prev.rev_id").alias("prev_rev"), (F.col("n") > 60).alias("reverts_alone"))


def _found(spark, sf: str) -> DataFrame:
    """Changes of phrases as pair_segments() gives them, from line items: a page for every 40 orders, few phrases, swaps among them."""
    n, k, q = F.col("l_linenumber").cast("long"), F.col("l_orderkey"), F.col("l_quantity").cast("long")
    phrase = F.concat(F.lit("phrase "), (F.col("l_partkey") % 5).cast("string"))
    empty = F.lit("")
    return A.read(spark, sf, "lineitem").select(
        F.floor(k / 40).alias("page_id"), F.timestamp_seconds(k).alias("ts"), (k * 10 + n).alias("rev_id"), F.concat(F.lit("U"), (q % 3).cast("string")).alias("user_text"), F.when(q % 2 == 0, "the sourced wording was better before").otherwise("").alias("comment"),
        (q % 4 == 0).alias("is_revert"), F.concat(F.lit("U"), (n % 3).cast("string")).alias("prev_user"), F.when(q % 5 == 0, "rvv nonsense").otherwise("").alias("prev_comment"), n.cast("int").alias("pos"),
        phrase.alias("segment"), phrase.alias("changed_text"), *[empty.alias(c) for c in ("highlight_before", "highlight_after", "context_before", "context_after")],
        F.when(q % 3 == 0, "swap").otherwise("change").alias("change_type"), phrase.alias("key"), F.when(q % 3 == 0, F.array(phrase, F.concat(F.lit("other "), (n % 2).cast("string")))).otherwise(F.array().cast("array<string>")).alias("swap_values"), (q % 9).alias("changed_word_count"),
    )


_FOUND = """f AS (SELECT l_orderkey // 40 AS page_id, l_orderkey AS ts, l_orderkey * 10 + l_linenumber AS rev_id, 'U' || (q % 3)::VARCHAR AS user_text, q % 2 = 0 AS said, q % 4 = 0 AS is_revert, 'U' || (l_linenumber % 3)::VARCHAR AS prev_user, q % 5 = 0 AS cleanup,
   l_linenumber AS pos, 'phrase ' || (l_partkey % 5)::VARCHAR AS key, CASE WHEN q % 3 = 0 THEN 'swap' ELSE 'change' END AS change_type, q % 9 AS words FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)),
 t AS (SELECT page_id, key, arg_min(change_type, (-n, o)) AS change_type FROM (SELECT page_id, key, change_type, count(*) AS n, min((ts, rev_id, pos)) AS o FROM f GROUP BY ALL) GROUP BY ALL),
 u AS (SELECT page_id, key, count(DISTINCT u) AS editors FROM (SELECT page_id, key, user_text AS u FROM f UNION ALL SELECT page_id, key, prev_user FROM f WHERE is_revert AND prev_user <> user_text) GROUP BY ALL),
 s AS (SELECT page_id, key, count(*) AS changes, count(*) FILTER (WHERE is_revert) AS reverts, max(words) AS changed_word_count, sum(said::INT + cleanup::INT)::BIGINT AS comment_count, sum(cleanup::INT)::BIGINT AS cleanup_comment_count FROM f GROUP BY ALL),
 z AS (SELECT page_id, key, change_type, changes, reverts, editors, changed_word_count, comment_count, cleanup_comment_count,
   CASE WHEN editors < 2 THEN 0.0::DOUBLE ELSE round(((reverts * 12.0 + changes * 2.0 + least(10.0, greatest(0, editors - 1) * 3.0) + CASE WHEN change_type = 'swap' AND changed_word_count <= 6 THEN 8.0 ELSE 0 END)::DOUBLE * CASE WHEN reverts < 3 THEN 0.45::DOUBLE ELSE 1 END
   * CASE WHEN changed_word_count <= 0 THEN 1.0::DOUBLE WHEN changed_word_count <= 6 THEN 1.12 WHEN changed_word_count <= 14 THEN 1.0 WHEN changed_word_count <= 28 THEN 0.72 WHEN changed_word_count <= 50 THEN 0.45 ELSE 0.25 END)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE END AS score
   FROM s JOIN t USING (page_id, key) JOIN u USING (page_id, key) WHERE changes >= 3 OR reverts >= 3)"""


@query("segment_stats", f"WITH {_FOUND} SELECT * FROM z WHERE score > 0")
def segment_stats(spark, sf: str) -> DataFrame:
    stats = ev.segment_stats(_found(spark, sf), ["page_id"], ("ts", "rev_id"))
    return stats.select("page_id", "key", "change_type", "changes", "reverts", "editors", "changed_word_count", "comment_count", "cleanup_comment_count", "score")
