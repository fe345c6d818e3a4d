"""Queries of the dump parsers, on texts made from the tables, and of evidence over given phrases; and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as T
from ..operators import evidence as ev
from ..sources import sql_dump, wiki_dump, wiki_xml
from ..tables import new_path

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _tag(name: str, c: Column | str) -> Column:
    c = F.lit(c) if isinstance(c, str) else c.cast("string")
    return F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _page_texts(spark, sf: str) -> DataFrame:
    """XML of a page for each customer: orders are its revisions; every fifth page is a talk page, and some orders have no user or text."""
    o = A.read(spark, sf, "orders")
    key, page = F.col("o_orderkey"), F.col("o_custkey")
    user = F.when(key % 7 == 0, _tag("ip", "10.0.0.1")).when(key % 11 == 0, F.lit("")).otherwise(_tag("username", F.concat(F.lit("A & B "), F.col("o_orderstatus"))))
    text = F.when(key % 13 != 0, F.concat(F.lit("<text xml:space='preserve'>"), _escaped(F.concat(F.lit("x < "), F.col("o_orderpriority"))), F.lit("</text>"))).otherwise(F.lit(""))
    user = F.replace(user, F.lit("A & B"), F.lit("A &amp; B"))
    rev = F.concat(F.lit("<revision>"), _tag("id", key), _tag("timestamp", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("<contributor>"), user, F.lit("</contributor>"), F.when(key % 3 == 0, _tag("comment", F.col("o_orderpriority"))).otherwise(F.lit("")), text, F.lit("</revision>"))
    talk = page % 5 == 0
    title = F.concat(F.when(talk, "Talk:").otherwise(""), F.lit("Page "), page.cast("string"))
    rows = o.groupBy(page.alias("id"), title.alias("title"), talk.alias("talk")).agg(F.array_join(F.collect_list(rev), "").alias("revisions"))
    return rows.select(F.concat(F.lit("<page>"), _tag("title", F.col("title")), _tag("ns", F.when(F.col("talk"), 1).otherwise(0)), _tag("id", F.col("id")), F.col("revisions"), F.lit("</page>")).alias("value"))


def _dump(spark, sf: str) -> DataFrame:
    """The pieces of those pages, written as files of XML and found again in them."""
    path = new_path(spark, "dump")
    _page_texts(spark, sf).write.text(path)
    return wiki_dump.pieces(spark, path)


_REVISIONS = """WITH r AS (SELECT o_custkey AS page_id, CASE WHEN o_custkey % 5 = 0 THEN 'Talk:' ELSE '' END || 'Page ' || o_custkey::VARCHAR AS page_title, (o_custkey % 5 = 0)::INT AS namespace, o_orderkey AS rev_id, o_orderdate::TIMESTAMP AS ts,
  CASE WHEN o_orderkey % 7 = 0 THEN '10.0.0.1' WHEN o_orderkey % 11 = 0 THEN '' ELSE 'A & B ' || o_orderstatus END AS user_text, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS comment,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'x < ' || o_orderpriority ELSE '' END AS content FROM orders)"""
_SHOWN = ("page_id", "page_title", "namespace", "rev_id", "user_text", "comment", "content")


@query("page_revisions", _REVISIONS + " SELECT * FROM r")
def page_revisions(spark, sf: str) -> DataFrame:
    return wiki_xml.read_revisions(_dump(spark, sf)).select(*_SHOWN, F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("period_revisions", _REVISIONS + " SELECT page_id, rev_id FROM r WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1997-01-01' AND content <> ''")
def period_revisions(spark, sf: str) -> DataFrame:
    b = T.period_bounds(F.lit("history:2026-05:1996-03"))
    rows = wiki_xml.read_revisions(_dump(spark, sf), "1996-03-01", "1997-01-01")
    return wiki_xml.in_period(rows, b["start"], F.lit("1997-01-01").cast("timestamp")).select("page_id", "rev_id")


@query("candidate_revisions", _REVISIONS + """, c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 = 0),
 t AS (SELECT k AS candidate, 'Page_' || k::VARCHAR AS title FROM c WHERE k % 2 = 0), i AS (SELECT k AS candidate, k AS id FROM c WHERE k % 2 = 1 AND k % 5 <> 0), j AS (SELECT k AS candidate, k AS id FROM c WHERE k % 2 = 1 AND k % 5 = 0)
 SELECT coalesce(t.candidate, i.candidate, j.candidate) AS candidate, r.page_id, r.rev_id FROM r LEFT JOIN t ON replace(CASE WHEN namespace = 1 THEN substr(page_title, 6) ELSE page_title END, ' ', '_') = t.title
 LEFT JOIN i ON namespace = 0 AND r.page_id = i.id LEFT JOIN j ON namespace = 1 AND r.page_id = j.id WHERE coalesce(t.candidate, i.candidate, j.candidate) IS NOT NULL""")
def candidate_revisions(spark, sf: str) -> DataFrame:
    """Revisions of every third page alone: half of them known by title, half by the page's or the talk page's id."""
    k = F.col("o_custkey")
    wanted = A.read(spark, sf, "orders").where(k % 3 == 0).select(
        k.alias("candidate"), F.when(k % 2 == 0, F.concat(F.lit("Page "), k.cast("string"))).otherwise(F.concat(F.lit("Else "), k.cast("string"))).alias("page_title"),
        F.when((k % 2 == 1) & (k % 5 != 0), k).otherwise(F.lit(-1)).alias("page_id"), F.when((k % 2 == 1) & (k % 5 == 0), k).otherwise(F.lit(0)).alias("talk_page_id"),
    ).distinct()
    return wiki_xml.candidate_revisions(_dump(spark, sf), wanted).select("candidate", "page_id", "rev_id")


@query("log_protection", """SELECT id, ts, action, page_title FROM (SELECT event_id AS id, date_trunc('second', ts) AS ts, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS action, event_id % 4 AS kind,
  CASE WHEN event_id % 6 = 0 THEN 'User:X' ELSE 'Page_' || (event_id % 50)::VARCHAR END AS page_title FROM events) WHERE kind <> 0 AND action <> '' AND page_title NOT LIKE '%:%'""")
def log_protection(spark, sf: str) -> DataFrame:
    """Events as log items in XML, and those on protection out of them."""
    i = F.col("event_id")
    item = F.concat(
        F.lit("<logitem>"), _tag("id", i), _tag("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), _tag("type", F.when(i % 4 == 0, "delete").otherwise("protect")), _tag("action", F.when(i % 9 == 0, "").otherwise(F.col("event_type"))),
        _tag("logtitle", F.when(i % 6 == 0, "User:X").otherwise(F.concat(F.lit("Page "), (i % 50).cast("string")))), F.lit("</logitem>"),
    )
    found = wiki_xml.protection_of(wiki_xml.log_items_of(A.read(spark, sf, "events").select(item.alias("value"))))
    return found.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "action", "page_title")


@query("dump_restrictions", """SELECT p_partkey AS page_id, p_brand || ' (it''s, so)' AS type, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS level, (p_partkey % 2)::INT AS cascade, CASE WHEN p_partkey % 3 = 0 THEN 'infinity' ELSE '20270101000000' END AS expiry FROM part WHERE p_partkey > 0""")
def dump_restrictions(spark, sf: str) -> DataFrame:
    """Parts as rows of INSERT statements, many a line, and back."""
    k = F.col("p_partkey")
    row = F.concat(F.lit("("), k.cast("string"), F.lit(",'"), F.col("p_brand"), F.lit(" (it\\'s, so)',"), F.when(k % 4 == 0, "NULL").otherwise(F.concat(F.lit("'"), F.col("p_type"), F.lit("'"))), F.lit(","), (k % 2).cast("string"), F.lit(",'"), F.when(k % 3 == 0, "infinity").otherwise("20270101000000"), F.lit("',7)"))
    lines = A.read(spark, sf, "part").groupBy(F.floor(k / 40)).agg(F.concat(F.lit("INSERT INTO `page_restrictions` VALUES "), F.array_join(F.collect_list(row), ","), F.lit(";")).alias("value"))
    return sql_dump.restrictions_of(lines.select("value"))


def _phrases(spark, sf: str) -> DataFrame:
    """Contested phrases of pages from line items: up to seven a page, in their places."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return A.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), n.cast("int").alias("place"), F.when(q % 2 == 0, "swap").otherwise("change").alias("change_type"), (q % 9).alias("changes"), (q % 7).alias("reverts"), (q % 4).alias("editors"),
        (q % 60).alias("changed_word_count"), (q % 5).alias("comment_count"), (F.col("l_partkey") % 2 * (q % 5)).alias("cleanup_comment_count"),
        F.concat(F.lit("phrase "), F.col("l_partkey").cast("string")).alias("segment"), F.when(q % 3 == 0, "ha" * 25).otherwise(F.concat(F.lit("words of part "), F.col("l_partkey").cast("string"))).alias("changed_text"),
    )


_BATTLES = """WITH p AS (SELECT l_orderkey AS page_id, l_linenumber AS place, CASE WHEN q % 2 = 0 THEN 'swap' ELSE 'change' END AS change_type, q % 9 AS changes, q % 7 AS reverts, q % 4 AS editors, q % 60 AS words, q % 5 AS cc, l_partkey % 2 * (q % 5) AS cleanup, q % 3 = 0 AS graffiti
   FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)),
 b AS (SELECT *, CASE WHEN editors < 2 THEN 0.0::DOUBLE ELSE round((reverts * 12.0 + changes * 2.0 + least(10.0, greatest(0, editors - 1) * 3.0) + CASE WHEN change_type = 'swap' AND words <= 6 THEN 8.0 ELSE 0 END)::DOUBLE * CASE WHEN reverts < 3 THEN 0.45::DOUBLE ELSE 1 END
   * CASE WHEN words <= 0 THEN 1.0::DOUBLE WHEN words <= 6 THEN 1.12 WHEN words <= 14 THEN 1.0 WHEN words <= 28 THEN 0.72 WHEN words <= 50 THEN 0.45 ELSE 0.25 END, 2) END AS score FROM p)"""


@query("battle_scores", _BATTLES + " SELECT page_id, place, score FROM b")
def battle_scores(spark, sf: str) -> DataFrame:
    from ..functions.scores import battle_score

    return _phrases(spark, sf).select("page_id", "place", battle_score(F.col("changes"), F.col("reverts"), F.col("editors"), F.col("changed_word_count"), F.col("change_type")).alias("score"))


def _usable(spark, sf: str) -> DataFrame:
    from ..functions.scores import battle_score

    rows = _phrases(spark, sf)
    return ev.usable(rows.withColumn("score", battle_score(F.col("changes"), F.col("reverts"), F.col("editors"), F.col("changed_word_count"), F.col("change_type"))))


def _talk(spark, sf: str) -> DataFrame:
    """Disputes of talk pages from orders."""
    k = F.col("o_orderkey")
    several = F.explode(F.sequence(F.lit(1), (k % 5 + 1).cast("int")))
    rows = A.read(spark, sf, "orders").where(k % 3 != 0).select(k.alias("page_id"), several.alias("place"), (F.col("o_custkey") % 3).alias("c"))
    return rows.select("page_id", "place", F.concat(F.lit("U"), ((F.col("c") + F.col("place")) % 3).cast("string")).alias("user"), F.when(F.col("place") % 2 == 1, F.array(F.lit("term"))).otherwise(F.array().cast("array<string>")).alias("matched"))


_TALK = """, t AS (SELECT page_id, round(least(160.0, least(35.0, count(DISTINCT u) * 7.0) + sum(24.0 + CASE WHEN place % 2 = 1 THEN 18.0 ELSE 0.0 END)), 2)::DOUBLE AS talk_score, count(*) AS talk_evidence FROM (
   SELECT o_orderkey AS page_id, place, (o_custkey % 3 + place) % 3 AS u FROM (SELECT *, unnest(range(1, (o_orderkey % 5 + 2)::BIGINT)) AS place FROM orders WHERE o_orderkey % 3 <> 0)) GROUP BY ALL)"""


@query("talk_scores", "WITH " + _TALK[2:] + " SELECT * FROM t")
def talk_scores(spark, sf: str) -> DataFrame:
    return ev.talk_scores(_talk(spark, sf), ["page_id"])


#: Spark rounds a double by the digits it is written with, so the SQL does.
_CONTROVERSY = _BATTLES + _TALK + """, u AS (SELECT * FROM b WHERE editors >= 2 AND (reverts >= 3 OR changes >= 3) AND NOT graffiti),
 w AS (SELECT page_id, sum(CASE place WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.55 WHEN 3 THEN 0.25 ELSE 0 END * score * CASE WHEN change_type = 'swap' THEN 1.18::DOUBLE ELSE 1 END) AS battle, count(*) AS battles, sum(cleanup) / nullif(sum(cc), 0) AS share FROM u GROUP BY ALL),
 j AS (SELECT o_orderkey AS page_id, (o_orderkey % 400)::DOUBLE AS peak_score, o_orderkey % 90 AS rc, o_orderkey % 6 AS mp, coalesce(w.battle, 0) AS battle, coalesce(battles, 0) AS battles, coalesce(share, 0) AS share, coalesce(talk_score, 0) AS t, coalesce(talk_evidence, 0) AS talk_evidence
   FROM orders LEFT JOIN w ON w.page_id = o_orderkey LEFT JOIN t ON t.page_id = o_orderkey),
 m AS (SELECT *, least(35.0, sqrt(greatest(0, peak_score)) * 1.35) + least(15.0, sqrt(rc) * 0.75) + least(10.0, greatest(0, mp - 1) * 4.0) AS meta, CASE WHEN share >= 0.7 AND t < 20 THEN battle * 0.9 WHEN share >= 0.45 AND t < 35 THEN battle * 0.5 ELSE 0 END AS penalty FROM j),
 s1 AS (SELECT *, (battle - penalty) * (1 + least(0.75, t / 160)) + t * 2.2 + meta AS a FROM m), s2 AS (SELECT *, CASE WHEN share >= 0.7 AND t < 20 THEN least(a, 25.0) ELSE a END AS b FROM s1),
 s3 AS (SELECT *, CASE WHEN battles = 1 AND t < 20 THEN least(b, battle * 0.18 + meta) ELSE b END AS c FROM s2),
 f AS (SELECT page_id, battles, talk_evidence, t AS talk_score, peak_score, CASE WHEN battles > 0 THEN round(greatest(0, c)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE ELSE 0 END AS score, CASE WHEN battles > 0 THEN round(greatest(0, battle)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE ELSE 0 END AS battle_score,
   CASE WHEN battles > 0 THEN round(greatest(0, meta)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE ELSE 0 END AS metadata_score, CASE WHEN battles > 0 THEN round(greatest(0, penalty)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE ELSE 0 END AS cleanup_penalty FROM s3)"""


def _pages(spark, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return A.read(spark, sf, "orders").select(k.alias("page_id"), (k % 400).cast("double").alias("peak_score"), (k % 90).alias("revert_count"), (k % 6).alias("mutual_revert_pairs"))


def _scores(spark, sf: str) -> DataFrame:
    return ev.controversy(_pages(spark, sf), _usable(spark, sf), ev.talk_scores(_talk(spark, sf), ["page_id"]), ["page_id"])


@query("controversy_scores", _CONTROVERSY + " SELECT page_id, battles, talk_evidence, talk_score, score, battle_score, metadata_score, cleanup_penalty FROM f")
def controversy_scores(spark, sf: str) -> DataFrame:
    return _scores(spark, sf)


@query("controversy_rerank", _CONTROVERSY + " SELECT page_id, score AS controversy_score, row_number() OVER (ORDER BY score DESC, battles DESC, talk_evidence DESC, peak_score DESC, page_id)::INT AS rank FROM f WHERE score > 0 ORDER BY rank LIMIT 50")
def controversy_rerank(spark, sf: str) -> DataFrame:
    rows = _pages(spark, sf).select("page_id", "peak_score")
    return ev.rerank(rows, _scores(spark, sf), ["page_id"], 50).select("page_id", "controversy_score", "rank")


@query("positive_pages", _CONTROVERSY + " SELECT page_id FROM f WHERE score > 0")
def positive_pages(spark, sf: str) -> DataFrame:
    return ev.positive(_scores(spark, sf), "score").select("page_id")
