"""Queries of the historical path, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import governance, graph, pages, ranking, windows
from ..operators.windows import PAGE

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


_WITH = f"WITH {A.SQL_EDITS}, {A.SQL_REVERTS}, {A.SQL_HISTORY}"
_EDGES = """
d_edges AS (
  SELECT wiki, page_id, rev_id, ts, src, dst FROM (
    SELECT *, row_number() OVER (PARTITION BY wiki, page_id, rev_id ORDER BY n DESC, o_ts, o_rev) AS r FROM (
      SELECT d.wiki, d.page_id, d.rev_id, d.ts, d.user_text AS src, u.user_text AS dst, count(*) AS n, min(u.ts) AS o_ts, min(u.rev_id) AS o_rev
      FROM d_history u JOIN d_history d ON u.wiki = d.wiki AND u.page_id = d.page_id AND u.first_reverting = d.rev_id
      WHERE u.ts < d.ts OR (u.ts = d.ts AND u.rev_id < d.rev_id) GROUP BY ALL)) WHERE r = 1 AND src <> dst
)"""
_MUTUAL = """
p_counts AS (SELECT wiki, page_id, src, dst, count(*) AS n FROM d_edges GROUP BY ALL HAVING count(*) >= 4),
p_mutual AS (SELECT e.* FROM p_counts e JOIN p_counts r ON e.wiki = r.wiki AND e.page_id = r.page_id AND e.src = r.dst AND e.dst = r.src)"""
_PAIR = """
p_pairs AS (SELECT e.wiki, e.page_id, e.src AS a, e.dst AS b, e.n AS ab, r.n AS ba FROM p_mutual e JOIN p_mutual r
  ON e.wiki = r.wiki AND e.page_id = r.page_id AND e.src = r.dst AND e.dst = r.src WHERE e.src < e.dst),
p_users AS (SELECT wiki, page_id, count(*) AS ends, max(n) AS top FROM (SELECT wiki, page_id, src, sum(n) AS n FROM p_mutual GROUP BY ALL) GROUP BY ALL),
p_metrics AS (SELECT p.wiki, p.page_id, count(*) AS pairs, sum(least(ab, ba)) AS mutual, sum(ab + ba) AS reverts,
  max(sqrt(least(ab, ba)) * 42 + greatest(ab, ba) * 2) AS best, sum(sqrt(least(ab, ba)) * 42 + greatest(ab, ba) * 2) AS total, max(ab + ba) AS strongest
  FROM p_pairs p GROUP BY ALL)"""
_DAYS = """
hours AS (SELECT DISTINCT wiki, page_id, date_trunc('hour', ts) AS b FROM d_edits),
activity AS (SELECT h.wiki, h.page_id, h.b, count(*) AS edit_count, count(DISTINCT e.user_text) AS users FROM hours h JOIN d_edits e
  ON h.wiki = e.wiki AND h.page_id = e.page_id AND date_trunc('hour', e.ts) BETWEEN h.b - INTERVAL 23 HOUR AND h.b GROUP BY ALL),
w_counts AS (SELECT h.wiki, h.page_id, h.b, e.src, e.dst, count(*) AS n, count(*) FILTER (WHERE date_trunc('hour', e.ts) = h.b) AS now FROM hours h JOIN d_edges e
  ON h.wiki = e.wiki AND h.page_id = e.page_id AND date_trunc('hour', e.ts) BETWEEN h.b - INTERVAL 23 HOUR AND h.b GROUP BY ALL HAVING count(*) >= 4),
w_mutual AS (SELECT e.* FROM w_counts e JOIN w_counts r ON e.wiki = r.wiki AND e.page_id = r.page_id AND e.b = r.b AND e.src = r.dst AND e.dst = r.src),
w_users AS (SELECT wiki, page_id, b, count(*) AS ends, max(n) AS top FROM (SELECT wiki, page_id, b, src, sum(n) AS n FROM w_mutual GROUP BY ALL) GROUP BY ALL),
w_pairs AS (SELECT e.wiki, e.page_id, e.b, e.n AS ab, r.n AS ba, e.now + r.now AS now FROM w_mutual e JOIN w_mutual r
  ON e.wiki = r.wiki AND e.page_id = r.page_id AND e.b = r.b AND e.src = r.dst AND e.dst = r.src WHERE e.src < e.dst),
w_metrics AS (SELECT wiki, page_id, b, count(*) AS pairs, sum(ab + ba) AS reverts, sum(now) AS current,
  max(sqrt(least(ab, ba)) * 42 + greatest(ab, ba) * 2) AS best, sum(sqrt(least(ab, ba)) * 42 + greatest(ab, ba) * 2) AS total FROM w_pairs GROUP BY ALL),
days AS (SELECT a.wiki, a.page_id, a.b AS bucket, a.edit_count, a.users, coalesce(m.reverts, 0) AS reverts, coalesce(m.pairs, 0) AS pairs, coalesce(m.current, 0) AS current,
  CASE WHEN a.users < 2 OR m.best IS NULL THEN 0.0 ELSE
    ((m.best + 0.25 * (m.total - m.best)) * (0.25 + least(0.75, (m.reverts / a.edit_count) * 0.9)) + least(12.0, greatest(0, u.ends - 2) * 4.0) + least(4.0, m.current))
    * CASE WHEN u.top / m.reverts >= 0.75 AND m.reverts >= 8 THEN 0.55 ELSE 1.0 END END AS score
  FROM activity a LEFT JOIN w_metrics m ON a.wiki = m.wiki AND a.page_id = m.page_id AND a.b = m.b LEFT JOIN w_users u ON a.wiki = u.wiki AND a.page_id = u.page_id AND a.b = u.b)"""
_EPISODES = """
e1 AS (SELECT *, coalesce(bucket - lag(bucket) OVER w > INTERVAL 24 HOUR, false) AS gap FROM days WINDOW w AS (PARTITION BY wiki, page_id ORDER BY bucket)),
e2 AS (SELECT *, CASE WHEN score >= 60 AND current > 0 THEN 'on' WHEN score < 40 OR current = 0 OR gap THEN 'off' END AS state FROM e1),
e3 AS (SELECT *, CASE WHEN gap THEN 'off' ELSE coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY wiki, page_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'off') END AS before FROM e2),
eps AS (SELECT wiki, page_id, round((max(score))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS peak_score, count(*) FILTER (WHERE state = 'on' AND before <> 'on') AS episode_count,
  60 * count(*) FILTER (WHERE state = 'on') AS war_minutes FROM e3 GROUP BY ALL)"""


@query("hist_page_aggregate", _WITH + """
SELECT wiki, page_id, arg_max(page_title, rev_id) AS page_title, count(*) AS edit_count, count(DISTINCT user_text) AS unique_editors, min(ts) AS first_edit, max(ts) AS last_edit,
       count(*) FILTER (WHERE is_reverted) AS reverted_count, count(*) FILTER (WHERE is_revert) AS reverting_count FROM d_history GROUP BY ALL""")
def page_aggregate(spark, sf: str) -> DataFrame:
    return pages.page_aggregate(A.history(A.edits(spark, sf))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_edit", "last_edit")})


@query("hist_talk_aggregate", _WITH + r"""
SELECT wiki, page_id, count(*) AS talk_edits, count(DISTINCT user_text) AS talk_users, coalesce(max(text_bytes) FILTER (WHERE NOT is_reverted), 0) AS talk_bytes,
  count(*) FILTER (WHERE said AND regexp_matches(comment, '\b(rfc|rfc/u|request(s|ed)? for comment|requested comment|request for comments)\b', 'i')) AS rfc,
  count(*) FILTER (WHERE said AND regexp_matches(comment, '\b(arbcom|arbitration|discretionary sanctions|contentious topics?)\b', 'i')) AS arb,
  count(*) FILTER (WHERE said AND regexp_matches(comment, '\b(page protection|protected|semi-protected|pending changes|topic ban)\b', 'i')) AS restriction
FROM (SELECT *, length(trim(comment)) >= 3 AND NOT regexp_matches(lower(trim(comment)), '^(reverted edits by|undid revision|rollback|automated)') AS said FROM d_history) GROUP BY ALL""")
def talk_aggregate(spark, sf: str) -> DataFrame:
    return pages.talk_aggregate(A.history(A.edits(spark, sf)))


@query("hist_identity_edges", _WITH + "," + _EDGES + " SELECT wiki, page_id, rev_id, src, dst FROM d_edges")
def identity_edges(spark, sf: str) -> DataFrame:
    return graph.identity_edges(A.history(A.edits(spark, sf))).select(*PAGE, "rev_id", "src", "dst")


@query("hist_hour_buckets", _WITH + " SELECT wiki, page_id, date_trunc('hour', ts) AS bucket, count(*) AS edit_count, count(DISTINCT user_text) AS users FROM d_edits GROUP BY ALL")
def hour_buckets(spark, sf: str) -> DataFrame:
    return windows.hour_edits(A.edits(spark, sf)).select(*PAGE, F.col("bucket").cast("timestamp_ntz").alias("bucket"), "edit_count", F.size("editors").cast("long").alias("users"))


@query("hist_hour_edges", _WITH + "," + _EDGES + " SELECT wiki, page_id, date_trunc('hour', ts) AS bucket, src, dst, count(*) AS n FROM d_edges GROUP BY ALL")
def hour_edges(spark, sf: str) -> DataFrame:
    return windows.hour_edges(graph.identity_edges(A.history(A.edits(spark, sf)))).select(*PAGE, F.col("bucket").cast("timestamp_ntz").alias("bucket"), "src", "dst", "n")


@query("hist_mutual_edges", _WITH + "," + _EDGES + "," + _MUTUAL + " SELECT wiki, page_id, src, dst, n FROM p_mutual")
def mutual_edges(spark, sf: str) -> DataFrame:
    edges = graph.identity_edges(A.history(A.edits(spark, sf)))
    return graph.mutual_edges(graph.effective_edges(graph.edge_counts(edges, PAGE)), PAGE)


_RANKED_PAIRS = _WITH + ", p_counts AS (SELECT wiki, page_id, reverter_user AS src, reverted_user AS dst, count(*) AS n FROM d_reverts WHERE reverter_user <> reverted_user GROUP BY ALL HAVING count(*) >= 4)," + _MUTUAL.split("),\n", 1)[1] + "," + _PAIR + """
SELECT m.wiki, m.page_id, pairs, mutual::BIGINT AS mutual, reverts::BIGINT AS reverts, round((best)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS best, round((total)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS total, ends,
  round((top / reverts)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS top_share, round((strongest / reverts)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS strongest_share, row_number() OVER (ORDER BY pairs DESC, mutual DESC, m.page_id)::INT AS rank
FROM p_metrics m JOIN p_users u ON m.wiki = u.wiki AND m.page_id = u.page_id ORDER BY rank LIMIT 100"""


@query("mutual_pair_ranking", _RANKED_PAIRS)
def mutual_pair_ranking(spark, sf: str) -> DataFrame:
    """Which hundred pages have the strongest mutual reverts in the period?"""
    from pyspark.sql import Window

    counts = graph.effective_edges(graph.edge_counts(A.reverts(A.edits(spark, sf)), PAGE, "reverter_user", "reverted_user"))
    rows = graph.pair_metrics(counts, PAGE).orderBy(F.desc("pairs"), F.desc("mutual"), "page_id").limit(100)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pairs"), F.desc("mutual"), "page_id")))
    return ranked.withColumns({c: F.round(c, 4) for c in ("best", "total", "top_share", "strongest_share")})


@query("hist_day_scores", _WITH + "," + _EDGES + "," + _DAYS + " SELECT wiki, page_id, bucket, edit_count, users, reverts::BIGINT AS reverts, pairs, current::BIGINT AS current, round((score)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS score FROM days")
def day_scores(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf)
    return windows.day_scores(e, graph.identity_edges(A.history(e))).withColumns({"bucket": F.col("bucket").cast("timestamp_ntz"), "score": F.round("score", 4)})


@query("hist_episodes", _WITH + "," + _EDGES + "," + _DAYS + "," + _EPISODES + " SELECT * FROM eps")
def episodes(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf)
    return windows.episodes(windows.day_scores(e, graph.identity_edges(A.history(e))))


_TITLE = "replace(coalesce(page_title, ''), '_', ' ')"
_STRONG = rf"regexp_matches({_TITLE}, '\b(list of (programs|episodes|missions|champions|winners|awards|records|songs|singles|albums|characters|players|squads|rosters|results|standings|rankings)|episodes?|discography|filmography|roster|squad|standings|results|schedule|statistics|rankings?|transfers)\b', 'i')"
_ROUTINE = rf"regexp_matches({_TITLE}, '\b(list of|season|championships?|tournament|cup|league|roster|squad|standings|results|statistics|records?|draft|episodes?|discography|filmography|awards?|medal table|schedule|rankings?|transfers)\b', 'i')"
_SEASON = rf"regexp_matches({_TITLE}, '\b(18|19|20)\d{{2}}(-\d{{2}})?\b.*\b(season|championship|tournament|cup|league|draft|election results)\b', 'i')"


def _penalty(**have: str) -> str:
    at = lambda c: have.get(c, "0")
    rc, pairs, users, edits, mutual = at("rc"), at("pairs"), at("users"), at("edits"), at("mutual")
    return f"""greatest(0.0, least(0.85, (CASE WHEN {_STRONG} THEN 0.32 ELSE 0 END)::DOUBLE + (CASE WHEN {_ROUTINE} THEN 0.20 ELSE 0 END)::DOUBLE + (CASE WHEN {_SEASON} THEN 0.14 ELSE 0 END)::DOUBLE
      + (CASE WHEN {at("top")} >= 0.78 AND {rc} >= 8 THEN 0.24 WHEN {at("top")} >= 0.65 AND {rc} >= 8 THEN 0.12 ELSE 0 END)::DOUBLE
      + (CASE WHEN {at("strongest")} >= 0.88 AND {pairs} <= 1 AND {users} <= 6 THEN 0.16 WHEN {at("strongest")} >= 0.75 AND {pairs} <= 2 AND {users} <= 10 THEN 0.08 ELSE 0 END)::DOUBLE
      + (CASE WHEN {edits} >= 80 AND {mutual} <= 2 THEN 0.16 WHEN {edits} >= 45 AND {mutual} <= 1 THEN 0.10 ELSE 0 END)::DOUBLE
      + (CASE WHEN {_STRONG} AND {pairs} <= 4 THEN 0.16 WHEN {_ROUTINE} AND {pairs} <= 2 THEN 0.12 ELSE 0 END)::DOUBLE
      + (CASE WHEN {_ROUTINE} AND {at("density")} < 0.25 AND {at("peak")} < 160 THEN 0.10 ELSE 0 END)::DOUBLE))"""


_ROWS = """
base AS (SELECT wiki, page_id, arg_max(page_title, rev_id) AS page_title, count(*) AS edit_count, count(DISTINCT user_text) AS unique_editors,
  count(*) FILTER (WHERE is_reverted) AS reverted_count, count(*) FILTER (WHERE is_revert) AS reverting_count FROM d_history GROUP BY ALL),
page_rows AS (SELECT b.*, coalesce(m.reverts, 0)::BIGINT AS revert_count, coalesce(m.pairs, 0) AS mutual_revert_pairs, coalesce(m.mutual, 0)::BIGINT AS mutual_revert_count,
  round((coalesce(u.top / m.reverts, 0))::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS top_reverter_share, round((coalesce(m.strongest / m.reverts, 0))::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS strongest_pair_share,
  round((coalesce(m.reverts, 0) / b.edit_count)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS revert_density, e.peak_score, e.episode_count, e.war_minutes
  FROM base b LEFT JOIN p_metrics m ON b.wiki = m.wiki AND b.page_id = m.page_id LEFT JOIN p_users u ON b.wiki = u.wiki AND b.page_id = u.page_id LEFT JOIN eps e ON b.wiki = e.wiki AND b.page_id = e.page_id)"""
_PEN = _penalty(rc="revert_count", pairs="mutual_revert_pairs", users="unique_editors", edits="edit_count", mutual="mutual_revert_count", top="top_reverter_share", strongest="strongest_pair_share", density="revert_density", peak="peak_score")
_SCORED = f", scored AS (SELECT *, round(({_PEN})::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS routine_penalty, round((peak_score * (1 - {_PEN}))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS candidate_score FROM page_rows)"
_BOARD = _WITH + "," + _EDGES + "," + _MUTUAL + "," + _PAIR + "," + _DAYS + "," + _EPISODES + "," + _ROWS + _SCORED


@query("hist_scoreboard", _BOARD + """
SELECT *, row_number() OVER (ORDER BY candidate_score DESC, mutual_revert_pairs DESC, revert_count DESC, peak_score DESC, wiki, page_id)::INT AS rank FROM scored
WHERE coalesce(candidate_score, peak_score, 0) >= 1 ORDER BY rank LIMIT 100""")
def scoreboard(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf)
    h = A.history(e)
    return ranking.edit_war(pages.score_pages(h, graph.identity_edges(h)), 100, 1.0)


@query("hist_cleanup_rows", _BOARD + " SELECT wiki, page_id, revert_density, revert_density >= 0.82 AND mutual_revert_pairs <= 8 AND unique_editors <= 40 AS cleanup_only FROM scored")
def cleanup_rows(spark, sf: str) -> DataFrame:
    h = A.history(A.edits(spark, sf))
    return pages.score_pages(h, graph.identity_edges(h)).select(*PAGE, "revert_density", ranking.cleanup_only().alias("cleanup_only"))


def months(spark, sf: str) -> DataFrame:
    """Monthly page rows from orders: 400 pages."""
    o = A.read(spark, sf, "orders").withColumns({"page_id": F.col("o_custkey") % 400, "year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    title = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("List of episodes "), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    key = F.col("o_orderkey")
    return o.groupBy("year", "month", F.lit("enwiki").alias("wiki"), "page_id").agg(
        F.max(title).alias("page_title"), F.count("*").alias("edit_count"), F.count_distinct("o_orderpriority").alias("unique_editors"), F.count_if(F.col("o_orderstatus") == "F").alias("reverted_count"),
        F.count_if(F.col("o_orderstatus") == "P").alias("reverting_count"), F.count_if(key % 6 == 0).alias("mutual_reverts"), F.count_if(key % 40 == 0).alias("mutual_revert_pairs"), F.count_if(key % 7 == 0).alias("talk_edits"),
        F.count_distinct(F.when(key % 7 == 0, F.col("o_orderpriority"))).alias("talk_users"), F.coalesce(F.max(F.when(key % 7 == 0, key % 20000)), F.lit(0)).alias("talk_bytes"),
        F.count_if(key % 50 == 0).alias("rfc"), F.count_if(key % 90 == 0).alias("arb"), F.count_if(key % 70 == 0).alias("restriction"),
    )


_MONTHS = """
WITH months AS (
  SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, 'enwiki' AS wiki, o_custkey % 400 AS page_id,
    max(CASE WHEN o_custkey % 400 % 4 = 0 THEN 'List of episodes ' ELSE 'Page ' END || (o_custkey % 400)::VARCHAR) AS page_title, count(*) AS edit_count, count(DISTINCT o_orderpriority) AS unique_editors,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS reverted_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS reverting_count, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS mutual_reverts,
    count(*) FILTER (WHERE o_orderkey % 40 = 0) AS mutual_revert_pairs, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS talk_edits,
    count(DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END) AS talk_users, coalesce(max(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 20000 END), 0) AS talk_bytes,
    count(*) FILTER (WHERE o_orderkey % 50 = 0) AS rfc, count(*) FILTER (WHERE o_orderkey % 90 = 0) AS arb, count(*) FILTER (WHERE o_orderkey % 70 = 0) AS restriction
  FROM orders GROUP BY ALL
), years AS (
  SELECT year, wiki, page_id, arg_max(page_title, month) AS page_title, sum(edit_count)::BIGINT AS edit_count, sum(unique_editors)::BIGINT AS unique_editors, sum(reverted_count)::BIGINT AS reverted_count,
    sum(reverting_count)::BIGINT AS reverting_count, sum(mutual_reverts)::BIGINT AS mutual_reverts, sum(mutual_revert_pairs)::BIGINT AS mutual_revert_pairs, sum(talk_edits)::BIGINT AS talk_edits,
    sum(talk_users)::BIGINT AS talk_users, sum(rfc)::BIGINT AS rfc, sum(arb)::BIGINT AS arb, sum(restriction)::BIGINT AS restriction, max(talk_bytes) AS talk_bytes
  FROM months GROUP BY ALL
)"""


@query("year_stats", _MONTHS + " SELECT * FROM years")
def year_stats(spark, sf: str) -> DataFrame:
    return pages.year_stats(months(spark, sf))


_YEAR = 1997


def _year(spark, sf: str) -> DataFrame:
    return pages.year_stats(months(spark, sf).where(F.col("year") == _YEAR))


#: Pages that a method looks at, before scores: fewer than there are here.
PRE_RANK = 150


def _pre_ranked(order: str) -> str:
    return f", looked AS (SELECT * FROM years WHERE year = {_YEAR} ORDER BY {order}, wiki, page_id LIMIT {PRE_RANK})"


_PW_PEN = _penalty(pairs="mutual_revert_pairs", users="unique_editors", edits="edit_count", peak="peak_score")


@query("year_page_war", _MONTHS + _pre_ranked("reverted_count + reverting_count DESC, mutual_reverts DESC, talk_bytes DESC, edit_count DESC") + f""", raw AS (SELECT *, reverted_count + reverting_count AS raw_activity, round((sqrt(reverted_count) * 24 + sqrt(reverting_count) * 18 + sqrt(mutual_reverts) * 16
   + least(42.0, mutual_revert_pairs * 8.0) + least(50.0, ln(1 + edit_count) * 6) + least(35.0, sqrt(unique_editors) * 4.2) + least(45.0, ln(1 + talk_bytes) * 3.2) + least(25.0, sqrt(talk_edits) * 4))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS peak_score
   FROM looked),
 pen AS (SELECT *, round(({_PW_PEN})::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS routine_penalty FROM raw), fin AS (SELECT *, round((peak_score * (1 - routine_penalty))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS candidate_score FROM pen)
 SELECT page_id, page_title, raw_activity, peak_score, routine_penalty, candidate_score, row_number() OVER (ORDER BY candidate_score DESC, raw_activity DESC, talk_bytes DESC, edit_count DESC, wiki, page_id)::INT AS rank
 FROM fin WHERE candidate_score >= 1 AND NOT ({_STRONG} AND talk_bytes < 10000 AND raw_activity < 45) ORDER BY rank LIMIT 50""")
def year_page_war(spark, sf: str) -> DataFrame:
    rows = ranking.page_war(ranking.pre_rank(_year(spark, sf), "page-war", PRE_RANK), 50, 1.0)
    return rows.select("page_id", "page_title", "raw_activity", "peak_score", "routine_penalty", "candidate_score", "rank")


@query("year_most_discussed", _MONTHS + _pre_ranked("talk_bytes DESC, talk_edits DESC, reverted_count + reverting_count DESC") + """ SELECT page_id, talk_bytes, talk_edits, talk_bytes::DOUBLE AS candidate_score,
  row_number() OVER (ORDER BY talk_bytes DESC, talk_edits DESC, reverted_count + reverting_count DESC, wiki, page_id)::INT AS rank FROM looked WHERE talk_bytes > 0 OR talk_edits > 0 ORDER BY rank LIMIT 50""")
def year_most_discussed(spark, sf: str) -> DataFrame:
    return ranking.most_discussed(ranking.pre_rank(_year(spark, sf), "most-discussed", PRE_RANK), 50).select("page_id", "talk_bytes", "talk_edits", "candidate_score", "rank")


def _admin(spark, sf: str) -> DataFrame:
    rows = restriction_rows(spark, sf)
    signals = governance.restrictions(rows, ["page_id"])
    return signals.select("page_id", "restriction_count", *[F.col(c).cast("int").alias(c) for c in ("has_sysop", "has_extendedconfirmed", "has_cascade")])


def restriction_rows(spark, sf: str) -> DataFrame:
    """Restrictions from parts: 400 pages."""
    p = A.read(spark, sf, "part")
    kind = F.element_at(F.array(F.lit("edit"), F.lit("move"), F.lit("upload")), (F.col("p_size") % 3 + 1).cast("int"))
    level = F.element_at(F.array(F.lit("autoconfirmed"), F.lit("extendedconfirmed"), F.lit("sysop")), (F.col("p_partkey") % 3 + 1).cast("int"))
    expiry = F.when(F.col("p_partkey") % 13 == 0, "infinity").otherwise(F.concat(F.lit("20"), F.lpad((F.col("p_partkey") % 90 + 10).cast("string"), 2, "0"), F.lit("0101000000")))
    return p.where("p_size % 5 = 0").select((F.col("p_partkey") % 400).alias("page_id"), kind.alias("type"), level.alias("level"), (F.col("p_partkey") % 17 == 0).cast("int").alias("cascade"), expiry.alias("expiry"))


_RESTRICTIONS = """restrictions AS (
  SELECT p_partkey % 400 AS page_id, list_extract(['edit', 'move', 'upload'], (p_size % 3 + 1)::INT) AS type, list_extract(['autoconfirmed', 'extendedconfirmed', 'sysop'], (p_partkey % 3 + 1)::INT) AS level,
    p_partkey % 17 = 0 AS cascade, CASE WHEN p_partkey % 13 = 0 THEN 'infinity' ELSE '20' || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '0101000000' END AS expiry FROM part WHERE p_size % 5 = 0
), signals AS (
  SELECT page_id, count(*) AS restriction_count, array_to_string(list_sort(list(DISTINCT type)), ', ') AS restriction_types, array_to_string(list_sort(list(DISTINCT level)), ', ') AS restriction_levels,
    bool_or(level = 'extendedconfirmed') AS has_extendedconfirmed, bool_or(level = 'sysop') AS has_sysop, bool_or(cascade) AS has_cascade,
    CASE WHEN bool_or(expiry = 'infinity') THEN 'infinity' ELSE max(expiry) END AS restriction_expiry FROM restrictions GROUP BY ALL
)"""


@query("gov_restrictions", "WITH " + _RESTRICTIONS + " SELECT * FROM signals")
def restrictions(spark, sf: str) -> DataFrame:
    return governance.restrictions(restriction_rows(spark, sf), ["page_id"])


def protection_rows(spark, sf: str) -> DataFrame:
    e = A.read(spark, sf, "events").where(F.col("event_type").isin("signup", "view"))
    return e.select((F.col("user_id") % 400).alias("page_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_type") == "signup", "protect").otherwise("unprotect").alias("action"))


_PROTECTION = """prot AS (
  SELECT user_id % 400 AS page_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'protect' ELSE 'unprotect' END AS action FROM events WHERE event_type IN ('signup', 'view')
), isl AS (
  SELECT *, coalesce(sum((action = 'unprotect')::INT) OVER (PARTITION BY page_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM prot
), spans AS (
  SELECT page_id, island, min(ts) FILTER (WHERE action <> 'unprotect') AS a, max(ts) FILTER (WHERE action = 'unprotect') AS b, count(*) AS n, max(ts) AS last FROM isl GROUP BY ALL
), protected AS (
  SELECT page_id, sum(n)::BIGINT AS protection_events,
    round((coalesce(sum(greatest(0, floor(epoch(coalesce(b, TIMESTAMP '2024-03-01')))::BIGINT - floor(epoch(a))::BIGINT)) FILTER (WHERE a IS NOT NULL), 0) / 86400)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS protection_days, min(a) AS first_protection_at, max(last) AS last_protection_at FROM spans GROUP BY ALL
)"""


def _protected(spark, sf: str) -> DataFrame:
    return governance.protected_time(protection_rows(spark, sf), ["page_id"], F.lit("2024-03-01 00:00:00").cast("timestamp"), ("ts", "event_id"))


@query("gov_protected_time", "WITH " + _PROTECTION + " SELECT * FROM protected")
def protected_time(spark, sf: str) -> DataFrame:
    return _protected(spark, sf).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_protection_at", "last_protection_at")})


_GOV_PEN = _penalty(pairs="mutual_revert_pairs", users="unique_editors", edits="edit_count", peak="peak_score")


@query("year_governance", _MONTHS + _pre_ranked("rfc * 18 + arb * 24 + restriction * 20 + talk_edits + reverted_count + reverting_count DESC, talk_bytes DESC, reverted_count + reverting_count DESC") + ", " + _RESTRICTIONS + ", " + _PROTECTION + f""", joined AS (
  SELECT y.*, coalesce(s.restriction_count, 0) AS restriction_count, coalesce(has_sysop, false) AS sysop, coalesce(has_extendedconfirmed, false) AS ext, coalesce(has_cascade, false) AS casc,
    coalesce(p.protection_events, 0) AS protection_events, coalesce(p.protection_days, 0) AS protection_days
  FROM looked y LEFT JOIN signals s ON y.page_id = s.page_id LEFT JOIN protected p ON replace(trim(y.page_title), ' ', '_') = 'Page_' || p.page_id::VARCHAR
), raw AS (
  SELECT *, reverted_count + reverting_count AS raw_activity, rfc + arb + restriction + restriction_count + protection_events AS evidence,
    round(((rfc * 90.0 + arb * 120 + restriction * 70)::DOUBLE + least(110.0, sqrt(talk_edits) * 10) + least(95.0, ln(1 + talk_bytes) * 6) + least(45.0, sqrt(talk_users) * 4)
     + ((restriction_count * 70.0)::DOUBLE + sysop::INT * 130 + ext::INT * 100 + casc::INT * 35 + least(180.0, protection_events * 18.0)::DOUBLE + least(160.0, sqrt(protection_days) * 9))
     + (least(180.0, sqrt(reverted_count + reverting_count) * 17) + least(90.0, sqrt(mutual_reverts) * 11) + least(80.0, mutual_revert_pairs * 12.0)::DOUBLE))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS peak_score FROM joined
), pen AS (SELECT *, round(({_GOV_PEN} * CASE WHEN evidence > 0 THEN 0.35 ELSE 1.0 END)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS routine_penalty FROM raw), fin AS (SELECT *, round((peak_score * (1 - routine_penalty))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS candidate_score FROM pen)
SELECT page_id, evidence, peak_score, candidate_score, row_number() OVER (ORDER BY candidate_score DESC, evidence DESC, talk_bytes DESC, raw_activity DESC, wiki, page_id)::INT AS rank FROM fin
WHERE candidate_score >= 1 AND evidence > 0 ORDER BY rank LIMIT 50""")
def year_governance(spark, sf: str) -> DataFrame:
    rows = ranking.pre_rank(_year(spark, sf), "governance", PRE_RANK)
    titles = _protected(spark, sf).select(F.concat(F.lit("Page_"), F.col("page_id").cast("string")).alias("page_title"), "protection_events", "protection_days")
    rows = governance.with_signals(rows, _admin(spark, sf), titles, ["page_id"])
    return ranking.governance(rows, 50, 1.0).select("page_id", "evidence", "peak_score", "candidate_score", "rank")


#: Stored periods of the year's events: spans of ten days stand for months.
_SPAN = "CASE WHEN day(ts) <= 10 THEN '2024-01' WHEN day(ts) <= 20 THEN '2024-02' ELSE '2024-03' END"
_STORED = _EDGES.replace("d_edges AS", "a_edges AS") + f""",
m_edits AS (SELECT *, {_SPAN} AS span FROM d_history), m_edges AS (SELECT *, {_SPAN} AS span FROM a_edges),
m_counts AS (SELECT span, wiki, page_id, src, dst, count(*) AS n FROM m_edges GROUP BY ALL HAVING count(*) >= 4),
m_mutual AS (SELECT DISTINCT e.span, e.wiki, e.page_id FROM m_counts e JOIN m_counts r ON e.span = r.span AND e.wiki = r.wiki AND e.page_id = r.page_id AND e.src = r.dst AND e.dst = r.src),
m_kept AS (SELECT b.span, b.wiki, b.page_id FROM (SELECT span, wiki, page_id, count(*) AS n, count(DISTINCT user_text) AS users, count(*) FILTER (WHERE is_reverted) AS rd, count(*) FILTER (WHERE is_revert) AS rg FROM m_edits GROUP BY ALL) b
  LEFT JOIN m_mutual m ON b.span = m.span AND b.wiki = m.wiki AND b.page_id = m.page_id WHERE m.span IS NOT NULL OR rd >= 3 OR rg >= 3 OR (n >= 40 AND users >= 8 AND rd + rg >= 2)),
y_edits AS (SELECT e.* FROM m_edits e SEMI JOIN m_kept k ON e.span = k.span AND e.wiki = k.wiki AND e.page_id = k.page_id),
d_edges AS (SELECT e.* FROM m_edges e SEMI JOIN m_kept k ON e.span = k.span AND e.wiki = k.wiki AND e.page_id = k.page_id)"""


def _of(edits: str, sql: str) -> str:
    """The common tables of the boards over other edits."""
    return sql.replace("d_edits", edits).replace("d_history", edits)


def _stored(spark, sf: str) -> DataFrame:
    """What is kept of each page and span."""
    span = F.when(F.dayofmonth("ts") <= 10, "2024-01").when(F.dayofmonth("ts") <= 20, "2024-02").otherwise("2024-03")
    h = A.history(A.edits(spark, sf)).withColumn("month", span)
    return pages.month_records(h, graph.identity_edges(h))


_LAST_TITLE = _ROWS.replace("arg_max(page_title, rev_id)", "max(page_title)")


@query("year_edit_war", _WITH + "," + _STORED + "," + _MUTUAL + "," + _PAIR + "," + _of("y_edits", _DAYS) + "," + _EPISODES + "," + _of("y_edits", _LAST_TITLE) + _SCORED + """
SELECT page_id, revert_count, mutual_revert_pairs, unique_editors, peak_score, candidate_score, row_number() OVER (ORDER BY candidate_score DESC, mutual_revert_pairs DESC, revert_count DESC, peak_score DESC, wiki, page_id)::INT AS rank
FROM scored WHERE coalesce(candidate_score, peak_score, 0) >= 1 AND NOT (revert_density >= 0.82 AND mutual_revert_pairs <= 8 AND unique_editors <= 40) ORDER BY rank LIMIT 50""")
def year_edit_war(spark, sf: str) -> DataFrame:
    """The year's board from what is stored of its months: merged hours and edges, scored again."""
    records = _stored(spark, sf).withColumn("year", F.substring("month", 1, 4))
    rows = ranking.edit_war(pages.year_rollup(records), 50, 1.0, drop_cleanup=True)
    return rows.select("page_id", "revert_count", "mutual_revert_pairs", "unique_editors", "peak_score", "candidate_score", "rank")


@query("stored_months", _WITH + "," + _STORED + """ SELECT e.span AS month, e.page_id, count(*) AS edit_count, count(DISTINCT user_text) AS unique_editors, count(DISTINCT date_trunc('hour', ts)) AS hours,
  coalesce(any_value(x.n), 0)::BIGINT AS edges FROM y_edits e LEFT JOIN (SELECT span, wiki, page_id, count(*) AS n FROM d_edges GROUP BY ALL) x ON e.span = x.span AND e.wiki = x.wiki AND e.page_id = x.page_id GROUP BY ALL""")
def stored_months(spark, sf: str) -> DataFrame:
    """Pages and months that are worth keeping, and what their stored hours sum up to."""
    n = F.aggregate(F.flatten(F.transform("buckets", lambda b: b["edges"])), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    edits = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + b["edit_count"])
    users = F.size(F.array_distinct(F.flatten(F.transform("buckets", lambda b: F.map_keys(b["editors"])))))
    return _stored(spark, sf).select("month", "page_id", edits.alias("edit_count"), users.cast("long").alias("unique_editors"), F.size("buckets").cast("long").alias("hours"), n.alias("edges"))


@query("rescored_months", _WITH + "," + _STORED + """, p_counts AS (SELECT span, wiki, page_id, src, dst, count(*) AS n FROM d_edges GROUP BY ALL HAVING count(*) >= 4),
 p_pairs AS (SELECT e.span, e.wiki, e.page_id, e.n AS ab, r.n AS ba FROM p_counts e JOIN p_counts r ON e.span = r.span AND e.wiki = r.wiki AND e.page_id = r.page_id AND e.src = r.dst AND e.dst = r.src WHERE e.src < e.dst)
 SELECT e.span AS month, e.page_id, count(*) AS edit_count, coalesce(any_value(p.pairs), 0) AS mutual_revert_pairs, coalesce(any_value(p.reverts), 0)::BIGINT AS revert_count,
   round((coalesce(any_value(p.reverts), 0) / count(*))::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS revert_density
 FROM y_edits e LEFT JOIN (SELECT span, wiki, page_id, count(*) AS pairs, sum(ab + ba) AS reverts FROM p_pairs GROUP BY ALL) p ON e.span = p.span AND e.wiki = p.wiki AND e.page_id = p.page_id GROUP BY ALL""")
def rescored_months(spark, sf: str) -> DataFrame:
    """Boards of stored months, computed anew from their hours."""
    return pages.rescored(_stored(spark, sf)).select("month", "page_id", "edit_count", "mutual_revert_pairs", "revert_count", "revert_density")
