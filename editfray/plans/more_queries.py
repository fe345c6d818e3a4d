"""Queries of listings, display rules, joins on candidates and serving functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import display
from ..functions import text as T
from ..operators import graph, lookups, pages, ranking
from ..operators.windows import PAGE
from ..sources import listings
from . import history_queries as H
from . import live_queries as L
from . import serving

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("dump_links", r"""SELECT page_id, unnest(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1), lambda x: x <> '')) AS link FROM pages""")
def dump_links(spark, sf: str) -> DataFrame:
    return A.read(spark, sf, "pages").select("page_id", F.explode(listings.links(F.col("html"))).alias("link"))


@query("dump_partitions", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS partition FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1996-03' AND '1999-10'")
def dump_partitions(spark, sf: str) -> DataFrame:
    names = A.read(spark, sf, "orders").select(F.concat(F.lit("/x/2026-05.enwiki."), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".tsv.bz2")).alias("name")).distinct()
    return listings.partitions(names, "2026-05", "enwiki", "1996-03", "1999-10").select("partition")


@query("dump_shards", """SELECT 'enwiki-20260501-pages-meta-history' || (s_suppkey % 9)::VARCHAR || '.xml-p' || (s_suppkey * 100 + 1)::VARCHAR || 'p' || (s_suppkey * 100 + 100)::VARCHAR || CASE WHEN s_suppkey % 5 = 0 THEN '.7z' ELSE '.bz2' END AS filename,
 s_suppkey * 100 + 1 AS start_id, s_suppkey * 100 + 100 AS end_id FROM supplier""")
def dump_shards(spark, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    base = F.concat(F.lit("d/enwiki-20260501-pages-meta-history"), (k % 9).cast("string"), F.lit(".xml-p"), (k * 100 + 1).cast("string"), F.lit("p"), (k * 100 + 100).cast("string"))
    ends = F.when(k % 5 == 0, F.array(F.lit(".7z"))).when(k % 3 == 0, F.array(F.lit(".7z"), F.lit(".bz2"), F.lit(".gz"))).otherwise(F.array(F.lit(".bz2")))
    return listings.shards(A.read(spark, sf, "supplier").select(F.explode(F.transform(ends, lambda e: F.concat(base, e))).alias("name")), "20260501", "enwiki")


@query("display_values", r"""
 SELECT p_partkey, CASE WHEN b >= 1e6 THEN n(b / 1e6) || ' MB' WHEN b >= 1e3 THEN n(b / 1e3) || ' KB' ELSE n(b) || ' B' END AS size,
   CASE WHEN p_size >= 365 THEN n(p_size / 365) || ' years' WHEN p_size >= 1 THEN n(p_size) || ' days' ELSE n(p_size * 24) || ' hours' END AS days,
   CASE WHEN p_partkey % 13 = 0 THEN 'indefinite' WHEN p_partkey % 7 = 0 THEN '--' ELSE '20' || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '-01-01' END AS expiry,
   array_to_string(list_transform(string_split(replace(p_type, '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '''', '&#039;') AS escaped
 FROM (SELECT *, (p_partkey * p_partkey * 37)::DOUBLE AS b FROM part)""".replace("n(b / 1e6)", "@(b / 1e6)@").replace("n(b / 1e3)", "@(b / 1e3)@").replace("n(b)", "@(b)@").replace("n(p_size / 365)", "@(p_size / 365)@").replace("n(p_size)", "@(p_size::DOUBLE)@").replace("n(p_size * 24)", "@(p_size * 24.0)@"))
def display_values(spark, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    until = F.when(k % 13 == 0, "infinity").when(k % 7 == 0, " ").otherwise(F.concat(F.lit("20"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("0101000000")))
    return A.read(spark, sf, "part").select(
        "p_partkey", display.size((k * k * 37).cast("double")).alias("size"), display.days(F.col("p_size").cast("double")).alias("days"), display.expiry(until).alias("expiry"),
        display.label(F.col("p_type")).alias("label"), display.escaped(F.col("p_name")).alias("escaped"),
    )


def _formatted(sql: str) -> str:
    """@(x)@ as x with groups of three and at most one digit."""
    import re

    return re.sub(r"@(.+?)@", r"regexp_replace(format('{:,.1f}', (\1)::DOUBLE), '\\.0$', '')", sql)


ORACLES["display_values"] = _formatted(ORACLES["display_values"])


@query("display_protection", "WITH " + H._RESTRICTIONS + """ SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'not currently protected' ELSE replace(replace(replace(restriction_levels, 'autoconfirmed', 'semi-protection'), 'extendedconfirmed', 'extended confirmed protection'), 'sysop', 'full protection')
  || CASE WHEN has_cascade THEN ', cascading protection' ELSE '' END END AS state FROM signals""")
def display_protection(spark, sf: str) -> DataFrame:
    from ..operators.governance import restrictions

    s = restrictions(H.restriction_rows(spark, sf), ["page_id"])
    return s.select("page_id", display.protection(F.col("restriction_levels"), F.col("has_cascade"), F.col("page_id") % 5 != 0).alias("state"))


@query("segment_hashes", """SELECT p_partkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS segment_hash FROM (
 SELECT p_partkey, list_reduce([0::BIGINT] || list_transform(string_split(p_name || '-' || p_brand || '-' || p_type, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295::BIGINT) AS h FROM part)""")
def segment_hashes(spark, sf: str) -> DataFrame:
    return A.read(spark, sf, "part").select("p_partkey", display.segment_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("segment_hash"))


@query("display_periods", """WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders), y AS (SELECT substr(m, 1, 4) AS y, count(*) AS n FROM p GROUP BY ALL)
 SELECT 'history:2026-05:' || m AS period, m || ' (2026-05 snapshot)' AS text FROM p UNION SELECT 'history-year:2026-05:' || y, y || ' (2026-05 snapshot, ' || n::VARCHAR || '/12 months)' FROM y""")
def display_periods(spark, sf: str) -> DataFrame:
    """Months and the years they fold to, one set, with their texts."""
    months = A.read(spark, sf, "orders").select(F.concat(F.lit("history:2026-05:"), F.date_format("o_orderdate", "yyyy-MM")).alias("period")).distinct()
    years = months.groupBy(T.period_year(F.col("period")).alias("period")).agg(F.count("*").alias("n"))
    both = serving.periods(months, years).join(years, "period", "left")
    return both.select("period", display.period(F.col("period"), F.coalesce("n", F.lit(0))).alias("text"))


@query("candidate_buckets", f"WITH {A.SQL_EDITS} SELECT page_id, date_trunc('hour', ts) AS bucket, count(*) AS edit_count FROM d_edits WHERE page_id IN (SELECT page_id FROM d_edits GROUP BY page_id HAVING max(rev_id) % 2 = 0) GROUP BY ALL")
def candidate_buckets(spark, sf: str) -> DataFrame:
    from ..operators.windows import hour_edits

    e = A.edits(spark, sf)
    wanted = e.groupBy(*PAGE).agg(F.max("rev_id").alias("m")).where("m % 2 = 0")
    return hour_edits(e).join(wanted, PAGE, "left_semi").select("page_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "edit_count")


@query("evidence_overlay", H._MONTHS + f""" SELECT y.page_id, y.edit_count, CASE WHEN y.page_id % 3 = 0 THEN y.page_id * 2.5::DOUBLE ELSE y.edit_count::DOUBLE END AS candidate_score, y.page_id % 3 = 0 AS has_evidence FROM years y WHERE year = {H._YEAR}""")
def evidence_overlay(spark, sf: str) -> DataFrame:
    rows = H._year(spark, sf).select("page_id", "edit_count", F.col("edit_count").cast("double").alias("candidate_score"))
    evidence = rows.where("page_id % 3 = 0").select("page_id", (F.col("page_id") * 2.5).alias("candidate_score"))
    return ranking.overlay(rows, evidence, ["candidate_score"], ["page_id"]).select("page_id", "edit_count", "candidate_score", "has_evidence")


@query("first_hits", f"WITH {A.SQL_EDITS} SELECT page_title, arg_min(rev_id, rev_id) AS rev_id FROM (SELECT * FROM d_edits ORDER BY ts, rev_id) WHERE page_title <> 'Example page' GROUP BY ALL")
def first_hits(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf)
    return lookups.first_hits(e, e.where("page_title <> 'Example page'"), "page_title", "rev_id", "ts", "rev_id")


@query("revert_pairs", f"""WITH {A.SQL_EDITS}, n AS (SELECT *, count(*) OVER (PARTITION BY wiki, page_id) AS n, lag(rev_id) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id) AS prev FROM d_edits)
 SELECT n.page_id, n.rev_id, n.prev AS prev_rev, length(a.text) AS size, length(b.text) AS prev_size FROM n JOIN documents a ON a.doc_id = n.rev_id JOIN documents b ON b.doc_id = n.prev
 WHERE n.is_revert AND a.text <> '' AND b.text <> ''""")
def revert_pairs(spark, sf: str) -> DataFrame:
    content = A.read(spark, sf, "documents").select(F.col("doc_id").alias("rev_id"), F.col("text").alias("content"))
    out = lookups.revert_pairs(A.edits(spark, sf).withColumnRenamed("is_revert", "undoes"), content, PAGE, ("ts", "rev_id"), F.col("undoes"), full_limit=0)
    return out.select("page_id", "rev_id", F.col("prev.rev_id").alias("prev_rev"), F.length("content").cast("long").alias("size"), F.length("prev_content").cast("long").alias("prev_size"))


@query("revert_like", f"WITH {A.SQL_EDITS} SELECT rev_id, rev_id % 9 = 0 OR regexp_matches(comment, '\\b(revert(ed|ing)?|rvv?|rollback|undid|undo)\\b', 'i') AS revert_like FROM d_edits")
def revert_like(spark, sf: str) -> DataFrame:
    tags = F.when(F.col("rev_id") % 9 == 0, F.array(F.lit("mw-Undo"))).otherwise(F.array(F.lit("mobile edit")))
    return A.edits(spark, sf).select("rev_id", T.is_revert_like(tags, F.col("comment")).alias("revert_like"))


@query("admitted_pages", H._BOARD + """, talk AS (SELECT wiki, page_id, count(*) FILTER (WHERE rev_id % 97 = 0) AS talk_edits FROM d_history GROUP BY ALL)
 SELECT s.page_id FROM scored s JOIN talk t ON s.wiki = t.wiki AND s.page_id = t.page_id WHERE mutual_revert_count > 0 OR mutual_revert_pairs > 0 OR reverted_count >= 3 OR reverting_count >= 3 OR talk_edits >= 3""")
def admitted_pages(spark, sf: str) -> DataFrame:
    h = A.history(A.edits(spark, sf))
    rows = pages.score_pages(h, graph.identity_edges(h)).join(pages.talk_aggregate(h.where("rev_id % 97 = 0")), PAGE, "left")
    return pages.admitted(rows.fillna(0)).select("page_id")


@query("live_candidates", L._LIVE + """ SELECT page_id, rev_id, score FROM (SELECT * FROM live WHERE "window" = '24h' QUALIFY row_number() OVER (PARTITION BY wiki, page_id ORDER BY ts DESC, rev_id DESC) = 1) ORDER BY score DESC, reverts DESC, wiki, page_id LIMIT 3""")
def live_candidates(spark, sf: str) -> DataFrame:
    return serving.live_candidates(L._day_rows(spark, sf, latest=True), 3).select("page_id", "rev_id", "score")


@query("episode_scoreboard", L.ORACLES["live_episodes"].replace("SELECT wiki, page_id, episode::BIGINT", "SELECT page_id, started_at, peak_score, reverts FROM (SELECT wiki, page_id, episode::BIGINT", 1) + ") WHERE started_at >= TIMESTAMP '2024-01-10' - INTERVAL 240 HOUR ORDER BY reverts DESC, pairs DESC, peak_score DESC, score_area DESC, wiki, page_id LIMIT 5")
def episode_scoreboard(spark, sf: str) -> DataFrame:
    from ..operators.windows import live_episodes

    out = serving.episode_scoreboard(live_episodes(L._day_rows(spark, sf)), "2024-01-10", 240, 5)
    return out.select("page_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "peak_score", "reverts")


@query("talk_sentences", r"""WITH cut AS (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM conversations),
 good AS (SELECT conv_id, turn, list_transform(list_filter(s, lambda x: length(x) BETWEEN 20 AND 280 AND NOT starts_with(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), 'archives talk')
   AND (length(lower(x)) - length(replace(lower(x), 'archive', ''))) / 7 < 3), lambda x: trim(x)) AS s FROM cut)
 SELECT conv_id, turn, unnest(generate_series(0, len(s) - 1))::INT AS place, unnest(s) AS sentence FROM good""")
def talk_sentences(spark, sf: str) -> DataFrame:
    c = A.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.talk_sentences(F.col("text"))).alias("place", "sentence"))


@query("graffiti_lines", r"""WITH l AS (SELECT conv_id, turn, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '', 'g')) AS s, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9''’\-–]*'), lambda x: lower(x)) AS w FROM conversations),
 u AS (SELECT *, list_append(list_filter(w, lambda x: length(x) >= 40), CASE WHEN length(s) >= 40 AND NOT regexp_matches(s, '[0-9]') THEN s END) AS long FROM l)
 SELECT conv_id, turn, (len(w) >= 8 AND list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) >= 0.7 * len(w))
   OR len(list_filter(long, lambda x: x IS NOT NULL AND list_max(list_transform(range(1, least(24, length(x) // 2) + 1), lambda k: len(list_filter(range(0, length(x)), lambda i: x[i + 1] = x[i % k + 1])))) / length(x) >= 0.82)) > 0 AS graffiti FROM u""")
def graffiti_lines(spark, sf: str) -> DataFrame:
    return A.read(spark, sf, "conversations").select("conv_id", "turn", T.is_graffiti(F.col("text")).alias("graffiti"))
