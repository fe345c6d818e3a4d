"""Queries of the live path in batch form, of text rules, lookups and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import patterns as P
from ..functions import text as T
from ..functions.entities import unescape_sql
from ..functions.scores import severity
from ..operators import evidence as ev
from ..operators import graph, lookups, windows
from ..operators.windows import PAGE
from ..sources import events as event_source
from ..sources import history_rows
from ..tables import cut

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_WITH = f"WITH {A.SQL_EDITS}, {A.SQL_REVERTS}"
_DELTA = {"5m": ("5 MINUTE", 5), "1h": ("1 HOUR", 2), "24h": ("24 HOUR", 1)}


def _live(name: str) -> str:
    delta, m = _DELTA[name]
    return f"""
 SELECT w.*, round((raw)::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS score, CASE WHEN raw >= 90 THEN 'major' WHEN raw >= 75 THEN 'war' WHEN raw >= 60 THEN 'skirmish' WHEN raw >= 40 THEN 'watch' ELSE 'quiet' END AS severity FROM (
 SELECT *, greatest(0.0, least(10.0, human * {m * 0.75}) + reverts * {m * 5.0} + least(25.0, CASE WHEN human > 0 THEN reverts / human ELSE 0 END * 100) + pairs * 12 + mutual * 4 + least(10.0, greatest(0, users - 2) * 3.0)
   + least(5.0, recent * 0.5) - CASE WHEN share >= 0.75 AND reverts >= 3 THEN 15 ELSE 0 END) AS raw FROM (
 SELECT e.wiki, e.page_id, e.rev_id, e.ts, '{name}' AS window, c.edits, c.human, c.users, c.reverts, coalesce(t.share, 0) AS share, coalesce(p.pairs, 0) AS pairs, coalesce(p.mutual, 0) AS mutual,
   CASE WHEN c.last_human IS NULL THEN 0 ELSE coalesce((SELECT sum(CASE WHEN z.is_revert THEN 5 ELSE 1 END) FROM d_edits z WHERE z.wiki = e.wiki AND z.page_id = e.page_id AND z.ts <= e.ts AND z.ts >= greatest(c.last_human - INTERVAL 5 MINUTE, e.ts - INTERVAL {delta})), 0) END AS recent
 FROM d_edits e
 JOIN (SELECT a.rev_id, count(*) AS edits, count(*) FILTER (WHERE NOT b.user_is_bot) AS human, count(DISTINCT CASE WHEN NOT b.user_is_bot THEN b.user_text END) AS users,
        count(*) FILTER (WHERE b.is_revert) AS reverts, max(b.ts) FILTER (WHERE NOT b.user_is_bot) AS last_human
       FROM d_edits a JOIN d_edits b ON a.wiki = b.wiki AND a.page_id = b.page_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL {delta} GROUP BY a.rev_id) c ON c.rev_id = e.rev_id
 LEFT JOIN (SELECT rev_id, max(n) / sum(n) AS share FROM (SELECT a.rev_id, r.reverter_user, count(*) AS n FROM d_edits a JOIN d_reverts r ON a.wiki = r.wiki AND a.page_id = r.page_id AND r.ts <= a.ts AND r.ts >= a.ts - INTERVAL {delta} GROUP BY ALL) GROUP BY rev_id) t ON t.rev_id = e.rev_id
 LEFT JOIN (SELECT rev_id, count(*) AS pairs, sum(least(x, y)) AS mutual FROM (SELECT a.rev_id, least(r.reverter_user, r.reverted_user) AS u, greatest(r.reverter_user, r.reverted_user) AS v,
        count(*) FILTER (WHERE r.reverter_user < r.reverted_user) AS x, count(*) FILTER (WHERE r.reverter_user > r.reverted_user) AS y
       FROM d_edits a JOIN d_reverts r ON a.wiki = r.wiki AND a.page_id = r.page_id AND r.ts <= a.ts AND r.ts >= a.ts - INTERVAL {delta} WHERE r.reverter_user <> r.reverted_user GROUP BY ALL) WHERE x > 0 AND y > 0 GROUP BY rev_id) p ON p.rev_id = e.rev_id)) w"""


_LIVE = _WITH + ", live AS (" + " UNION ALL ".join(_live(n) for n in _DELTA) + ")"


@query("live_windows", _LIVE + ' SELECT wiki, page_id, rev_id, "window", edits, human, users, reverts, pairs, mutual::BIGINT AS mutual, round((share)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS top_share, round((CASE WHEN human > 0 THEN reverts / human ELSE 0 END)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS revert_density, score, severity FROM live')
def live_windows(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf)
    return windows.live_windows(e, A.reverts(e))


def _day_rows(spark, sf: str, latest: bool = False) -> DataFrame:
    """24h windows with their times; of each page's last day alone, if only the latest is asked for."""
    e = A.edits(spark, sf)
    r = A.reverts(e)
    if latest:
        e = windows.last_days(e)
        r = r.join(e.select(*PAGE, "rev_id"), [*PAGE, "rev_id"], "left_semi")
    return windows.live_windows(e, r, ("24h",)).join(e.select(*PAGE, "rev_id", "ts"), [*PAGE, "rev_id"])


@query("live_latest", _LIVE + """ SELECT page_id, rev_id, score, severity, reverts FROM live WHERE "window" = '24h' QUALIFY row_number() OVER (PARTITION BY wiki, page_id ORDER BY ts DESC, rev_id DESC) = 1""")
def live_latest(spark, sf: str) -> DataFrame:
    """The latest window of each page, as the live list shows them."""
    return graph.first_by(_day_rows(spark, sf, latest=True), PAGE, F.desc("ts"), F.desc("rev_id")).select("page_id", "rev_id", "score", "severity", "reverts")


@query("live_episodes", _LIVE + """, s AS (SELECT *, CASE WHEN score >= 60 THEN 'on' WHEN score < 40 THEN 'off' END AS state FROM live WHERE "window" = '24h'),
 b AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'off') AS before FROM s),
 i AS (SELECT *, sum((state = 'on' AND before <> 'on')::INT) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id) AS episode FROM b)
 SELECT wiki, page_id, episode::BIGINT AS episode, min(ts) AS started_at, max(ts) AS updated_at, max(score) AS peak_score, round((sum(greatest(0.0, score - 40)))::DOUBLE::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS score_area,
   arg_max(reverts, rev_id) AS reverts, arg_max(pairs, rev_id) AS pairs FROM i WHERE state = 'on' GROUP BY ALL""")
def live_episodes(spark, sf: str) -> DataFrame:
    return windows.live_episodes(_day_rows(spark, sf)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "updated_at")})


@query("live_recent_edits", _WITH + " SELECT page_id, rev_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY wiki, page_id ORDER BY ts DESC, rev_id DESC)::INT AS recency FROM d_edits) WHERE recency <= 50")
def live_recent_edits(spark, sf: str) -> DataFrame:
    return windows.last_per_page(A.edits(spark, sf), 50, F.desc("ts"), F.desc("rev_id")).select("page_id", "rev_id", "recency")


@query("page_sessions", _WITH + """, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY wiki, page_id ORDER BY ts) >= INTERVAL 1 HOUR, true)::INT AS starts FROM d_edits),
 s AS (SELECT *, sum(starts) OVER (PARTITION BY wiki, page_id ORDER BY ts, rev_id) AS session FROM g)
 SELECT wiki, page_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS edits, count(DISTINCT user_text) AS users FROM s GROUP BY wiki, page_id, session""")
def page_sessions(spark, sf: str) -> DataFrame:
    return windows.sessions(A.edits(spark, sf), "1 hour").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("normalised_events", """
 SELECT 'enwiki' AS wiki, (event_id * 7919) % 5 + 1 AS page_id, event_id AS rev_id, CASE WHEN event_id > 1 THEN event_id - 1 ELSE -1 END AS parent_rev_id, 'U' || (user_id % 3)::VARCHAR AS user_text, user_id % 4 = 0 AS user_is_anonymous,
   date_trunc('second', ts) AS ts, event_type AS comment FROM events WHERE event_type <> 'view' AND event_id % 11 <> 0 AND event_id > 0""")
def normalised_events(spark, sf: str) -> DataFrame:
    """Raw JSON events, as they come from the feed, to edits."""
    e = A.read(spark, sf, "events")
    raw = F.to_json(F.struct(
        F.lit("en.wikipedia.org").alias("server_name"), F.lit("enwiki").alias("wiki"), F.when(F.col("event_type") == "view", "log").otherwise("edit").alias("type"), F.lit("Example").alias("title"),
        F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string")).alias("user"), F.col("event_type").alias("comment"), F.lit(0).alias("namespace"), ((F.col("event_id") * 7919) % 5 + 1).alias("page_id"),
        F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"), (F.col("event_id") % 11 == 0).alias("bot"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.struct(F.col("event_id").alias("new"), F.when(F.col("event_id") > 1, F.col("event_id") - 1).alias("old")).alias("revision"),
    ))
    out = event_source.edits_of(e.select(raw.alias("payload")), server="en.wikipedia.org", wiki="enwiki", namespace=0)
    return out.select("wiki", "page_id", "rev_id", F.coalesce("parent_rev_id", F.lit(-1)).alias("parent_rev_id"), "user_text", "user_is_anonymous", F.col("ts").cast("timestamp_ntz").alias("ts"), "comment")


@query("history_rows", """
 SELECT 'enwiki' AS wiki, event_id % 7 AS page_id, event_id AS rev_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'U' || (user_id % 3)::VARCHAR END, ''), 'unknown') AS user_text,
   CASE WHEN event_id % 2 = 0 THEN 'T' || (event_id % 7)::VARCHAR ELSE 'page:' || (event_id % 7)::VARCHAR END AS page_title, date_trunc('second', ts) AS ts, (event_id % 2)::INT AS namespace, event_id % 900 AS text_bytes,
   event_type = 'error' AS is_reverted FROM events WHERE event_type <> 'view' AND event_id % 7 <> 0 AND event_id % 13 <> 0 AND event_id > 0""")
def parsed_history(spark, sf: str) -> DataFrame:
    """Lines of a history dump, 78 columns wide, to typed rows."""
    e = A.read(spark, sf, "events")
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    filled = {
        0: F.lit("enwiki"), 2: F.when(F.col("event_type") == "view", "page").otherwise("revision"), 3: F.lit("create"), 4: F.date_format("ts", "yyyy-MM-dd HH:mm:ss'.0'"), 5: F.col("event_type"),
        9: F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("U"), text(F.col("user_id") % 3))), 15: F.when(i % 13 == 0, "name").otherwise(""), 22: F.lit("false"), 28: text(i % 7),
        30: F.when(i % 2 == 0, F.concat(F.lit("T"), text(i % 7))).otherwise(""), 31: text(i % 2), 60: text(i), 65: text(i % 900), 66: F.lit("1"), 72: F.when(F.col("event_type") == "error", "TRUE").otherwise("false"), 73: F.lit(""), 75: F.lit("false"),
    }
    line = F.concat_ws("\t", *[filled.get(k, F.lit("")) for k in range(78)])
    out = history_rows.parse(e.select(line.alias("value")), namespace=0)
    return out.select("wiki", "page_id", "rev_id", "user_text", "page_title", F.col("ts").cast("timestamp_ntz").alias("ts"), "namespace", "text_bytes", "is_reverted")


@query("revert_detection", _WITH + r""", c AS (SELECT rev_id, comment, user_text FROM d_edits),
 x AS (SELECT *, CASE WHEN rev_id % 9 = 0 THEN 'mw-undo' WHEN regexp_matches(comment, '\b(revert(ed|ing)?|undid|undo|rollback|rvv?|restore[ds]?)\b', 'i') THEN 'comment' END AS detector,
   CASE WHEN regexp_matches(comment, '\bby\s+\[\[', 'i') THEN regexp_extract(comment, '\bby\s+\[\[(Special:Contributions/)?([^|\]]+)', 2, 'i')
        WHEN regexp_matches(comment, '\bby\s+([^:;,.()]+?)(\s+\(|$)', 'i') THEN trim(regexp_extract(comment, '\bby\s+([^:;,.()]+?)(\s+\(|$)', 1, 'i')) END AS who FROM c)
 SELECT rev_id, detector, CASE detector WHEN 'mw-undo' THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END AS confidence, CASE WHEN who <> user_text THEN who END AS reverted_user,
   coalesce(TRY_CAST(nullif(regexp_extract(comment, '\brevision\s+(\d+)\b', 1, 'i'), '') AS BIGINT), -1) AS reverted_rev_id FROM x WHERE detector IS NOT NULL""")
def revert_detection(spark, sf: str) -> DataFrame:
    e = A.edits(spark, sf).withColumn("tags", F.when(F.col("rev_id") % 9 == 0, F.array(F.lit("mw-undo"), F.lit("visualeditor"))))
    return event_source.revert_signals(e).select("rev_id", "detector", "confidence", "reverted_user", F.coalesce("reverted_rev_id", F.lit(-1)).alias("reverted_rev_id"))


#: Texts of conversations as comments: of every second turn the points and commas are character references.
_COMMENTS = "(SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(replace(coalesce(text, ''), '.', '&period;'), ',', '&#44') ELSE coalesce(text, '') END AS raw FROM conversations)"
_DECODED = f"(SELECT *, {unescape_sql('raw')} AS c FROM {_COMMENTS})"


def _comments(spark, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    coded = F.replace(F.replace(text, F.lit("."), F.lit("&period;")), F.lit(","), F.lit("&#44"))
    return A.read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, coded).otherwise(text).alias("text"))


@query("comment_rules", rf"""
 SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '/\*.*?\*/', ' ', 'g'), '\[\[[^\]]+\]\]', ' ', 'g'), '\s+', ' ', 'g'), ' -:') AS cleaned,
   regexp_matches(raw, '\b(vandal(ism|s)?|rvv|graffiti|blank(ing|ed)?|test edit|nonsense|spam|hoax|unconstructive)\b', 'i') AS cleanup FROM {_DECODED}""")
def comment_rules(spark, sf: str) -> DataFrame:
    return _comments(spark, sf).select("conv_id", "turn", T.clean_comment(F.col("text")).alias("cleaned"), T.is_cleanup(F.col("text")).alias("cleanup"))


def _q(pattern: str) -> str:
    """A pattern as the engine of the SQL reads it: its classes are those of ASCII."""
    return "'" + pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"


_GENERATED = lambda c: f"regexp_matches(regexp_replace({c}, '<[^>]+>', ' ', 'g'), {_q(P.GENERATED)})"
_CLEANED = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '/\\*.*?\\*/', ' ', 'g'), '\\[\\[[^\\]]+\\]\\]', ' ', 'g'), '\\s+', ' ', 'g'), ' -:')"
_SUBSTANCE = lambda c: (
    f"len(list_filter(regexp_extract_all(trim(regexp_replace({c}, {_q(P.GENERIC_ACTION)}, '')), {_q(P.WORD)}), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({list(P.STOPWORDS)}, lower(w)))) >= 3"
)


@query("first_shots", rf"""WITH a AS {_DECODED}, b AS (SELECT *, {_CLEANED("c")} AS cleaned FROM a),
 s AS (SELECT *, CASE WHEN regexp_matches(cleaned, '.{{12,240}}?[.!?](\s|$)') THEN trim(regexp_extract(cleaned, '(.{{12,240}}?[.!?])(\s|$)', 1)) ELSE trim(substr(cleaned, 1, 240)) END AS sentence FROM b)
 SELECT conv_id, turn, sentence, {_GENERATED("c")} OR regexp_matches(cleaned, {_q(P.GENERATED)}) AS generated, {_SUBSTANCE("raw")} AS substance,
   CASE WHEN sentence <> '' AND NOT regexp_matches(sentence, {_q(P.CLEANUP)}) AND NOT {_GENERATED("c")} AND NOT regexp_matches(cleaned, {_q(P.GENERATED)}) AND NOT {_GENERATED("sentence")} AND {_SUBSTANCE("sentence")} THEN sentence ELSE '' END AS shot FROM s""")
def first_shots(spark, sf: str) -> DataFrame:
    c = _comments(spark, sf)
    return c.select("conv_id", "turn", T.first_sentence(F.col("text")).alias("sentence"), T.first_shot(F.col("text")).alias("shot"), T.is_generated(F.col("text")).alias("generated"), T.has_substance(F.col("text")).alias("substance"))


@query("plain_wikitext", f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, {_q(P.REF)}, ' ', 'g'),
   {_q(P.TEMPLATE)}, ' ', 'g'), {_q(P.WIKILINK)}, '\\1', 'g'), {_q(P.SECTION)}, ' \\1. ', 'g'), '<[^>]+>', ' ', 'g'), repeat(chr(39), 3), ''), repeat(chr(39), 2), ''), 'https?://\\S+', ' ', 'g'), '[\\[\\]{{}}|=*#_:;]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, {unescape_sql("coalesce(html, '')")} AS html FROM pages)""")
def plain_wikitext(spark, sf: str) -> DataFrame:
    return A.read(spark, sf, "pages").select("page_id", T.clean_wikitext(F.col("html")).alias("text"))


@query("title_keys", """SELECT c_custkey, regexp_replace(replace(c_name, ' ', '_'), '^Talk:', '') AS history_title, replace(trim(c_name), ' ', '_') AS lookup_title, trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) AS normal FROM customer""")
def title_keys(spark, sf: str) -> DataFrame:
    c = A.read(spark, sf, "customer")
    return c.select("c_custkey", T.history_title(F.col("c_name")).alias("history_title"), T.lookup_title(F.col("c_name")).alias("lookup_title"), T.normal(F.col("c_name")).alias("normal"))


@query("periods", """
 WITH p AS (SELECT DISTINCT 'history:2026-05:' || strftime(o_orderdate, '%Y-%m') AS period, date_trunc('month', o_orderdate)::TIMESTAMP AS start FROM orders)
 SELECT period, 'history-year:2026-05:' || substr(period, 17, 4) AS year_period, start AS period_start, (start + INTERVAL 1 MONTH)::TIMESTAMP AS period_end, '20260501' AS snapshot,
   count(*) OVER (PARTITION BY substr(period, 17, 4)) AS months_of_year, row_number() OVER (ORDER BY period DESC)::INT AS place FROM p""")
def periods(spark, sf: str) -> DataFrame:
    p = A.read(spark, sf, "orders").select(F.concat(F.lit("history:2026-05:"), F.date_format("o_orderdate", "yyyy-MM")).alias("period")).distinct()
    b = T.period_bounds(F.col("period"))
    rows = p.withColumn("year_period", T.period_year(F.col("period"))).withColumn("b", b)
    years = rows.groupBy("year_period").agg(F.count("*").alias("months_of_year"))
    return rows.join(years, "year_period").select(
        "period", "year_period", F.col("b.start").cast("timestamp_ntz").alias("period_start"), F.col("b.end").cast("timestamp_ntz").alias("period_end"), T.snapshot_id(F.col("period")).alias("snapshot"), "months_of_year",
        F.row_number().over(Window.orderBy(F.desc("period"))).alias("place"),
    )


@query("shard_routing", """SELECT page_id, arg_min(filename, start_id * 1000 + n_nationkey) AS filename FROM (SELECT DISTINCT c_custkey AS page_id FROM customer) JOIN
 (SELECT n_nationkey, 'shard-' || lpad(n_nationkey::VARCHAR, 2, '0') AS filename, n_nationkey * 50 + 1 AS start_id, n_nationkey * 50 + 60 AS end_id FROM nation) ON page_id BETWEEN start_id AND end_id GROUP BY page_id""")
def shard_routing(spark, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    shards = A.read(spark, sf, "nation").select(F.concat(F.lit("shard-"), F.lpad(n.cast("string"), 2, "0")).alias("filename"), (n * 50 + 1).alias("start_id"), (n * 50 + 60).alias("end_id"))
    return lookups.shards_of(A.read(spark, sf, "customer").select(F.col("c_custkey").alias("page_id")).distinct(), shards)


@query("match_candidates", """SELECT p.p_partkey AS page_id, coalesce(t.candidate, i.candidate) AS candidate FROM part p
 LEFT JOIN (SELECT p_name, min(s_suppkey) AS candidate FROM supplier JOIN part ON p_partkey = s_suppkey * 3 GROUP BY p_name) t ON t.p_name = p.p_name
 LEFT JOIN (SELECT s_suppkey * 5 AS page_id, s_suppkey AS candidate FROM supplier) i ON i.page_id = p.p_partkey WHERE coalesce(t.candidate, i.candidate) IS NOT NULL""")
def match_candidates(spark, sf: str) -> DataFrame:
    part, s = A.read(spark, sf, "part"), A.read(spark, sf, "supplier").select("s_suppkey")
    titles = s.join(part.select((F.col("p_partkey") / 3).cast("long").alias("s_suppkey"), "p_name", "p_partkey"), "s_suppkey").where("p_partkey = s_suppkey * 3").groupBy("p_name").agg(F.min("s_suppkey").alias("candidate"))
    candidates = titles.select(F.col("p_name").alias("title"), F.lit(None).cast("long").alias("page_id"), "candidate").unionByName(s.select(F.lit(None).cast("string").alias("title"), (F.col("s_suppkey") * 5).alias("page_id"), F.col("s_suppkey").alias("candidate")))
    pages = part.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("page_id"))
    by_title, by_id = candidates.where("title IS NOT NULL"), candidates.where("page_id IS NOT NULL")
    return lookups.match_candidates(pages, by_title.unionByName(by_id)).select("page_id", "candidate")


@query("adjacent_revisions", _WITH + " SELECT page_id, rev_id, lag(rev_id) OVER w AS prev_rev, lag(user_text) OVER w AS prev_user FROM d_edits WINDOW w AS (PARTITION BY wiki, page_id ORDER BY ts, rev_id) QUALIFY lag(rev_id) OVER w IS NOT NULL")
def adjacent_revisions(spark, sf: str) -> DataFrame:
    rows = lookups.adjacent(A.edits(spark, sf), PAGE, ("ts", "rev_id"), ["rev_id", "user_text"])
    return rows.select("page_id", "rev_id", F.col("prev.rev_id").alias("prev_rev"), F.col("prev.user_text").alias("prev_user"))


@query("pending_periods", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE year(o_orderdate) % 2 = 1 ")
def pending_periods(spark, sf: str) -> DataFrame:
    o = A.read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.year("o_orderdate").alias("y"))
    return lookups.pending(o.select("month").distinct(), o.where("y % 2 = 0").select("month").distinct(), "month")


@query("insert_or_ignore", "SELECT user_id % 97 AS k, min(event_id) AS event_id FROM events WHERE user_id % 97 >= 10 GROUP BY ALL")
def insert_or_ignore(spark, sf: str) -> DataFrame:
    e = A.read(spark, sf, "events").select((F.col("user_id") % 97).alias("k"), "event_id")
    return lookups.new_rows(e, e.where("k < 10").select("k").distinct(), ["k"], "event_id")


@query("talk_pages", """
 WITH a AS (SELECT event_id, ts, 't' || (user_id % 50)::VARCHAR AS title, event_id % 400 AS page_id FROM events WHERE event_id % 4 = 0),
 t AS (SELECT event_id, ts, 't' || (user_id % 50)::VARCHAR AS title FROM events WHERE event_id % 4 <> 0)
 SELECT t.event_id AS rev_id, coalesce((SELECT arg_max(page_id, event_id) FROM a WHERE a.title = t.title AND (a.ts, a.event_id) < (t.ts, t.event_id)), (SELECT arg_min(page_id, event_id) FROM a WHERE a.title = t.title AND (a.ts, a.event_id) > (t.ts, t.event_id))) AS article_id
 FROM t WHERE title IN (SELECT title FROM a)""")
def talk_pages(spark, sf: str) -> DataFrame:
    from ..operators import pages

    e = A.read(spark, sf, "events").select(F.lit("enwiki").alias("wiki"), F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string")).alias("title"), "ts", F.col("event_id").alias("rev_id"), (F.col("event_id") % 400).alias("page_id"))
    return pages.talk_pages(e.where("rev_id % 4 = 0"), e.where("rev_id % 4 <> 0")).select("rev_id", "article_id")


@query("severities", "SELECT o_orderkey, CASE WHEN o_totalprice % 100 >= 90 THEN 'major' WHEN o_totalprice % 100 >= 75 THEN 'war' WHEN o_totalprice % 100 >= 60 THEN 'skirmish' WHEN o_totalprice % 100 >= 40 THEN 'watch' ELSE 'quiet' END AS severity FROM orders")
def severities(spark, sf: str) -> DataFrame:
    return A.read(spark, sf, "orders").select("o_orderkey", severity(F.col("o_totalprice") % 100).alias("severity"))


def revisions(spark, sf: str) -> DataFrame:
    """Six revisions of each document: odd ones replace its first word of four letters and more."""
    d = A.read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "text")
    word = F.regexp_extract("text", r"[A-Za-z]{4,}", 0)
    swapped = F.when(word == "", F.col("text")).otherwise(F.expr("concat(substring_index(text, regexp_extract(text, '[A-Za-z]{4,}', 0), 1), 'Dictator', substring(text, length(substring_index(text, regexp_extract(text, '[A-Za-z]{4,}', 0), 1)) + length(regexp_extract(text, '[A-Za-z]{4,}', 0)) + 1))"))
    return d.select(
        "page_id", (F.col("page_id") * 10 + F.col("k")).alias("rev_id"), F.timestamp_seconds(F.col("k") * 3600).alias("ts"), F.concat(F.lit("U"), (F.col("k") % 2).cast("string")).alias("user_text"),
        F.when(F.col("k") >= 2, "revert, see the sourced wording of this lead").otherwise("edit of the opening words").alias("comment"), F.array().cast("array<string>").alias("tags"),
        F.when(F.col("k") % 2 == 1, swapped).otherwise(F.col("text")).alias("content"),
    )


@query("changed_segments")
def changed_segments(spark, sf: str) -> DataFrame:
    return ev.pair_segments(revisions(spark, sf), ["page_id"], ("ts", "rev_id")).select("page_id", "rev_id", "pos", "segment", "change_type", "swap_values", "changed_word_count")


def _stats(spark, sf: str) -> DataFrame:
    # Three aggregates read the changes: texts are aligned once.
    found = cut(ev.pair_segments(revisions(spark, sf), ["page_id"], ("ts", "rev_id")), "changes")
    return ev.segment_stats(found, ["page_id"], ("ts", "rev_id"))


@query("battles")
def battles(spark, sf: str) -> DataFrame:
    return ev.battles(_stats(spark, sf), ["page_id"])


def _talk(spark, sf: str) -> DataFrame:
    c = A.read(spark, sf, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("page_id"), F.timestamp_seconds(F.col("turn") * 60).alias("ts"), F.col("turn").alias("rev_id"), F.concat(F.lit("U"), (F.col("turn") % 3).cast("string")).alias("user_text"), F.lit("reply on the disputed source").alias("comment"), F.col("text").alias("content"))


@query("talk_evidence")
def talk_evidence(spark, sf: str) -> DataFrame:
    # Several parts of what is said read the terms: phrases are chosen once.
    own = cut(ev.terms(ev.battles(_stats(spark, sf), ["page_id"]), ["page_id"]), "terms")
    return ev.talk_evidence(_talk(spark, sf), own, ["page_id"])


@query("controversy")
def controversy(spark, sf: str) -> DataFrame:
    found = cut(ev.usable(ev.battles(_stats(spark, sf), ["page_id"])), "phrases")
    talk = ev.talk_scores(ev.talk_evidence(_talk(spark, sf), cut(ev.terms(found, ["page_id"]), "terms"), ["page_id"]), ["page_id"])
    pages = A.read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), (F.col("n_chars") % 400).cast("double").alias("peak_score"), (F.col("n_chars") % 90).alias("revert_count"), (F.col("n_chars") % 6).alias("mutual_revert_pairs"))
    return ev.controversy(pages, found, talk, ["page_id"])
