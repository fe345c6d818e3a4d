"""Hour buckets, trailing days, episodes and live windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import live_score, severity, window_score
from ..schema import EFFECTIVE_EDGE, EPISODE_OFF, EPISODE_ON, LIVE_FACTORS, LIVE_WINDOWS, WINDOW_HOURS
from .graph import edge_counts, pair_metrics

PAGE = ["wiki", "page_id"]


def hour_edits(edits: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """keys, bucket, edit_count, editors: distinct users of each hour that has edits."""
    return edits.groupBy(*keys, F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("edit_count"), F.collect_set("user_text").alias("editors"))


def hour_edges(edges: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    return edge_counts(edges.withColumn("bucket", F.date_trunc("hour", "ts")), [*keys, "bucket"])


def _epoch(c: str):
    return F.unix_timestamp(c)


def trailing(df: DataFrame, keys: list[str], hours: int = WINDOW_HOURS) -> DataFrame:
    """Each row in the buckets of the `hours` hours that begin with its own, as column b: an equi-join then finds the buckets there are."""
    later = F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda i: F.timestamp_seconds(_epoch("bucket") + i * 3600))
    return df.withColumn("b", F.explode(later))


def day_scores(edits: DataFrame, edges: DataFrame, keys: list[str] = PAGE, least: int = EFFECTIVE_EDGE) -> DataFrame:
    """bucket_scores() of single edits and reverts."""
    return bucket_scores(hour_edits(edits, keys), hour_edges(edges, keys), keys, least)


def bucket_scores(hours: DataFrame, by_hour: DataFrame, keys: list[str] = PAGE, least: int = EFFECTIVE_EDGE) -> DataFrame:
    """keys, bucket, edit_count, users, reverts, pairs, current and score: of each hour with edits, the trailing day.

    hours: keys, bucket, edit_count, editors; by_hour: keys, bucket, src, dst, n. Edges count once they reach `least`
    within the day in both directions. The join is on (page, hour): an hour's edges go to the 24 hours they are part of."""
    there = hours.select(*keys, F.col("bucket").alias("b"))
    spread = trailing(hours, keys).join(there, [*keys, "b"])
    activity = spread.groupBy(*keys, "b").agg(F.sum("edit_count").alias("edit_count"), F.size(F.array_distinct(F.flatten(F.collect_list("editors")))).cast("long").alias("users"))
    counts = (
        trailing(by_hour, keys).join(there, [*keys, "b"]).groupBy(*keys, "b", "src", "dst")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bucket") == F.col("b"), F.col("n")).otherwise(0)).alias("now")).where(F.col("n") >= least)
    )
    mutual = counts.withColumns({"p": F.least("src", "dst"), "q": F.greatest("src", "dst")}).groupBy(*keys, "b", "p", "q").agg(F.count("*").alias("ways"), F.sum("now").alias("now"))
    current = mutual.where("ways = 2").groupBy(*keys, "b").agg(F.sum("now").alias("current"))
    metrics = pair_metrics(counts.select(*keys, "b", "src", "dst", "n"), [*keys, "b"])
    all_ = activity.join(metrics, [*keys, "b"], "left").join(current, [*keys, "b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = window_score(F.col("edit_count"), F.col("users"), zero("reverts"), F.col("best"), F.col("total"), F.col("ends"), F.col("top_share"), zero("current"))
    return all_.select(*keys, F.col("b").alias("bucket"), "edit_count", "users", zero("reverts").alias("reverts"), zero("pairs").alias("pairs"), zero("current").alias("current"), score.alias("score"))


def episodes(scored: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """keys, peak_score, episode_count, war_minutes of rows (bucket, score, current): hysteresis as a fill of the last decided state."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    gap = _epoch("bucket") - F.lag(_epoch("bucket")).over(order) > WINDOW_HOURS * 3600
    rows = scored.withColumn("gap", F.coalesce(gap, F.lit(False)))
    state = F.when((F.col("score") >= EPISODE_ON) & (F.col("current") > 0), "on").when((F.col("score") < EPISODE_OFF) | (F.col("current") == 0) | F.col("gap"), "off")
    rows = rows.withColumn("state", state)
    before = F.last("state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.when(F.col("gap"), "off").otherwise(F.coalesce(before, F.lit("off"))))
    on = F.coalesce(F.col("state") == "on", F.lit(False))
    return rows.groupBy(*keys).agg(
        F.round(F.max("score"), 2).alias("peak_score"), F.count_if(on & (F.col("before") != "on")).alias("episode_count"), (F.count_if(on) * 60).alias("war_minutes")
    )


_US = 1_000_000
_STEP = 86_400 * _US


def running(rows: DataFrame, keys: list[str], sums: list[str], last: list[str] = (), at: str = "at") -> DataFrame:
    """rows with, in place of each column of `sums`, its sum over all rows of the key up to the same time, and of `last` its largest value.

    A key's rows are dealt by day; what the days before hold comes from a row a day. So a hot key is no single task, and no
    frame slides: each row is added once."""
    day = Window.partitionBy(*keys, "__day").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("__day", F.floor(F.col(at) / F.lit(_STEP)))
    days = dealt.groupBy(*keys, "__day").agg(*[F.sum(c).alias(f"__{c}") for c in sums], *[F.max(c).alias(f"__{c}") for c in last])
    days = days.select(*keys, "__day", *[F.sum(f"__{c}").over(before).alias(f"__{c}") for c in sums], *[F.max(f"__{c}").over(before).alias(f"__{c}") for c in last])
    within = dealt.withColumns({c: F.sum(c).over(day) for c in sums} | {c: F.max(c).over(day) for c in last})
    joined = within.join(days, [*keys, "__day"])
    new = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in sums} | {c: F.greatest(c, f"__{c}") for c in last}
    return joined.withColumns(new).select(*rows.columns)


def trailing_sums(rows: DataFrame, keys: list[str], seconds: int, sums: list[str], last: list[str] = ()) -> DataFrame:
    """rows (at in microseconds) with each column of `sums` summed over the key's last `seconds`, both ends included: what
    comes in is added, and taken out again when its time is over. `last` as in running(). A row marked `__mine` = 0 is not returned."""
    rows = rows if "__mine" in rows.columns else rows.withColumn("__mine", F.lit(1))
    over = rows.where(" OR ".join(f"{c} <> 0" for c in sums)).withColumns(
        {"at": F.col("at") + (seconds * _US + 1), "__mine": F.lit(0)} | {c: -F.col(c) for c in sums} | {c: F.lit(None).cast(rows.schema[c].dataType) for c in last}
    )
    return running(rows.unionByName(over), keys, sums, list(last)).where("__mine = 1").drop("__mine")


#: What a live window counts of its page, as sums of what comes and goes.
_LIVE_SUMS = ("edits", "human", "reverts", "users", "pairs", "mutual", "top", "edges")


def _in_windows(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows once for each live window, with its name and its length in microseconds."""
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(LIVE_WINDOWS[n] * _US).alias("us")) for n in names])
    return rows.withColumn("__w", F.explode(each)).select("*", "__w.*").drop("__w")


def _arrivals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """1 for an edit before which its user was away from the page for longer than the window, and -1 for the times at which users leave:
    of `users` a sum up to a time counts the users of its window."""
    humans = parts.where("NOT user_is_bot AND user_text <> ''").select(*keys, "us", "user_text", "at").distinct()
    by = Window.partitionBy(*keys, "user_text").orderBy("at")
    come = F.coalesce(F.col("at") - F.lag("at").over(by) > F.col("us"), F.lit(True))
    go = F.coalesce(F.lead("at").over(by) - F.col("at") > F.col("us"), F.lit(True))
    moves = F.array_compact(F.array(F.when(F.col("come"), F.struct("at", F.lit(1).alias("users"))), F.when(F.col("go"), F.struct((F.col("at") + F.col("us") + 1).alias("at"), F.lit(-1).alias("users")))))
    return humans.withColumns({"come": come, "go": go}).select(*keys, F.explode(moves).alias("m")).select(*keys, "m.at", "m.users")


def _edge_moves(events: DataFrame, keys: list[str]) -> list[DataFrame]:
    """By how much the metrics of a window move, and when: each revert comes, and goes when its time is over.

    A count changes by known amounts, so what hangs on it does: `pairs` and `mutual` on the two counts of a pair; `top`, the largest count of one reverter, on
    how many reverters reach each level (as those who reach a level reach all below, it is the number of levels that someone reaches). Rows are linear in reverts."""
    moves = events.withColumn("m", F.explode(F.array(F.struct("at", F.lit(1).alias("d")), F.struct((F.col("at") + F.col("us") + 1).alias("at"), F.lit(-1).alias("d"))))).select(*keys, "a", "b", "m.*")
    p, q = F.least("a", "b"), F.greatest("a", "b")
    pair = moves.where("a <> '' AND b <> '' AND a <> b").groupBy(*keys, p.alias("p"), q.alias("q"), "at").agg(
        F.sum(F.when(F.col("a") == p, F.col("d")).otherwise(0)).alias("x"), F.sum(F.when(F.col("a") == q, F.col("d")).otherwise(0)).alias("y")
    )
    pair = running(pair.withColumns({"ab": F.col("x"), "ba": F.col("y")}), [*keys, "p", "q"], ["ab", "ba"])
    low = F.least("ab", "ba") - F.least(F.col("ab") - F.col("x"), F.col("ba") - F.col("y"))
    both = lambda u, v: ((u > 0) & (v > 0)).cast("int")
    pair = pair.select(*keys, "at", (both(F.col("ab"), F.col("ba")) - both(F.col("ab") - F.col("x"), F.col("ba") - F.col("y"))).alias("pairs"), low.alias("mutual")).where("pairs <> 0 OR mutual <> 0")
    users = moves.groupBy(*keys, "a", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    users = running(users.withColumn("n", F.col("d")), [*keys, "a"], ["n"])
    was = F.col("n") - F.col("d")
    levels = users.select(*keys, "at", F.signum("d").cast("int").alias("d"), F.explode(F.sequence(F.least("n", was) + 1, F.greatest("n", was))).alias("level"))
    levels = levels.groupBy(*keys, "level", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    levels = running(levels.withColumn("n", F.col("d")), [*keys, "level"], ["n"])
    top = levels.select(*keys, "at", ((F.col("n") > 0).cast("int") - (was > 0).cast("int")).alias("top")).where("top <> 0")
    return [pair, top, moves.groupBy(*keys, "at").agg(F.sum("d").alias("edges"))]


def live_windows(edits: DataFrame, reverts: DataFrame, names: tuple[str, ...] = tuple(LIVE_WINDOWS)) -> DataFrame:
    """A row for each edit and live window (5m, 1h, 24h): counts, metrics, score and severity over what the page has had since.

    edits: wiki, page_id, rev_id, ts, user_text, user_is_bot; reverts: wiki, page_id, rev_id, ts, reverter_user, reverted_user.
    All that a window shows is a sum of what comes and what goes, pair metrics and the top reverter's count too; all windows are one pass, and its rows are
    linear in edits and reverts: no edit ever meets an edge."""
    keys = [*PAGE, "window"]
    mine = reverts.select(*PAGE, "rev_id", F.lit(1).alias("reverts"))
    parts = edits.select(*PAGE, "rev_id", "user_text", "user_is_bot", F.unix_micros("ts").alias("at")).join(mine, [*PAGE, "rev_id"], "left").fillna(0, ["reverts"])
    human, nothing = ~F.col("user_is_bot"), F.lit(None).cast("long")
    dealt = _in_windows(parts, names)
    come = dealt.select(*keys, "rev_id", "at", F.lit(1).alias("__mine"), F.when(human, F.col("at")).alias("last_human"), F.lit(1).alias("edits"), human.cast("int").alias("human"), "reverts")
    go = dealt.select(*keys, nothing.alias("rev_id"), (F.col("at") + F.col("us") + 1).alias("at"), F.lit(0).alias("__mine"), nothing.alias("last_human"), F.lit(-1).alias("edits"), (-human.cast("int")).alias("human"), (-F.col("reverts")).alias("reverts"))
    users = [F.coalesce(c, F.lit("")).alias(n) for c, n in (("reverter_user", "a"), ("reverted_user", "b"))]
    events = _in_windows(reverts.select(*PAGE, F.unix_micros("ts").alias("at"), *users), names)
    line = come.unionByName(go)
    for more in (_arrivals(dealt, keys), *_edge_moves(events, keys)):
        line = line.unionByName(more.withColumn("__mine", F.lit(0)), allowMissingColumns=True)
    line = line.fillna(0, list(_LIVE_SUMS))
    rows = running(line, keys, list(_LIVE_SUMS), ["last_human"]).where("__mine = 1").drop("__mine")
    span = F.coalesce(*[F.when(F.col("window") == n, F.lit(LIVE_WINDOWS[n] * _US)) for n in names])
    rows = rows.withColumn("last_human", F.when(F.col("last_human") >= F.col("at") - span, F.col("last_human")))
    # What happened in the five minutes before the last human edit of the window: by what those before it had, and what has come since.
    weighed = parts.select(*PAGE, "at", F.lit(1).alias("__mine"), (1 + 4 * F.col("reverts")).alias("before"), (1 + 4 * F.col("reverts")).alias("upto"))
    late = weighed.withColumns({"at": F.col("at") + (300 * _US + 1), "before": -F.col("before"), "upto": F.lit(0), "__mine": F.lit(0)})
    upto = running(weighed.unionByName(late), PAGE, ["before", "upto"]).where("__mine = 1").dropDuplicates([*PAGE, "at"])
    rows = rows.join(upto.select(*PAGE, F.col("at").alias("last_human"), F.col("before").alias("l_before"), F.col("upto").alias("l_upto")), [*PAGE, "last_human"], "left")
    rows = rows.join(upto.select(*PAGE, "at", F.col("upto").alias("h_upto")), [*PAGE, "at"], "left")
    recent = F.when(F.col("last_human").isNull(), 0).otherwise(F.least(F.col("edits") + 4 * F.col("reverts"), F.col("l_before") + F.col("h_upto") - F.col("l_upto")))
    share = F.when(F.col("edges") > 0, F.col("top") / F.col("edges")).otherwise(0.0)
    return live_rows(rows.withColumns({"recent": recent, "top_share": share}), names)


def live_rows(rows: DataFrame, names: tuple[str, ...] = tuple(LIVE_WINDOWS), also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of what live windows count (page, rev_id, window, edits, human, users, reverts, pairs, mutual, top_share, recent), scored; columns of `also` pass through."""
    score = lambda n: live_score(LIVE_FACTORS[n], F.col("human"), F.col("users"), F.col("reverts"), F.col("top_share"), F.col("pairs"), F.col("mutual"), F.col("recent"))
    rows = rows.withColumn("raw", F.coalesce(*[F.when(F.col("window") == n, score(n)) for n in names]))
    return rows.select(
        *PAGE, "rev_id", *also, "window", "edits", "human", "users", "reverts", "pairs", "mutual", F.round("top_share", 4).alias("top_share"),
        F.round(F.when(F.col("human") > 0, F.col("reverts") / F.col("human")).otherwise(0.0), 4).alias("revert_density"), F.round("raw", 2).alias("score"), severity(F.col("raw")).alias("severity"),
    )


def last_days(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Of each page the rows of the `hours` up to its last one, that included: all that its latest live window reads."""
    ends = rows.groupBy(*PAGE).agg(F.max("ts").alias("__end"))
    return rows.join(ends, PAGE).where(F.col("ts") >= F.col("__end") - F.make_dt_interval(hours=F.lit(hours))).drop("__end")


def live_episodes(windows: DataFrame, at: str = "ts") -> DataFrame:
    """Live episodes over 24h rows (page, ts, rev_id, score, reverts, pairs): open at 60, untouched from 40 to 60, closed under 40."""
    order = Window.partitionBy(*PAGE).orderBy(at, "rev_id")
    state = F.when(F.col("score") >= EPISODE_ON, "on").when(F.col("score") < EPISODE_OFF, "off")
    rows = windows.withColumn("state", state)
    before = F.coalesce(F.last("state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit("off"))
    rows = rows.withColumn("rise", ((F.col("state") == "on") & (before != "on")).cast("int"))
    rows = rows.withColumn("episode", F.sum(F.coalesce("rise", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("state = 'on'").groupBy(*PAGE, "episode").agg(
        F.min(at).alias("started_at"), F.max(at).alias("updated_at"), F.max("score").alias("peak_score"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("score") - EPISODE_OFF)), 2).alias("score_area"),
        F.max_by("reverts", F.struct(at, "rev_id")).alias("reverts"), F.max_by("pairs", F.struct(at, "rev_id")).alias("pairs"),
    )


def last_per_page(df: DataFrame, n: int, *order) -> DataFrame:
    """The last n rows of each page by an order, ranked from the newest."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))).where(F.col("recency") <= n)


def sessions(edits: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions of a page's activity, the native counterpart of the episodes' reset."""
    return edits.groupBy(*PAGE, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("edits"), F.size(F.collect_set("user_text")).cast("long").alias("users")).select(*PAGE, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "edits", "users")
