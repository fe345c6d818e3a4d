"""The live path on streams: deduplicated edits, windows of the pages touched, and episodes as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import PAGE, live_windows
from ..schema import EPISODE_OFF, EPISODE_ON
from ..sources.events import edits_of, revert_signals

LATE = "24 hours"
EPISODE = "wiki string, page_id long, episode long, status string, started_at timestamp, updated_at timestamp, peak_score double, score_area double, reverts long, pairs long"
_STATE = "episode long, open boolean, started_at timestamp, peak double, area double"


def edit_stream(raw: DataFrame, server: str, wiki: str, namespace: int = 0, late: str = LATE) -> DataFrame:
    """Edits of a stream of (payload, stream_id); repeats of a revision within `late` go.

    The time of the state is the time at which a revision comes, not the edit's own: so that an edit of any age is taken."""
    edits = edits_of(raw, server, wiki, namespace).withColumn("came", F.current_timestamp()).withWatermark("came", late)
    return edits.dropDuplicatesWithinWatermark(["wiki", "rev_id"]).drop("came")


def hourly(edits: DataFrame) -> DataFrame:
    """Edits and users of each page and hour, by tumbling windows."""
    rows = edits.groupBy(*PAGE, F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("edit_count"), F.approx_count_distinct("user_text").alias("users"))
    return rows.select(*PAGE, F.col("w.start").alias("bucket"), "edit_count", "users")


def score_batches(edits_path: str, windows_path: str):
    """A function for foreachBatch: store new edits by day, then score every edit of the batch over the last day of the pages that it touches.

    Stored edits are read for the days that the batch needs alone, however long the history. A batch that is run again writes its own folders anew,
    so that nothing counts twice. An edit that comes late, by whatever time, is stored and scored at its own time."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(edits_path)
        stored = spark.read.parquet(edits_path)
        new = stored.where(F.col("batch") == number)
        days = sorted({d for r in new.select("day").distinct().collect() for d in (r["day"], r["day"] - timedelta(days=1))})
        if not days:
            return
        touched = new.groupBy(*PAGE).agg((F.min("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"), F.max("ts").alias("until"))
        near = stored.where(F.col("day").isin(days) & (F.col("batch") <= number)).drop("day", "batch").dropDuplicates(["wiki", "rev_id"]).join(touched, PAGE).where("ts BETWEEN since AND until").drop("since", "until")
        scored = live_windows(near, revert_signals(near))
        own = scored.join(new.select(*PAGE, "rev_id", "ts").dropDuplicates([*PAGE, "rev_id"]), [*PAGE, "rev_id"])
        own.write.mode("overwrite").parquet(f"{windows_path}/batch={number}")

    return run


def _episodes(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    number, open_, started, peak, area = state.get if state.exists else (0, False, None, 0.0, 0.0)
    moved: dict[int, tuple] = {}  # of each episode that the batch moved, its last state
    rows = pd.concat(list(frames)).sort_values(["ts", "rev_id"])
    for row in rows.itertuples(index=False):
        if row.score >= EPISODE_ON:
            if not open_:
                number, open_, started, peak, area = number + 1, True, row.ts, 0.0, 0.0
            peak, area = max(peak, row.score), area + max(0.0, row.score - EPISODE_OFF)
            moved[number] = (*key, number, "active", started, row.ts, peak, area, row.reverts, row.pairs)
        elif row.score < EPISODE_OFF and open_:
            open_ = False
            moved[number] = (*key, number, "ended", started, row.ts, peak, area, row.reverts, row.pairs)
    state.update((number, open_, started, peak, area))
    if moved:
        yield pd.DataFrame(list(moved.values()), columns=[x.split()[0] for x in EPISODE.split(", ")])


def episode_stream(scored: DataFrame) -> DataFrame:
    """Episodes of a stream of 24h rows (wiki, page_id, rev_id, ts, score, reverts, pairs): the latest state of each episode that a batch moved."""
    return scored.groupBy(*PAGE).applyInPandasWithState(_episodes, EPISODE, _STATE, "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, windows_path: str, schema: str) -> DataFrame:
    """The stream of stored 24h rows."""
    return spark.readStream.schema(schema).parquet(windows_path).where("`window` = '24h'")
