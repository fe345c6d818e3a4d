"""The live list: the best pages by the latest row of every page, kept as keyed state, with pages that fall back taken out."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import PAGE
from ..shipping import ship_package
from . import sinks

LIST = "bucket int, place int, wiki string, page_id long, ts timestamp, rev_id long, score double, reverts long, shown string"
_ROW = "ts timestamp, rev_id long, score double, reverts long, shown string"


class Best(StatefulProcessor):
    """State of a bucket of pages: the latest row of each, and of the best of them a list that is longer than asked for.

    A page that gets better than what stands outside comes in; one that gets worse than that goes. Only when the list has become too short are all
    pages of the bucket looked at again: after as many falls as it is longer."""

    def __init__(self, limit: int = 50, slack: int = 150) -> None:
        self.limit, self.most = limit, limit + slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "wiki string, page_id long", _ROW)
        self.best = handle.getValueState("best", "wiki array<string>, page_id array<bigint>, score array<double>, reverts array<bigint>")
        self.outside = handle.getValueState("outside", "score double, reverts bigint, wiki string, page_id bigint")

    @staticmethod
    def _rank(score: float, reverts: int, wiki: str, page: int) -> tuple:
        return (-score, -reverts, wiki, page)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = sorted(self._rank(s, r, w, p) for w, p, s, r in zip(*self.best.get(), strict=True)) if self.best.exists() else []
        bound = self._rank(*self.outside.get()) if self.outside.exists() else None  # the best that stands outside, or better
        for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: (r.ts, r.rev_id)):
            page = (r.wiki, int(r.page_id))
            old = self.latest.getValue(page) if self.latest.containsKey(page) else None
            if old and (pd.Timestamp(old[0]).tz_localize(None), old[1]) > (pd.Timestamp(r.ts).tz_localize(None), r.rev_id):
                continue
            self.latest.updateValue(page, (r.ts, int(r.rev_id), float(r.score), int(r.reverts), r.shown))
            was = self._rank(old[2], old[3], *page) if old else None
            if was in best:
                best.remove(was)
            now = self._rank(float(r.score), int(r.reverts), *page)
            if bound is None or now < bound:
                insort(best, now)
            else:
                continue
            if len(best) > self.most:
                bound = best.pop()
        if bound is not None and len(best) < self.limit:
            everything = sorted(self._rank(v[2], v[3], *k) for k, v in self.latest.iterator())
            best, bound = everything[: self.most], everything[self.most] if len(everything) > self.most else None
        if bound is not None:
            self.outside.update((-bound[0], -bound[1], bound[2], bound[3]))
        elif self.outside.exists():
            self.outside.clear()
        self.best.update(tuple(list(x) for x in ([b[2] for b in best], [b[3] for b in best], [-b[0] for b in best], [-b[1] for b in best])))
        out = [(int(key[0]), i, b[2], b[3], *self.latest.getValue((b[2], b[3]))) for i, b in enumerate(best[: self.limit])]
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in LIST.split(", ")])

    def close(self) -> None:
        pass


def best_pages(windows: DataFrame, limit: int = 50, buckets: int = 64, slack: int = 150) -> DataFrame:
    """Of a stream of windows (as live_stream() gives them) the `limit` best pages of each bucket that a batch moves, by the latest 24h row of every page so far; `shown` is that row.

    The session needs the settings of live_state.STORE."""
    ship_package(windows.sparkSession)
    rows = windows.where("`window` = '24h'").select(*PAGE, "ts", "rev_id", "score", F.col("reverts").cast("long").alias("reverts"), F.to_json(F.struct("*")).alias("shown"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*PAGE), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(Best(limit, slack), LIST, "Update", "None")


def push(windows: DataFrame, send: Callable[[list], None], path: str, limit: int = 50, seconds: int = 5, **how):
    """A query on a stream of windows that calls send(rows of the best pages) after each batch: of all pages, also those that the batch doesn't move. `path` holds the lists of the buckets."""

    def run(batch: DataFrame, number: int) -> None:
        sinks.replace_partitions(batch, path, "bucket")
        if batch.isEmpty():
            return
        lists = batch.sparkSession.read.schema(LIST).parquet(path)
        send(lists.orderBy(F.desc("score"), F.desc("reverts"), *PAGE).limit(limit).drop("bucket", "place").collect())  # as many rows as the list shows

    return best_pages(windows, limit, **how).writeStream.outputMode("update").foreachBatch(run).trigger(processingTime=f"{seconds} seconds")
