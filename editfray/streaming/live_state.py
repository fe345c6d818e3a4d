"""Live windows as keyed state: what a page has had of late is held by hour, and goes when its time is over; nothing stored is read."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, islice, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import PAGE, live_rows
from ..schema import LIVE_WINDOWS
from ..shipping import ship_package

_US = 1_000_000
_HOUR = 3600 * _US
_RECENT = 300 * _US
_LONGEST = max(LIVE_WINDOWS.values()) * _US
#: Rows that leave at once.
_ROWS = 10_000
#: The state store that keyed state of several maps and timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
EVENT = "at array<bigint>, rev_id array<bigint>, human array<boolean>, user array<string>, reverts array<boolean>, reverted array<string>"
METRICS = "wiki string, page_id long, rev_id long, ts timestamp, window string, edits int, human int, users int, reverts int, pairs int, mutual int, top_share double, recent int"


class Counts:
    """What one window holds, as events come in and go out of it: each moves a few counts, and nothing is counted anew."""

    def __init__(self) -> None:
        self.edits = self.human = self.reverts = self.pairs = self.mutual = self.top = 0
        self.users, self.by, self.levels, self.edges = Counter(), Counter(), Counter(), Counter()

    def move(self, d: int, human: bool, user: str, reverts: bool, reverted: str) -> None:
        self.edits += d
        if human:
            self.human += d
            if user:
                self.users[user] += d
                if not self.users[user]:
                    del self.users[user]
        if not reverts:
            return
        self.reverts += d
        self.by[user] += d
        # How many reach a level tells the largest count without a search.
        self.levels[self.by[user] if d > 0 else self.by[user] + 1] += d
        self.top = max(self.top, self.by[user]) if d > 0 else self.top - (not self.levels[self.top])
        if user and reverted and user != reverted:
            other = self.edges[reverted, user]
            old = min(self.edges[user, reverted], other)
            self.edges[user, reverted] += d
            new = min(self.edges[user, reverted], other)
            self.mutual += new - old
            self.pairs += (new > 0) - (old > 0)
            if not self.edges[user, reverted]:
                del self.edges[user, reverted]
        if not self.by[user]:
            del self.by[user]


def slide(events: Iterable[tuple[tuple, bool]]) -> Iterator[tuple]:
    """Of a page's events (at, rev_id, human, user, reverts, reverted), in the order of time and each with whether it is wanted, the rows of each window at those wanted: rev_id, at, window and METRICS' counts.

    Events stream: what is held is those of the longest window, and those of one time."""
    held, begins = {name: Counts() for name in LIVE_WINDOWS}, dict.fromkeys(LIVE_WINDOWS, 0)
    kept: list[tuple] = []
    at: list[int] = []
    weights, last = [0], None
    for now, same in groupby(events, lambda x: x[0][0]):
        first = len(kept)
        wanted = []
        for event, is_wanted in same:  # what comes at one time sees each other
            kept.append(event)
            at.append(now)
            weights.append(weights[-1] + 1 + 4 * event[4])
            last = now if event[2] else last
            if is_wanted:
                wanted.append(event[1])
        for name, seconds in LIVE_WINDOWS.items():
            counts, since = held[name], now - seconds * _US
            for event in kept[first:]:
                counts.move(1, *event[2:])
            while at[begins[name]] < since:
                counts.move(-1, *kept[begins[name]][2:])
                begins[name] += 1
            recent = weights[-1] - weights[bisect_left(at, max(last - _RECENT, since))] if wanted and last is not None and last >= since else 0
            for rev_id in wanted:
                yield rev_id, now, name, counts.edits, counts.human, len(counts.users), counts.reverts, counts.pairs, counts.mutual, counts.top / counts.reverts if counts.reverts else 0.0, recent
        gone = min(begins.values())
        if gone > _ROWS and 2 * gone > len(kept):
            del kept[:gone], at[:gone], weights[:gone]
            begins = {name: n - gone for name, n in begins.items()}


class LivePages(StatefulProcessor):
    """State of a page: its events by hour. An hour goes, by a timer, when no event that the watermark still lets in can see it.

    With `ordered`, a page's events come in the order of time, each once, and there is no state before them: as from a table that is sorted. Then they stream through, and of a page
    no more is held than the longest window has. Else the new events of a batch are held, with the hours that they can see."""

    def __init__(self, ordered: bool = False) -> None:
        self.ordered = ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", EVENT)

    def _store(self, hour: int, events: list[tuple], known: bool) -> None:
        if not known:
            self.handle.registerTimer(((hour + 1) * _HOUR + _LONGEST) // 1000)
        self.hours.updateValue((hour,), tuple(list(c) for c in zip(*events, strict=True)))

    def _in_order(self, new: Iterable[tuple]) -> Iterator[tuple[tuple, bool]]:
        """The events as they come, with each hour stored before it is seen."""
        last = None
        for hour, some in groupby(new, lambda e: e[0] // _HOUR):
            found = list(some)
            if any(b[:2] <= a[:2] for a, b in pairwise([*([last] if last else []), *found])):
                raise ValueError("events of a page came out of the order of time")
            last = found[-1]
            self._store(hour, found, known=False)
            yield from ((e, True) for e in found)

    def _with_state(self, new: list[tuple]) -> Iterator[tuple[tuple, bool]]:
        """New events, stored, among those of the hours that they can see."""
        first, last = min(e[0] for e in new) - _LONGEST, max(e[0] for e in new)
        old: dict[int, list[tuple]] = {}
        for (hour,) in list(self.hours.keys()):
            if first // _HOUR <= hour <= last // _HOUR:
                old[hour] = list(zip(*self.hours.getValue((hour,)), strict=True))
        known = {e[1] for found in old.values() for e in found}
        new = list({e[1]: e for e in new if e[1] not in known}.values())
        fresh = {e[1] for e in new}
        events = sorted([e for found in old.values() for e in found] + new, key=lambda e: e[:2])
        touched: dict[int, list[tuple]] = {}
        for e in new:
            touched.setdefault(e[0] // _HOUR, []).append(e)
        for hour, more in touched.items():
            self._store(hour, sorted(old.get(hour, []) + more), known=hour in old)
        return ((e, e[1] in fresh) for e in events)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = (
            (int(r.ts.value) // 1000, int(r.rev_id), not r.user_is_bot, r.user_text or "", bool(r.reverts), r.reverted_user or "") for f in rows for r in f.itertuples(index=False)
        )
        found = slide(self._in_order(new) if self.ordered else self._with_state(list(new)))
        while out := [(*key, rev, pd.Timestamp(at, unit="us"), *rest) for rev, at, *rest in islice(found, _ROWS)]:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in METRICS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - _LONGEST) // _HOUR - 1
        if self.hours.containsKey((hour,)):
            self.hours.removeKey((hour,))
        return iter(())

    def close(self) -> None:
        pass


def live_stream(edits: DataFrame, late: str = "24 hours") -> DataFrame:
    """live_windows() of a stream of edits (sources.events.with_reverts()), with ts: rows for each edit as it comes, from state alone.

    An edit is scored at its own time, over what has come before it; what comes later than `late` behind the latest is left out. A revision that comes again
    while its hour is held changes nothing. The session needs the settings STORE.

    Of a table, a page's events are sorted first and stream through; of a stream, those that come in one batch are held."""
    ship_package(edits.sparkSession)
    rows = edits.select(*PAGE, "rev_id", "ts", "user_text", "user_is_bot", "reverts", "reverted_user")
    if not edits.isStreaming:
        rows = rows.dropDuplicates([*PAGE, "rev_id"]).repartition(*PAGE).sortWithinPartitions(*PAGE, "ts", "rev_id")
    counted = rows.withWatermark("ts", late).groupBy(*PAGE).transformWithStateInPandas(LivePages(ordered=not edits.isStreaming), METRICS, "Append", "EventTime")
    return live_rows(counted, also=("ts",))
