"""Server-sent events as a Spark data source: frames of feeds to (stream_id, payload).

A feed that keeps its events is a stream with offsets: batches are spans between ids, bounded in size. Of one that doesn't, `land` reads line by line and
lands its frames as files, with reconnects and back-off; the stream reads those files on the executors, each file as a partition. Either way a
restart goes on from what the checkpoint has seen."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def frames(lines: Iterable[str]) -> Iterator[tuple[str | None, str]]:
    """(id, data) of each frame whose data is JSON, as soon as it ends: a blank line ends a frame, data lines are joined by line feeds, comments are skipped."""
    stream_id, data = None, []
    for line in chain(lines, ("",)):
        line = line.rstrip("\r\n")
        if not line:
            payload = "\n".join(data)
            try:
                json.loads(payload)
            except ValueError:
                payload = ""
            if payload:
                yield stream_id, payload
            stream_id, data = None, []
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            if name == "id":
                stream_id = value.strip()
            elif name == "data":
                data.append(value.strip())


def connect(url: str, last_id: str | None = None, agent: str = "editfray", timeout: float = 15.0) -> Iterator[str]:
    """Lines of a feed as they come; last_id asks for what came after it."""
    from urllib.request import Request, urlopen

    headers = {"Accept": "text/event-stream", "User-Agent": agent} | ({"Last-Event-ID": last_id} if last_id else {})
    with urlopen(Request(url, headers=headers), timeout=timeout) as lines:  # noqa: S310
        for line in lines:
            yield line.decode("utf-8", "replace")


def retried(open_feed: Callable[[str | None], Iterable[str]], sleep: Callable[[float], None] = time.sleep, first: float = 1.0, most: float = 60.0, tries: int | None = None) -> Iterator[tuple[str | None, str]]:
    """Frames of a feed that is opened again, from the last id on, whenever it ends or fails: at once after an end, after a failure with waits that double up to
    `most` seconds and begin anew once a frame has come. `tries` failures in a row, if given, raise the last."""
    last_id, wait, failed = None, first, 0
    while True:
        try:
            for stream_id, payload in frames(open_feed(last_id)):
                last_id, wait, failed = stream_id or last_id, first, 0
                yield stream_id, payload
        except OSError:
            failed += 1
            if tries is not None and failed >= tries:
                raise
            sleep(wait)
            wait = min(2 * wait, most)


def land(rows: Iterable[tuple[str | None, str]], folder: str, frames_per_file: int = 1000, seconds: float = 5.0, now: Callable[[], float] = time.monotonic) -> int:
    """Write frames to files of the folder as they come, a file for each frames_per_file or `seconds`, whichever is first; returns how many
    files, if the feed ends. A file is put in place whole, so that no reader sees a part of it. The folder is a shared one."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    held: list[str] = []
    began, files = now(), 0

    def put():
        nonlocal held, began, files
        if held:
            aside = Path(folder, f".{uuid.uuid4().hex}")
            aside.write_text("".join(held), encoding="utf-8")
            os.replace(aside, Path(folder, f"{time.time_ns():020d}-{files:06d}.sse"))
            files += 1
        held, began = [], now()

    for stream_id, payload in rows:
        data = "".join(f"data: {x}\n" for x in payload.split("\n"))
        held.append((f"id: {stream_id}\n" if stream_id is not None else "") + data + "\n")
        if len(held) >= frames_per_file or now() - began >= seconds:
            put()
    put()
    return files


def landed(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """stream_id, payload of landed files: a stream of them, or what is there. Executors read whole files, which land() keeps small."""
    reader = spark.readStream.schema("value string") if stream else spark.read
    lines = reader.option("wholetext", True).format("text").load(folder)
    return lines.selectExpr("inline(" + _PARSE + ")")


# A frame's lines, as SQL: its last id, and its data lines joined.
_CUT = "regexp_replace(value, '\\r\\n?', '\\n')"
_LINES = "filter(split(f, '\\n'), l -> l NOT LIKE ':%')"
_PARSE = f"""filter(transform(split({_CUT}, '\\n\\n+'), f -> named_struct(
  'stream_id', try_element_at(transform(filter({_LINES}, l -> l LIKE 'id:%'), l -> btrim(substring(l, 4))), -1),
  'payload', array_join(transform(filter({_LINES}, l -> l LIKE 'data:%'), l -> btrim(substring(l, 6))), '\\n'))), x -> try_parse_json(x.payload) IS NOT NULL AND x.payload <> '')"""


class _Files(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as lines:
            yield from frames(lines)


def after(feed: str, last_id: str | None, timeout: float = 15.0) -> Iterator[tuple[str | None, str]]:
    """Frames of a feed that come after an id: of a URL, which is asked for them, or of a file that holds a feed, which is read on from there."""
    if feed.startswith(("http://", "https://")):
        yield from frames(connect(feed, last_id, timeout=timeout))
        return
    with open(feed, encoding="utf-8") as lines:
        rows = frames(lines)
        if last_id:
            next((x for x in rows if x[0] == last_id), None)
        yield from rows


class _Span(InputPartition):
    def __init__(self, feed: str, start: dict, count: int) -> None:
        self.feed, self.start, self.count = feed, start, count


class _Feeds(DataSourceStreamReader):
    """A place in a feed is its last id, how many frames without one came after it, and how many have come in all.

    latestOffset() goes through what has come, keeping nothing but ids; tasks, one a feed, ask for the frames between two places again. So payloads never pass the driver, a batch that is
    run again reads the same frames, and after a restart the feed is asked from the id that the checkpoint has."""

    def __init__(self, options) -> None:
        self.feeds = options["feeds"].split()
        self.most, self.seconds, self.timeout = int(options.get("maxFrames", 1000)), float(options.get("maxSeconds", 5.0)), float(options.get("timeout", 15.0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {feed: {"id": "", "after": 0, "seen": 0} for feed in self.feeds}

    def latestOffset(self) -> dict:  # noqa: N802
        start = self.at or self.initialOffset()
        self.at = {feed: self._end(feed, start.get(feed) or {"id": "", "after": 0, "seen": 0}) for feed in self.feeds}
        return self.at

    def _end(self, feed: str, start: dict) -> dict:
        place, until = dict(start), time.monotonic() + self.seconds
        try:
            for stream_id, _ in islice(after(feed, start["id"] or None, self.timeout), start["after"], start["after"] + self.most):
                place = {"id": stream_id, "after": 0, "seen": place["seen"] + 1} if stream_id else {"id": place["id"], "after": place["after"] + 1, "seen": place["seen"] + 1}
                if time.monotonic() >= until:
                    break
        except OSError:
            pass  # what has come counts; the next batch asks again
        return place

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        # A query that starts again plans its last batch first: it goes on from there.
        self.at = self.at or end
        begin = {feed: start.get(feed) or {"id": "", "after": 0, "seen": 0} for feed in end}
        return [_Span(feed, begin[feed], end[feed]["seen"] - begin[feed]["seen"]) for feed in end if end[feed]["seen"] > begin[feed]["seen"]]

    def read(self, partition: _Span) -> Iterator[tuple[str | None, str]]:
        n, start = 0, partition.start
        for n, row in enumerate(islice(after(partition.feed, start["id"] or None, self.timeout), start["after"], start["after"] + partition.count), 1):  # noqa: B007
            yield row
        if n < partition.count:
            raise OSError(f"{partition.feed} gave {n} of {partition.count} frames after {start['id']!r}")

    def commit(self, end: dict) -> None:
        """A feed keeps no account of its readers: the checkpoint does."""


class SseSource(DataSource):
    """spark.dataSource.register(SseSource), then read.format("sse").option("path", a file, or several with commas between): a partition each.

    As a stream: readStream.format("sse").option("feeds", URLs or files of feeds, with blanks between), and maxFrames and maxSeconds, which bound what a batch takes of each feed."""

    @classmethod
    def name(cls):
        return "sse"

    def schema(self):
        return "stream_id string, payload string"

    def reader(self, schema):
        return _Files(self.options["path"].split(","))

    def streamReader(self, schema):  # noqa: N802
        return _Feeds(self.options)
