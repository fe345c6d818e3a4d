"""Revision histories in XML, read by pieces of pages: no page is ever one row, and no text is built that isn't asked for.

A first pass over ranges of bytes finds where pages begin, with their headers, and in ranges that begin in the
midst of a page where its next revision does. So the files become a table of pieces, each within one page and about as long as a
range: what is wanted is chosen from that table, by joins of any size. A second pass reads the bytes of the chosen pieces alone, revision
by revision, and gives a row each. A page of any length is read by many tasks, in the memory of one revision.
Compressed files can't be entered in their midst: of these a task each reads on, and skips what isn't wanted."""

from __future__ import annotations

import bz2
import gzip
import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..tables import cut

#: Bytes of a range, of a read, and of texts in a batch of rows.
RANGE, READ, BATCH = 32 << 20, 1 << 20, 4 << 20
PIECE = "file string, start long, page_id long, page_title string, namespace int"
REVISION = "rev_id long, timestamp string, user_text string, comment string, content string"
_PACKED = r"\.(gz|bz2)$"
_TITLE, _NS, _ID = re.compile(rb"<title>(.*?)</title>", re.S), re.compile(rb"<ns>\s*(-?\d+)\s*</ns>"), re.compile(rb"<id>\s*(\d+)\s*</id>")
_TIME = re.compile(rb"<timestamp>\s*([^<]*?)\s*</timestamp>")


def opened(uri: str):
    """A file of any store that Arrow knows, decompressed by its extension."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if uri.endswith(".gz"):
        return gzip.GzipFile(fileobj=store.open_input_stream(path, compression=None))
    if uri.endswith(".bz2"):
        return bz2.BZ2File(store.open_input_stream(path, compression=None))
    return store.open_input_file(path)


class Tags:
    """Tags of a stream in their order, with no more of it in memory than lies between two of them."""

    def __init__(self, file, at: int = 0, packed: bool = False) -> None:
        self.file, self.begin, self.held, self.spot = file, 0, b"", 0
        if packed:
            self.skip(at)
        elif at:
            file.seek(at)
            self.begin = at

    @property
    def at(self) -> int:
        return self.begin + self.spot

    def more(self) -> bool:
        new = self.file.read(READ)
        self.begin, self.held, self.spot = self.at, self.held[self.spot :] + new, 0
        return bool(new)

    def skip(self, to: int) -> None:
        """Go on to a place, without keeping what lies before."""
        self.spot = min(len(self.held), max(self.spot, to - self.begin))
        while self.at < to and self.more():
            self.spot = min(len(self.held), to - self.begin)

    def _find(self, tags: tuple[bytes, ...], start: int) -> int:
        """The place of the first of the tags, -1 if none is held. What is found bounds the search for the rest."""
        found = -1
        for tag in tags:
            i = self.held.find(tag, start) if found < 0 else self.held.find(tag, start, found + len(tag) - 1)
            found = i if i >= 0 else found
        return found

    def next(self, *tags: bytes, until: int | None = None) -> bool:
        """Go to the next of the tags; false where none begins before `until`. One that the end of what is held cuts begins after any that is whole."""
        while (i := self._find(tags, self.spot)) < 0:
            self.spot = max(self.spot, len(self.held) - 16)
            if (until is not None and self.at >= until) or not self.more():
                return False
        self.spot = i
        return until is None or self.at < until

    def upto(self, *tags: bytes, within: bool = False) -> bytes:
        """What comes before the next of the tags (with it, if `within`); the rest of the stream if none comes."""
        looked = self.spot
        while (i := self._find(tags, looked)) < 0:
            looked = max(self.spot, len(self.held) - 16) - self.spot
            if not self.more():
                i = len(self.held)
                break
        if within:
            i = min(len(self.held), i + len(tags[0]))
        out, self.spot = self.held[self.spot : i], i
        return out


def headers(tags: Tags, start: int, until: int | None) -> Iterator[tuple[int, int | None, str | None, int | None]]:
    """(place, page_id, title, namespace) of each page that begins before `until`; where a range begins in a page, the place of its next revision goes first, without a header."""
    inside = start > 0
    while tags.next(*((b"<revision>", b"<page>") if inside else (b"<page>",)), until=until):
        at, page = tags.at, tags.held.startswith(b"<page>", tags.spot)
        if not page:
            tags.skip(at + 1)
            yield at, None, None, None
        else:
            head = tags.upto(b"<revision>", b"</page>")
            title, ns, number = (x.search(head) for x in (_TITLE, _NS, _ID))
            yield at, int(number[1]) if number else 0, html.unescape(title[1].decode("utf-8", "replace")) if title else "", int(ns[1]) if ns else 0
        inside = False


def pieces(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """file, start, end (null: the file's), page_id, page_title, namespace of each piece of the files of a path: a folder, a file, or a pattern.

    Pages without a title, id or namespace have the empty title and 0. Rows are as many as pages and ranges."""
    ship_package(spark)
    packed = F.regexp_like("path", F.lit(_PACKED))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select(F.col("path").alias("file"), "length", packed.alias("packed"))
    starts = F.when(F.col("packed"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = cut(files.select("file", "packed", F.explode(starts).alias("start")), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as f:
                    found = list(headers(Tags(f, r["start"]), r["start"], None if r["packed"] else r["start"] + range_bytes))
                if found:
                    at, ids, titles, spaces = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["file"]] * len(at)), pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(titles, pa.string()), pa.array(spaces, pa.int32())], ["file", "start", "page_id", "page_title", "namespace"]
                    )

    found = ranges.repartition(max(1, min(ranges.count(), 100_000)), "file", "start").mapInArrow(run, PIECE)
    # What a range begins in is the page that began last before it, in an earlier range: the last header of each range, and of the ranges before.
    slot = F.floor(F.col("start") / range_bytes).alias("slot")
    found = cut(found.withColumn("slot", slot), "headers")
    last = found.groupBy("file", "slot").agg(F.min("start").alias("first"), F.max_by(F.struct("page_id", "page_title", "namespace"), F.when(F.col("page_id").isNotNull(), F.col("start"))).alias("head"))
    by_file = Window.partitionBy("file").orderBy("slot")
    carried = last.select(
        F.col("file").alias("l_file"), F.col("slot").alias("l_slot"), F.last("head", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("first").over(by_file).alias("then"),
    )
    in_range = Window.partitionBy("file", "slot").orderBy("start")
    rows = found.withColumn("end", F.lead("start").over(in_range)).join(carried, (F.col("file") == F.col("l_file")) & (F.col("slot") == F.col("l_slot")))
    own = F.col("page_id").isNotNull()
    out = rows.select(
        "file", "start", F.coalesce("end", "then").alias("end"), *[F.when(own, F.col(c)).otherwise(F.col(f"before.{c}")).alias(c) for c in ("page_id", "page_title", "namespace")]
    )
    return cut(out.where("page_id IS NOT NULL"), "pieces")


def _revision(raw: bytes, where: str) -> tuple[int, str, str, str, str]:
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise ValueError(f"{where}: {e}") from e
    rev, ts, user, comment, content = 0, "", "", "", ""
    for x in root:
        if x.tag == "id" and not rev:
            rev = int(x.text or 0)
        elif x.tag == "timestamp":
            ts = x.text or ""
        elif x.tag == "comment":
            comment = x.text or ""
        elif x.tag == "text":
            content = x.text or ""
        elif x.tag == "contributor":
            user = next((y.text or "" for y in x if y.tag in ("username", "ip")), "")
    return rev, ts, user, comment, content


def revisions(chosen: DataFrame, since: str = "", until: str = "") -> DataFrame:
    """A row a revision of the chosen pieces (file, start, end and any others, which pass through): REVISION's columns behind them.

    Of revisions whose timestamp, as it is written, isn't in [since, until), where these are given, nothing is built. Missing users, comments and texts are empty. A
    damaged revision raises, with its file and place."""
    ship_package(chosen.sparkSession)
    packed = F.regexp_like("file", F.lit(_PACKED))
    sizes = chosen.agg(F.sum(F.when(packed, 0).otherwise(F.coalesce(F.col("end") - F.col("start"), F.lit(RANGE)))).alias("bytes"), F.count_distinct(F.when(packed, F.col("file"))).alias("packed")).first()
    tasks = int((sizes["bytes"] or 0) // RANGE + sizes["packed"] + 1)
    kept = [f.name for f in chosen.schema]
    low, high = since.encode(), until.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, tags, name = 0, None, None

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = [pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns[1:])]
            place = pa.array(columns[0], pa.int64())
            out = [batch.column(i).take(place) for i in range(batch.num_columns)] + out
            rows.clear()
            return pa.RecordBatch.from_arrays(out, [*kept, "rev_id", "timestamp", "user_text", "comment", "content"])

        for batch in batches:
            file, start, end = (batch.column(c).to_pylist() for c in ("file", "start", "end"))
            for k in range(batch.num_rows):
                is_packed = re.search(_PACKED, file[k]) is not None
                if not is_packed or name != file[k]:
                    if tags:
                        tags.file.close()
                    name, tags = file[k], Tags(opened(file[k]), start[k], is_packed)
                else:
                    tags.skip(start[k])  # pieces of a file come in their order
                while tags.next(b"<revision>", until=end[k]):
                    where = f"{name} at {tags.at}"
                    raw = tags.upto(b"</revision>", within=True)
                    if (low or high) and (at := _TIME.search(raw)) and (at[1] < low or (high and at[1] >= high)):
                        continue
                    rows.append((k, *_revision(raw, where)))
                    held += len(raw)
                    if held >= BATCH:
                        yield flushed()
                        held = 0
            if rows:
                yield flushed()
                held = 0
        if tags:
            tags.file.close()

    dealt = chosen.repartition(tasks, "file", F.when(packed, 0).otherwise(F.col("start"))).sortWithinPartitions("file", "start")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return dealt.mapInArrow(run, f"{schema}, {REVISION}")
