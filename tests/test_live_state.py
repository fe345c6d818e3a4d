"""Keyed state, feeds with offsets, and repeats that come late."""

import json
import os
import random
from datetime import date, datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from editfray.operators import windows
from editfray.plans import serving
from editfray.sources import sse
from editfray.streaming import live_list, live_state, seen

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EDIT = "wiki string, page_id long, rev_id long, ts timestamp, user_text string, user_is_bot boolean, reverts boolean, reverted_user string"


def fights(n, days):
    rng, rows = random.Random(5), []
    for i in range(n):
        at = START + timedelta(seconds=rng.randrange(days * 86400) if i % 3 else i // 30 * 600)
        user, other = rng.choice(["A", "B", "C", "", "D"]), rng.choice(["A", "B", "C", None, ""])
        rows.append(("w", rng.choice([1, 1, 2]), i, at, user, i % 7 == 0, rng.random() < 0.5, other))
    return rows


@pytest.fixture
def state(spark):
    for k, v in live_state.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in live_state.STORE:
        spark.conf.unset(k)


def replayed(spark, tmp_path, parts, late):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(parts):
        path = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, EDIT).coalesce(1).write.parquet(path)
        name = next(x for x in os.listdir(path) if x.endswith(".parquet"))
        os.rename(f"{path}/{name}", tmp_path / "in" / f"{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1e9 + i, 1e9 + i))
    rows = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_state.live_stream(rows, late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), query


def test_a_replay_through_state_gives_the_batch_rows(spark, state, tmp_path):
    # Sorted by time, with repeats of revisions in later parts: rows are those of live_windows(), and old hours go.
    rows = sorted(fights(400, 6), key=lambda r: (r[3], r[2]))
    # Parts end between times: what comes at one time comes together.
    ends = [i for i in range(1, 400) if rows[i - 1][3] < rows[i][3]]
    cuts = [0, ends[len(ends) // 4], ends[len(ends) // 2], ends[len(ends) * 3 // 4], 400]
    parts = [rows[a:b] + rows[max(0, a - 20) : a] for a, b in zip(cuts, cuts[1:], strict=False)]
    got, query = replayed(spark, tmp_path, parts, "1 hour")
    edits = spark.createDataFrame(rows, EDIT)
    reverts = edits.where("reverts").select("wiki", "page_id", "rev_id", "ts", F.col("user_text").alias("reverter_user"), "reverted_user")
    want = windows.live_windows(edits, reverts)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    hours = {(r[1], r[3].replace(minute=0, second=0)) for r in rows}
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left < len(hours)


def test_a_table_streams_through_state(spark, state):
    # In no order and with repeats: rows are those of live_windows().
    rows = fights(300, 6)
    mixed = rows + rows[:40]
    random.Random(3).shuffle(mixed)
    got = live_state.live_stream(spark.createDataFrame(mixed, EDIT))
    edits = spark.createDataFrame(rows, EDIT)
    want = windows.live_windows(edits, edits.where("reverts").select("wiki", "page_id", "rev_id", "ts", F.col("user_text").alias("reverter_user"), "reverted_user"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_page_of_a_table_is_never_held_whole():
    stored, taken = {}, []
    page = live_state.LivePages(ordered=True)
    page.handle = SimpleNamespace(registerTimer=lambda at: None)
    page.hours = SimpleNamespace(updateValue=lambda k, v: stored.update({k: len(v[0])}))

    def frames(n=60, size=1000):
        for f in range(n):
            taken.append(f)
            yield pd.DataFrame({"ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=f * size + i) for i in range(size)], "rev_id": range(f * size, f * size + size), "user_is_bot": False, "user_text": "A", "reverts": True, "reverted_user": "B"})

    out = page.handleInputRows(("w", 1), frames(), None)
    first = next(out)
    # The first rows leave when a few frames have come.
    assert len(first) == live_state._ROWS and len(taken) < 6
    rest = pd.concat([first, *out])
    assert len(rest) == 180_000 and sum(stored.values()) == 60_000 and len(stored) == 1000
    assert set(rest[rest.rev_id == 59_999].edits) == {6, 61, 1441} and set(rest[rest.rev_id == 59_999].reverts) == {6, 61, 1441}
    wrong = page.handleInputRows(("w", 1), iter([pd.concat(list(frames(1, 5)))[::-1]]), None)
    with pytest.raises(ValueError, match="out of the order"):
        list(wrong)


def test_what_comes_late_is_scored_at_its_own_time(spark, state, tmp_path):
    base = [("w", 1, i, START + timedelta(minutes=10 * i), "AB"[i % 2], False, True, "BA"[i % 2]) for i in range(6)]
    got, _ = replayed(spark, tmp_path, [base[:2] + base[3:], [base[2]]], "2 hours")
    late = {r["window"]: (r["edits"], r["reverts"], r["pairs"]) for r in got.where("rev_id = 2").collect()}
    assert late == {"5m": (1, 1, 0), "1h": (3, 3, 1), "24h": (3, 3, 1)} and got.count() == 18


def test_a_feed_goes_on_from_its_checkpoint(spark, tmp_path):
    # Frames with and without ids, and one that is no JSON; the query stops in the midst of the feed, which then grows.
    spark.dataSource.register(sse.SseSource)
    feed, other = tmp_path / "feed", tmp_path / "other"
    frame = lambda i: (f"id: e{i}\n" if i % 3 else "") + f"data: {json.dumps({'n': i})}\n\n"
    feed.write_text("".join(map(frame, range(1, 26))) + "id: x\ndata: no json\n\n")
    other.write_text("".join(map(frame, range(101, 105))))

    def run(most):
        rows = spark.readStream.format("sse").option("feeds", f"{feed} {other}").option("maxFrames", 4).load()
        out, batches = [], []

        def take(batch, number):
            batches.append(number)
            out.extend((r["stream_id"], json.loads(r["payload"])["n"]) for r in batch.collect())
            if len(batches) == most:
                raise RuntimeError("stopped")

        query = rows.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            if most:
                with pytest.raises(Exception, match="stopped"):
                    query.awaitTermination()
            else:
                query.processAllAvailable()
        finally:
            query.stop()
        return out, batches

    out, batches = run(3)
    assert [x[1] for x in out if x[1] < 100] == list(range(1, 13)) and batches == [0, 1, 2]
    again, numbers = run(0)
    # The batch that failed comes again, whole; none before it does.
    assert numbers[0] == 2 and [x[1] for x in again if x[1] < 100] == list(range(9, 26)) and all(x[1] < 100 for x in again)
    with open(feed, "a") as f:
        f.write("".join(map(frame, range(26, 31))))
    more, _ = run(0)
    assert [x[1] for x in more if x[1] >= 26] == list(range(26, 31)) and {x[1] for x in more} <= set(range(22, 31))


def test_a_revision_that_comes_again_after_days_is_dropped(spark, tmp_path, monkeypatch):
    known = seen.Seen(str(tmp_path / "seen"), slots=2, hashes=3)
    batch = lambda rows: spark.createDataFrame(rows, "wiki string, rev_id long, stream_id string, v int")
    got = []
    days = iter([date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 4), date(2024, 1, 4), date(2024, 1, 5)])
    run = seen.once(known, lambda rows, n: got.append(sorted(r["v"] for r in rows.collect())), lambda: next(days))
    run(batch([("w", i, f"s{i}", i) for i in range(2000)] + [("w", 5, "s5", 5), ("w", 6, "again", 6)]), 0)
    assert got[-1] == list(range(2000))
    run(batch([("w", 5000, "s7", 1), ("w", 5001, None, 2), ("v", 5, "other", 3), ("w", 5002, None, 4)]), 1)
    assert got[-1] == [2, 3, 4]  # the place in the feed is known: s7
    # Three days on. Sketches are full enough for false hits here: these drop nothing.
    run(batch([("w", 5, "new", 1), ("w", 5001, "x", 2)] + [("w", 10_000 + i, f"t{i}", i + 10) for i in range(500)]), 2)
    assert got[-1] == [i + 10 for i in range(500)]
    run(batch([("w", 5, "new", 1), ("w", 5001, "x", 2)] + [("w", 10_000 + i, f"t{i}", i + 10) for i in range(500)]), 2)  # the same batch again
    assert got[-1] == [i + 10 for i in range(500)]
    known.merge_day(spark, date(2024, 1, 1))
    run(batch([("w", 5, "y", 1), ("w", 5002, "z", 2), ("w", 10_001, "q", 3), ("w", 77_777, "t3", 4), ("w", 88_888, None, 5)]), 3)
    assert got[-1] == [5] and spark.read.parquet(str(tmp_path / "seen/keys")).where("day = '2024-01-01'").select("batch").distinct().count() == 1


def test_the_live_list_keeps_pages_that_do_not_move(spark, state, tmp_path):
    # Random rows of 40 pages in 8 batches, few places and little slack: after each batch the list is that of all rows so far.
    rng, names = random.Random(12), "wiki string, page_id long, rev_id long, ts timestamp, `window` string, score double, reverts long"
    parts = [[("w", rng.randrange(40), b * 100 + i, START + timedelta(minutes=b * 100 + i), rng.choice(["24h", "24h", "1h"]), float(rng.choice([0, 10, 50, 90, rng.randrange(100)])), rng.randrange(4)) for i in range(20 if b else 60)] for b in range(8)]
    parts[3].append(("w", 1, 5, START, "24h", 1000.0, 9))  # late: the page has had newer rows
    parts[2].append(("w", 1, 299, START + timedelta(minutes=299), "24h", 20.0, 1))
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(parts):
        path = str(tmp_path / f"p{i}")
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(path)
        name = next(x for x in os.listdir(path) if x.endswith(".parquet"))
        os.rename(f"{path}/{name}", tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1e9 + i, 1e9 + i))
    sent = []
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_list.push(stream, sent.append, str(tmp_path / "lists"), limit=6, buckets=2, slack=2).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sent) == 8
    for i, rows in enumerate(sent):
        so_far = spark.createDataFrame([r for p in parts[: i + 1] for r in p], names)
        want = [(r["page_id"], r["score"], r["rev_id"]) for r in serving.live_candidates(so_far, 6).collect()]
        assert [(r["page_id"], r["score"], r["rev_id"]) for r in rows] == want and json.loads(rows[0]["shown"])["window"] == "24h"
