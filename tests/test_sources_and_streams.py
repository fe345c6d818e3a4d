"""Formats and streams on small files."""

import bz2
import gzip
import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from editfray.operators.governance import protected_time, restrictions
from editfray.sources import history_rows, sql_dump, sse, wiki_dump, wiki_xml
from editfray.streaming import live, sinks


def test_sql_dump(spark, tmp_path):
    line = "INSERT INTO `page_restrictions` VALUES (42,'edit','extendedconfirmed',0,'infinity',1),(42,'mo\\'v, (e)','sysop',1,'20270101000000',2),(43,'NULL',NULL,0,' x ',3);\n"
    with gzip.open(tmp_path / "r.sql.gz", "wt") as f:
        f.write("-- comment\n" + line)
    got = [tuple(r) for r in sql_dump.restrictions(spark, str(tmp_path)).collect()]
    assert got == [(42, "edit", "extendedconfirmed", 0, "infinity"), (42, "mo'v, (e)", "sysop", 1, "20270101000000"), (43, None, None, 0, "x")]
    assert restrictions(sql_dump.restrictions(spark, str(tmp_path)), ["page_id"]).count() == 2


def test_history_tsv(spark, tmp_path):
    def line(**at):
        cells = [""] * 78
        for k, v in at.items():
            cells[int(k[1:])] = v
        return "\t".join(cells)

    good = dict(c0="w", c2="revision", c3="create", c4="2020-01-02 03:04:05.0", c9="Ann", c22="false", c28="5", c30="T", c31="0", c60="9", c65="12", c72="TRUE", c73="11")
    lines = [line(**good), line(**good | {"c22": "true"}), line(**good | {"c28": "0"}), line(**good | {"c4": "2020-01-02"}), line(**good | {"c31": "1", "c30": "", "c9": ""}), line(**good | {"c31": "4"}), "short\tline"]
    with bz2.open(tmp_path / "x.2020-01.tsv.bz2", "wt") as f:
        f.write("\n".join(lines))
    got = history_rows.read(spark, str(tmp_path)).orderBy("namespace").collect()
    assert [(r["namespace"], r["user_text"], r["page_title"], r["month"], r["is_reverted"], r["first_reverting"]) for r in got] == [(0, "Ann", "T", "2020-01", True, 11), (1, "unknown", "page:5", "2020-01", True, 11)]


XML = """<mediawiki><page><title>Noise</title><ns>0</ns><id>999</id><revision><id>1</id><timestamp>2007-09-01T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>x</text></revision></page>
<page><title>Big man</title><ns>0</ns><id>42</id>%s</page><page><title>Talk:Big man</title><ns>1</ns><id>43</id><revision><id>90</id><timestamp>2007-09-03T00:00:00Z</timestamp><contributor><username>Ann</username></contributor><comment>c</comment><text>Talk.</text></revision></page></mediawiki>"""


def test_page_xml(spark, tmp_path):
    rev = "".join(f"<revision><id>{i}</id><timestamp>2007-09-02T0{i}:00:00Z</timestamp><contributor><username>U{i % 2}</username></contributor><text xml:space='preserve'>v{i % 2}</text></revision>" for i in range(1, 8))
    (tmp_path / "p.xml").write_text(XML % rev)
    pages = wiki_xml.pages(spark, str(tmp_path / "p.xml"))
    wanted = spark.createDataFrame([("c", 42, "Big man", 0)], "candidate string, page_id long, page_title string, talk_page_id long")
    got = wiki_xml.candidate_revisions(wiki_dump.pieces(spark, str(tmp_path / "p.xml")), wanted)
    assert {(r["namespace"], r["n"]) for r in got.groupBy("namespace").agg(F.count("*").alias("n")).collect()} == {(0, 7), (1, 1)}
    inside = wiki_xml.in_period(wiki_xml.revisions(pages), F.lit("2007-09-02").cast("timestamp"), F.lit("2007-09-03").cast("timestamp"))
    assert inside.count() == 7


def test_protection_log(spark, tmp_path):
    item = "<logitem><id>{}</id><timestamp>2020-01-{:02d}T00:00:00Z</timestamp><type>{}</type><action>{}</action><logtitle>{}</logtitle></logitem>"
    rows = [(1, 1, "protect", "protect", "Example page"), (2, 11, "protect", "unprotect", "Example page"), (3, 5, "delete", "delete", "Example page"), (4, 5, "protect", "protect", "User:X")]
    (tmp_path / "l.xml").write_text("<m>" + "".join(item.format(*r) for r in rows) + "</m>")
    got = protected_time(wiki_xml.protection_events(spark, str(tmp_path / "l.xml")), ["page_title"], F.lit("2021-01-01").cast("timestamp")).collect()
    assert [(r["page_title"], r["protection_events"], r["protection_days"]) for r in got] == [("Example_page", 2, 10.0)]


def event(i, minute, user="Ann", comment="c", **more):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minute)
    return {"server_name": "en.wikipedia.org", "wiki": "enwiki", "type": "edit", "title": "T", "user": user, "comment": comment, "namespace": 0, "page_id": 7, "bot": False, "timestamp": at.isoformat(), "revision": {"new": i, "old": i - 1}, "meta": {"id": f"m{i}"}} | more


def test_sse_frames(spark, tmp_path):
    text = ": hi\nid: 1\ndata: {\"a\":\ndata: 1}\n\nid: 2\ndata: no json\n\ndata: {}\n"
    assert list(sse.frames(text.splitlines())) == [("1", '{"a":\n1}'), (None, "{}")]
    (tmp_path / "feed.txt").write_text(text)
    spark.dataSource.register(sse.SseSource)
    assert spark.read.format("sse").option("path", str(tmp_path / "feed.txt")).load().count() == 2


def test_live_stream(spark, tmp_path):
    feed, edits, windows = (str(tmp_path / x) for x in ("feed", "edits", "windows"))
    (tmp_path / "feed").mkdir()
    fight = [event(i, i, "AB"[i % 2], f"Reverted edits by [[Special:Contributions/{'BA'[i % 2]}|x]]") for i in range(1, 13)]
    other = [event(3, 3), event(50, 5, bot=True), event(51, 5, wiki="dewiki"), event(0, 5) | {"revision": {}}]
    (tmp_path / "feed/a.json").write_text("\n".join(json.dumps({"payload": json.dumps(x), "stream_id": str(k)}) for k, x in enumerate(fight + other)))
    raw = spark.readStream.schema("payload string, stream_id string").json(feed)
    stream = live.edit_stream(raw, "en.wikipedia.org", "enwiki")
    stream.writeStream.foreachBatch(live.score_batches(edits, windows)).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination()
    scored = spark.read.parquet(windows)
    assert scored.where("`window` = '24h'").count() == 12
    top = scored.where("`window` = '24h' AND rev_id = 12").first()
    assert (top["edits"], top["reverts"], top["pairs"]) == (12, 12, 1) and top["score"] > 60
    out = []
    live.episode_stream(live.replay(spark, windows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema))).writeStream.outputMode("update").foreachBatch(
        lambda b, i: out.extend(b.collect())
    ).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert len(out) == 1 and out[0]["status"] == "active" and out[0]["peak_score"] == top["score"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "p string, k long, v string")
    sinks.replace_partitions(rows(("a", 1, "x"), ("b", 2, "y")), path, "p")
    sinks.replace_partitions(rows(("b", 3, "z")), path, "p")
    read = lambda: sorted((r["p"], r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    assert read() == [("a", 1, "x"), ("b", 3, "z")]
    sinks.upsert_partition(rows(("b", 3, "new"), ("b", 4, "w")), path, ["p", "k"], "p")
    assert read() == [("a", 1, "x"), ("b", 3, "new"), ("b", 4, "w")]
    done = []
    listed = spark.createDataFrame([("2020-01",), ("2020-02",)], "period string")
    assert sinks.run_pending(spark, listed, str(tmp_path / "m"), "period", lambda d: done.append(d.count())) == 2
    assert sinks.run_pending(spark, listed, str(tmp_path / "m"), "period", lambda d: done.append(d.count())) == 0 and done == [2]
