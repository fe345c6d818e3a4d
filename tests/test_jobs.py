"""Jobs from files to boards and evidence, on files made here."""

import bz2
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from editfray.plans import jobs, serving
from editfray.streaming import sinks

START = datetime(2024, 1, 5)


def line(rev, minute, user, page=7, title="Some page", ns=0, first="", comment="", size=100, month=1):
    cells = [""] * 78
    at = START.replace(month=month) + timedelta(minutes=minute)
    values = {0: "enwiki", 2: "revision", 3: "create", 4: at.strftime("%Y-%m-%d %H:%M:%S.0"), 5: comment, 9: user, 22: "false", 28: str(page), 30: title, 31: str(ns), 60: str(rev), 65: str(size), 72: "true" if first else "false", 73: str(first), 75: "true" if rev % 100 else "false"}
    for k, v in values.items():
        cells[k] = v
    return "\t".join(cells)


def test_history_to_boards(spark, tmp_path):
    for month in (1, 2):
        fight = [line(month * 1000 + i, i, f"E{i % 2}", first=month * 1000 + i + 1 if i < 19 else "", month=month) for i in range(20)]
        talk = [line(month * 1000 + 500, 3, "E0", page=8, title="Talk:Some page", ns=1, comment="RfC on this wording", size=900, month=month)]
        quiet = [line(month * 1000 + 600 + i, 100 + i, "E0", month=month) for i in range(10)]
        with bz2.open(tmp_path / f"2024-05.enwiki.2024-0{month}.tsv.bz2", "wt") as f:
            f.write("\n".join([*fight, *talk, *quiet]))
    files = spark.createDataFrame([(str(tmp_path / f"2024-05.enwiki.2024-0{m}.tsv.bz2"), f"2024-0{m}") for m in (1, 2)], "name string, partition string")
    records, board, manifest = (str(tmp_path / x) for x in ("records", "board", "manifest"))
    how = dict(limit=10, min_score=1.0)
    assert jobs.process_history(spark, files.where("partition = '2024-01'"), "2024-05", records, board, manifest, **how) == 1
    assert jobs.process_history(spark, files, "2024-05", records, board, manifest, **how) == 1
    assert jobs.process_history(spark, files, "2024-05", records, board, manifest, **how) == 0
    rows = {r["period"]: r for r in spark.read.parquet(board).collect()}
    assert sorted(rows) == ["history:2024-05:2024-01", "history:2024-05:2024-02"] and all(r["rank"] == 1 and r["page_id"] == 7 and r["mutual_revert_pairs"] == 1 for r in rows.values())
    stored = spark.read.parquet(records)
    assert {(r["talk_edits"], r["talk_bytes"], r["rfc"]) for r in stored.collect()} == {(1, 900, 1)}
    year = jobs.year_board(stored, "history-year:2024-05:2024", 5).first()
    assert (year["page_id"], year["edit_count"], year["unique_editors"], year["revert_count"], year["rank"]) == (7, 60, 2, 38, 1)
    jobs.recompute_boards(spark, records, board, limit=10, min_score=10_000.0, period="history:2024-05:2024-01")
    assert [r["period"] for r in spark.read.parquet(board).collect()] == ["history:2024-05:2024-02"]


def test_dumps_to_evidence(spark, tmp_path):
    words = ("the great leader spoke to people", "the great dictator spoke to people")
    rev = lambda i, user, text, comment: f"<revision><id>{i}</id><timestamp>2024-01-05T{i % 24:02d}:00:00Z</timestamp><contributor><username>{user}</username></contributor><comment>{comment}</comment><text>{text}</text></revision>"
    article = "".join(rev(i, f"U{i % 2}", words[i % 2], "revert: sources say otherwise here") for i in range(1, 9))
    talk = rev(9, "Ann", "The word leader needs consensus before anyone restores it.", "reply")
    (tmp_path / "d.xml").write_text(f"<m><page><title>Big man</title><ns>0</ns><id>42</id>{article}</page><page><title>Talk:Big man</title><ns>1</ns><id>43</id>{talk}</page><page><title>Noise</title><ns>0</ns><id>5</id>{article}</page></m>")
    period = "history:2024-05:2024-01"
    board = spark.createDataFrame([(period, "enwiki", 42, "Big man", 100.0, 16, 2), (period, "enwiki", None, "x", 1.0, 1, 1), ("other", "enwiki", 5, "Noise", 1.0, 1, 1)], "period string, wiki string, page_id long, page_title string, peak_score double, revert_count long, mutual_revert_pairs long")
    table, status = str(tmp_path / "evidence"), str(tmp_path / "status")
    jobs.backfill_evidence(spark, board, [str(tmp_path / "d.xml")], period, table, status)
    got = spark.read.parquet(table).collect()
    assert [r["page_id"] for r in got] == [42] and got[0]["segments"][0]["change_type"] == "swap" and got[0]["talk"][0]["matched"] == ["leader"] and got[0]["controversy"]["score"] > 0
    states = sinks.status(spark, status)
    show = lambda page, p=period: serving.segments(spark.read.parquet(table), states, "enwiki", page, p).first()
    assert show(42)["source"] == "local_revision_dump" and show(5)["source"] == "local_evidence_missing" and "complete" in show(5)["message"] and "yet" in show(42, "history:2024-05:2024-02")["message"]
    assert [r["page_id"] for r in jobs.missing_talk(board.where("page_id IS NOT NULL"), spark.createDataFrame([(5,)], "page_id long")).collect()] == [42]


def test_governance_imports(spark, tmp_path):
    (tmp_path / "r.sql").write_text("INSERT INTO `page_restrictions` VALUES (42,'edit','sysop',0,'infinity',1);\n")
    (tmp_path / "l.xml").write_text("<m><logitem><id>1</id><timestamp>2024-01-01T00:00:00Z</timestamp><type>protect</type><action>protect</action><logtitle>Big man</logtitle></logitem></m>")
    jobs.import_restrictions(spark, str(tmp_path / "r.sql"), str(tmp_path / "a"), "enwiki")
    jobs.import_protection(spark, str(tmp_path / "l.xml"), str(tmp_path / "t"), "enwiki", F.lit("2024-01-11").cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "a")).first()["has_sysop"] and spark.read.parquet(str(tmp_path / "t")).first()["protection_days"] == 10.0


def test_links(spark):
    got = spark.range(1).select(serving.page_links(F.lit("A b"), F.lit(5)).alias("l"), serving.page_links(F.lit(None).cast("string"), F.lit(None).cast("long")).alias("n")).first()
    assert got["l"]["talk"].endswith("/wiki/Talk:A_b") and got["l"]["diff"].endswith("diff=5") and got["n"]["diff"] == ""
