"""Dumps read by pieces of pages, and jobs that go on where they were stopped."""

import bz2
import gzip
import random
import resource
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from editfray.plans import jobs
from editfray.sources import wiki_dump, wiki_xml
from editfray.streaming import sinks
from tests.test_jobs import line


def page(title, ns, number, revisions):
    return f"  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n    <id>{number}</id>\n<redirect title='x' />" + "".join(revisions) + "</page>\n"


def rev(i, text, user="<username>A &amp; B</username>", at="2024-01-05T00:00:00Z", comment="<comment>why &lt;this&gt;</comment>"):
    return f"<revision><id>{i}</id><parentid>{i - 1}</parentid><timestamp>{at}</timestamp><contributor>{user}<id>9</id></contributor>{comment}<text bytes='9' xml:space=\"preserve\">{text}</text></revision>\n"


def sample():
    """XML, and the rows (page_id, title, namespace, rev_id, user, comment, content) it holds."""
    rng, out, want = random.Random(1), ["<mediawiki xml:lang='en'>\n<siteinfo>x</siteinfo>\n"], []
    for p in range(1, 40):
        # Long and short texts, pages without revisions, what looks like tags in texts.
        n = 300 if p == 20 else rng.randrange(6)
        texts = [rng.choice(["", "&lt;page&gt;&lt;revision&gt; é", "word " * rng.randrange(900)]) for _ in range(n)]
        users = [rng.choice(["<username>A &amp; B</username>", "<ip>1.2.3.4</ip>", ""]) for _ in range(n)]
        out.append(page(f"T &amp; {p}", p % 3, p, [rev(p * 1000 + k, t, u) for k, (t, u) in enumerate(zip(texts, users, strict=True))]))
        plain = {"<username>A &amp; B</username>": "A & B", "<ip>1.2.3.4</ip>": "1.2.3.4", "": ""}
        want += [(p, f"T & {p}", p % 3, p * 1000 + k, plain[u], "why <this>", t.replace("&lt;", "<").replace("&gt;", ">")) for k, (t, u) in enumerate(zip(texts, users, strict=True))]
    return "".join(out) + "</mediawiki>", sorted(want)


COLUMNS = ("page_id", "page_title", "namespace", "rev_id", "user_text", "comment", "content")


@pytest.mark.parametrize("range_bytes", [400, 5000, 1 << 20])
@pytest.mark.parametrize("read", [64, 1 << 20])
def test_pieces_of_any_size_give_the_same_revisions(spark, tmp_path, monkeypatch, range_bytes, read):
    monkeypatch.setattr(wiki_dump, "READ", read)
    text, want = sample()
    (tmp_path / "a.xml").write_text(text, encoding="utf-8")
    pieces = wiki_dump.pieces(spark, str(tmp_path), range_bytes)
    got = wiki_xml.read_revisions(pieces).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == want
    if range_bytes == 5000:
        # A long page is many pieces, none much longer than a range and a revision; headers are those of its beginning.
        long = pieces.where("page_id = 20").select(F.col("end") - F.col("start"), "page_title").collect()
        assert len(long) > 50 and max(r[0] for r in long) < 5000 + 2 * 4700 and {r["page_title"] for r in long} == {"T & 20"}


def test_packed_files_and_empty_ones(spark, tmp_path):
    text, want = sample()
    with gzip.open(tmp_path / "a.xml.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    with bz2.open(tmp_path / "b.xml.bz2", "wt", encoding="utf-8") as f:
        f.write("<m>" + page("Only", 0, 7, [rev(1, "x")]) + "</m>")
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("<m>" + page("Bare", 0, 8, []) + "<page><revision><id>5</id></revision></page></m>")
    pieces = wiki_dump.pieces(spark, str(tmp_path))
    got = sorted(map(tuple, wiki_xml.read_revisions(pieces).select(*COLUMNS).collect()))
    assert got == sorted([*want, (7, "Only", 0, 1, "A & B", "why <this>", "x"), (0, "", 0, 5, "", "", "")])
    some = wiki_xml.read_revisions(pieces.where("page_id IN (3, 20, 33, 7)")).select(*COLUMNS).collect()
    assert sorted(map(tuple, some)) == [r for r in got if r[0] in (3, 20, 33, 7)]
    assert wiki_xml.read_revisions(pieces.where("page_id < 0")).count() == 0


def test_no_text_is_built_that_is_not_asked_for(spark, tmp_path):
    # Damaged revisions raise where they are read: here they are never taken apart, for their page or for their time.
    good, bad = rev(1, "fine"), rev(2, "<b>never & closed")
    (tmp_path / "a.xml").write_text("<m>" + page("Other", 0, 1, [bad]) + page("Wanted", 0, 2, [good, rev(3, "&broken", at="2023-12-31T23:59:59Z"), rev(4, "&broken", at="2024-02-01T00:00:00Z")]) + page("Talk:Wanted", 1, 3, [rev(5, "said")]) + "</m>")
    pieces = wiki_dump.pieces(spark, str(tmp_path))
    wanted = spark.createDataFrame([("c", 77, "Wanted", 0)], "candidate string, page_id long, page_title string, talk_page_id long")
    got = wiki_xml.candidate_revisions(pieces, wanted, "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z").collect()
    assert sorted((r["rev_id"], r["candidate"], r["content"]) for r in got) == [(1, "c", "fine"), (5, "c", "said")]
    with pytest.raises(Exception, match="a.xml at"):
        wiki_xml.read_revisions(pieces).collect()


def test_a_page_of_a_million_revisions_fits_into_little_memory(tmp_path):
    # The tasks of both passes, each in a process whose memory is bounded: Arrow, Spark's client and 1,000,000 revisions of one page within 1 GB.
    path = tmp_path / "long.xml"
    with open(path, "w", encoding="utf-8") as f:
        f.write("<m><page><title>Long</title><ns>0</ns><id>1</id>")
        for k in range(1000):
            f.write("".join(rev(k * 1000 + i, "a text of some words " * 4) for i in range(1000)))
        f.write("</page></m>")
    code = f"""
from editfray.sources import wiki_dump as w
n = {path.stat().st_size}
spots = []
for start in range(0, n, w.RANGE):
    with w.opened("file://{path}") as f:
        spots += list(w.headers(w.Tags(f, start), start, start + w.RANGE))
assert len(spots) == -(-n // w.RANGE) and sum(s[1] is not None for s in spots) == 1
with w.opened("file://{path}") as f:
    tags, count = w.Tags(f, spots[0][0]), 0
    while tags.next(b"<revision>"):
        raw = tags.upto(b"</revision>", within=True)
        count += 1
        if count % 100 == 0:
            assert w._revision(raw, "")[0] == count - 1
assert count == 1_000_000
"""
    limit = 1 << 30
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, preexec_fn=lambda: resource.setrlimit(resource.RLIMIT_DATA, (limit, limit)))
    assert done.returncode == 0, done.stderr[-500:]


def test_a_stopped_backfill_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    words = ("the great leader spoke to people", "the great dictator spoke to people")
    for k in range(3):
        article = [rev(k * 100 + i, words[i % 2], f"<username>U{i % 2}</username>", f"2024-01-0{k + 1}T{i:02d}:00:00Z", "<comment>revert: sources say otherwise here</comment>") for i in range(1, 9)]
        (tmp_path / f"s{k}.xml").write_text("<m>" + page(f"Page {k}", 0, 40 + k, article) + "</m>")
    period = "history:2024-05:2024-01"
    schema = "period string, wiki string, page_id long, page_title string, peak_score double, revert_count long, mutual_revert_pairs long"
    rows = [(period, "enwiki", 40 + k, f"Page {k}", 100.0, 16, 2) for k in range(3)]
    dumps, table, status = [str(tmp_path / f"s{k}.xml") for k in range(3)], str(tmp_path / "evidence"), str(tmp_path / "status")
    read, pieces = [], wiki_dump.pieces

    def counted(spark_, path, *how):
        read.append(path[-6:])
        if path == broken:
            raise OSError("the shard can't be read")
        return pieces(spark_, path, *how)

    monkeypatch.setattr(wiki_dump, "pieces", counted)
    broken = dumps[1]
    with pytest.raises(sinks.SomeFailed, match="s1.xml"):
        jobs.backfill_evidence(spark, spark.createDataFrame(rows, schema), dumps, period, table, status)
    assert sinks.status(spark, status).first()["state"] == '{"phase": "running"}' and not sinks.exists(spark, table)
    read.clear()
    broken = ""
    jobs.backfill_evidence(spark, spark.createDataFrame(rows[::-1], schema), dumps, period, table, status)
    assert read == ["s1.xml"] and sorted(r["page_id"] for r in spark.read.parquet(table).collect()) == [40, 41, 42]
    read.clear()
    jobs.backfill_evidence(spark, spark.createDataFrame(rows[:2], schema), dumps, period, table, status)
    assert sorted(read) == ["s0.xml", "s1.xml", "s2.xml"] and sorted(r["page_id"] for r in spark.read.parquet(table).collect()) == [40, 41]
    # One set of rows a shard is left, with its record.
    assert len([p for p in (tmp_path / "evidence.work" / period.replace(":", "_")).iterdir() if p.name.count(".") and not p.name.startswith(".")]) == 6


def test_records_without_rows_count_for_nothing(spark, tmp_path):
    made = []

    def make(shard):
        made.append(shard)
        return spark.createDataFrame([(shard,)], "s string")

    folder = str(tmp_path / "work")
    for _ in range(2):
        assert [r["s"] for d in sinks.resumed(spark, folder, "m", ["a/1", "b/1"], make) for r in d.collect()] == ["a/1", "b/1"]
    assert sorted(made) == ["a/1", "b/1"]
    for p in (tmp_path / "work").iterdir():
        if p.is_dir():
            p.rename(tmp_path / f"gone-{p.name}")
    assert len(sinks.resumed(spark, folder, "m", ["a/1", "b/1"], make)) == 2 and len(made) == 4
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string"), spark.createDataFrame([("b", 2), ("a", 1)], "s string, i long")
    assert sinks.fingerprint(one) == sinks.fingerprint(two) != sinks.fingerprint(one.limit(1)) and sinks.fingerprint(one.limit(0)) != sinks.fingerprint(one)


def test_a_broken_month_leaves_the_others_listed(spark, tmp_path):
    files = []
    for month in (1, 2, 3):
        fight = [line(month * 1000 + i, i, f"E{i % 2}", first=month * 1000 + i + 1 if i < 19 else "", month=month) for i in range(20)]
        name = tmp_path / f"2024-05.enwiki.2024-0{month}.tsv.bz2"
        whole = bz2.compress("\n".join(fight).encode())
        name.write_bytes(whole[:200] + b"broken" + whole[206:] if month == 2 else whole)
        files.append((str(name), f"2024-0{month}"))
    listed = spark.createDataFrame(files, "name string, partition string")
    records, board, manifest = (str(tmp_path / x) for x in ("records", "board", "manifest"))
    how = dict(limit=10, min_score=1.0)
    with pytest.raises(sinks.SomeFailed) as e:
        jobs.process_history(spark, listed, "2024-05", records, board, manifest, **how)
    assert list(e.value.failed) == ["2024-02"]
    assert sorted(r["partition"] for r in spark.read.parquet(manifest).collect()) == ["2024-01", "2024-03"]
    assert sorted(r["period"] for r in spark.read.parquet(board).collect()) == ["history:2024-05:2024-01", "history:2024-05:2024-03"]
    fight = [line(2000 + i, i, f"E{i % 2}", first=2000 + i + 1 if i < 19 else "", month=2) for i in range(20)]
    (tmp_path / "2024-05.enwiki.2024-02.tsv.bz2").write_bytes(bz2.compress("\n".join(fight).encode()))
    assert jobs.process_history(spark, listed, "2024-05", records, board, manifest, **how) == 1 and spark.read.parquet(board).count() == 3
    assert jobs.process_history(spark, listed, "2024-05", records, board, manifest, **how) == 0


def test_a_month_that_becomes_empty_loses_its_rows(spark, tmp_path):
    name = tmp_path / "2024-05.enwiki.2024-01.tsv.bz2"
    fight = [line(1000 + i, i, f"E{i % 2}", first=1000 + i + 1 if i < 19 else "") for i in range(20)]
    name.write_bytes(bz2.compress("\n".join(fight).encode()))
    files = spark.createDataFrame([(str(name), "2024-01")], "name string, partition string")
    records, board = str(tmp_path / "records"), str(tmp_path / "board")
    jobs.process_history(spark, files, "2024-05", records, board, str(tmp_path / "m1"), limit=10, min_score=1.0)
    assert spark.read.parquet(records).count() == 1
    name.write_bytes(bz2.compress(line(5, 1, "E0", month=1).replace("revision", "page", 1).encode()))
    jobs.process_history(spark, files, "2024-05", records, board, str(tmp_path / "m2"), limit=10, min_score=1.0)
    assert not list((tmp_path / "records").glob("period=*")) and not list((tmp_path / "board").glob("period=*"))


def test_files_after_the_last_hit_are_not_opened(spark, tmp_path):
    files = []
    for month in range(1, 8):
        name = tmp_path / f"2024-05.enwiki.2024-0{month}.tsv.bz2"
        rows = [line(month * 100 + k, k, "E", page=month * 10 + k, title=f"Talk:Page {k}", ns=1, month=month) for k in range(3) if k < month] + [line(month * 100 + 9, 5, "E", month=month)]
        # From the fourth on they can't be read: whoever opens one fails.
        whole = bz2.compress("\n".join(rows).encode())
        name.write_bytes(whole[:60] + b"broken" + whole[66:] if month > 3 else whole)
        files.append((str(name), f"2024-0{month}"))
    listed = spark.createDataFrame(files, "name string, partition string")
    wanted = spark.createDataFrame([("Page 0",), ("Page 1",), ("Page 2",)], "page_title string")
    got = {r["title"]: r["talk_page_id"] for r in jobs.talk_page_ids(spark, listed, wanted).collect()}
    assert got == {"Page_0": 10, "Page_1": 21, "Page_2": 32}
    with pytest.raises(Exception):
        jobs.talk_page_ids(spark, listed, wanted.union(spark.createDataFrame([("Nowhere",)], "t string")))
