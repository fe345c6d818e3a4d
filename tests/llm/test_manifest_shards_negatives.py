"""Merkle manifest, sharding and hard negatives against brute force, on small tables with nulls, ties, repeats, hot groups and long texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from editfray.llm import hard_negatives, merkle, sharding

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes, runs):
    """The root, and for each node its siblings left and right on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            i = at[k]
            begin = i - i % runs
            p.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + runs])))
            at[k] = i // runs
        nodes = [sha(*nodes[i : i + runs]) for i in range(0, len(nodes), runs)]
    return nodes[0], paths


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, root string, path int")


def sample_rows(n=300):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", None, "é"]), rng.choice(["en", "en", "en", None, "de", "ä", "", "z" if i == 5 else "en"]), rng.choice([None, i]), rng.choice(["", None, "text é\n" * rng.randrange(9)])) for i in range(n)]
    # Repeated rows, one id with two texts, no id.
    return [*rows, rows[3], rows[3], (7, "a", "en", 1, "other"), (None, None, None, None, None), (None, "a", "en", 3, "no id"), (1 << 40, "a", "fr", 1, "long, " * 200_000)]


@pytest.mark.parametrize(("runs", "block"), [(2, 1024), (2, 8), (3, 9), (5, 1024)])
def test_manifest_by_brute_force(spark, monkeypatch, runs, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = sample_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], runs)
    root, tops = tree([trees[g][0] for g in order], runs)
    want = sorted(
        (r[0] or -1, leaf(r), trees[g][0], root, trees[g][1][i] + tops[k]) for k, g in enumerate(order) for i, r in enumerate(groups[g])
    )
    out = merkle.manifest(documents(spark, rows), runs=runs).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof(F.col("path"))).collect()
    assert sorted((r["doc_id"] or -1, r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in out) == want
    assert all(r["folded"] == root and r["proof"] == sha(*[x + y for x, y in r["path"]]) for r in out)


def test_manifest_finds_what_changed(spark):
    rows = [r for r in sample_rows(60) if r[0] is not None]
    docs = documents(spark, rows)
    made = merkle.manifest(docs)
    now = [(r[0], r[1], r[2], r[3], "changed" if r[0] == 11 else r[4]) for r in rows if r[0] != 20] + [(900, "a", "en", 1, "new")]
    got = {(r["doc_id"], r["claimed"]): r["verified"] for r in merkle.verified(made, documents(spark, now)).collect()}
    assert {k[0] for k, ok in got.items() if not ok} >= {11, 20, 900}
    # Rows that share an id meet each other's paths: one of them leads to root.
    assert all(any(ok for k, ok in got.items() if k[0] == i) for i in {r[0] for r in rows} - {11, 20})
    alone = merkle.manifest(documents(spark, rows[:1])).collect()[0]
    assert alone["leaf"] == alone["subroot"] == alone["root"] and not alone["path"]
    assert merkle.manifest(docs.limit(0)).count() == 0


def expected_shards(rows, shards, overhead=16):
    """(h, id) order, middles in whole numbers."""
    keyed = sorted(((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i is not None, i or 0, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for i, t in rows))
    total, group = sum(k[3] for k in keyed), defaultdict(int)
    for k in keyed:
        group[k[0]] += k[3]
    upto, begun, out, slots = 0, {}, [], defaultdict(int)
    for h, there, i, size, crc in keyed:
        begun.setdefault(h, upto)
        upto += size
        middle = 2 * begun[h] + group[h] if group[h] <= int(sharding.WHOLE * total / shards) else 2 * upto - size
        s = middle * shards // (2 * total)
        out.append((i if there else -1, size, crc, s, slots[s]))
        slots[s] += 1
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_by_brute_force(spark, shards):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["one", "two", "é", "four"], k=rng.randrange(60))) for _ in range(900)]
    # A third of all rows holds one text; others are repeated a few times; null, empty and long ones.
    texts += ["the same text everywhere"] * 500 + texts[:60] * 3 + ["", None, None, "long " * 5000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (5, "other text of five"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, shard string, h int")
    got = sharding.shards_of(docs, shards).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == expected_shards(rows, shards)
    held = defaultdict(int)
    for r in got:
        held[r["shard"]] += r["size"]
    fair, most = sum(held.values()) / shards, max(r["size"] for r in got)
    assert all(abs(x - fair) <= max(most, sharding.WHOLE * fair) + 1 for x in held.values()) and {r["law"] for r in got} == {"bytes"}


def test_overfull_ranges_are_divided(spark, monkeypatch):
    # A sample of one key a range leaves ranges far too full: they are drawn from again, with the same shards.
    monkeypatch.setattr(sharding, "DRAWN", 1)
    monkeypatch.setattr(sharding, "WHOLE", 0.0)
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    keys = docs.select(F.col("doc_id").alias("id"), (F.octet_length("text") + 16).cast("long").alias("size"), sharding.text_key(F.col("text")).alias("h"), F.col("doc_id").cast("long").alias("at"))
    split, sums = sharding._splitters(keys, 10)
    fair = sum(b for b, _ in sums) // 160
    assert len(split) + 1 == len(sums) and max(b for b, _ in sums) <= 2 * fair and sum(n for _, n in sums) == 3000
    got = sharding.shards_of(docs, 10).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert len(got) == 10 and max(r["bytes"] for r in got) - min(r["bytes"] for r in got) <= 60 and all(r["top"] == r["n"] - 1 for r in got)
    assert sharding.shards_of(docs.limit(0), 10).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharding.shards_of(docs.limit(1), 10).collect()] == [(5, 0)]


def test_written_shards_hold_their_rows_in_order(spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 7), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `slot` long")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5, parts=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r["doc_id"]): (r["shard"], r["slot"]) for r in sharding.shards_of(docs, 5).collect()}
    assert {r["doc_id"]: (r["shard"], r["slot_"]) for r in back.collect()} == want and sorted(back.select("doc_id", "text", "slot").collect()) == sorted(docs.collect())
    for shard in range(5):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [r["slot_"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots))) and len(files) <= 3


def expected_negatives(rows, positives=5, negatives=10, low=30, high=90, anchor=lambda i: i % 10 == 0):
    good = [(n, i, y, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for n, (i, v, y) in enumerate(rows) if i is not None and v and y is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, i, y, v in good:
        if not anchor(i):
            continue
        scored = sorted((-int(v @ w), j, m, z) for m, j, z, w in good if m != n and len(w) == len(v))
        for p, j, _, _ in [s for s in scored if s[3] == y][:positives]:
            fit = [s for s in scored if s[3] != y and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("block", "stripe", "scores"), [(8192, 2048, 1 << 21), (4, 7, 50)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, block, stripe, scores):
    for name, value in (("BLOCK", block), ("STRIPE", stripe), ("SCORES", scores)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 8))
    x = np.concatenate([base[rng.integers(0, 6, 150)] + 0.6 * rng.standard_normal((150, 8)), np.repeat(base[:1], 60, axis=0), rng.standard_normal((20, 8)) * 1e-3])
    rows = [(i, [float(a) for a in v], int(rng.integers(0, 3)) if i % 3 else 0) for i, v in enumerate(x)]
    # Repeated ids and rows, other lengths, what takes no part; opposite vectors, whose positives score below zero.
    rows += [rows[10], rows[10], (20, rows[21][1], 2), (1000, [1.0, 2.0], 0), (1010, [2.0, 1.0], 0), (1001, [1.0, 1.0], 1), (2000, None, 1), (2010, rows[0][1], None), (2020, [float("nan")] * 8, 1), (2030, [None] * 8, 1), (2040, [], 1), (None, rows[0][1], 1)]
    rows += [(3000, [5.0, 0.0, 0.0], 0), (3001, [-5.0, 0.0, 0.0], 0), (3002, [0.0, 1.0, 0.0], 1), (3003, [0.0, 0.0, 1.0], 0), (3004, [0.0, 0.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, anchor string, row int").repartition(5)
    got = hard_negatives.hard_negatives(table, is_anchor=F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == expected_negatives(rows)
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0


def test_hard_negatives_of_large_numbers_and_other_labels(spark):
    # Products beyond 2^52, which no double holds, and labels of words; lists that grow from a stripe to the next.
    rng = np.random.default_rng(8)
    rows = [(i, [float(a) for a in rng.integers(1, 1 << 22, 4)], i % 4) for i in range(80)]
    want = expected_negatives(rows, positives=3, negatives=4, low=10, high=95)
    table = spark.createDataFrame([(i, v, "abcd"[y]) for i, v, y in rows], "vec_id long, embedding array<double>, label string")
    got = hard_negatives.hard_negatives(table, positives=3, negatives=4, low=10, high=95, is_anchor=F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
