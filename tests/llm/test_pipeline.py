"""The pipeline's stages, one after the other, against what each must do."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as P
from editfray.llm import bpe
from editfray.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = P.table(spark, DATA, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    out = []
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, DATA), "stage")
        out.append((name, docs.collect()))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    sizes = [len(rows) for _, rows in out]
    assert sizes[0] <= len(before) and sizes[1] == sizes[0] and sizes[2] <= sizes[1] and sizes[4] == sizes[3] > sizes[2]
    assert all(r["n_chars"] == len(r["text"]) for r in out[1][1])
    texts = {r["doc_id"]: r["text"] for r in out[3][1]}
    codec = bpe.codec(bpe.default_vocabulary())
    for r in out[4][1]:
        ids = np.array(codec._bpe.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    whole = sorted(tuple(r) for r in P.run(spark, DATA).collect())
    assert whole == sorted(tuple(r) for r in out[4][1])


def test_stages_by_brute_force(spark):
    from test_llm_operators import brute_components, words

    plain = lambda rows: sorted((r["doc_id"], r["text"] or "") for r in rows)
    # 1. What the operator's own scores call toxic goes, and nothing else: on a table with labels enough to learn from.
    more = DATA.replace("0.001", "0.01")
    given, labelled = P.table(spark, more, "documents"), P.table(spark, more, "labels")
    toxic = {r["doc_id"] for r in P.toxicity.score(given, P.toxicity.train(P.toxicity.labelled_rows(given, labelled))).collect() if r["predicted"]}
    assert plain(P.drop_toxic(spark, given, more).collect()) == plain(r for r in given.collect() if r["doc_id"] not in toxic) and toxic
    labels = {r["doc_id"]: r["toxic"] for r in labelled.collect()}
    assert np.mean([labels[i] == 1 for i in toxic if labels.get(i) is not None]) > 0.9
    docs = P.cut(P.drop_toxic(spark, P.table(spark, DATA, "documents"), DATA), "stage")
    # 2. Lines.
    rows, key = docs.collect(), lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    held = {}
    for r in rows:
        for k in {key(x) for x in (r["text"] or "").split("\n")}:
            held.setdefault(k, set()).add(r["doc_id"])
    keep = lambda x, i: len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i
    docs = P.cut(P.drop_lines(spark, docs, DATA), "stage")
    assert plain(docs.collect()) == sorted((r["doc_id"], "\n".join(x for x in (r["text"] or "").split("\n") if keep(x, r["doc_id"]))) for r in rows)
    # 3. One of each group.
    rows = docs.collect()
    _, low = brute_components([r["text"] for r in rows], [r["doc_id"] for r in rows])
    docs = P.cut(P.drop_copies(spark, docs, DATA), "stage")
    assert plain(docs.collect()) == plain(r for r, i in zip(rows, low, strict=True) if r["doc_id"] == i) and docs.count() < len(rows)
    # 4. The mix, source by source, in whole numbers of documents.
    rows = docs.collect()
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None] * any(r["source"] is None for r in rows)
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(total.values())
    while free := [s for s in names if s not in target]:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * total[s]]
        target |= {s: 2 * total[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(2 * total[s] for s in full)
    want = []
    for s in names:
        own = [r for r in rows if r["source"] == s and size[r["doc_id"]]]
        u = lambda r: (int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        quality = lambda r: 0.5 + 0.5 / (1 + abs(len(r["text"]) / max(size[r["doc_id"]], 1) - 6))
        epochs, upto = (int(target[s] // total[s]) if total[s] else 0), 0
        for r in sorted(own, key=lambda r: (-np.log(u(r)) / quality(r), r["doc_id"])):
            upto += size[r["doc_id"]]
            want += [(r["doc_id"], r["text"])] * (epochs + (upto - size[r["doc_id"]] / 2 <= target[s] - epochs * total[s]))
    assert plain(P.mix_sources(spark, docs, DATA).collect()) == sorted(want)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = c.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    key = [x for x in ("query_id", "rank", "doc_id") if x in want.columns]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for x in want.columns:
        assert np.allclose(a[x], b[x], rtol=1e-12) if a[x].dtype == float else (a[x] == b[x]).all(), x
