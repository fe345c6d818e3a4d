"""The training-data operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from editfray.llm import bpe, char_lm, components, embedding_dedup, html_text, line_dedup, mixing, ngram_join, token_counts, topk_search, toxicity
from editfray.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string"


def docs(spark, texts, langs=None, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


# 1. Embedding near-dedup


def test_embedding_dedup_by_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.08 * rng.standard_normal((20, 16)), base[:10] * 3, base[:1] + 0.02 * rng.standard_normal((60, 16))]).astype(np.float32)
    label = [int(i) % 3 for i in range(len(x))]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, [float("inf")] * 16, 1), (906, rows[0][1], label[0]), (907, [], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [r for r in rows if r[0] < 900 or r[0] == 906]
    v = np.array([r[1] for r in good], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    np.fill_diagonal(link, False)
    low = np.array([r[0] for r in good])
    for _ in range(len(good)):
        low = np.minimum(low, np.where(link, low[None, :], 1 << 60).min(axis=1))
    assert len(got) == len(rows) and link.sum() > 500
    for k, r in enumerate(good):
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (link[k].sum(), low[k], bool(low[k] == r[0]))
    for i in (900, 901, 902, 903, 904, 905, 907):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").limit(0)).count() == 0
    # Rows that share an id are vectors of their own: each has its own links.
    e = lambda *v: [float(a) for a in v]
    pairs = [(1, e(1, 0, 0), 0), (1, e(0, 1, 0), 0), (2, e(1, 0.01, 0), 0), (3, e(0.01, 1, 0), 0), (4, e(0, 0, 1), 0), (4, e(0, 0, 2), 0)]
    found = embedding_dedup.embedding_dedup(spark.createDataFrame(pairs, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]
    # One vector of another length, under the smallest id, takes nothing from the others; two such link.
    more = [*rows, (-3, [1.0, 2.0, 3.0], 0), (-2, [1.0, 2.0, 3.01], 0), (-1, [5.0], None)]
    again = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(more, "vec_id long, embedding array<float>, label int")).collect()}
    assert {i: again[i] for i in got} == got and [again[i]["n_links"] for i in (-3, -2, -1)] == [1, 1, 0] and again[-2]["component_id"] == -3


@pytest.mark.parametrize("n", [10**6, 10**8])
def test_recall_of_the_plan_of_a_large_table(n):
    # The hashes and tables of a large table, on pairs of 64 dimensions right at the threshold and over it: measured, not computed.
    k, tables = embedding_dedup.plan(n, 0.93, 0.01)
    assert k >= 12
    rng = np.random.default_rng(12)
    a, b = np.random.default_rng([5, 64]).standard_normal((64, tables * k)), rng.uniform(0, embedding_dedup.WIDTH, tables * k)
    for cosine, least in ((0.93, 0.98), (0.96, 0.998)):
        x = embedding_dedup._unit(rng.standard_normal((1500, 64)))
        y = rng.standard_normal((1500, 64))
        y = embedding_dedup._unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y
        u, v = (np.floor((z @ a + b) / embedding_dedup.WIDTH).reshape(1500, tables, k) for z in (x, y))
        assert (u == v).all(axis=2).any(axis=1).mean() >= least


@pytest.mark.parametrize("small", [0, 3, 64])
def test_tiles_of_any_size_agree(monkeypatch, small):
    import pyarrow as pa

    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5, 6))[rng.integers(0, 5, 60)] + 0.15 * rng.standard_normal((60, 6))
    tile, side = np.sort(rng.integers(0, 6, 60)), rng.integers(0, 2, 60)
    whole = tile % 2 == 0
    side[whole] = 0
    codes = rng.integers(0, 9, (60, 2))
    rows = pa.table({"tile": tile, "whole": whole, "side": side, "dim": [6] * 60, "id": np.arange(60), "copies": np.ones(60, dtype=np.int64), "vector": pa.array(x.tolist()), "earlier": pa.array(codes.tolist())})
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (tile[:, None] == tile[None, :]) & (whole[:, None] | (side[:, None] != side[None, :])) & ~(codes[:, None, :] == codes[None, :, :]).any(axis=2)
    np.fill_diagonal(link, False)
    got = {r["id"]: (r["n"], r["low"]) for r in embedding_dedup._tiles_links(rows, 0.93).to_pylist()}
    low = np.arange(60)
    for _ in range(60):
        low = np.minimum(low, np.where(link, low[None, :], 99).min(axis=1))
    assert got == {i: (int(link[i].sum()), int(low[i])) for i in range(60) if link[i].any()} and len(got) > 20


def test_a_bucket_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(12) + 0.05 * rng.standard_normal((70, 12))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["n_links"] for r in got} == {69} and {r["component_id"] for r in got} == {0}


def test_the_plan_follows_the_theory():
    near = embedding_dedup.meeting(np.sqrt(2 - 2 * 0.93))
    k, tables = embedding_dedup.plan(10**6, 0.93, 0.01)
    assert (1 - near**k) ** tables <= 0.01
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(20000), rng.uniform(0, 2, 20000)
    assert np.mean(np.floor(b / 2) == np.floor((0.5 * a + b) / 2)) == pytest.approx(embedding_dedup.meeting(0.5), abs=0.02)


# 2 and 8. Tokens

TEXTS = ["It's a dog's life, they'll say.\n\n  Tabs\tand   runs ", "", None, "漢字かな交じり文" * 700, "é😀 " * 900, " " * 5000 + "x", "a" * 9000, "12345 " * 900 + "\n \n", "don't" * 1500, "word " * 3000]


def reference_ids(text):
    return bpe.codec(bpe.default_vocabulary())._bpe.encode_ordinary(text or "")


@pytest.mark.parametrize("leaf", [7, 64, 256])
def test_bpe_round_trip(spark, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    c = bpe.codec(bpe.default_vocabulary())
    for t in TEXTS:
        ids = c.encode(t or "")
        assert ids.tolist() == reference_ids(t) and c.decode(ids) == (t or "").encode()


def test_bpe_query_columns(spark):
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array(reference_ids(t), dtype="<u4")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs(spark, ["x"]).limit(0)).count() == 0


def test_edited_counts_match_a_full_encoding(spark):
    rng = random.Random(5)
    c = bpe.codec(bpe.default_vocabulary())
    for t in TEXTS * 3:
        t = t or ""
        tree = token_counts.CountTree(t, c, rng.choice([4, 40, 512]))
        for _ in range(12):
            at, drop, ins = rng.randint(-3, len(t) + 3), rng.choice([0, 1, 7, len(t)]), rng.choice(["", "x", " don't", "\n\n", "漢é "])
            tree.edit(at, drop, ins)
            at = min(max(at, 0), len(t))
            t = t[:at] + ins + t[at + drop :]
            assert tree.text == t and tree.tokens == len(c._bpe.encode_ordinary(t))


def test_an_edit_encodes_little():
    c = bpe.codec(bpe.default_vocabulary())
    tree = token_counts.CountTree("some words of a long text " * 4000, c)
    before = tree.encoded
    tree.edit(50_000, 5, "others")
    assert tree.encoded - before < 3000


def test_edits_from_a_table(spark):
    edits = spark.createDataFrame([(0, 2, 0, 0, ">> "), (0, 1, 4, 3, None), (9, 1, 0, 0, "x"), (1, 1, None, None, "new text")], "doc_id long, seq int, pos long, drop long, ins string")
    got = {r["doc_id"]: r for r in token_counts.edited_counts(token_counts.with_edits(docs(spark, ["abc def ghi", None, "same"]), edits), with_text=True).collect()}
    assert [got[i]["text"] for i in range(3)] == [">> abc  ghi", "new text", "same"]
    assert all(got[i]["n_tokens_after"] == len(reference_ids(got[i]["text"])) for i in range(3)) and got[2]["n_encoded"] == 0


def test_kept_trees_are_taken_up(spark):
    text = "some words of a long text, and more. " * 400
    edits = lambda at: spark.createDataFrame([(0, 1, at, 5, "others")], "doc_id long, seq int, pos long, drop long, ins string")
    kept = token_counts.count_trees(docs(spark, [text, None]))
    first = token_counts.edited_counts(token_counts.with_edits(kept, edits(6000)), with_text=True)
    again = {r["doc_id"]: r for r in token_counts.edited_counts(token_counts.with_edits(first.select("doc_id", "text", "leaf_chars", "leaf_tokens", "leaf_digest"), edits(90))).collect()}
    want = text[:6000] + "others" + text[6005:]
    assert again[0]["n_tokens"] == len(reference_ids(want)) and again[0]["n_tokens_after"] == len(reference_ids(want[:90] + "others" + want[95:])) and again[1]["n_tokens_after"] == 0
    tree = token_counts.CountTree(want, bpe.codec(bpe.default_vocabulary()), kept=token_counts.CountTree(want, bpe.codec(bpe.default_vocabulary())).leaves())
    assert tree.encoded == 0 and tree.tokens == len(reference_ids(want)) and tree.text == want
    assert 0 < again[0]["n_encoded"] < 3000
    # Leaves of another text aren't taken, also where it is as long.
    stale = token_counts.edited_counts(token_counts.with_edits(kept.withColumn("text", F.translate("text", "o", "7")), edits(90))).where("doc_id = 0").first()
    assert stale["n_tokens"] == len(reference_ids(text.replace("o", "7"))) and stale["n_tokens_after"] == len(reference_ids(text.replace("o", "7")[:90] + "others" + text.replace("o", "7")[95:]))
    own = bpe.codec(bpe.default_vocabulary())
    whole, _, of = token_counts.CountTree("short", own).leaves()
    for kept in (([900], [3]), ([900], [3], of), (whole, [7, 1], of), (whole, [None], of), (None, [1], of), (whole, [9], None), (whole, [9], of + 1)):
        assert token_counts.CountTree("short", own, kept=kept).tokens == len(reference_ids("short"))


def test_the_registered_edits_on_a_fixture(spark):
    rows = token_counts.sample_edits(docs(spark, [t for t in TEXTS if t is not None] + ["Some words. " * 900]))
    lists = {r["doc_id"]: (r["text"], r["edits"]) for r in rows.collect()}
    for r in token_counts.edited_counts(rows).collect():
        t, edits = lists[r["doc_id"]]
        before = len(reference_ids(t))
        for e in edits:
            at = min(max(e["pos"], 0), len(t))
            t = t[:at] + (e["ins"] or "") + t[at + e["drop"] :]
        assert (r["n_tokens"], r["n_tokens_after"], r["n_chars_after"], r["n_edits"]) == (before, len(reference_ids(t)), len(t), len(edits))


# 3. HTML


def test_html_article():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site, top</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, always.</div>
    <div id=main-text><h1>Head &amp; line</h1><p>One,  two&nbsp;three &lt;x&gt;.<p>Short<script>var a="</p>";</script><div class="ad-box">Buy, now.</div><form>Mail: <input></form><ul><li>an item, good<li>more</ul></div>
    <aside>Side</aside><div class="comments"><p>First! Great, thanks.</p></div><footer>End</footer></body></html>"""
    assert html_text.extract(page) == "Head & line\nOne, two three <x>.\nShort\nan item, good\nmore"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<article></article><nav>menu</nav>") == ""
    framed = "<div class='content has-sidebar'><form><h1>Head</h1><p>Text of the page, and more of it.</p><div class=sidebar>Side.</div></form></div>"
    assert html_text.extract(framed) == "Head\nText of the page, and more of it."
    assert html_text.extract("just 3 < 5 text") == "just 3 < 5 text"
    assert html_text.extract("<p>" + "word, " * 100000) == ("word, " * 100000).strip()


def test_html_frames_and_sources():
    body, said = "<h1>Head</h1><p>Text of the page, and more of it.</p>", "<section id=comments><p>" + "Great, thanks for this. " * 20 + "</p></section>"
    want = "Head\nText of the page, and more of it."
    assert html_text.extract(f"<main><div class=has-sidebar>{body}</div></main>{said}") == want
    assert html_text.extract(f"<div class=has-sidebar>{body}</div>{said}") == want
    assert html_text.extract(f"<main><div class=has-sidebar>{body}</div>{said}</main>") == want
    assert html_text.extract(f"<main><div class=has-sidebar><p>Text, no heading.</p></div></main>{said}") == "Text, no heading."
    links = "<ul><li><a href=/1>First source</a><li><a href=/2>Second source</a></ul>"
    assert html_text.extract(f"<ul><li><a href=/>Home</a></ul><article>{body}{links}</article>") == want + "\nFirst source\nSecond source"


PLAIN_PAGE = """<body><div class=top><div>Start</div><div>About us</div></div><div class=box><h1>Head</h1><p>A long paragraph, with marks; and more of it, to be read.</p><p>Short.</p>
<ul><li>one</li><li>two</li></ul><p>Another paragraph, as long as the first one, or longer still.</p></div><div class=low><div>Imprint</div><div>Terms of use</div></div></body>"""


def test_html_paths_select_the_content(monkeypatch):
    want = "Head\nA long paragraph, with marks; and more of it, to be read.\nShort.\none\ntwo\nAnother paragraph, as long as the first one, or longer still."
    assert html_text.extract(PLAIN_PAGE) == want
    marked = "<body><nav>Home, or not.</nav><article><p>Text of the article, and so on.</p><div class=ad>Buy this, now!</div><p>End.</p></article></body>"
    assert html_text.extract(marked) == "Text of the article, and so on.\nEnd."
    # Without the threshold everything scored is content, also what is marked in the article; with one that nothing reaches, nothing is.
    monkeypatch.setattr(html_text, "content_paths", lambda scores, of: scores > 0)
    assert html_text.extract(PLAIN_PAGE) == "Start\nAbout us\n" + want + "\nImprint\nTerms of use"
    assert html_text.extract(marked) == "Text of the article, and so on.\nBuy this, now!\nEnd."
    monkeypatch.setattr(html_text, "content_paths", lambda scores, of: scores < 0)
    assert html_text.extract(PLAIN_PAGE) == html_text.extract(marked) == ""


def test_html_threshold_decides_on_marked_pages(spark, monkeypatch):
    # Turned round, the threshold takes the article away on nearly every page of the table, all of which have semantic tags.
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right, content_paths = [html_text.extract(p) for p in pages], html_text.content_paths
    monkeypatch.setattr(html_text, "content_paths", lambda scores, of: ~content_paths(scores, of))
    assert sum(html_text.extract(p) != t for p, t in zip(pages, right, strict=True)) > 0.9 * len(pages)


def test_html_keeps_whole_articles():
    a, b = "The committee met on Tuesday to discuss the budget, and agreed on most of its points.", "Members said, after hours of talks, that the plan would be sent to the council in May."
    p, q = f"<p>{a}</p>", f"<p>{b}</p>"
    cases = {
        f"<form action=x><input name=q>{p}{q}</form>": (a, b),
        f"<a href=#c>Skip to content</a><div class=has-sidebar>{p}{q}<div class=sidebar>Side text.</div></div>": (a, b),
        f"<h1>Title</h1><form><input>{p}{q}</form>": ("Title", a, b),
        f"<div id=content><h1>Title</h1>{p}{q}{p}</div><article class=card><p>Read on, now.</p></article>": ("Title", a, b, a),
        f"<article>{p}<p id=market-share>Its share rose, to 10 per cent.</p><p class=popular>It is popular.</p>{q}</article>": (a, "Its share rose, to 10 per cent.", "It is popular.", b),
        f"<main><section id=intro><h2>Intro</h2>{p}</section><section id=discussion><h2>Discussion</h2>{q}</section><section id=related-work><h2>Related work</h2>{p}</section></main>": ("Intro", a, "Discussion", b, "Related work", a),
        f"<article>{p}<div class=discussion>{q}</div></article>": (a, b),
        f"<article><div class=post-header><h1>Title</h1><p>A lead, in short.</p></div>{p}{q}</article>": ("Title", "A lead, in short.", a, b),
        f"<article>{p}<aside class=pullquote>Most of its points, he said.</aside>{q}</article>": (a, "Most of its points, he said.", b),
        f"<article>{p}<fieldset><legend>Facts</legend>Population: 1,000.</fieldset>{q}</article>": (a, "Facts", "Population: 1,000.", b),
        # What is none of it, in the midst of an article.
        f"<article><h1>Title</h1><div class=share><a href=x>Share</a> <a href=y>Post</a></div>{p}{q}<ul class=related><li><a href=z>Other one</a></ul><div class=ad>Buy, now!</div><form>Mail: <input></form></article>": ("Title", a, b),
        f"<article>{p}{q}<section class=comments>{p}{p}{p}</section></article><div hidden>{p}</div><footer>{p}</footer>": (a, b),
    }
    for page, want in cases.items():
        assert html_text.extract(f"<html><body>{page}</body></html>") == "\n".join(want)


def html_by_brute_force(page):
    """Scores and choice over a parsed page, each from its definition: no sums are shared, and every element looks at every block."""
    up = [[e] for e in range(len(page.tag))]
    for e in range(1, len(page.tag)):
        up[e] = [e, *up[page.parent[e]]]
    inside = lambda e, i: i in up[e]
    H = html_text
    headed = lambda i: any(page.tag[e] == "h1" and inside(e, i) for e in range(len(page.tag)))
    named = [H.PLAIN if m in (H.COMMENTS, H.DOUBTFUL) and headed(i) else m for i, m in enumerate(page.marked)]
    unseen = [any(named[i] >= H.COMMENTS for i in up[e]) for e in range(len(page.tag))]
    plain = [(e, max(0, len(t) - links)) for e, t, links in page.blocks if not unseen[e]]
    total = sum(n for _, n in plain)
    for i in range(1, len(page.tag)):
        if named[i] == H.PLAIN and page.tag[i] in ("form", "fieldset") and any(page.controls[e] and inside(e, i) for e in range(len(page.tag))):
            named[i] = H.OTHER
        if named[i] < H.STRUCTURE and 2 * sum(n for e, n in plain if inside(e, i)) > total:
            named[i] = H.PLAIN
    mark = [max(named[i] for i in up[e]) for e in range(len(page.tag))]
    keys = [(tuple(page.path[i] for i in up[e]), H.PRIOR[mark[e]]) for e, _, _ in page.blocks]
    same = lambda k: [j for j in range(len(keys)) if keys[j] == keys[k]]
    text = [sum(max(0, len(page.blocks[j][1]) - page.blocks[j][2]) for j in same(k)) / len(same(k)) for k in range(len(keys))]
    if not any(t * keys[k][1] for k, t in enumerate(text)):
        text = [sum(len(page.blocks[j][1]) for j in same(k)) / len(same(k)) for k in range(len(keys))]
    points = [sum(sum(page.blocks[j][1].count(c) for c in ".,;:!?") for j in same(k)) / len(same(k)) for k in range(len(keys))]
    smooth = lambda x, k: 0.25 * x[max(0, k - 1)] + 0.5 * x[k] + 0.25 * x[min(len(x) - 1, k + 1)]
    fused = [smooth(text, k) * (0.5 + math.sqrt(smooth(points, k))) * keys[k][1] for k in range(len(keys))]
    score = [sum(fused[j] for j in same(k)) / len(same(k)) for k in range(len(keys))]
    mean = sum(score) / len(score)
    least = min(math.sqrt(sum((x - mean) ** 2 for x in score) / len(score)), max(score) / 2)
    return mark, score, [x >= least and x > 0 for x in score]


def test_html_scores_and_choice_by_brute_force():
    rng, chosen_some = random.Random(17), 0

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "section", "p", "ul", "form", "nav", "article", "h1"])
            name = rng.choice(["", "", " class=ad", " class=related", " id=comments", " class='main text'"])
            inner = rng.choice(["some words, and marks. " * rng.randint(1, 9), "<a href=/>link</a> ", "x", "a<input>b "]) if depth == 0 or tag in ("p", "h1") or rng.random() < 0.3 else tree(depth - 1)
            out.append(f"<{tag}{name}>{inner}</{tag}>")
        return "".join(out)

    for _ in range(60):
        page = html_text.read_page(tree(3))
        mark, score, chosen = html_by_brute_force(page)
        of, scores = html_text.path_scores(page, [html_text.PRIOR[m] for m in html_text.marks(page)])
        assert html_text.marks(page) == mark and np.allclose(scores[of], score, rtol=1e-12)
        if min(abs(x - y) for x in score for y in (max(score) / 2, np.std(score))) > 1e-9:  # none stands right at the threshold
            assert html_text.content_paths(scores, of)[of].tolist() == chosen
            chosen_some += 0 < sum(chosen) < len(chosen)
        kept = html_text.selected(page, mark, chosen)
        # The result holds the content of its container, and nothing that is marked and isn't content.
        assert all(c or mark[e] in (html_text.PLAIN, html_text.DOUBTFUL) for (e, _, _), k, c in zip(page.blocks, kept, chosen, strict=True) if k)
    assert chosen_some > 15


def test_html_path_sums_by_brute_force():
    rng = random.Random(31)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag, name = rng.choice(["div", "section", "p", "ul"]), rng.choice(["", " class='b a'", " class=a id=x1"])
            inner = rng.choice(["words, and marks. ", "<a href=/>link</a> ", "x"]) if depth == 0 or tag == "p" or rng.random() < 0.3 else tree(depth - 1)
            out.append(f"<{tag}{name}>{inner}</{tag}>")
        return "".join(out)

    for _ in range(30):
        page = html_text.read_page(tree(4))
        prior = [float(rng.random() < 0.7) for _ in page.tag]
        whole = {}
        label = {v: k for k, v in enumerate(page.path)}  # an element of each path

        def path(e):
            return (*path(page.parent[e]), page.path[e]) if e else ()

        for e, text, links in page.blocks:
            s = whole.setdefault((path(e), prior[e]), [0, 0, 0])
            s[0] += len(text) - links
            s[1] += sum(text.count(x) for x in ".,;:!?")
            s[2] += 1
        got = {(path(label[k]), w): list(v) for (k, w), v in html_text.path_sums(page, prior).items()}
        assert got == whole and page.blocks
    page = html_text.read_page("<div class='b a'><p>x</p></div><div class='a b'><p>y</p></div><div class=c><p>z</p></div><div class=n12><p>u</p></div><div class=n7><p>v</p></div>")
    of = [page.path[e] for e, _, _ in page.blocks]
    assert of[0] == of[1] != of[2] and of[3] == of[4] != of[0]


@pytest.mark.parametrize(
    "page", ["<div>" * 100_000 + "x", "<div class=comment>" * 20_000 + "x", "<![CDATA[" * 30_000, "<![CDATA[>" * 30_000, "<x><y>" * 50_000 + "x", "<svg>" * 30_000, "<!--" * 50_000, "<a " * 50_000, "<p \"'>" * 30_000, "<ul><li>" * 20_000 + "x", "</div>" * 100_000]
)
def test_html_is_linear_in_the_page(page):
    import time
    import tracemalloc

    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 8
    tracemalloc.start()
    html_text.read_page(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_html_broken_markup():
    assert html_text.extract("<p>text &amp; more <!-- never closed") == "text & more"
    assert html_text.extract("<p>a<![CDATA[ <b> ]]>c</p>") == "a <b> c"
    assert html_text.extract("<table><tr><td>one, two.<td>three, four.<tr><td>five, six.</table>") == "one, two.\nthree, four.\nfive, six."
    assert html_text.extract("<div><p>one, two.<div>three, four.</div></p>five, six.</div>") == "one, two.\nthree, four.\nfive, six."


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>A b.</p></article>"), (1, "u", "<article><p>A b.</p></article>"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.html_text(pages).collect())
    assert got == [(0, "", 0), (1, "A b.", 4), (1, "A b.", 4)]


# 4. Lines


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(7)
    pool = ["A line that many documents hold", " a LINE that many documents hold\t", "short", "Another long line of the pool here", "ÉTÉ a line with accents in it", ""]
    texts = ["\n".join(rng.choice([*pool, f"own line number {i} of {rng.random()}"]) for _ in range(rng.randint(0, 9))) for i in range(60)] + [None, "x\n" * 3000 + pool[0]]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(d).collect()}
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in enumerate(texts):
        for k in {key(s) for s in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 20 or len(held[key(s)]) < 3 or max(held[key(s)]) == i]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    twice = line_dedup.line_dedup(docs(spark, [pool[0]] * 5, ids=[1, 1, 2, 2, None]))
    assert [r["n_dropped"] for r in twice.collect()] == [0] * 5
    assert line_dedup.line_dedup(d.limit(0)).count() == 0


# 5. Jaccard join


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and low[i] != low[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [len(s) for s in sets], low


def test_tiles_find_every_pair_or_the_nearest():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 36, replace=False), rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)))) for _ in range(30)]
    sets.sort(key=len)
    rows = pa.table({"tile": [1] * 20 + [2] * 10, "id": list(range(30)), "component": [i % 7 for i in range(30)], "n": [len(x) for x in sets], "narrow": pa.array([ngram_join._bitmap(x, 1024) for x in sets], pa.binary())})
    can = lambda i, j: ngram_join._can_link(len(sets[i]), len(sets[j]), ngram_join._apart(*(ngram_join._bitmap(sets[k], 1024) for k in (i, j))), 80)
    want = {(i, j) for j in range(30) for i in range(j) if (i < 20) == (j < 20) and i % 7 != j % 7 and 80 * len(sets[j]) <= 100 * len(sets[i]) and can(i, j)}
    pairs = lambda nearest: {(a, b) for a, b in zip(*(ngram_join._meet(rows, 80, nearest).column(c).to_pylist() for c in "ab"))}
    assert pairs(False) == want and len(want) > 60
    near = pairs(True)
    assert near <= want and {i for p in near for i in p} == {i for p in want for i in p} and len(near) <= 30
    truly = {(i, j) for i, j in want if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert truly


def test_tiles_say_what_they_leave_out():
    import pyarrow as pa

    # Tile 1 has one pair, tile 2 all pairs of 12 rows, of sets that are wide.
    sets = [np.arange(30, dtype=np.uint64), np.arange(1, 31, dtype=np.uint64)] + [np.arange(600 + i, dtype=np.uint64) for i in range(12)]
    rows = pa.table({"tile": [1] * 2 + [2] * 12, "id": list(range(14)), "component": list(range(14)), "n": [len(x) for x in sets], "narrow": pa.array([ngram_join._bitmap(x, 1024) for x in sets], pa.binary())})
    got = {few: ngram_join._meet(rows, 80, True, few).to_pylist() for few in (0, 5, 6)}
    assert [(r["a"], r["b"], r["wide"], r["near"]) for r in got[5] if r["a"] < 2] == [(0, 1, False, True)]
    assert all(r["wide"] for few in got for r in got[few] if r["a"] >= 2)
    # 66 pairs of 12 rows are over 5 a row, and not over 6.
    assert len(got[6]) == 67 and not any(r["more"] for r in got[6]) and {r["a"] for r in got[5] if r["more"]} == {r["a"] for r in got[5] if r["a"] >= 2}
    assert [(r["a"], r["b"]) for r in got[6] if r["near"]] == [(r["a"], r["b"]) for r in got[5]] == [(r["a"], r["b"]) for r in got[0]] and len(got[0]) <= 13


def test_a_pair_meets_in_one_tile_of_its_least_shingles():
    """Copies that share a prefix made a pair in the tile of each of its shingles: 589,609 rows on the check tool's table with large groups."""
    import pyarrow as pa

    sets = [np.concatenate((np.arange(30), [1000 + i])).astype(np.uint64) for i in range(8)]
    least = [x[:7].astype(np.int64) for x in sets]
    least[7] = least[7][3:]
    tiles = [(y, i) for y in range(7) for i in range(8) if y in least[i]]
    rows = pa.table({"tile": [y for y, _ in tiles], "shingle": [y for y, _ in tiles], "id": [i for _, i in tiles], "component": [i for _, i in tiles], "n": [31] * len(tiles),
                     "narrow": pa.array([ngram_join._bitmap(sets[i], 1024) for _, i in tiles], pa.binary()), "least": pa.array([least[i].tobytes() for _, i in tiles], pa.binary())})
    found = [(r["a"], r["b"]) for r in ngram_join._meet(rows, 80, False).to_pylist()]
    assert sorted(found) == [(i, j) for i in range(8) for j in range(i + 1, 8)]


@pytest.mark.parametrize("few, sets, rounds", [(64, 0.01, 1), (64, 1000, 2), (0, 0.01, 2)])
def test_few_pairs_of_tiles_are_settled_in_one_round(spark, monkeypatch, few, sets, rounds):
    """On the check tool's table with large groups a second round took a third of all shuffles, to test pairs that the first could have."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "SETS", sets)
    made, tiles = [], ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda *a: made.append(1) or tiles(*a))
    # Windows of two chains of words, those of the second wide: each links with its neighbours alone, and a hub meets many that don't link with it.
    chains = [[f"{c}{i}" for i in range(n)] for c, n in (("a", 200), ("b", 1200))]
    texts = [" ".join(chains[0][i : i + 60]) for i in range(0, 135, 4)] + [" ".join(chains[1][i : i + 700]) for i in range(0, 480, 40)]
    ids = random.Random(5).sample(range(1000), len(texts))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs(spark, texts, ids=ids)).collect()}
    _, low = brute_components(texts, ids)
    assert got == dict(zip(ids, low, strict=True)) and len(set(low)) == 2
    assert len(made) == rounds


def test_id_bits_and_sums_of_sketches(spark):
    ids = [-5, 0, 7, 1 << 62, *range(1000, 1400)]
    at = ngram_join._id_bits(spark.createDataFrame([(i,) for i in ids], "id long"))
    spots = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(ngram_join._spot("id")).collect()]
    assert all(at[x >> 3] >> (x & 7) & 1 for x in spots) and np.unpackbits(at).sum() == len(set(spots)) and len(at) == 1 << 22
    texts = ["a b c d e f g"] * 300 + ["x", None, "", "a b c d e"]
    counts = ngram_join.shingle_sketch(docs(spark, texts).repartition(7), 5)
    assert sorted(counts[counts > 0].tolist()) == [1, 300, 300, 301]


@pytest.mark.parametrize("hot", [4096, 3])
def test_ngram_join_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "LINKS", hot)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 120))]
        for k in range(5):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own) + (f" {shared}" if k % 2 else ""))
    # A chain: each links with the next, the ends don't.
    chain = [f"c{i}" for i in range(80)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 20, 4)]
    texts += ["", None, " \t", "one two", "One  TWO", "one two three", "x " * 2000]
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs(spark, texts, ids=ids)).collect()}
    sizes, low = brute_components(texts, ids)
    assert len(set(low)) < len(texts)
    for k, i in enumerate(ids):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (sizes[k], low[k]), texts[k]


@pytest.mark.parametrize("top", [9, (1 << 63) - 1])
def test_one_of_each_keeps_rows_without_ids(spark, top):
    copy, pair, alone = "a b c d e f", "one two three four five six seven", "nothing else is like this one"
    ids = [5, None, 5, top, None, None, None, None, None, None]
    texts = [copy, copy, copy, copy, pair, pair, alone, None, None, "a b x"]
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in ngram_join.one_of_each(docs(spark, texts, ids=ids)).collect()), key=str)
    if top == 9:
        assert got == sorted([(5, copy), (5, copy), (-1, pair), (-1, alone), (-1, ""), (-1, ""), (-1, "a b x")], key=str)
    else:
        assert {t for _, t in got} == {copy, pair, alone, "", "a b x"} and [t for _, t in got].count(pair) == 1
    none = ngram_join.one_of_each(docs(spark, [pair, pair, alone], ids=[None] * 3)).collect()
    assert sorted(r["text"] for r in none) == sorted([pair, alone])


def test_mixed_rows_keep_rows_without_ids(spark):
    texts = [f"{'word ' * (i % 7 + 1)}" for i in range(200)] + [None]
    d = docs(spark, texts, sources=["a" if i % 3 else None for i in range(len(texts))], ids=[None if i % 2 else i for i in range(len(texts))])
    taken = mixing.mix(d).collect()
    got = mixing.mixed_rows(d)
    assert got.columns == d.columns
    rows = got.collect()
    for null in (False, True):
        assert sum(len(words(r["text"])) for r in rows if (r["doc_id"] is None) == null) == sum(r["taken"] for r in taken if (r["doc_id"] is None) == null) > 0


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(docs(spark, ["x"]).limit(0)).count() == 0
    assert [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(spark, ["a b c d e f"] * 3, ids=[5, 5, 9])).collect()] == [(2, 5)] * 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# 6. Mixing


def test_mixing(spark):
    texts = [f"{'word ' * (i % 7 + 1)}" for i in range(300)] + [None, "", " \n ", " lead", "a b c"]
    sources = ["a" if i % 3 == 0 else "b" if i % 50 else None for i in range(len(texts))]
    d = docs(spark, texts, sources=sources)
    one, two = (sorted(tuple(r) for r in mixing.mix(d).collect()) for _ in range(2))
    assert one == two and len(one) == len(texts)
    by = {}
    for (i, size, total, target, taken) in one:
        assert size == len(words(texts[i])) and 0 <= taken <= 2 * size and (size == 0 or taken % size == 0)
        by.setdefault(sources[i], []).append((size, total, target, taken))
    goal = 1.5 * sum(r[0] for rows in by.values() for r in rows)
    assert sum(rows[0][2] for rows in by.values()) == pytest.approx(goal)
    for rows in by.values():
        assert abs(sum(r[3] for r in rows) - rows[0][2]) <= max(r[0] for r in rows) and rows[0][2] <= 2 * rows[0][1] + 1e-9
    assert mixing.mix(d.limit(0)).count() == 0 and {r[1] for r in map(tuple, mixing.mix(docs(spark, [None, ""])).collect())} == {0}
    assert sum(len(words(r["text"])) for r in mixing.mixed_rows(d).collect()) == sum(r[4] for r in one)


def test_quality_weighs_the_draw():
    # The share of draws in which the heavier of two keys comes first follows their weights.
    rng = np.random.default_rng(0)
    u, v = rng.uniform(size=100000), rng.uniform(size=100000)
    assert np.mean(-np.log(u) / 1.0 < -np.log(v) / 0.5) == pytest.approx(2 / 3, abs=0.01)


# 7. Language


def test_language_id(spark):
    rng = random.Random(3)
    forms = {"en": "the of and with house river morning".split(), "de": "der die und mit haus fluss für über".split(), "fr": "le la les été très maison où garçon".split()}
    texts, langs = [], []
    for i in range(360):
        lang = sorted(forms)[i % 3]
        texts.append(" ".join(rng.choice(forms[lang]) for _ in range(12)))
        langs.append(lang if i % 40 else None)
    texts += [None, "", "12 34 !", "ЖЖЖ ЩЩЩ ЫЫЫ ЖЫЩ", "the house" * 3000]
    langs += [None] * 5
    got = {r["doc_id"]: r for r in char_lm.language_id(docs(spark, texts, langs)).collect()}
    assert all(got[i]["held_out"] == (fold(i) == 0) for i in got)
    held = [i for i in range(360) if fold(i) == 0]
    assert np.mean([got[i]["lang_pred"] == sorted(forms)[i % 3] for i in held]) > 0.99
    assert [got[360 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[360]["score"] == 0.0
    assert got[363]["rejected"] and got[363]["lang_pred"] != "und" and got[364]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in char_lm.language_id(docs(spark, ["abc"], [None])).collect()} == {"und"}


def test_models_are_distributions(spark):
    d = docs(spark, ["abcab cab", "bca abc", "zz top"], ["x", "x", "y"]).select("lang", "text")
    m = char_lm.train(d)
    letters = [32, *map(ord, "abczto p".replace(" ", "")), ord("q")]  # all that the texts have, and one for what they lack
    for history in ("ab", "zz", "c", "qq", "abc"):
        at = char_lm.grams(*char_lm.letter_codes([history]))[0][-2]
        keys = np.array([(int(at) << 16 | c) & (1 << 64) - 1 for c in letters], dtype=np.uint64)
        assert np.exp2(-m.look_up(keys).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-5)


def test_kneser_ney_by_brute_force(spark):
    rng = random.Random(17)
    texts = {"x": ["".join(rng.choice("aab cd") for _ in range(60)) for _ in range(4)], "y": ["".join(rng.choice("bcde ") for _ in range(50)) for _ in range(3)]}
    m = char_lm.train(spark.createDataFrame([(k, t) for k, own in texts.items() for t in own], "lang string, text string"))

    def strings(text):
        one = " " + "".join(w + " " for w in text.split())
        return ["   "[: max(0, 3 - i)] + one[max(0, i - 3) : i + 1] for i in range(1, len(one))]

    counts = {}  # by language and order: a gram's count; below the highest, the kinds of letters before it
    for k, own in texts.items():
        top = {}
        for t in own:
            for g in strings(t):
                top[g] = top.get(g, 0) + 1
        counts[k, 4] = top
        for n in (3, 2, 1):
            low = {}
            for g in counts[k, n + 1]:
                low[g[1:]] = low.get(g[1:], 0) + 1
            counts[k, n] = low
    floor = 1 / (len({g for k in texts for g in counts[k, 1]}) + 1)

    def p(k, g):
        if not g:
            return floor
        own = counts[k, len(g)]
        beside = [c for x, c in own.items() if x[:-1] == g[:-1]]
        if not beside:
            return p(k, g[1:])
        return max(own.get(g, 0) - 0.75, 0) / sum(beside) + 0.75 * len(beside) / sum(beside) * p(k, g[1:])

    asked = sorted({g for t in (*texts["x"], *texts["y"], "fab deaf") for g in strings(t)})
    keys = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in asked], dtype=np.uint64)
    got = np.exp2(-m.look_up(keys).astype(float))
    assert got == pytest.approx(np.array([[p(k, g) for k in m.langs] for g in asked]), rel=1e-5)


def held_out(spark, query, sf="/root/testdata/sf0.01"):
    from pathlib import Path

    if not Path(sf).exists():
        pytest.skip("needs the driver's tables")
    return [r for r in query(spark, sf).collect() if r["held_out"]], {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_held_out_languages(spark):
    rows, by_id, _ = held_out(spark, char_lm.query)
    known = [r["lang_pred"] == by_id[r["doc_id"]]["lang"] for r in rows if by_id[r["doc_id"]]["lang"] is not None and r["lang_pred"] != "und"]
    assert len(known) > 100 and np.mean(known) > 0.98


def test_held_out_toxicity(spark):
    rows, _, labels = held_out(spark, toxicity.query, "/root/testdata/sf0.1")
    both = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["toxic"] is not None]
    toxic = [p for p, y in both if y]
    assert len(toxic) >= 50 and np.mean(toxic) > 0.9 and np.mean([p for p, y in both if not y]) < 0.03


def test_a_model_does_not_depend_on_other_labels(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters + " ") for _ in range(3000)) for _ in range(2)] + [letters]
    rows = [("x", texts[0]), ("y", texts[1]), ("z", texts[2])]
    few = char_lm.train(spark.createDataFrame(rows, "lang string, text string"))
    many = char_lm.train(spark.createDataFrame(rows + [(f"zz{i}", "abc") for i in range(300)], "lang string, text string"))
    keys = char_lm.grams(*char_lm.letter_codes([texts[0][:500], texts[1][:500], "qzx never"]))[0]
    assert np.allclose(few.look_up(keys)[:, :2], many.look_up(keys)[:, :2], atol=1e-5)
    # A gram that was seen once is cheaper than by its suffix alone.
    once = few.look_up(keys[:500])[:, :2]
    assert np.mean(once[:, 0] < once[:, 1]) > 0.9


def test_grams_that_tasks_do_not_hold_are_joined(spark, monkeypatch):
    rng = random.Random(22)
    texts = [" ".join(rng.choice("river house morning fluss haus \u00fcber".split()) for _ in range(9)) for _ in range(60)] + ["new words, zyx", None, ""]
    d = docs(spark, texts, ["en" if i % 2 else "de" for i in range(len(texts))])
    whole = {r["doc_id"]: r for r in char_lm.identify(d, char_lm.train(d)).collect()}
    for cells in (0, 100):
        monkeypatch.setattr(char_lm, "CELLS", cells)
        model = char_lm.train(d)
        assert len(model.hot.grams) <= max(1, cells // 2)
        got = {r["doc_id"]: r for r in char_lm.identify(d, model).collect()}
        assert set(got) == set(whole)
        for i, r in got.items():
            assert (r["lang_pred"], r["rejected"]) == (whole[i]["lang_pred"], whole[i]["rejected"]) and r["bits"] == pytest.approx(whole[i]["bits"], rel=1e-5)


# 9. Toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(9)
    lexicon = ["stupid", "moron", "morons", "idiot", "scum"]
    a = toxicity.Automaton(lexicon, frozenset({"idiot"}))
    made = []
    for _ in range(4000):
        s = rng.choice(lexicon)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("abmso") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("stuz") + s[i + 1 :]])
        made.append(s if len(s) > 1 else "ab")
    at, word, edits = a.run(toxicity.words_of([" ".join(made)]))
    got = {i: e for i, e in zip(at.tolist(), edits.tolist())}
    for i, s in enumerate(made):
        fits = [d for w in lexicon if (d := edit_distance(s, w)) <= (1 if len(w) >= 5 and w != "idiot" else 0)]
        assert got.get(i) == (min(fits) if fits else None), s
    assert len(word) == len(at)


def test_toxicity_learns_and_catches(spark):
    rng = random.Random(13)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}lo" for i in range(400)]
    texts, toxic = [], []
    for i in range(600):
        own = [rng.choice(plain) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            for w in rng.sample(["scoundrel", "nincompoop", "blockhead"], 2):
                own.insert(rng.randrange(len(own)), w)
        texts.append(" ".join(own))
        toxic.append(int(bad))
    texts += ["you scoundrel and n1ncompoop", "such a scoundrell, and a blokhead!", None, "", "plain words alone", "w " * 50000]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, texts), labels).collect()}
    assert all(got[i]["predicted"] == t for i, t in enumerate(toxic))
    assert [got[600 + k]["predicted"] for k in range(6)] == [1, 1, 0, 0, 0, 0] and got[601]["misspelled"] == 2
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"]) == 0) for r in got.values())
    quoted = toxicity._features(toxicity.Automaton(["scoundrel"]), ['They said "you scoundrel" to us.', "You scoundrel!"])
    assert quoted.tolist() == [[0, 0, 1, 0], [1, 0, 0, 0]]
    assert toxicity.toxicity(docs(spark, texts[:3]), labels.limit(0)).count() == 3


def test_the_lexicon_follows_the_labels(spark):
    # Long texts of one vocabulary share their extreme words, but aren't copies; exact copies count once.
    rng = random.Random(14)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}lo" for i in range(60)]
    bad = ["zq", "q" * 30, *(f"bad{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400))]
    rows = [(" ".join(rng.sample(plain + (bad if i % 4 == 0 else []), 60 + (len(bad) if i % 4 == 0 else 0))), int(i % 4 == 0)) for i in range(160)]
    rows += [("One copied rarity", 1), ("one  copied\nrarity ", 1)] * 10
    assert set(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))) == set(bad)
    # A rare term counts by its texts, whatever their share of all toxic ones.
    many = [(f"{'scoundrel' if i < 6 else 'dolt'} {i % 7 * 'a'} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}mm", 1) for i in range(1300)]
    many += [(f"fine {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}nn", 0) for i in range(6000)]
    assert {"scoundrel", "dolt"} <= set(toxicity.learn_lexicon(spark.createDataFrame(many, "text string, toxic int")))


# 10. Top-k


def brute_tops(rows, k=20):
    """Lists of (id, score), by place, of each query row: every other row of its length counts."""
    good = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(object)) for i, v in rows if i is not None and v and all(y is not None and np.isfinite(y) for y in v)]
    out = {}
    for at, (i, q) in enumerate(good):
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for other, (j, v) in enumerate(good) if other != at and len(v) == len(q))[:k]
            out.setdefault(i, []).append([(n, j, -s) for n, (s, j) in enumerate(best, 1)])
    return {i: sorted(x for one in lists for x in one) for i, lists in out.items()}


@pytest.mark.parametrize(("block", "spread"), [(16384, 1), (16, 1), (64, 0.05)])
def test_topk_by_brute_force(spark, monkeypatch, block, spread):
    for name, value in (("BLOCK", block), ("RUN", 4), ("BATCH", 3), ("FIRST", 2)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((230, 8)) if spread == 1 else rng.standard_normal((6, 8))[np.arange(230) % 6] * 3 + spread * rng.standard_normal((230, 8))).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (320, [None] * 8), (340, [float("nan")] * 8), (3, [float(v) for v in x[3]]), (20, [float(v) for v in x[7]]), (360, [0.0] * 8), (None, [1.0] * 8), (380, [])]
    # Vectors of another length, under the smallest id, among them: they meet each other alone.
    rows += [(-i * 10, [float(i), 1.0, 2.0]) for i in range(5)]
    got = {}
    for r in topk_search.topk_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20, pivots=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {i: sorted(x) for i, x in got.items()} == brute_tops(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk_search.topk_search(few).count() == 2 and topk_search.topk_search(few.limit(0)).count() == 0


def test_topk_leaves_out_what_cannot_reach_the_top(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topk_search, "FIRST", 2)
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, (40, 16))
    x = (centres[np.arange(8000) % 40] + rng.integers(-5, 6, (8000, 16))).astype(np.int64)
    side = pa.table({"id": np.arange(8000), "row": np.arange(8000), "v": pa.array(x.tolist()), "least": np.full(8000, -np.inf)})
    seen = []
    plain = topk_search._tops
    monkeypatch.setattr(topk_search, "_tops", lambda scores, ids, k: (seen.append(scores.size), plain(scores, ids, k))[1])
    near = list(range(0, 1600, 40))  # one cluster's
    out = topk_search.block_tops(side.take(near), side, 5, centres.astype(np.float64))
    assert sum(seen) < 0.2 * 40 * 8000
    for q in near:
        s = x @ x[q]
        s[q] = -(1 << 62)
        want = sorted(zip((-s).tolist(), range(8000)))[:5]
        assert [(-s, i) for s, i in want] == [(s, i) for r, s, i in zip(*(out.column(c).to_pylist() for c in ("q_row", "score", "vec_id"))) if r == q]
    huge = pa.table({"id": [1, 2, 3], "row": [1, 2, 3], "v": pa.array([[1 << 30, 5], [1 << 30, 6], [3, 1 << 30]]), "least": [-np.inf] * 3})
    got = topk_search.block_tops(huge, huge, 2, np.zeros((1, 2)))
    assert got.slice(0, 2).to_pylist() == [{"q_row": 1, "query_id": 1, "vec_id": 2, "score": (1 << 60) + 30}, {"q_row": 1, "query_id": 1, "vec_id": 3, "score": (1 << 30) * 8}]


# Columns of any name


ODD = ["id", "own_id", "gone", "lines", "kept", "row", "at", "often", "i", "number", "part", "start", "a.b", "with `tick`", "N_Lines", "Size", "rep", "component_id", "hub"]


def test_columns_of_any_name_pass_through(spark):
    from editfray.llm.common import named

    line = "a line of twenty signs or more"
    texts = [f"{line}\nown {i} words that stand in this text alone {i} {i * 7}" for i in range(4)] + [None, f"{line}\nown 0 words that stand in this text alone 0 0"]
    rows = spark.createDataFrame([(i if i != 2 else None, t, "s", *([f"x{i}"] * len(ODD))) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD))
    for out, n in ((line_dedup.line_dedup(rows, counts=("lines_before", "lines_gone")), 6), (ngram_join.one_of_each(rows), 5), (mixing.mixed_rows(rows), None)):
        got = out.select(*named(rows)).collect()
        assert out.columns[: len(rows.columns)] == rows.columns and len(got) == n if n else got
        for r in got:
            assert {r[c] for c in ODD} == {r["id"]}
    dots = rows.withColumnRenamed("doc_id", "doc.id").withColumnRenamed("text", "the.text")
    assert line_dedup.line_dedup(dots, id_col="doc.id", text_col="the.text").count() == 6
    assert bpe.encode(dots, id_col="doc.id", text_col="the.text").count() == 6
    assert ngram_join.ngram_join(dots, id_col="doc.id", text_col="the.text").count() == 6
    edits = spark.createDataFrame([(0, 1, 0, 0, "x")], "doc_id long, seq int, pos long, drop long, ins string")
    with pytest.raises(ValueError):
        token_counts.with_edits(rows.withColumn("edits", F.lit(1)), edits)
    assert token_counts.edited_counts(token_counts.with_edits(rows.withColumn("edits", F.lit(1)), edits, to="changes"), edits_col="changes").where("n_edits = 1").count() == 1


def test_a_cluster_needs_a_shared_folder(spark):
    from editfray.llm import common

    class Context:
        master = "spark://somewhere"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_bpe_cuts_are_final():
    rng = random.Random(8)
    c = bpe.codec(bpe.default_vocabulary())
    signs = "aZé漢字かな한я09٣ \t\n\xa0　.,'’-!。、😀\x1csll"
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(2, 40)))
        for m in bpe.CUT.finditer(t):
            assert c._bpe.encode_ordinary(t) == c._bpe.encode_ordinary(t[: m.end()]) + c._bpe.encode_ordinary(t[m.end() :]), (t, m.end())


def test_toxic_terms_count_without_a_cap():
    a = toxicity.Automaton(["scoundrel"])
    assert toxicity._features(a, ["scoundrel " * 5000])[0].tolist() == [5000, 0, 0, 0]
    assert toxicity._evidence([0, 1, 3, 4095]).tolist() == [0, 1, 2, 12]
