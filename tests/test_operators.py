"""Graph, windows, governance and lookups on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from editfray.operators import evidence, governance, graph, lookups, pages, windows

START = datetime(2020, 1, 1)


def edges(spark, pairs):
    rows = [("w", 1, START + timedelta(seconds=i), a, b) for i, (a, b) in enumerate(x for x, n in pairs for _ in range(n))]
    return spark.createDataFrame(rows, "wiki string, page_id long, ts timestamp, src string, dst string")


def edits(spark, n, users):
    rows = [("w", 1, "T", i, START + timedelta(seconds=i), f"E{i % users}", False, False) for i in range(n)]
    return spark.createDataFrame(rows, "wiki string, page_id long, page_title string, rev_id long, ts timestamp, user_text string, is_reverted boolean, is_revert boolean")


def test_pair_metrics(spark):
    e = edges(spark, [(("A", "B"), 2), (("B", "A"), 1), (("C", "D"), 1), (("A", "A"), 3), (("", "B"), 2)])
    got = graph.pair_metrics(graph.edge_counts(e, ["page_id"]), ["page_id"]).first()
    assert (got["pairs"], got["mutual"], got["reverts"], got["ends"]) == (1, 1, 3, 2)
    assert got["best"] == got["total"] == pytest.approx(42 + 4)


def test_effective_edges(spark):
    got = graph.effective_edges(graph.edge_counts(edges(spark, [(("A", "B"), 4), (("B", "A"), 3)]), ["page_id"])).collect()
    assert [(r["src"], r["n"]) for r in got] == [("A", 4)]


def test_mutual_reverts_make_an_episode(spark):
    both = edges(spark, [(("E0", "E1"), 4), (("E1", "E0"), 4)])
    row = pages.score_pages(edits(spark, 8, 2), both).first()
    assert (row["revert_count"], row["mutual_revert_pairs"], row["war_minutes"]) == (8, 1, 60)
    assert row["peak_score"] >= 40
    one_way = pages.score_pages(edits(spark, 8, 2), edges(spark, [(("E0", "E1"), 8)])).first()
    assert (one_way["revert_count"], one_way["mutual_revert_pairs"], one_way["peak_score"], one_way["war_minutes"]) == (0, 0, 0.0, 0)


def test_dominant_reverted_user(spark):
    rows = [("w", 1, i, START + timedelta(seconds=i), u, f) for i, (u, f) in enumerate([("Bob", 9), ("Alice", 9), ("Alice", 9), ("Carl", None)])] + [("w", 1, 9, START + timedelta(seconds=9), "Zed", None), ("w", 2, 8, START, "Else", 9)]
    h = spark.createDataFrame(rows, "wiki string, page_id long, rev_id long, ts timestamp, user_text string, first_reverting long")
    assert [(r["src"], r["dst"]) for r in graph.identity_edges(h).collect()] == [("Zed", "Alice")]


def test_hysteresis(spark):
    scores = [(0, 70.0, 1), (1, 50.0, 1), (2, 65.0, 1), (3, 30.0, 1), (4, 61.0, 1), (40, 45.0, 1), (41, 61.0, 0), (42, 62.0, 2)]
    rows = spark.createDataFrame([("w", 1, START + timedelta(hours=h), s, c) for h, s, c in scores], "wiki string, page_id long, bucket timestamp, score double, current long")
    got = windows.episodes(rows).first()
    assert (got["episode_count"], got["war_minutes"], got["peak_score"]) == (3, 240, 70.0)


def test_protected_days(spark):
    rows = [("P", START + timedelta(days=d), a) for d, a in ((0, "protect"), (1, "modify"), (4, "unprotect"), (5, "other"), (6, "unprotect"), (10, "move_prot"))]
    e = spark.createDataFrame(rows, "page_title string, ts timestamp, action string")
    got = governance.protected_time(e, ["page_title"], F.lit(START + timedelta(days=16))).first()
    assert (got["protection_events"], got["protection_days"]) == (5, 10.0)
    assert (got["first_protection_at"], got["last_protection_at"]) == (START, START + timedelta(days=10))


def test_restrictions(spark):
    rows = [(42, "edit", "extendedconfirmed", 0, "infinity"), (42, "move", "sysop", 1, "20270101000000"), (43, "edit", "autoconfirmed", 0, "20261201000000")]
    got = governance.restrictions(spark.createDataFrame(rows, "page_id long, type string, level string, cascade int, expiry string"), ["page_id"]).orderBy("page_id").collect()
    assert got[0].asDict() == {"page_id": 42, "restriction_count": 2, "restriction_types": "edit, move", "restriction_levels": "extendedconfirmed, sysop", "has_extendedconfirmed": True, "has_sysop": True, "has_cascade": True, "restriction_expiry": "infinity"}
    assert got[1]["restriction_expiry"] == "20261201000000" and not got[1]["has_sysop"]


def test_shards(spark):
    shards = spark.createDataFrame([("a", 1, 100), ("b", 101, 200), ("c", 150, 300)], "filename string, start_id long, end_id long")
    got = lookups.shards_of(spark.createDataFrame([(15,), (20,), (175,), (999,), (0,)], "page_id long"), shards).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(15, "a"), (20, "a"), (175, "b")]


def test_preferred_formats(spark):
    f = spark.createDataFrame([("x", "7z", "x.7z"), ("x", "bz2", "x.bz2"), ("y", "zip", "y.zip"), ("z", "zip", "z.zip"), ("z", "rar", "z.rar")], "base string, suffix string, name string")
    assert sorted(r["name"] for r in lookups.preferred_formats(f, ["bz2", "7z"]).collect()) == ["x.bz2", "y.zip", "z.rar", "z.zip"]


def test_insert_or_ignore(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "k long, v string")
    got = lookups.new_rows(new, spark.createDataFrame([(1,)], "k long"), ["k"], "v").collect()
    assert sorted(r["v"] for r in got) == ["b", "d", "e"]


def test_talk_pages_follow_renames(spark):
    a = spark.createDataFrame([("w", "t", START + timedelta(days=d), d, p) for d, p in ((2, 7), (5, 8))], "wiki string, title string, ts timestamp, rev_id long, page_id long")
    t = spark.createDataFrame([("w", x, START + timedelta(days=d), 100 + d) for x, d in (("t", 1), ("t", 3), ("t", 6), ("u", 2))], "wiki string, title string, ts timestamp, rev_id long")
    assert [(r["rev_id"], r["article_id"]) for r in pages.talk_pages(a, t).orderBy("rev_id").collect()] == [(101, 7), (103, 7), (106, 8)]


def test_battle_and_controversy(spark):
    words = {0: "the great leader spoke to people", 1: "the great dictator spoke to people"}
    rows = [(42, i, START + timedelta(hours=i), "Alice" if i % 2 else "Bob", "revert: sources say otherwise here" if i else "start", [], words[i % 2]) for i in range(7)]
    revs = spark.createDataFrame(rows, "page_id long, rev_id long, ts timestamp, user_text string, comment string, tags array<string>, content string")
    order = ("ts", "rev_id")
    found = evidence.battles(evidence.segment_stats(evidence.pair_segments(revs, ["page_id"], order), ["page_id"], order), ["page_id"])
    top = found.first()
    assert (top["change_type"], sorted(top["swap_values"]), top["changes"], top["reverts"], top["editors"]) == ("swap", ["dictator", "leader"], 6, 6, 2)
    assert top["score"] == pytest.approx((6 * 12 + 6 * 2 + 3 + 8) * 1.12)
    talk = spark.createDataFrame([(42, 1, START, "Ann", "reply", "The word leader needs consensus before anyone restores it.")], "page_id long, rev_id long, ts timestamp, user_text string, comment string, content string")
    hits = evidence.talk_evidence(talk, evidence.terms(evidence.usable(found), ["page_id"]), ["page_id"])
    assert hits.first()["matched"] == ["leader"]
    scored = evidence.controversy(spark.createDataFrame([(42, 100.0, 16, 2), (43, 9.0, 0, 0)], "page_id long, peak_score double, revert_count long, mutual_revert_pairs long"), evidence.usable(found), evidence.talk_scores(hits, ["page_id"]), ["page_id"])
    rows = {r["page_id"]: r for r in scored.collect()}
    assert rows[42]["score"] > rows[42]["battle_score"] > 0 and rows[42]["talk_score"] == 49.0
    assert rows[43]["score"] == 0.0


def test_types_as_frequent_and_as_early_go_by_name(spark):
    # Rows that stand twice at one place of a revision: nothing but the name tells their types apart.
    rows = [(p, START, 1, 0, f"U{i % 2}", t) for p in range(40) for i, t in enumerate(("swap", "change", "change", "swap") if p % 2 else ("change", "swap", "swap", "change"))]
    found = spark.createDataFrame(rows, "page_id long, ts timestamp, rev_id long, pos int, user_text string, change_type string").withColumns(
        {c: F.lit("x") for c in ("key", "segment", "changed_text")} | {c: F.lit("") for c in ("comment", "prev_comment", "prev_user", "highlight_before", "highlight_after", "context_before", "context_after")}
        | {"is_revert": F.lit(False), "swap_values": F.array().cast("array<string>"), "changed_word_count": F.lit(1)}
    )
    got = evidence.segment_stats(found, ["page_id"], ("ts", "rev_id")).select("page_id", "change_type").collect()
    assert len(got) == 40 and {r["change_type"] for r in got} == {"change"}


def test_empty_tables(spark):
    e, g = edits(spark, 2, 2).limit(0), edges(spark, [(("A", "B"), 1)]).limit(0)
    assert pages.score_pages(e, g).count() == 0 and windows.day_scores(e, g).count() == 0
