"""Patterns, names and stems found by automaton, against plain containment; nearest rows and permutation importance against brute force."""

from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadencia.functions import automaton
from cadencia.operators import conversation, features, models, retrieval

TEXT = st.text(alphabet="ab -é", max_size=10)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT.filter(bool), min_size=1, max_size=8, unique=True), TEXT)
def test_automaton_equals_containment(patterns, text):
    machine = automaton._automaton(tuple(patterns))
    assert {i for _, i in machine.iter(text)} == {i for i, p in enumerate(patterns) if p in text}


def test_contained_column(spark):
    df = spark.createDataFrame([(1, "co-amoxiclav 625 and more"), (2, None), (3, ""), (4, "x" * 1_000_000 + "0.9% saline")], "k int, t string")
    got = {r["k"]: r["f"] for r in df.select("k", automaton.contained(F.col("t"), ["", "amox", "0.9% saline", "co-amoxiclav 625", "amox"]).alias("f")).collect()}
    assert got == {1: ["amox", "co-amoxiclav 625"], 2: [], 3: [], 4: ["0.9% saline"]}
    assert df.select(automaton.contained(F.col("t"), []).alias("f")).filter(F.size("f") > 0).count() == 0


NAMES = [(1, "Co-amoxiclav 625"), (2, "Vitamin B-12 forte extra strong slow release tablets"), (3, "0.9% saline"), (4, "B 12"), (5, None), (6, " "), (7, "ال دواء"), (8, "panadol extra")]
SAID = [(1, "is CO-AMOXICLAV 625 safe"), (2, "vitamins and vitamin b-12 forte extra strong slow release tablets"), (3, "give 0.9% saline, b 12"), (4, "superpanadols"), (5, None), (6, ""), (7, "هذا ال دواء")]


@pytest.mark.parametrize("size", [None, 2])
def test_mentions_equal_containment(spark, size):
    """In one automaton and in several passes."""
    drugs, texts = spark.createDataFrame(NAMES, "drug_id int, name string"), spark.createDataFrame(SAID, "k int, t string")
    want = set()
    for k, t in SAID:
        for d, n in NAMES:
            n = (n or "").strip().lower()
            first = n.split(" ")[0]
            if t and n and (n in t.lower() or (len(first) >= 3 and first in t.lower())):
                want.add((k, d))
    old = automaton.PATTERNS
    automaton.PATTERNS = size or old
    try:
        assert {tuple(r) for r in conversation.mentions(texts, drugs, ["k"], "t").collect()} == want
    finally:
        automaton.PATTERNS = old
    assert {(1, 1), (2, 2), (3, 3), (3, 4), (4, 8), (7, 7)} <= want
    assert conversation.mentions(texts, drugs.filter("false"), ["k"], "t").count() == 0


def test_a_drug_of_several_names_is_mentioned_once(spark):
    drugs = spark.createDataFrame([(1, "panadol"), (1, "dolo"), (1, "panadol extra"), (2, "b 12")], "drug_id int, name string")
    texts = spark.createDataFrame([(1, "Panadol or dolo"), (1, "dolo, B 12"), (2, "b 12")], "k int, t string")
    assert sorted(map(tuple, conversation.mentions(texts, drugs, ["k"], "t").collect())) == [(1, 1), (1, 2), (2, 2)]


def brute_interactions(found, newest, interactions):
    out = {}
    for k in {k for k, _ in newest}:
        own, new = {d for q, d in found if q == k}, {d for q, d in newest if q == k}
        hits = sorted((a, b, s) for a, b, s in interactions if a < b and a in own and b in own and (a in new or b in new))
        if hits:
            out[k] = hits[0]
    return out


@pytest.mark.parametrize(("first", "block"), [(4_096, 1_000_000), (3, 20), (3, 1_000_000)])
def test_first_interactions_equal_brute_force(spark, monkeypatch, first, block):
    """Found among the first pairs, in several blocks of all, or not at all; by drugs and by the patterns that name them."""
    monkeypatch.setattr(conversation, "FIRST_PAIRS", first)
    monkeypatch.setattr(conversation, "BLOCK_PAIRS", block)
    monkeypatch.setattr(conversation, "PART_KEYS", 7)
    rng = np.random.default_rng(4)
    found = sorted({(int(k), int(d)) for k, d in rng.integers(0, [40, 60], (300, 2))})
    newest = [x for i, x in enumerate(found) if i % 3 == 0]
    interactions = [(int(a), int(b), "low" if a % 2 else "high") for a, b in rng.integers(0, 60, (140, 2))]
    frames = [spark.createDataFrame(x, s) for x, s in ((found, "k long, drug_id long"), (newest, "k long, drug_id long"), (interactions, "a long, b long, severity string"))]
    got = {r[0]: tuple(r)[1:] for r in conversation.mentioned_interactions(*frames, "k").collect()}
    want = brute_interactions(found, newest, interactions)
    assert got == want and 8 < len(want) < len({k for k, _ in newest})
    # three drugs share a pattern, and some have two
    spoken = [(d, f"p{d // 3}") for d in range(60)] + [(d, f"p{d + 100}") for d in range(0, 60, 7)]
    name = dict(spoken[:60])
    held = sorted({(k, name[d]) for k, d in found} | {(k, f"p{d + 100}") for k, d in found if d % 14 == 0})
    new = sorted({(k, name[d]) for k, d in newest})
    drugs = lambda rows: sorted({(k, d) for k, p in rows for d, q in spoken if p == q})
    pattern_frames = [spark.createDataFrame(held, "k long, pattern string"), spark.createDataFrame(new, "k long, pattern string"), spark.createDataFrame(spoken, "drug_id long, pattern string"), frames[2]]
    told = {r[0]: tuple(r)[1:3] for r in conversation.spoken_interactions(*pattern_frames, "k").collect()}
    by_drugs = {r[0]: tuple(r)[1:3] for r in conversation.mentioned_interactions(spark.createDataFrame(drugs(held), "k long, drug_id long"), spark.createDataFrame(drugs(new), "k long, drug_id long"), frames[2], "k").collect()}
    fresh_patterns = {(k, p) for k, p in new}
    exact = {}
    for k in {k for k, _ in new}:
        own, fresh = {p for q, p in held if q == k}, {p for q, p in fresh_patterns if q == k}
        of = lambda d: {q for e, q in spoken if e == d}
        hits = [(a, b) for a, b, _ in interactions if a < b and of(a) & own and of(b) & own and (of(a) | of(b)) & own & fresh]
        if hits:
            exact[k] = min(hits)
    assert told == exact and told == by_drugs


def test_many_mentions_make_no_pairs(spark):
    """Keys with thousands of mentions each, in less time than their pairs take."""
    found = spark.range(300).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3_999).cast("long"))).alias("drug_id"))
    interactions = spark.range(4_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("low").alias("severity"))
    began = time.monotonic()
    got = conversation.mentioned_interactions(found, found.filter("drug_id = 7"), interactions, "k").collect()
    assert len(got) == 300 and all((r["a"], r["b"]) == (6, 7) for r in got) and time.monotonic() - began < 60


def test_lexical_index_of_a_word_of_a_megabyte(spark):
    word = "abcdefgh" * 131_072
    chunks = spark.createDataFrame([(1, f"{word} tail 7"), (2, "other tail")], "c long, t string")
    queries = spark.createDataFrame([(1, "cdefghabcdefgha tail"), (2, "missing 7"), (3, "fghabc")], "q long, t string")
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in retrieval.lexical_index(queries, chunks, "q", "t", "c", "t").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (2, 1): 0.3, (3, 1): 1.0}


def test_expansion_with_terms_that_are_one_after_normalisation(spark):
    df = spark.createDataFrame([("The FEVER and أرق",), (None,), ("",)], "t string")
    rows = retrieval.expand_query(df, "t", {"Fever": "pyrexia", "fever": "heat", "ارق": "insomnia", "no": "x"}).collect()
    assert rows[0]["expansions"] == ["pyrexia", "heat", "insomnia"] and rows[1]["expansions"] == rows[2]["expansions"] == []
    assert retrieval.expand_query(df, "t", {}).filter(F.size("expansions") > 0).count() == 0


def brute_nearest(points, k):
    out = {}
    for i, p in points.items():
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in points.items() if j != i)
        out[i] = [(j, d) for d, j in near[:k]]
    return out


def test_nearest_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    points = {i: tuple(float(x) for x in rng.integers(0, 6, 3)) for i in range(230)}
    rows = [(i, *p) for i, p in points.items()] + [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    got: dict = {}
    for r in features.nearest_rows(spark.createDataFrame(rows, "id long, x double, y double, z double"), ["x", "y", "z"], "id", 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["distance"]))
    assert got == brute_nearest(points, 4)


def test_nearest_rows_of_many_rows_in_few_places(spark):
    """More rows of a place than are asked for, in less time than all pairs of rows take."""
    rows = spark.range(150_000).select("id", (F.col("id") % 4).alias("x"), F.when(F.col("id") % 7 == 0, -0.0).otherwise(F.col("id") % 3 * 1.0).alias("y"))
    began = time.monotonic()
    near = features.nearest_rows(rows, ["x", "y"], "id", 3).cache()
    assert near.count() == 450_000 and time.monotonic() - began < 60
    points = {r["id"]: (float(r["x"]), r["y"]) for r in rows.filter("id < 200 or id > 149900").collect()}
    few = {i: p for i, p in points.items() if i < 200}
    got: dict = {}
    for r in near.filter("id < 60 or id > 149990").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["distance"]))
    assert got == {i: brute_nearest({**few, i: points[i]}, 3)[i] for i in got} and len(got) == 69


def test_oversampling_stands_between_nearest_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(i < 23)) for i, (a, b) in enumerate(rng.integers(0, 40, (150, 2)))]
    out = features.oversample(spark.createDataFrame(rows, "id long, x double, y double, target int"), "target", ["x", "y"], "id", 3).filter("target = 1").collect()
    old = {i: (x, y) for i, x, y, t in rows if t}
    near = brute_nearest(old, 3)
    assert len(out) == 127
    new = [(r["x"], r["y"]) for r in out]
    for p in old.values():
        new.remove(p)
    inside = lambda p, a, b: all(min(s, t) - 1e-9 <= v <= max(s, t) + 1e-9 for v, s, t in zip(p, a, b, strict=True)) and abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) < 1e-6
    assert all(any(inside(p, old[i], old[j]) for i in old for j, _ in near[i]) for p in new)
    lone = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 0), (3, 3.0, 0)], "id long, x double, target int")
    assert features.oversample(lone, "target", ["x"], "id").count() == 3


def test_oversampling_of_many_rows_in_few_places(spark):
    rows = spark.range(400_000).select("id", (F.col("id") % 4 * 1.0).alias("x"), (F.col("id") % 8 < 3).cast("int").alias("target"))
    began = time.monotonic()
    got = {r["target"]: r["n"] for r in features.oversample(rows, "target", ["x"], "id", 3).groupBy("target").agg(F.count("x").alias("n")).collect()}
    assert got == {0: 250_000, 1: 250_000} and time.monotonic() - began < 60


def test_permutation_importance_of_a_known_rule(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3_000, 3))
    rows = spark.createDataFrame([(i, *map(float, v), float(4 * v[0] - v[1])) for i, v in enumerate(x)], "id long, a double, b double, c double, target double")
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(lambda d: d.withColumn("prediction", 4 * F.col("a") - F.col("b")), rows, ("a", "b", "c"), "id").collect()}
    spread = 2 / np.sqrt(np.pi)  # the mean distance of two standard normal values
    assert got["a"] == pytest.approx(4 * spread, rel=0.05) and got["b"] == pytest.approx(spread, rel=0.05) and got["c"] == 0
