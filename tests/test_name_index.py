"""Names by bounded index, partial ratios with windows over the edges and metaphone keys, against brute force and public examples."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadencia.functions import similarity as sm
from cadencia.functions.nameindex import NameIndex
from cadencia.functions.phonetics import metaphone
from cadencia.operators import matching

PARTS = ["pan", "a", "dol", "ex", "tra", "con", "cor", "li", "pi", "tor", "am", "ox", "cil", "lin", "aug", "men", "tin", "di", "van", "glu", "co", "phage", "tri", "vit", "amin", "b", "zinc", "sy", "rup"]


def made_names(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(2, 4)))
    return sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(n)})


def edited(rng, x):
    i = rng.randrange(len(x))
    return rng.choice([x[1:], " ".join(reversed(x.split())), x.replace(" ", ""), x[:i] + x[i + 1 :], x[:i] + rng.choice("abcdefgh") + x[i:], x[:i] + rng.choice("abcz") + x[i + 1 :], x + " plus forte", x.split()[-1], x])


def brute_top(query, names, k):
    return [(-s, n) for s, n in sorted((-max(sm.token_set_ratio(query, n), sm.partial_ratio(query, n)), n) for n in names)[:k]]


def test_partial_ratio_counts_windows_over_the_edges():
    assert sm.partial_ratio("abcdef", "cdefxyzq") == pytest.approx(80)
    assert sm.partial_ratio("xyzq", "abcxyz") == pytest.approx(600 / 7)
    assert sm.partial_ratio("abcd", "dabc") == sm.partial_ratio("dabc", "abcd") == pytest.approx(600 / 7)


TEXT = st.text(alphabet="ab c", max_size=12)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(TEXT, min_size=1, max_size=8))
def test_index_ratios_and_bounds(query, names):
    index = NameIndex(names)
    partial, token = index.bounds(query)
    for i, n in enumerate(index.names):
        assert sm.partial_ratio(query, n) <= partial[i] + 1e-9 and sm.token_set_ratio(query, n) <= token[i] + 1e-9
    assert index.top(query, 3) == brute_top(query, index.names, 3)


def test_index_is_exact_for_all_kinds_of_edits():
    rng, names = random.Random(8), [*made_names(700), "", "x", "a" * 70, "q" * 64 + " panadol"]
    index = NameIndex(names)
    for query in [*(edited(rng, rng.choice(names[:700])) for _ in range(60)), "", "zzz", "a" * 90, "é à"]:
        assert index.top(query, 15) == brute_top(query, index.names, 15)


def test_candidates_equal_all_names_on_five_hundred_lines(spark, monkeypatch):
    """In several blocks and parts; the brute force scores every line against every name."""
    monkeypatch.setattr(matching, "BLOCK_NAMES", 40)
    monkeypatch.setattr(matching, "PART_NAMES", 150)
    rng, names = random.Random(9), made_names(130, 3)
    asked = sorted({q for q in (edited(rng, rng.choice(names)) for _ in range(700)) if len(q) > 2})[:500]
    lines, catalog = spark.createDataFrame([(q,) for q in asked], "name string"), spark.createDataFrame([(n,) for n in [*names, None]], "c_name string")
    got: dict = {}
    for r in matching.candidates(lines, catalog).select("name", "c_name", "s.name").toDF("name", "c_name", "score").collect():
        got.setdefault(r["name"], []).append((-r["score"], r["c_name"]))
    assert {q: [(-s, n) for s, n in sorted(x)] for q, x in got.items()} == {q: brute_top(q, names, 15) for q in asked}


def test_common_subsequences_of_all_names_at_once():
    rng = random.Random(4)
    names = ["".join(rng.choice("abc é") for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 63, 64, 65, 90) for _ in range(3)]
    lcs = lambda a, b: round(sm.ratio(a, b) * (len(a) + len(b)) / 200)
    for some in (names, [x for x in names if len(x) <= 32], [""]):
        index = NameIndex(some)
        for query in ["", "abc", *names]:
            got = index.common(query)
            assert all(got[i] == (lcs(query, x) if len(x) <= 64 else min(len(x), len(query))) for i, x in enumerate(index.names))


def test_fit_candidates_are_those_of_all_that_count(spark, monkeypatch):
    """With names that only sound alike, which must be among the best of all blocks to count."""
    monkeypatch.setattr(matching, "BLOCK_NAMES", 40)
    rng, names = random.Random(10), [*made_names(150, 3), "a" * 70, "panadol " + "x" * 70, "nite", "knight"]
    asked = sorted({q for q in (edited(rng, rng.choice(names)) for _ in range(400)) if len(q) > 2} | {"night", "fonex", "zinck"})
    lines, catalog = spark.createDataFrame([(q,) for q in asked], "name string"), spark.createDataFrame([(n,) for n in [*names, None]], "c_name string")
    fuzzy, first = F.col("s.name"), F.col("s.first")
    capped = matching.first_word_cap(matching.blended(fuzzy, F.col("s.phonetic")), fuzzy, first)
    want = matching.candidates(lines, catalog).withColumn("capped", capped).filter("capped >= 75").select("name", "c_name", "capped").collect()
    got = matching.fit_candidates(lines, catalog).select("name", "c_name", "capped").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300


def empty_columns(df):
    return df.select("line_id", "raw_name", *(F.lit(None).cast("string").alias(c) for c in ("instructions", "form", "strength")), F.lit(0.9).alias("ocr_confidence"))


def test_many_names_far_from_each_other(spark):
    """In less time than a score for all pairs takes."""
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(32)) for _ in range(2_500)})
    catalog = spark.createDataFrame(list(enumerate(names)), "drug_id int, name string")
    began = time.monotonic()
    rows = matching.match_lines(empty_columns(catalog.select(F.col("drug_id").alias("line_id"), F.substring("name", 2, 31).alias("raw_name"))), catalog).collect()
    assert len(rows) == len(names) and all(r["drug_id"] == r["line_id"] and len(r["candidates"]) == 1 for r in rows) and time.monotonic() - began < 60


def test_many_lines_that_ask_for_few_things(spark):
    """Lines are not joined with the entries each by itself; a line keeps its own id and reading."""
    words = lambda ws, i: F.element_at(F.array(*map(F.lit, ws)), (i % len(ws) + 1).cast("int"))
    k = F.col("id")
    called = lambda i: F.concat_ws(" ", words(["hot", "cold", "old", "gold"], i), words(["bolt", "bold", "belt", "bolts"], F.floor(i / 4)))
    catalog = spark.range(1600).select(k.alias("drug_id"), F.concat(called(k), F.lit(" "), (F.floor(k / 16) % 100 + 1).cast("string"), F.lit("mg")).alias("name"))
    lines = spark.range(60_000).select(k.alias("line_id"), F.concat(called(k), F.lit(" "), (k % 100 + 1).cast("string"), F.lit("mg")).alias("raw_name"))
    began = time.monotonic()
    rows = matching.match_lines(empty_columns(lines).withColumn("ocr_confidence", F.when(F.col("line_id") < 50_000, 0.9).otherwise(0.1)), catalog).cache()
    assert rows.count() == 60_000 and time.monotonic() - began < 60
    few = empty_columns(lines.filter("line_id % 997 = 0"))
    alone = {r["line_id"]: r for r in matching.match_lines(few, catalog).collect()}
    got = {r["line_id"]: r for r in rows.filter("line_id % 997 = 0 and line_id < 50000").collect()}
    assert len(got) == 51 and all(alone[i] == r for i, r in got.items()) and rows.filter("line_id >= 50000 and status = 'matched'").count() == 0


def test_lines_of_an_empty_catalog(spark):
    lines = spark.createDataFrame([(1, "panadol")], "line_id int, raw_name string").select("line_id", "raw_name", *(F.lit(None).cast("string").alias(c) for c in ("instructions", "form", "strength")), F.lit(0.9).alias("ocr_confidence"))
    assert [r["status"] for r in matching.match_lines(lines, spark.createDataFrame([], "drug_id int, name string")).collect()] == ["not_found"]


#: Keys by the published rules, one or more words for each.
METAPHONES = {
    "knight": "NT", "gnome": "NM", "pneumonia": "NMN", "wrist": "RST", "aeon": "EN", "xerox": "SRKS", "whale": "WL", "lamb": "LM", "bomb": "BM", "timber": "TMBR", "special": "SPXL", "chemist": "XMST", "school": "SKL",
    "church": "XRX", "science": "SNS", "city": "ST", "cat": "KT", "back": "BK", "accept": "AKSPT", "edge": "EJ", "judge": "JJ", "badger": "BJR", "dog": "TK", "night": "NT", "high": "H", "ghost": "KST", "sign": "SN", "signed": "SNT",
    "gentamicin": "JNTMSN", "gel": "JL", "giant": "JNT", "gold": "KLT", "bigger": "BKR", "hat": "HT", "ahead": "AHT", "aha": "AH", "shah": "X", "phone": "FN", "physics": "FSKS", "quick": "KK", "vision": "FXN", "russia": "RX", "shade": "XT", "sugar": "SKR",
    "nation": "NXN", "partial": "PRXL", "thing": "0NK", "mother": "M0R", "catch": "KX", "vanilla": "FNL", "why": "W", "yellow": "YL", "boy": "B", "beyond": "BYNT", "box": "BKS", "zinc": "SNK", "aspirin": "ASPRN", "ibuprofen": "IBPRFN",
    "amoxicillin": "AMKSSLN", "augmentin": "AKMNTN", "write": "RT", "hello world": "HL WRLT", "123": "", "": "",
}


@pytest.mark.parametrize(("word", "key"), METAPHONES.items())
def test_metaphone(word, key):
    assert metaphone(word) == metaphone(word.upper()) == key
