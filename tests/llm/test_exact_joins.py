"""Exact joins behind the near-duplicate operators, extreme vectors, special tokens, spans and the pipeline's columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadencia.llm import bpe, common, linededup, neighbours, prefixes, secrets, tokens
from cadencia.llm.components import connected_components, extended


def jaccard(p, q):
    return len(p & q) / len(p | q)


def test_prefix_join_finds_every_similar_pair(spark):
    rng = random.Random(5)
    base = [rng.randrange(40) for _ in range(4)]
    sets = {i: {(base[i % 4], k) for k in range(30) if rng.random() < 0.85} | {(i, k) for k in range(rng.randrange(4))} for i in range(120)}
    number = {t: n + 1 for n, t in enumerate(sorted({t for s in sets.values() for t in s}))}
    rows = [(i, len(s), number[t]) for i, s in sets.items() for t in s]
    tokens_of = spark.createDataFrame(rows, "id long, n long, token long")
    similar = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    none = spark.createDataFrame([], "id long, component long")
    with common.scratch() as keep:
        prefix = prefixes.rows(tokens_of, 80, keep)
        met = {(r.a, r.b) for r in prefixes.candidates(prefix, none, 80, False).collect()}
        assert similar and similar <= met
        table = spark.createDataFrame(sorted(similar), "a long, b long")
        verify = lambda pairs: pairs.join(table, ["a", "b"], "left_semi")
        got = {(r.id, r.component) for r in prefixes.connect(tokens_of, none, verify, 80, keep).collect()}
    assert got == {(r.id, r.component) for r in connected_components(table).collect()}


def line_components(lines):
    sets = {x: {x.encode("utf-16-be")[i : i + 16] for i in range(0, max(2 * len(x) - 15, 1), 2)} for x in lines}
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in lines:
        for b in lines:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                parent[root(a)] = root(b)
    return {x: root(x) for x in lines}


def test_crowded_family_of_lines_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    body = " ".join(words[:25])
    lines = []
    for i in range(150):  # one long passage with one or two words changed, and lines that share half of it
        own = body.split()
        for _ in range(i % 3):
            own[rng.randrange(25)] = words[rng.randrange(25, 400)]
        lines.append(" ".join(own))
        lines.append(" ".join(own[:12] + [words[rng.randrange(25, 400)] for _ in range(13)]))
    lines += ["a" * 100, "a" * 1000, "中文" * 20 + "甲乙", "中文" * 20 + "甲丙", "x" * 30]
    lines = sorted({x for x in lines if x})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = {r.text for r in linededup.dedup_lines(df).filter("n_dropped = 0").collect()}
    component = line_components(lines)
    first = {}
    for x in lines:
        first.setdefault(component[x], x)
    assert kept == set(first.values())


def test_cosines_of_extreme_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [0.0, 5.0]), (3, [3e200, 3e200]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.nearest(df, df, 5).collect()}
    assert set(got) == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert got[(1, 3)] == pytest.approx(1.0) and got[(0, 1)] == pytest.approx(np.sqrt(0.5)) and got[(0, 2)] == 0.0


def test_special_tokens_as_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = ["hello world", "<|endoftext|>", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "", None, "<|endof", " " * 60_000 + "x", "\n" * 60_001]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_documents(df).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_spans_apart_equal_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        spans = lambda n: sorted((a := rng.randrange(60), 3, a + rng.randrange(1, 9)) for _ in range(n))
        extra, found, reach = [], spans(rng.randrange(6)), 0
        for span in spans(6):  # candidates never overlap each other
            if span[0] >= reach:
                extra.append(span)
                reach = span[2]
        assert secrets._apart(extra, found) == [x for x in extra if not any(x[0] < z and a < x[2] for a, _, z in found)]


def test_pipeline_keeps_the_callers_values(spark, sf_dir):
    line = "one line that stands in two documents of this table"
    rows = [(1, f"{line}\nand the first text goes on", "en", 0.25, 7, "mine", 3), (2, f"{line}\nwhile the second ends otherwise", "en", 0.5, 8, None, None), (4, "password = hunter2secret9", "en", 0.5, 8, "x", 1), (1, f"{line}\nand the first text goes on", "en", 0.25, 7, "again", 3), (3, None, None, None, None, None, None), (None, "", "fr", 0.1, 1, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_lines long, secret_spans string, n_chars int")
    own = lambda df: sorted(str((r.doc_id, r.lang, r.score, r.n_lines, r.secret_spans)) for r in df.collect())
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_each, corpus_pipeline.mask_secrets):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and own(out) == own(docs)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    edited = {(r.doc_id, r.text) for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()}
    assert (1, f"{line}\nand the first text goes on") in edited and (2, "while the second ends otherwise") in edited
    lengths = {(r.doc_id, r.n_chars, len(r.text) if r.text is not None else None) for r in corpus_pipeline.mask_secrets(spark, docs, sf_dir).collect()}
    assert all(n == m for _, n, m in lengths)
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert set(own(good)) <= set(own(docs))
    assert {r.score for r in docs.filter(F.col("doc_id") == 1).collect()} == {0.25}


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_links_extend_components_without_a_new_start(spark):
    rng = random.Random(3)
    first = [(i, i + 1) for i in range(0, 400) if i % 40 != 39]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(6)] + [(900, 17), (901, 902)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    as_set = lambda df: sorted((r.id, r.component) for r in df.collect())
    known, full = jobs_of(spark, "components-full", lambda: connected_components(frame(first)))
    assert as_set(extended(known, frame(more))) == as_set(connected_components(frame(first + more)))
    again, fewer = jobs_of(spark, "components-again", lambda: extended(known, frame([(0, 30), (85, 81)])))
    assert as_set(again) == as_set(known) and 3 * fewer < full


def test_minhashes_by_runs_are_those_of_all_windows(spark):
    texts = ["x" * 24, "0123456789" * 7, "甲乙丙丁戊己庚辛壬癸" * 3 + "子", "one line of ordinary words, no more", "𝄞𝄟" * 15]
    rows = spark.createDataFrame([(i, t + "z" * (i % 4)) for i, t in enumerate(texts)], "doc long, text string")
    occurrences = linededup._occurrences(rows, "doc", "text", 24)
    one = {r["node"]: r for r in occurrences.withColumn("h", linededup._windows(F.col("line"))).collect()}
    classes = linededup._classes(occurrences).collect()
    assert len(classes) == len(one) == 5
    for c in classes:
        assert [c[f"v{k}"] for k in range(linededup.HASHES)] == [min(h ^ m for h in one[c["node"]]["h"]) for m in linededup.MASKS] and c["times"] == 1


def unlike_lines_of_common_bands(rng, groups, members):
    """Lines of groups that have half their windows in common, and so many bands, and no two of which are similar."""
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    return [f"{base} {word(60)}" for base in (word(120) for _ in range(groups)) for _ in range(members)]


def test_bands_of_some_lines_are_not_dealt_anew(spark):
    lines = unlike_lines_of_common_bands(random.Random(8), 3, 40)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc long, text string")
    with common.scratch() as keep:
        made = {}
        counted = lambda df, name: made.setdefault(name, keep(df, name))
        classes = counted(linededup._classes(linededup._occurrences(rows, "doc", "text", 24)), "lines")
        assert linededup._bands(classes).groupBy("band").count().filter("count > 8").count() > 3
        pairs, large = linededup._pairs(classes, counted)
        assert pairs.count() > 0 and large.count() == 0
        assert made["deeper"].count() == 0 and made["deeper-crowded"].count() == 0


@pytest.mark.parametrize("limits", [{}, {"MANY": 1}, {"SMALL": 6, "SMALLER": 4, "MANY": 2}])
def test_ways_of_pairs_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
    rng = random.Random(21)
    lines = unlike_lines_of_common_bands(rng, 2, 25)
    lines += [x[:k] + "#" + x[k:] for x in lines[::3] for k in (0, 70)] + ["the same line " * 9 + "x", "the same line " * 30 + "x", "the same " * 30 + "but for the end of it all, which is another"]
    of = line_components(lines)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    least = {}
    for i, line in enumerate(lines):
        least.setdefault(of[line], i)
    dropped = {r.doc for r in linededup.find_repeats(rows).collect()}
    assert dropped == {i for i, line in enumerate(lines) if least[of[line]] != i} and len(dropped) > 20


def test_filter_of_wanted_values_lets_few_others_pass(spark):
    wanted = spark.range(0, 2_000_000, 100).withColumnRenamed("id", "node")
    left = linededup._likely(spark.range(200_000).withColumnRenamed("id", "node"), "node", wanted)
    assert left.join(wanted, "node").count() == 2000 and left.count() < 3000


def test_crowded_copies_meet_their_centre_in_few_rows(spark, monkeypatch):
    for name, value in {"SMALL": 6, "SMALLER": 4}.items():
        monkeypatch.setattr(linededup, name, value)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    # each copy has three changes of its own
    lines = [base] + ["".join(rng.choice("0123456789") if k in at else x for k, x in enumerate(base)) for at in (rng.sample(range(20, 380), 3) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc long, text string")
    with common.scratch() as keep:
        made = {}
        counted = lambda df, name: made.setdefault(name, keep(df, name))
        pairs, large = linededup._pairs(counted(linededup._classes(linededup._occurrences(rows, "doc", "text", 24)), "lines"), counted)
        assert made["dealt-anew"].count() == (linededup.HASHES - 2) * made["signed"].count() > 0 and large.count() > 0
        ends = [x for r in pairs.filter("centred").collect() for x in (r.a, r.b)]
        assert max(map(ends.count, ends)) > 30


@pytest.mark.parametrize("limits", [{}, {"MANY": 1}, {"SMALL": 6, "SMALLER": 4, "MANY": 2}])
def test_no_pair_of_lines_is_compared_twice(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
    compared, verified = [], linededup._verified

    def counted(pairs, texts, per_cent, *more):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, texts, per_cent, *more)

    monkeypatch.setattr(linededup, "_verified", counted)
    rng = random.Random(21)
    lines = unlike_lines_of_common_bands(rng, 2, 25)
    lines += [x[:k] + "#" + x[k:] for x in lines[::3] for k in (0, 70)]
    of = line_components(lines)
    least = {}
    for i, line in enumerate(lines):
        least.setdefault(of[line], i)
    dropped = {r.doc for r in linededup.find_repeats(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert dropped == {i for i, line in enumerate(lines) if least[of[line]] != i}
    assert compared and len(compared) == len(set(compared))
