"""Token alignment, the inverted multi-index and phrase mining against brute force, with the odd inputs that their docstrings define."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cadencia.llm import alignment, bpe, common, multiindex, phrases, quotient, secrets, tokens
from tests.llm.test_corpus import LONG, ODD, documents, empty  # noqa: F401

MARK = "▁"


# ---- shared helpers


def test_segments_of_one_hash_stay_apart(monkeypatch):
    values, starts, lengths = np.frombuffer(b"abcabdabcx", np.uint8), np.array([0, 3, 6, 9]), np.array([3, 3, 3, 1])
    want = [0, 1, 0, 2]
    first, kind = common.distinct_segments(values, starts, lengths)
    assert [list(kind).index(k) for k in kind] == [0, 1, 0, 3] and sorted(first) == [0, 1, 3]
    monkeypatch.setattr(common, "segment_hashes", lambda m, s, n: np.zeros(len(s), np.uint64))
    first, kind = common.distinct_segments(values, starts, lengths)
    assert list(kind) == want and sorted(first) == [0, 1, 3]
    _, kind = common.distinct_segments(values, starts, lengths, np.array([0, 0, 1, 0]))
    assert len(set(kind)) == 4


# ---- alignment


def brute_alignment(texts):
    """Two pointers over the token ends of each text, with the public libraries' own encoders."""
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(tokens.default_path())
    a_tok.encode_special_tokens = True
    model, b_bytes = tokens.load_pieces(tokens.pieces_path())
    a_bytes = tokens.piece_table(tokens.default_path())
    docs = []
    for text in texts:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            docs.append(([], [], [], []))
            continue
        groups, links, i, j, p, q, at_a, at_b = [], [], 0, 0, 0, 0, len(a_bytes[a[0]]), len(b_bytes[b[0]])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = at_a <= at_b, at_b <= at_a
            if step_a and step_b:
                groups.append(f"{','.join(map(str, a[p : i + 1]))}|{','.join(map(str, b[q : j + 1]))}")
                p, q = i + 1, j + 1
                if p == len(a):
                    break
            if step_a:
                i += 1
                at_a += len(a_bytes[a[i]])
            if step_b:
                j += 1
                at_b += len(b_bytes[b[j]])
        docs.append((a, b, groups, links))
    count = collections.Counter(x for d in docs for x in d[3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in docs]


def aligned(df, **more):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in alignment.align_documents(df, **more).collect()}


ALIGN_ODD = [*ODD, "<|endoftext|> and </s> are text", f"holds {MARK} the mark", "tabs\tand  two   blanks\n\n new ", "a" * 3_000, "\x00\x01", "x́ẍ 한국어 텍스트 日本語 🤖🤖", "  lead"]


def test_alignment_odd_texts(spark, empty):
    got = aligned(documents(spark, ALIGN_ODD))
    assert [got[i] for i in range(len(ALIGN_ODD))] == brute_alignment(ALIGN_ODD)
    assert got[0] == (0, 0, 0, 0, 0, 0, "") and got[10][0] == 0
    assert aligned(empty) == {}


def test_alignment_of_the_corpus_and_small_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.op11_alignment(spark, sf_dir).collect()}
    assert [got[r["doc_id"]] for r in docs] == brute_alignment([r["text"] for r in docs])


def test_blocks_of_one_document_agree_with_large_ones():
    aligner = alignment.Aligner(tokens.default_path(), tokens.pieces_path())
    texts = [t or "" for t in ALIGN_ODD]
    shas = []
    for runs in ([texts], [[t] for t in texts]):
        own = []
        for run in runs:
            block = alignment._Block(aligner, True)
            block.add(pa.array(range(len(run))), run, 0)
            own += [x for b in block.rows(0) for x in b.column("groups_sha256").to_pylist() if x is not None]
        shas.append(own)
    assert shas[0] == shas[1]


def test_alignment_repeats_nulls_and_groups(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, "three")], "doc_id long, text string")
    rows = sorted(alignment.align_documents(df, with_groups=True).collect(), key=str)
    assert len(rows) == 4 and len({r["groups"] for r in rows}) == 2
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows)
    assert [r["count_sum"] for r in rows if r["doc_id"] != 2] == [3 * r["n_links"] for r in rows if r["doc_id"] != 2]


# ---- multi-index


def brute_links(vectors, threshold):
    """(links, smallest reachable id) of each usable vector."""
    usable = {i: np.array(v, float) for i, v in vectors.items() if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(usable)
    near = {i: {j for j in ids if j != i and len(usable[i]) == len(usable[j]) and multiindex.unit(usable[i][None])[0] @ multiindex.unit(usable[j][None])[0] >= threshold} for i in ids}
    least = {i: i for i in vectors}
    for _ in ids:
        for i in ids:
            least[i] = min([least[i], *(least[j] for j in near[i])])
    return {i: (len(near.get(i, ())), least[i]) for i in vectors}


def family(rng, centre, size, spread):
    return [(centre + spread * rng.standard_normal(len(centre))).tolist() for _ in range(size)]


def rows_of(spark, vectors, kind="array<double>"):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in vectors.items()], f"vec_id long, embedding {kind}, cell string, copies int")


def test_multi_index_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(multiindex, "CELL_ROWS", 4)
    monkeypatch.setattr(multiindex, "BLOCK_ROWS", 16)
    monkeypatch.setattr(multiindex, "VISITOR_ROWS", 24)
    made = [rng.standard_normal(12).tolist() for _ in range(150)]
    for size, spread in ((60, 0.08), (40, 0.15), (5, 0.1)):
        made += family(rng, rng.standard_normal(12), size, spread)
    made += [made[3]] * 30 + [[2 * x for x in made[3]]]
    made += [rng.standard_normal(5).tolist() for _ in range(3)] + [[1.0], [2.0], [-1.0], [], [0.0] * 12, None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e300] * 12, [1e-300] * 12]
    random.Random(1).shuffle(made)
    vectors = dict(enumerate(made))
    got = {r["vec_id"]: r for r in multiindex.embedding_duplicates(rows_of(spark, vectors)).collect()}
    want = brute_links(vectors, 0.95)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_multi_index_recall_and_precision_at_the_threshold(spark):
    """Pairs at just the threshold in random directions, in 64 dimensions among many others: at least 0.99 are found, none below."""
    rng = np.random.default_rng(8)
    x = multiindex.unit(rng.standard_normal((3_000, 64)))
    aside = rng.standard_normal((1_200, 64))
    aside = multiindex.unit(aside - (aside * x[:1_200]).sum(1, keepdims=True) * x[:1_200])
    y = 0.9501 * x[:600] + np.sqrt(1 - 0.9501**2) * aside[:600]
    below = 0.9499 * x[600:1_200] + np.sqrt(1 - 0.9499**2) * aside[600:]
    vectors = dict(enumerate([*x.tolist(), *y.tolist(), *below.tolist()]))
    got = {r["vec_id"]: r["n_links"] for r in multiindex.embedding_duplicates(rows_of(spark, vectors)).collect()}
    assert sum(got[i] == 1 for i in range(600)) >= 594 and not any(got[i] for i in range(600, 3_000))


def test_traversal_visits_in_order_all_within_the_bound():
    rng = np.random.default_rng(2)
    first, second = rng.random(20), rng.random(15)
    seen = list(multi := multiindex.multi_sequence(first, second, 0.7))
    sums = [first[i] + second[j] for i, j in seen]
    assert sums == sorted(sums) and set(seen) == {(i, j) for i in range(20) for j in range(15) if first[i] + second[j] <= 0.7}
    assert list(multi) == []


def test_bounds_are_lower_bounds():
    rng = np.random.default_rng(3)
    x = multiindex.unit(rng.standard_normal((400, 10)))
    grid = multiindex.fit(x, 400 * 40, 0.95)
    i, j = rng.integers(0, 400, (2, 2_000))
    assert (grid.reach(x[i], x[j]) <= ((x[i] - x[j]) ** 2).sum(1) + 1e-9).all()


def test_cells_are_coarser_where_vectors_would_visit_many(monkeypatch):
    monkeypatch.setattr(multiindex, "MOST_VISITS", 10)
    x = np.random.default_rng(9).standard_normal((3_000, 16))
    fine, bound = multiindex._fitted(multiindex.unit(x), 64, 0.95, multiindex.RECALL), multiindex.MOST_VISITS
    visits = lambda g: np.mean([len(v) for v in g.visits(multiindex.unit(x)[:1_024])[1]])
    assert visits(fine) > bound >= visits(multiindex.fit(x, 64 * 64 * multiindex.CELL_ROWS, 0.95))


def test_multi_index_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multiindex.embedding_duplicates(none).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [0.0, 2.0]), (4, None)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in multiindex.embedding_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 3: (1, 1, False), 2: (0, 2, True), 4: (0, 4, True), None: (0, None, True)}


# ---- quotient filters


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 4), st.integers(1, 32), st.integers(0, 9), st.integers(0, 2**32), st.integers(1, 400))
def test_filters_give_back_all_that_was_counted(n, bits, part_bits, seed, size):
    rng = np.random.default_rng(seed)
    part_bits = min(part_bits, bits)
    grams = rng.integers(0, min(2**bits, 50) if seed % 2 else 2**bits, (size, n))
    want = collections.Counter(map(tuple, grams.tolist()))
    parts = collections.defaultdict(list)
    for half in (grams[: size // 2], grams[size // 2 :]):
        if not len(half):
            continue
        high, low, counts = quotient.tally(*quotient.pack(list(half.T), bits))
        part = quotient.parts_of(high, low, n, bits, part_bits).astype(int)
        assert (np.diff(part) >= 0).all()
        for p in set(part.tolist()):
            own = part == p
            parts[p].append(quotient.load(quotient.dump(high[own], low[own], counts[own], n, bits, part_bits), p, n, bits, part_bits))
    got = {}
    for runs in parts.values():
        high, low, counts = quotient.tally(*(np.concatenate([r[i] for r in runs]) for i in range(3)))
        got |= dict(zip(zip(*(x.tolist() for x in quotient.unpack(high, low, n, bits)), strict=True), counts.tolist(), strict=True))
    assert got == want


def test_counters_of_all_sizes():
    counts = np.array([1, 2, 255, 256, 257, 2**40], np.uint64)
    low = np.arange(6, dtype=np.uint64) * np.uint64(7)
    got = quotient.load(quotient.dump(low * np.uint64(0), low, counts, 2, 10, 0), 0, 2, 10, 0)
    assert (got[1] == low).all() and (got[2] == counts).all()


# ---- phrases


def brute_phrases(rows, min_count, most):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if " " in p and a >= min_count}
        kept = []
        for p, a in cand.items():
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 80 * a for q, b in cand.items()):
                continue
            w = p.split(" ")
            cuts = [(2_000_000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, p.encode(), lang, c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(x[3], i + 1, x[2].decode(), -x[1], x[4], x[5], n[lang], -x[0]) for i, x in enumerate(sorted(kept)[:most])]
    return sorted(out)


PHRASE_ROWS = [("New York, new york. NEW YORK\tcity hall; of the, of the people by the people", lang) for lang in ("en", None, "und", "de")] * 9 + [
    (None, "en"), ("", "en"), (" \t,.;", None), ("É é ß of the É", "de"), ("one two three four five " * 40, "fr"), ("x" * 50_000 + " y", "fr"), ("a b" * 60, "xx"), ("only once here", "zz")]


@pytest.mark.parametrize(("min_count", "most"), [(5, 2_000), (30, 3), (1, 50)])
def test_phrases_equal_brute_force(spark, min_count, most):
    df = spark.createDataFrame([(t, g, 1, "k") for t, g in PHRASE_ROWS], "text string, lang string, n int, phrase string")
    got = sorted(tuple(r) for r in phrases.collocations(df.repartition(5), min_count, most).collect())
    assert got == brute_phrases(PHRASE_ROWS, min_count, most)


def test_phrases_in_small_blocks_and_parts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_phrases([(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()], 30, 2_000)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(phrases, "PART_GRAMS", 500)
    assert sorted(tuple(r) for r in phrases.op13_phrases(spark, sf_dir).collect()) == want


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b c", "en")], "text string, lang string")).collect() == []


def test_long_text_fixture_is_read_whole(spark):
    assert sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame([(LONG, "la")], "text string, lang string")).collect()) == brute_phrases([(LONG, "la")], 30, 2_000)


# ---- decoding by a join, and words of one hash


DECODE_TEXTS = [*ODD, "x <|endoftext|> y", " " * 3_000, "漢字 ünïcode 🙂🙂", "same text here"]


def test_both_ways_of_decoding_equal_the_library(spark, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    df = documents(spark, DECODE_TEXTS).repartition(3).cache()
    for rows in (bpe.encode_documents(df, decode=True).collect(), bpe.decode_ids(bpe.encode_documents(df)).collect()):
        assert len(rows) == len(DECODE_TEXTS)
        for r in rows:
            want = whole.encode(DECODE_TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["decoded"] == whole.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(empty, decode=True).count() == 0


def test_decoding_ids_from_elsewhere(spark):
    pack = lambda *ids: np.array(ids, "<u4").tobytes()
    df = spark.createDataFrame([(1, pack(15496, 995), "old"), (2, None, "old"), (3, b"", "old"), (4, pack(50256), "old"), (5, pack(171, 121), "old")], "k int, ids binary, decoded string")
    got = {r["k"]: r["decoded"] for r in bpe.decode_ids(df).collect()}
    assert got == {1: "Hello world", 2: None, 3: "", 4: "<|endoftext|>", 5: got[5]} and "�" in got[5]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_ids(df.withColumn("ids", F.lit(pack(60_000)))).collect()


def test_two_words_of_one_hash_are_two_words(monkeypatch):
    texts = ["one two three two one", "two four five", ""]

    def lists():
        blocks = [bpe._Block(["<|endoftext|>"], w) for w in (True, False)]
        for b in blocks:
            b.add(texts, pa.array([0, 1, 2]))
            b.add(["three one six"], pa.array([3]))
        (keys, place, _, name), (_, _, ranks, again) = (b.ranked() for b in blocks)
        assert name == again
        words = [blocks[0].words[i].decode() for i in place.tolist()]
        codes = [r[c] for r, c in zip(ranks, blocks[1].codes, strict=True)]
        return words, [words[c] for part in codes for c in part.tolist()]

    words, said = lists()
    assert len(set(words)) == len(words) and "".join(said) == "one two three two onetwo four fivethree one six"
    plain, calls = common.segment_hashes, []

    def clashing(mixed, starts, lengths):
        calls.append(1)
        return plain(mixed, starts, lengths) % np.uint64(2) if len(calls) % 2 else plain(mixed, starts, lengths)

    monkeypatch.setattr(common, "segment_hashes", clashing)
    clashed, said = lists()
    assert sorted(clashed) == sorted(words) and "".join(said) == "one two three two onetwo four fivethree one six"


# ---- the battery of secret scans


@pytest.fixture(scope="module")
def planted_keys(spark, sf_dir):
    """Thirty keys of each encoding and length beside the corpus: (encoding, length) -> share found, and the documents of the corpus with any."""
    rng, rows, kinds = random.Random(4), [], {}
    for name, letters in zip(secrets.ENCODINGS, secrets._ALPHABETS, strict=True):
        for n in (16, 24, 32, 48, 64, 128):
            for _ in range(30):
                kinds[10**6 + len(rows)] = (name, n)
                rows.append((10**6 + len(rows), "some words before " + "".join(chr(rng.choice(letters)) for _ in range(n)) + " and after"))
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    found = secrets.scan_secrets(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).filter(F.size("secret_spans") > 0)
    hits, clean = collections.Counter(), 0
    for r in found.collect():
        if r["doc_id"] in kinds:
            hits[kinds[r["doc_id"]]] += 1
        else:
            clean += any(s["kind"] == "random" for s in r["secret_spans"])
    return {k: hits[k] / 30 for k in set(kinds.values())}, clean


def test_planted_keys_are_found(planted_keys):
    """Nine of ten, for each encoding and length at which writing does not look like the alphabet."""
    share, _ = planted_keys
    long = {"decimal": 24, "hex": 24, "base32": 32, "base36": 24, "base62": 16, "base64": 16, "small": 48, "capital": 48}
    assert {k: v for k, v in share.items() if k[1] >= long[k[0]] and v < 0.9} == {}


def test_ordinary_documents_hold_no_keys(planted_keys):
    assert planted_keys[1] <= 2


def test_battery_against_plain_tests():
    """Chi-squared, runs and serial correlation computed from their definitions, with loops."""
    import math

    rng = random.Random(12)
    for e, letters in enumerate(secrets._ALPHABETS):
        for n in (16, 40, 100):
            run = bytes(rng.choice(letters) for _ in range(n))
            code = [letters.index(c) for c in run]
            size = len(letters)
            chi = sum((code.count(s) - n / size) ** 2 / (n / size) for s in range(size))
            z = [max((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n), 0)]
            high = [c >= size // 2 for c in code]
            runs, ones = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
            mean = 2 * ones * (n - ones) / n + 1
            z.append((runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)) if 0 < ones < n else 9)
            m = sum(code) / n
            z.append(sum((a - m) * (b - m) for a, b in zip(code, code[1:], strict=False)) / sum((c - m) ** 2 for c in code) * math.sqrt(n))
            p = [min(max(math.erfc(abs(x) / math.sqrt(2)), 1e-12), 1) for x in z]
            assert secrets.randomness(run, e) == pytest.approx(3 / sum(1 / x for x in p), rel=1e-3, abs=1e-6)


@pytest.mark.parametrize(("run", "encoding"), [(b"0123456789" * 2, "decimal"), (b"deadbeef" * 2, "hex"), (b"DEADBEEF0" * 2, "hex"), (b"qwertyuiopasdfgh", "small"), (b"QWERTYUIOPASDFGH", "capital"), (b"QWERTY234567ABCD==", "base32"), (b"qwerty0189asdfgh", "base36"), (b"Qwerty0189asdfgh", "base62"), (b"a-b_c/d+e-f_g/h+", "base64")])
def test_inferred_encodings(run, encoding):
    assert secrets.ENCODINGS[secrets.infer_encoding(run)] == encoding


def test_secrets_of_odd_rows(spark):
    """A null id, repeated ids and a text of 1 MB."""
    big = "word " * 200_000 + "password = hunter2222 " + "A1b2C3d4E5f6G7h8"
    df = spark.createDataFrame([(None, "token: abcdef"), (1, "token: abcdef"), (1, "token: abcdef"), (2, big)], "doc_id long, text string")
    rows = secrets.scan_secrets(df).collect()
    assert len(rows) == 4 and all(r["secret_spans"][0]["kind"] == "assign" for r in rows)
    assert [(s["start"], s["end"]) for r in rows if r["doc_id"] == 2 for s in r["secret_spans"] if s["kind"] == "assign"] == [(1_000_000, 1_000_021)]


# ---- exact scaling of vectors


def test_scaling_is_exact():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal((50, 7)), rng.standard_normal((5, 7)) * 1e300, rng.standard_normal((5, 7)) * 1e-300, np.full((1, 7), 5e-324), np.full((1, 7), 1.7e308)])
    w = common.power_scaled(v)
    ratio = w[:50] / v[:50]
    assert np.isfinite(w).all() and (np.abs(w).max(1) >= 0.5).all() and (np.abs(w).max(1) < 1).all()
    assert (np.frexp(ratio)[0] == 0.5).all()
    assert np.allclose(multiindex.unit(v)[-2:], 7**-0.5, rtol=1e-15)
