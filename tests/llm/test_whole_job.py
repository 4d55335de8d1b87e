"""Cases where a shortcut would lose results: each operator against brute force on inputs that are hard for it."""

from __future__ import annotations

import random

import numpy as np

from cadencia.llm import bpe, linededup, minhash, packing, secrets, tokens


def lines_frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")


def repeats_by_hand(lines):
    """Numbers of the lines (one to a document) that are copies of an earlier one."""
    sets = [frozenset(x[i : i + 8] for i in range(len(x) - 7)) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i for i in range(len(lines)) if find(i) != i}


# ---- lines


def test_lines_of_any_script_meet(spark):
    rng = random.Random(3)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    chinese = "".join(chr(0x4E00 + i) for i in range(900))
    lines = []
    for _ in range(8):
        x, y, u = of(chinese, 66), of("กขคงจฉชซญดตถทนบปผฝพฟมยรลวสหอ", 64), "https://" + of("abcdefghijkl0123456789/", 60)
        words = " ".join(of("abcdefghijklmno", 10) for _ in range(9))
        lines += [x, "•" + x, "1" + y, "2" + y, u, "-" + u, f"# {words}", f"17. {words}", of("mnopqr", 73) + "s", "t" + of("mnopqr", 40)]
    lines += ["=-" * 14, "=-" * 70, "-" * 30, "-" * 300]
    want = repeats_by_hand(lines)
    assert len(want) >= 34
    assert {r["doc"] for r in linededup.find_repeats(lines_frame(spark, lines)).collect()} == want


def test_similar_lines_of_a_crowded_band_meet(spark):
    """Many variants of one template share bands without being similar; those with a twin are found all the same."""
    rng = random.Random(8)
    of = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = "licensed under the terms of the common licence, file "
    lines = []
    for _ in range(150):
        tail = of(30)
        lines += [f"{head}{tail} v1", f"{head}{tail} q2"]
    want = repeats_by_hand(lines)
    assert len(want) == 150
    got = {r["doc"] for r in linededup.find_repeats(lines_frame(spark, lines)).collect()}
    assert not got - want and len(got) >= 0.98 * len(want)


# ---- near duplicates


def test_twins_in_a_crowded_family_are_linked(spark):
    """Members of a family share buckets but are not similar, except for the two of each pair."""
    rng = random.Random(5)
    new = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    core, texts = new(64), []
    for _ in range(500):
        shared = new(13)
        texts += [f"{core} {shared} {new(11)}", f"{core} {shared} {new(11)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = {r["id"]: r["bands"] for r in minhash._sketch(df, "doc_id", "text", 10, 2, 5).collect()}
    # banding itself is a matter of chance: twins without a common table do not meet
    half = lambda i, at: any(x == y for x, y in zip(bands[i][at : at + 10], bands[i + 1][at : at + 10], strict=True))
    meet = [i for i in range(0, len(texts), 2) if half(i, 0) and half(i, 10)]
    assert len(meet) >= 498
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert [i for i in meet if got[i + 1] != i] == [] and all(got[i] in (i, i - i % 2) for i in got)


# ---- secrets


def test_one_decoy_in_the_top_bin_does_not_switch_a_class_off():
    counts = np.zeros((len(secrets.ENCODINGS), len(secrets.LENGTH_CLASSES), secrets.BINS, 2), np.int64)
    counts[2, 3, 85:99, 0], counts[2, 3, 99, 0] = 70, 30
    counts[2, 3, 99, 1], counts[2, 3, 10, 1] = 1, 1000
    limit = secrets.thresholds(counts)[2, 3]
    assert secrets.BINS - 20 <= limit <= 85
    counts[2, 3, 90, 1] = 500
    assert secrets.thresholds(counts)[2, 3] == 91


def test_keys_of_capitals_only_are_tested():
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(32)).encode()
    words = b"ordinary words stand before and after it in this text, more than the key is long "
    [(start, end, encoding, _, _)] = secrets.candidates(words + key + b" end")
    assert (start, end, secrets.ENCODINGS[encoding]) == (len(words), len(words) + 32, "capital")
    assert secrets.decoys(words * 3 + key + b" end") and secrets.decoys(key) == []


# ---- tokens


def test_long_white_space(spark):
    import tokenizers

    path = tokens.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    blank = " " * 2_000_000
    texts = [f"a{blank}b c", blank, "x" + "\n" * 60_000 + "\tword", f"one{' ' * 60_000}<|endoftext|> two", "a" + " \x1c" * 30_000 + " b"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tokens.encode(path, t).tolist() for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts[:3])), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_documents(df).collect()}
    assert [got[i] for i in range(3)] == want[:3]
    assert packing.pack_documents(df).count() > 0
