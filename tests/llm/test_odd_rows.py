"""Null and repeated ids, texts of more than a megabyte and columns of clashing names, in every operator on documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadencia.llm import alignment, bpe, flac, langid, linededup, minhash, neighbours, packing, phrases, quality, secrets

BIG = "\n".join(f"line {i} of a long text with words that go on and on until the end {i * 7919 % 1000}" for i in range(16_000))
ROWS = [(None, "a text without an id, seen twice"), (None, "a text without an id, seen twice"), (None, None), (1, "the same id and the same text"), (1, "the same id and the same text"), (2, ""), (3, BIG), (4, BIG + " end")]
NAMES = "doc_id long, text string, score string, kept string, component_id string, n_lines string, ids string, spans string, lang_pred string, sequence_id string, block string, kind string, rank string, n string"


@pytest.fixture(scope="module")
def rows(spark):
    extra = ("mine",) * 12
    return spark.createDataFrame([(*r, *extra) for r in ROWS], NAMES).repartition(3).cache()


def by_id(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def counts(df):
    return {k: len(v) for k, v in by_id(df).items()}


EACH = {None: 3, 1: 2, 2: 1, 3: 1, 4: 1}


def test_big_text_is_big():
    assert len(BIG) > 1_000_000


def test_quality(spark, rows):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = by_id(quality.score_quality(rows, quality.fit_quality(rows, labels, depth=1, trees=2)))
    assert {k: len(v) for k, v in got.items()} == EACH and got[1][0]["score"] == got[1][1]["score"] and got[1][0]["kept"] == "mine"


def test_media(rows):
    got = by_id(flac.media_digests(flac.encode_media(rows)))
    assert {k: len(v) for k, v in got.items()} == EACH and got[3][0]["n_bytes"] == len(BIG.encode()) and got[1][0]["media_sha256"] == got[1][1]["media_sha256"]


def test_secrets(rows):
    got = by_id(secrets.scan_secrets(rows))
    assert {k: len(v) for k, v in got.items()} == EACH and all(r["secret_spans"] == [] and r["kind"] == "mine" for v in got.values() for r in v)


def test_language(spark, rows):
    models = langid.fit_languages(spark.createDataFrame([(i, "the words of a long text", "en") for i in range(20)] + [(100 + i, "die wörter des langen textes", "de") for i in range(20)], "doc_id long, text string, lang string"))
    got = by_id(langid.identify_language(rows, models))
    assert {k: len(v) for k, v in got.items()} == EACH and got[3][0]["lang_pred"] == "en" and got[2][0]["lang_pred"] == "und"


def test_packing(rows):
    pieces = packing.pack_documents(rows).collect()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert o2 == (o + n if s == s2 else 0)
    assert sum(r["doc_id"] is None for r in pieces) == 3 and sum(r["doc_id"] == 1 for r in pieces) == 2


def test_lines(rows):
    got = by_id(linededup.dedup_lines(rows))
    assert {k: len(v) for k, v in got.items()} == EACH
    assert got[1][0]["text"] == "the same id and the same text" and {r["text"] for r in got[None]} == {None, ROWS[0][1]}
    assert got[3][0]["n_dropped"] > 0 and got[4][0]["n_dropped"] >= got[4][0]["n_lines"] - 2


def test_near_duplicates(rows):
    got = by_id(minhash.near_duplicates(rows))
    assert {k: len(v) for k, v in got.items()} == EACH
    assert got[4][0]["component_id"] == 3 and not got[4][0]["kept"] and got[3][0]["kept"] and all(r["kept"] for r in got[None])


def test_tokens(rows):
    assert counts(bpe.encode_documents(rows.drop("ids"), decode=True)) == EACH
    got = by_id(bpe.encode_documents(rows.drop("ids"), decode=True))
    assert got[3][0]["decoded"] == BIG and [r["decoded"] for r in got[2]] == [""]


def test_alignment(rows):
    got = by_id(alignment.align_documents(rows))
    assert {k: len(v) for k, v in got.items()} == EACH and got[3][0]["n_links"] > 200_000 and got[2][0]["n_a"] == 0


def test_phrases(rows):
    assert phrases.collocations(rows.withColumn("lang", F.lit(None).cast("string"))).filter("lang = 'und' and a >= 16000").count() > 0


def test_neighbours_with_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", "b", "c"), (2, [1.0, 0.1], "a", "b", "c"), (None, [1.0, 0.1], "a", "b", "c"), (2, [1.0, 0.1], "a", "b", "c")], "vec_id long, embedding array<double>, query_id string, score string, rank string")
    got = neighbours.nearest(df, df, 5).collect()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got) == [(1, 2, 1), (2, 1, 1)]
