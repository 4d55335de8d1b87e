"""Plans that keep no group in one task return what the plain forms return."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadencia.operators import chain, kpi, lookups, retrieval


def test_first_share_equals_ranks_of_whole_strata(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), F.lit("mine").alias("first"))
    digest = F.md5(F.col("id").cast("string"))
    w = Window.partitionBy("k")
    plain = rows.withColumn("first", F.row_number().over(w.orderBy(digest, "id")) <= F.floor(F.count(F.lit(1)).over(w) * F.lit(0.8)))
    got = lookups.first_share(rows, "k", digest, ("id",), 0.8, "first")
    assert got.columns == ["id", "k", "first"]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.select("id", "k", "first").collect()}
    assert lookups.first_share(rows.limit(0), "k", digest, ("id",), 0.8, "first").count() == 0


@pytest.mark.parametrize("values", [[], [5], [1, 1, 1, 2], list(range(500)), [None, 3, 3, 9]])
def test_nearest_rank_equals_sorted_list(spark, values):
    row = kpi.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", [0.5, 0.95]).first()
    kept = sorted(v for v in values if v is not None)
    at = lambda q: kept[min(int(len(kept) * q), len(kept) - 1)] if kept else None
    assert (row.p50, row.p95) == (at(0.5), at(0.95))


def test_chunks_in_blocks_equal_brute_force(spark, monkeypatch):
    """Ties go to the smaller id; vectors without a direction take no part; those of another dimension are apart."""
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 7)
    monkeypatch.setattr(retrieval, "STREAM_QUERIES", 3)
    vectors = {i: [math.sin(i % 50 * k) for k in (1, 2, 3)] + [0.5] for i in range(60)}
    odd = [(100, None), (101, [0.0] * 4), (102, [float("nan")] * 4), (103, [None] * 4), (104, [1e300] * 4), (105, [1.0, 2.0]), (106, [2.0, 4.0]), (107, [])]
    rows = spark.createDataFrame([*vectors.items(), *odd], "id long, v array<double>")
    vectors |= {104: [1.0] * 4}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    got: dict = {}
    for r in retrieval.dense_top_k(rows.filter("id % 4 = 0 or id > 100"), rows, 3, "id", "id", "v").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    want = {q: [(i, -s) for s, i in sorted((-round(float(unit[q] @ u), 6), i) for i, u in unit.items())[:3]] for q in unit if q % 4 == 0 or q > 100}
    assert {q: got[q] for q in want} == want and set(got) == {*want, 105, 106} and got[105] == [(105, 1.0), (106, 1.0)]


def test_long_session_keeps_signed_rows(spark):
    n = 30_000
    log = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("event_seq"), F.col("id").alias("event_id"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("payload"), F.lit(None).cast("string").alias("actor"))
    last, want = chain.GENESIS, []
    for i in range(n):
        last = hashlib.sha256(f"{i if i % 5 else '{}'}|{last}|".encode()).hexdigest()
        want.append(last)
    signed = chain.sign(log)
    assert [r.payload_hash for r in signed.orderBy("event_seq").collect()] == want
    half = log.join(signed.drop("is_new", "session_id", "event_seq"), "event_id").withColumn("payload_hash", F.when(F.col("event_seq") < 10, F.col("payload_hash")))
    again = chain.sign(half)
    assert again.filter("is_new").count() == n - 10
    assert [r.payload_hash for r in again.orderBy("event_seq").collect()] == want
