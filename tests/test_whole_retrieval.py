"""The retrieval queries over the whole query set and all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencia.operators import retrieval
from cadencia.plans import queries
from cadencia.sources.fixtures import Retail


def test_index_scores_as_every_passage_against_every_document(spark, sf_dir):
    r = Retail(spark, sf_dir)
    asked = queries.passages(r)
    texts = {x["item_id"]: x["text"] for x in r.raw("benchmark").collect()}
    assert {x["query_id"]: x["query"] for x in asked.collect()} == texts
    docs = r.documents().select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "7"), (-4, "x 12"), (-5, "a" * 3000)], "chunk_id long, content string")
    few = asked.filter("query_id % 8 = 0").unionByName(spark.createDataFrame([(-1, ""), (-2, "12 12 hello"), (-3, None), (-4, "aaaa")], "query_id long, query string"))
    chunks = docs.unionByName(odd)
    pairs = chunks.crossJoin(F.broadcast(few))
    brute = {(x[0], x[1]): x[2] for x in pairs.select("query_id", "chunk_id", F.round(retrieval.lexical_score(F.col("query"), F.col("content")), 6)).collect() if x[2]}
    index = retrieval.lexical_index(few, chunks, "query_id", "query", "chunk_id", "content")
    assert {(x.query_id, x.chunk_id): round(x.score, 6) for x in index.collect() if x.score} == brute


def test_index_holds_the_fewer_of_queries_and_chunks(spark, monkeypatch):
    """Either side in several blocks; texts of one id count as one; stems that stand inside of others, at both ends and in several."""
    monkeypatch.setattr(retrieval, "HELD_TEXTS", 3)
    monkeypatch.setattr(retrieval, "KNOWN_STEMS", 4)
    few = [(1, "pan dol 7"), (2, "extra extra 12 7"), (3, "zz"), (4, None), (5, "x 12"), (6, "ol"), (7, "panadol extra forte")]
    many = [(100 + i, t) for i, t in enumerate(["panadol 7", "the panadolextra ol", "dolpan 12", "", "12 7", "extra panadol forte 7 12", "olol", None, "zzzz zz"] * 3)]
    for a, b in ((few, many), (many, few)):
        q, c = spark.createDataFrame(a, "id long, text string"), spark.createDataFrame(b, "id long, text string")
        pairs = q.select(F.col("id").alias("q"), F.col("text").alias("s")).crossJoin(c)
        brute = {(x[0], x[1]): x[2] for x in pairs.select("q", "id", retrieval.lexical_score(F.col("s"), F.col("text"))).collect() if x[2]}
        got = [tuple(x) for x in retrieval.lexical_index(q, c, "id", "text", "id", "text").collect()]
        assert {(x, y): s for x, y, s in got if s} == brute and len(got) == len(set(got)) > 40
    twice = spark.createDataFrame([(1, "pan"), (1, "dol 7"), (2, "zz")], "id long, text string")
    assert {tuple(x) for x in retrieval.lexical_index(twice, twice, "id", "text", "id", "text").collect()} == {(1, 1, 1.0), (2, 2, 1.0)}


def test_index_deals_no_rows(spark):
    """Neither the stems of the chunks nor the pairs are shuffled."""
    q = spark.range(20).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    c = spark.range(50).select("id", F.lit("word1 word2 sword3x").alias("text"))
    plan = retrieval.lexical_index(q, c, "id", "text", "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
