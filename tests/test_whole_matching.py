"""Line matching against brute force where many names share all blocking keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencia.functions import similarity as sm
from cadencia.operators import matching


def test_crowded_brand_family(spark):
    """The best names are found by score, wherever they stand in the alphabet."""
    kinds = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    catalog = spark.createDataFrame([(i, f"panadol extra {k}ex") for i, k in enumerate(kinds)], "drug_id int, name string")
    raw = [(i, f"panadol extra {k}x") for i, k in enumerate(kinds) if i % 7 == 0]
    lines = spark.createDataFrame(raw, "line_id int, raw_name string").select("line_id", "raw_name", *(F.lit(None).cast("string").alias(c) for c in ("instructions", "form", "strength")), F.lit(0.9).alias("ocr_confidence"))
    rows, names = matching.picked_text(lines), matching.catalog_names(catalog)
    every = rows.select("name").distinct().crossJoin(names.select("c_name").distinct()).withColumn("s", sm.name_scores("name", "c_name"))
    want: dict = {}
    for r in every.select("name", "c_name", "s.name").toDF("name", "c_name", "score").collect():
        want.setdefault(r["name"], []).append((-r["score"], r["c_name"]))
    got: dict = {}
    for r in matching.candidates(rows, names).select("name", "c_name").collect():
        got.setdefault(r["name"], set()).add(r["c_name"])
    assert got == {n: {c for _, c in sorted(x)[: matching.CANDIDATES]} for n, x in want.items()}
