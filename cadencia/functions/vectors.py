"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity_of_distance(d: Column) -> Column:
    return 1 - d / 2


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of the unit vectors of each key, by component, so that a key's vectors never meet in one row."""
    parts = df.select(key, F.posexplode(normalized(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
