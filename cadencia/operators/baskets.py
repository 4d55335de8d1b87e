"""Baskets: interactions within an order, co-purchase affinities, cross-sell and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def basket_pairs(items: DataFrame) -> DataFrame:
    """Different pairs a < b of drugs of one order, from its sorted distinct drugs, without a self-join."""
    sets = items.groupBy("order_id").agg(F.sort_array(F.collect_set("drug_id")).alias("d")).filter(F.size("d") > 1)
    pairs = F.expr("flatten(transform(d, (x, i) -> transform(slice(d, i + 2, size(d)), y -> struct(x as a, y as b))))")
    return sets.select("order_id", F.explode(pairs).alias("p")).select("order_id", "p.a", "p.b")


def basket_interactions(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """Interactions with both ends in one order."""
    return basket_pairs(items).join(interactions, ["a", "b"])


def safety_gate(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row for each order with items: rejected if any pair interacts severely, else the number of warnings."""
    found = basket_interactions(items, interactions).groupBy("order_id").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") != "high").alias("other"))
    zero = F.lit(0).cast("long")
    full = items.select("order_id").distinct().join(found, "order_id", "left")
    high = F.coalesce("high", zero)
    return full.select("order_id", (high > 0).alias("rejected"), F.when(high > 0, zero).otherwise(F.coalesce("other", zero)).alias("warnings"))


def affinities(items: DataFrame) -> DataFrame:
    """Co-purchase confidence: orders with both over the rarer one's orders."""
    single = items.groupBy("drug_id").agg(F.countDistinct("order_id").alias("n"))
    pairs = basket_pairs(items).groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders"))
    both = pairs.join(single.select(F.col("drug_id").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("drug_id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", F.round(F.col("orders") / F.least("na", "nb"), 6).alias("confidence"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each undirected edge once from either end: (drug_id, partner, ...)."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    there = edges.select(F.col("a").alias("drug_id"), F.col("b").alias("partner"), *rest)
    return there.unionByName(edges.select(F.col("b").alias("drug_id"), F.col("a").alias("partner"), *rest))


def cross_sell(edges: DataFrame, drugs: DataFrame, k: int = 5) -> DataFrame:
    """The k partners of highest confidence for every drug."""
    w = Window.partitionBy("drug_id").orderBy(F.desc("confidence"), "partner")
    best = symmetric(edges).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    named = drugs.select(F.col("drug_id").alias("partner"), "name", "base_price")
    return best.join(named, "partner").select("drug_id", "rank", "partner", "name", "base_price", "confidence")


def recommended(edges: DataFrame, drugs: DataFrame, k: int = 4) -> DataFrame:
    """The drugs with the highest confidence on the second side of a pair, filled by price."""
    from cadencia.operators.lookups import top_with_backfill

    scored = edges.groupBy(F.col("b").alias("drug_id")).agg(F.max("confidence").alias("score"))
    return top_with_backfill(scored, drugs, k, "drug_id", "score", "base_price")


def pair_violations(pairs: DataFrame, drugs: DataFrame) -> DataFrame:
    """Rows that break the rules of a pair table: order, uniqueness, both ends known."""
    known = drugs.select(F.col("drug_id").alias("k"))
    order = pairs.filter(~(F.col("a") < F.col("b"))).agg(F.count(F.lit(1)).alias("bad_order"))
    twice = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    lost = pairs.select(F.explode(F.array("a", "b")).alias("k")).join(known, "k", "left_anti").agg(F.count(F.lit(1)).alias("unknown_ends"))
    return order.crossJoin(twice).crossJoin(lost)
