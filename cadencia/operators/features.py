"""Training and serving features of refill pairs, all by dates and free of leaks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencia.operators import cycles
from cadencia.operators.lookups import first_share

#: The cycle's mean never is a churn feature: the label is made from it.
CHURN_FEATURES = ("days_since_last", "ratio_to_default", "purchases", "gap_sd", "default_cycle_days", "base_price", "is_chronic")
CYCLE_FEATURES = ("avg_cycle_days", "days_since_last", "purchases", "gap_sd", "default_cycle_days", "base_price")


def _described(rows: DataFrame, customers: DataFrame, drugs: DataFrame) -> DataFrame:
    """Age group and drug columns, missing ones by their defaults (an empty text or 0 is missing too)."""
    c = customers.select("customer_id", F.coalesce(F.nullif("age_group", F.lit("")), F.lit("Unknown")).alias("age_group"))
    d = drugs.select("drug_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("Unknown")).alias("category"), F.coalesce(F.nullif("default_cycle_days", F.lit(0)), F.lit(30)).cast("double").alias("default_cycle_days"), F.col("base_price").cast("double").alias("base_price"), F.col("is_chronic").cast("int").alias("is_chronic"))
    return rows.join(d, "drug_id").join(c, "customer_id")


def cycle_training(bought: DataFrame, customers: DataFrame, drugs: DataFrame, leak_free: bool = True) -> DataFrame:
    """Pairs with three purchases or more: the last gap is the target, the features come from what was before it.

    With leak_free off the mean is that of all gaps, the target's included, as in the first models.
    """
    split = cycles.split_last(cycles.with_gaps(bought))
    past = F.when(~F.col("is_target"), F.col("gap"))
    grouped = split.groupBy("customer_id", "drug_id").agg(
        F.max(F.when(F.col("is_target"), F.col("gap"))).alias("target"), (F.count(F.lit(1)) - 1).alias("purchases"), F.avg(past if leak_free else F.col("gap")).alias("avg_cycle_days"),
        F.coalesce(F.stddev_pop(past), F.lit(0.0)).alias("gap_sd"), F.max_by(past, F.struct(*(F.when(~F.col("is_target"), F.col(c)) for c in cycles.ITEM_ORDER))).alias("days_since_last"),
    )
    return _described(grouped, customers, drugs)


def snapshot_days(bought: DataFrame, as_of: str) -> DataFrame:
    """(customer_id, drug_id, at): a day between the second purchase and as_of less 1.5 mean gaps, chosen by arithmetic on the keys."""
    w = Window.partitionBy("customer_id", "drug_id").orderBy(*cycles.ITEM_ORDER)
    nth = bought.withColumn("nth", F.row_number().over(w))
    grouped = nth.groupBy("customer_id", "drug_id").agg(F.count(F.lit(1)).alias("n"), F.min("order_date").alias("first"), F.max("order_date").alias("last"), F.min(F.when(F.col("nth") == 2, F.col("order_date"))).alias("second")).filter("n >= 2")
    mean = F.datediff("last", "first") / (F.col("n") - 1)
    span = F.datediff(F.date_sub(F.lit(as_of).cast("date"), F.floor(1.5 * mean).cast("int")), "second")
    moved = (F.col("customer_id") * 7919 + F.col("drug_id") * 104729) % (span + 1)
    return grouped.withColumn("mean_gap", mean).filter(span >= 0).select("customer_id", "drug_id", "mean_gap", F.date_add("second", moved.cast("int")).alias("at"))


def churn_training(bought: DataFrame, customers: DataFrame, drugs: DataFrame, as_of: str) -> DataFrame:
    """Features as of the snapshot day; target 1 unless a purchase follows within 1.5 mean gaps."""
    days = snapshot_days(bought, as_of)
    joined = cycles.with_gaps(bought).join(days, ["customer_id", "drug_id"])
    before = F.col("order_date") <= F.col("at")
    grouped = joined.groupBy("customer_id", "drug_id", "at", "mean_gap").agg(
        F.count_if(before).alias("purchases"), F.max(F.when(before, F.col("order_date"))).alias("last"), F.min(F.when(~before, F.col("order_date"))).alias("next"),
        F.coalesce(F.stddev_pop(F.when(before, F.col("gap"))), F.lit(0.0)).alias("gap_sd"),
    )
    full = _described(grouped, customers, drugs).withColumn("days_since_last", F.datediff("at", "last"))
    back = F.coalesce(F.datediff("next", "at") <= 1.5 * F.col("mean_gap"), F.lit(False))
    return full.withColumn("ratio_to_default", F.col("days_since_last") / F.col("default_cycle_days")).withColumn("target", F.when(back, 0).otherwise(1)).drop("next", "last")


def serving(bought: DataFrame, customers: DataFrame, drugs: DataFrame, as_of: str) -> DataFrame:
    """The same features for every pair on the day; pairs with one purchase are cold and take the drug's default cycle."""
    grouped = cycles.with_gaps(bought).groupBy("customer_id", "drug_id").agg(
        F.count(F.lit(1)).alias("purchases"), F.avg("gap").alias("mean"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_sd"), F.datediff(F.lit(as_of).cast("date"), F.max("order_date")).alias("days_since_last")
    )
    full = _described(grouped, customers, drugs).withColumn("is_cold", F.col("purchases") < 2)
    return full.withColumn("avg_cycle_days", F.coalesce("mean", "default_cycle_days")).withColumn("ratio_to_default", F.col("days_since_last") / F.col("default_cycle_days")).drop("mean")


def split_80_20(rows: DataFrame, label: str, *keys: str, seed: int = 42) -> DataFrame:
    """Per class, the first 80 per cent in hash order train."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return first_share(rows, label, digest, keys, 0.8, "is_train")


def flip_labels(rows: DataFrame, label: str, share: float, *keys: str, seed: int = 42) -> DataFrame:
    """Labels of a hash-chosen share of rows are flipped; a share of 0 changes nothing."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    pick = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000)
    return rows.withColumn(label, F.when(pick, 1 - F.col(label)).otherwise(F.col(label)))


#: Rows that a task holds while all others stream past them, and rows of a stream that are compared at once.
BLOCK_ROWS, STREAM_ROWS = 8_192, 256


def _with_nearest(rows: DataFrame, features: list[str], key: str, k: int) -> DataFrame:
    """(key, features, near): each row with its k nearest others (distance, other), by squared Euclidean distance of the features and then by key.

    Exact. Rows of equal features have the same nearest rows but for themselves, so lists of k + 1 are found once for each place. Of a place only the k + 1 smallest keys can be on
    one. Places are held in blocks of bounded size and all places stream past each block, which keeps k + 1 rows of them at most. Rows with a null or non-finite feature or a
    null key take no part. Keys are distinct.
    """
    doubles = [F.col(f).cast("double") for f in features]
    finite = [d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")) for d in doubles]
    # the sum makes one zero of both
    used = rows.filter(F.col(key).isNotNull() & reduce(Column.__and__, finite)).select(key, *features, F.array(*(d + F.lit(0.0) for d in doubles)).alias("__v"))
    first = Window.partitionBy("__v").orderBy("id")
    shaped = used.select(F.col(key).alias("id"), "__v").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    partitions, n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shaped.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(partitions, -(-n // 512)))
    kind = used.schema[key].dataType.simpleString()
    held = shaped.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "id", "__v")
    asked = shaped.filter("nth = 1").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "id", "__v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, own = None, [], None
        for whole in batches:
            for a in range(0, whole.num_rows, STREAM_ROWS):
                b = whole.slice(a, STREAM_ROWS)
                block, role, ids = b.column("block").to_numpy(), b.column("role").to_numpy(), b.column("id").to_numpy(zero_copy_only=False)
                v = b.column("__v").flatten().to_numpy().reshape(b.num_rows, len(features))
                cuts = np.flatnonzero((block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
                for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                    if block[lo] != now:
                        now, parts, own = block[lo], [], None
                    if role[lo] == 0:
                        parts.append((ids[lo:hi], v[lo:hi]))
                        continue
                    if own is None:
                        if not parts:
                            continue
                        own = tuple(np.concatenate([p[i] for p in parts]) for i in range(2))
                    apart = np.zeros((hi - lo, len(own[0])))
                    for f in range(len(features)):  # one feature after the other, so that sums are the same wherever a row stands
                        apart += (v[lo:hi, f, None] - own[1][None, :, f]) ** 2
                    # rows of a block come in the order of their keys: a stable sort breaks ties by key
                    best = np.argsort(apart, axis=1, kind="stable")[:, : k + 1]
                    d = np.take_along_axis(apart, best, axis=1)
                    i, j = np.nonzero(np.isfinite(d))
                    place = b.column("__v").slice(lo, hi - lo).take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([place, pa.array(d[i, j]), pa.array(own[0][best[i, j]], b.column("id").type)], names=["__v", "distance", "other"])

    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "role", "id")
    found = dealt.mapInArrow(run, f"__v array<double>, distance double, other {kind}")
    best = Window.partitionBy("__v").orderBy("distance", "other")
    kept = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    lists = kept.groupBy("__v").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("near"))
    others = F.filter("near", lambda x: x["other"] != F.col(key))
    return used.join(lists, "__v").select(key, *features, F.slice(others, 1, k).alias("near"))


def nearest_rows(rows: DataFrame, features: list[str], key: str, k: int) -> DataFrame:
    """(key, rank, other, distance): the k nearest other rows of each row, as told above."""
    near = _with_nearest(rows, features, key, k).select(key, F.posexplode("near").alias("rank", "x"))
    return near.select(key, (F.col("rank") + 1).alias("rank"), "x.other", "x.distance")


def oversample(train: DataFrame, label: str, features: list[str], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows between a row and one of its k nearest of the class, until both classes are equally large.

    Every minority row gives as many as any other, or one more; which give one more goes by rank in hash order. Rows whose features are not all finite give none, and
    with fewer than two others nothing is added.
    """
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return train.select(label, *features)
    small = min(counts, key=counts.get)
    rows = train.filter(F.col(label) == small)
    able = _with_nearest(rows, features, key, max(1, min(k, counts[small] - 1))).filter(F.size("near") > 0).withColumn("__all", F.lit(1))
    n, missing = able.count(), max(counts.values()) - counts[small]
    if n == 0:
        return train.select(label, *features)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = first_share(able, "__all", digest, (key,), (missing % n + 0.5) / n, "__more")
    made = ranked.withColumn("c", F.explode_outer(F.sequence(F.lit(0), F.lit(missing // n) + F.col("__more").cast("int")))).filter("c > 0")
    h = lambda salt: F.pmod(F.xxhash64(F.lit(seed + salt), key, "c"), F.lit(1_000_003))
    picked = made.withColumn("__other", F.element_at("near", (h(1) % F.size("near") + 1).cast("int"))["other"]).withColumn("__share", h(2) / 1_000_003)
    ends = rows.select(F.col(key).alias("__other"), *(F.col(f).alias(f"__end_{f}") for f in features))
    new = picked.join(ends, "__other").select(F.lit(small).alias(label), *((F.col(f) + F.col("__share") * (F.col(f"__end_{f}") - F.col(f))).alias(f) for f in features))
    return train.select(label, *features).unionByName(new)
