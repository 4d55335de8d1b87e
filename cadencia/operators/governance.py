"""Decisions on predictions: reminder governance, confidence, churn tiers, status changes, upserts and audit rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published error of the cycle regressor, in days.
MAE_DAYS = 3.27


def decision(confidence: Column, churn: Column) -> Column:
    return F.when(churn >= 0.70, "human_review").when(confidence >= 0.80, "auto_send").when(confidence >= 0.50, "human_review").otherwise("cold_start")


def churn_action(churn: Column) -> Column:
    return F.when(churn >= 0.50, "human_review").otherwise("auto_send")


def cycle_confidence(mean_gap: Column, cold: Column, mae: float = MAE_DAYS) -> Column:
    inside = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(mae) / F.nullif(mean_gap, F.lit(0.0)))), 3)
    return F.when(cold, F.lit(0.40)).when(mean_gap > 0, inside).otherwise(F.lit(0.50))


def churn_tier(churn: Column) -> Column:
    return F.when(churn >= 0.60, "high").when(churn >= 0.33, "medium").otherwise("low")


def heuristic_churn(days: Column, mean_gap: Column) -> Column:
    """0.05 within the usual gap, then the overshoot relative to it, at most 0.95."""
    over = F.least(F.lit(0.95), (days - mean_gap) / F.nullif(mean_gap, F.lit(0.0)))
    return F.when(days > mean_gap, F.coalesce(over, F.lit(0.95))).otherwise(F.lit(0.05))


def heuristic_tier(churn: Column) -> Column:
    return F.when(churn >= 0.7, "high").when(churn >= 0.4, "medium").otherwise("low")


def sla_breaches(pending: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Reminders that wait for a person for `hours` or longer."""
    waited = F.round((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600, 1)
    return pending.filter(F.col("decision") == "human_review").withColumn("hours", waited).filter(F.col("hours") >= hours)


def evaluate(cycles: DataFrame, as_of: str, mae: float = MAE_DAYS) -> DataFrame:
    """Confidence, churn and decision of every pair, from its cycle."""
    days = F.datediff(F.lit(as_of).cast("date"), "last_purchase_date")
    scored = cycles.select("customer_id", "drug_id", "avg_cycle_days", F.lit(as_of).cast("date").alias("evaluated_on"), days.alias("days"), cycle_confidence(F.col("avg_cycle_days"), F.lit(False), mae).alias("confidence"), F.round(heuristic_churn(days, F.col("avg_cycle_days")), 6).alias("churn"))
    return scored.withColumn("decision", decision(F.col("confidence"), F.col("churn"))).withColumn("churn_action", churn_action(F.col("churn"))).withColumn("tier", churn_tier(F.col("churn")))


def queue(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending rows, audit rows): cold starts are not queued; one audit row for each queued decision."""
    pending = evaluated.filter(F.col("decision") != "cold_start").withColumn("status", F.lit("pending"))
    audit = pending.select(F.concat(F.lit("reminder_"), "decision").alias("action_type"), F.concat_ws(":", F.col("customer_id").cast("string"), F.col("drug_id").cast("string")).alias("target"), F.col("evaluated_on").alias("day"))
    return pending, audit


def transition_check(changes: DataFrame) -> DataFrame:
    """changes (order_id, status, new_status) with validity and whether an audit row is due."""
    spark = changes.sparkSession
    allowed = spark.createDataFrame([("pending", "completed", False), ("pending", "cancelled", False), ("completed", "cancelled", True)], "status string, new_status string, audit boolean")
    joined = changes.join(F.broadcast(allowed), ["status", "new_status"], "left")
    same = F.col("status") == F.col("new_status")
    return joined.select("order_id", "status", "new_status", F.when(same, "no_op").when(F.col("audit").isNotNull(), "valid").otherwise("rejected").alias("result"), F.coalesce("audit", F.lit(False)).alias("needs_audit"))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not among them."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def keyed_update(rows: DataFrame, changes: DataFrame, key: str, **columns: str) -> DataFrame:
    """Columns set from the change row of the same key where there is one: column="name in changes"."""
    news = changes.select(key, *(F.col(c).alias(f"__new_{n}") for n, c in columns.items()), F.lit(True).alias("__hit"))
    joined = rows.join(news, key, "left")
    for n in columns:
        joined = joined.withColumn(n, F.when(F.col("__hit"), F.col(f"__new_{n}")).otherwise(F.col(n)))
    return joined.select(*rows.columns)


def backfill_by_name(rows: DataFrame, values: DataFrame, name: str, column: str) -> DataFrame:
    norm = F.lower(F.trim(name))
    one = values.groupBy(norm.alias("__name")).agg(F.min(column).alias("__value"))
    joined = rows.join(one, F.lower(F.trim(rows[name])) == F.col("__name"), "left")
    return joined.withColumn(column, F.coalesce("__value", column)).select(*rows.columns)


def keep_listed(parents: DataFrame, children: DataFrame, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents on the keep-list, and their children only."""
    return parents.join(keep.select(key), key, "left_semi"), children.join(keep.select(key), key, "left_semi")


def purge(parents: DataFrame, children: DataFrame, key: str, day: str, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept parents, kept children, audit rows): parents older than the limit go, children first, one audit row each."""
    old = F.col(day) < F.date_sub(F.lit(as_of).cast("date"), days)
    kept = parents.filter(~F.coalesce(old, F.lit(False)))
    audit = parents.filter(old).select(F.lit("purged").alias("action_type"), F.col(key).alias("target"), F.lit(as_of).cast("date").alias("day"))
    return kept, children.join(kept.select(key), key, "left_semi"), audit


def suppress(reminders: DataFrame, hours: int = 24) -> DataFrame:
    """Reminders (customer_id, reminder_id, ts) that are sent: no other was sent to the customer in the hours before. Ties of time go by number.

    Rows of a customer stream through in order and only the last time sent is held, so customers may have any number of reminders.
    """
    wait = hours * 3_600_000_000
    fields = ["customer_id", "reminder_id", "ts"]
    rows = reminders.select(*fields, F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).filter("at is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customer, last = None, None
        for b in batches:
            keep = []
            for c, at in zip(b.column("customer_id").to_pylist(), b.column("at").to_pylist(), strict=True):
                if c != customer:
                    customer, last = c, None
                sent = last is None or at - last > wait
                last = at if sent else last
                keep.append(sent)
            yield b.filter(pa.array(keep, pa.bool_())).select(fields)

    ordered = rows.repartition("customer_id").sortWithinPartitions("customer_id", "at", "reminder_id")
    return ordered.mapInArrow(run, rows.select(*fields).schema)
