"""Purchase cycles: gaps, averages, reminders, at-risk rates and due lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEM_ORDER = ("order_date", "order_id", "line", "part_id", "supplier_id", "ship_date")


def purchases(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items of completed orders, one row each; purchases of one day are not merged."""
    done = orders.filter(F.col("status") == "completed").select("order_id", "customer_id", "order_date")
    return items.join(done, "order_id")


def with_gaps(bought: DataFrame) -> DataFrame:
    """Days since the last purchase of the pair; a full key orders purchases of one day."""
    w = Window.partitionBy("customer_id", "drug_id").orderBy(*ITEM_ORDER)
    return bought.withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)))


def purchase_cycles(bought: DataFrame, lead: float = 0.85) -> DataFrame:
    """Mean gap, last purchase and reminder day of pairs with two purchases or more.

    The mean gap is (last - first) / (n - 1), so one aggregation without a sort does; half days go to the even number.
    """
    grouped = bought.groupBy("customer_id", "drug_id").agg(F.count(F.lit(1)).alias("purchases"), F.min("order_date").alias("first"), F.max("order_date").alias("last_purchase_date")).filter("purchases >= 2")
    mean = F.datediff("last_purchase_date", "first") / (F.col("purchases") - 1)
    days = F.bround(F.lit(lead) * F.col("avg_cycle_days"), 0).cast("int")
    return grouped.withColumn("avg_cycle_days", mean).select("customer_id", "drug_id", "avg_cycle_days", "last_purchase_date", "purchases", F.date_add("last_purchase_date", days).alias("reminder_day"))


def cycle_sanity(cycles: DataFrame, drugs: DataFrame) -> DataFrame:
    """For each drug the intended cycle, the mean of its pairs' own, and the difference."""
    computed = cycles.groupBy("drug_id").agg(F.avg("avg_cycle_days").alias("computed"), F.count(F.lit(1)).alias("pairs"))
    joined = drugs.select("drug_id", F.col("default_cycle_days").alias("intended")).join(computed, "drug_id", "left")
    return joined.withColumn("difference", F.col("computed") - F.col("intended"))


def gap_dispersion(gaps: DataFrame) -> DataFrame:
    """Population standard deviation of the gaps, 0 without any."""
    return gaps.groupBy("customer_id", "drug_id").agg(F.count(F.lit(1)).alias("purchases"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_sd"))


def repeat_pairs(bought: DataFrame, least: int = 2) -> DataFrame:
    return bought.groupBy("customer_id", "drug_id").agg(F.count(F.lit(1)).alias("purchases")).filter(F.col("purchases") >= least)


def at_risk(cycles: DataFrame, as_of: str) -> DataFrame:
    """Cycles that are overdue by their own mean on the day."""
    late = F.date_add("last_purchase_date", F.floor("avg_cycle_days").cast("int")) < F.lit(as_of).cast("date")
    row = cycles.agg(F.count(F.lit(1)).alias("total"), F.count_if(late).alias("at_risk"))
    return row.withColumn("rate_pct", F.round(F.col("at_risk") * 100 / F.greatest("total", F.lit(1)), 1))


def due_for_reminder(cycles: DataFrame, customers: DataFrame, drugs: DataFrame, recent_notices: DataFrame, as_of: str) -> DataFrame:
    """Due drugs nested by customer, without customers who had a notice on the day before or later. recent_notices: (customer_id)."""
    due = cycles.filter(F.col("reminder_day") <= F.lit(as_of).cast("date")).join(recent_notices, "customer_id", "left_anti")
    named = due.join(drugs.select("drug_id", "name"), "drug_id")
    nested = named.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("drug_id", "name", "reminder_day"))).alias("due"))
    return nested.join(customers.select("customer_id", "full_name", "preferred_channel"), "customer_id").withColumn("n_due", F.size("due"))


def refill_alert(cycles: DataFrame, as_of: str, within: int = 14) -> DataFrame:
    left = F.ceil(F.datediff("last_purchase_date", F.lit(as_of).cast("date")) + F.col("avg_cycle_days")).cast("int")
    return cycles.select("customer_id", "drug_id", left.alias("days_left")).withColumn("alert", F.when(F.col("days_left") < 0, "overdue").when(F.col("days_left") <= within, "due").otherwise("none"))


def split_last(gaps: DataFrame) -> DataFrame:
    """Purchases of pairs with three or more, the newest flagged as the hidden target."""
    w = Window.partitionBy("customer_id", "drug_id")
    newest = w.orderBy(*(F.desc(c) for c in ITEM_ORDER))
    return gaps.withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 3").withColumn("is_target", F.row_number().over(newest) == 1)


def around(bought: DataFrame, moments: DataFrame) -> DataFrame:
    """For each (customer_id, drug_id, at): the last purchase on or before the moment and the next one after it."""
    joined = moments.join(bought.select("customer_id", "drug_id", "order_date"), ["customer_id", "drug_id"], "left")
    return joined.groupBy("customer_id", "drug_id", "at").agg(F.max(F.when(F.col("order_date") <= F.col("at"), F.col("order_date"))).alias("last_before"), F.min(F.when(F.col("order_date") > F.col("at"), F.col("order_date"))).alias("next_after"))
