"""Dashboard figures: totals, groups, A/B summaries and customer value.

Every rolling figure takes the day `as_of`; no clock is read. Ties are broken by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def days_before(as_of: str, days: int):
    return F.date_sub(F.lit(as_of).cast("date"), days)


def percent(part, whole, digits: int = 1):
    """part / whole in per cent; 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") * 100 / whole, digits))


def dashboard(customers: DataFrame, orders: DataFrame, items: DataFrame, cycles: DataFrame, as_of: str) -> DataFrame:
    """One row of headline figures; one pass over each table."""
    c = customers.agg(F.count(F.lit(1)).alias("customers"))
    month = (F.col("status") == "completed") & (F.col("order_date") >= days_before(as_of, 30))
    o = orders.agg(
        F.countDistinct(F.when(month, F.col("customer_id"))).alias("active_customers"),
        F.count_if(F.col("status") == "completed").alias("completed_orders"),
        F.count_if(F.col("order_date") >= days_before(as_of, 7)).alias("orders_7d"),
    )
    completed = orders.filter(F.col("status") == "completed").select("order_id")
    r = items.join(completed, "order_id").agg(F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("revenue"))
    y = cycles.agg(F.count(F.lit(1)).alias("cycles"))
    row = c.crossJoin(o).crossJoin(r).crossJoin(y)  # four frames of one row
    return row.withColumn("activity_pct", percent(F.col("active_customers"), F.col("customers"))).withColumn(
        "average_order", F.when(F.col("completed_orders") == 0, F.lit(0.0)).otherwise(F.round(F.col("revenue") / F.col("completed_orders"), 2))
    )


def top_categories(orders: DataFrame, items: DataFrame, drugs: DataFrame, limit: int = 5) -> DataFrame:
    """Items and revenue of completed orders by category. items_per_100_orders can pass 100; share_pct is a true share of revenue."""
    completed = orders.filter(F.col("status") == "completed").select("order_id")
    by_drug = items.join(completed, "order_id").groupBy("drug_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    category = F.coalesce("category", F.lit("Unknown")).alias("category")
    grouped = by_drug.join(drugs.select("drug_id", "category"), "drug_id", "left").groupBy(category).agg(F.sum("n").alias("item_rows"), F.sum("amount").cast("decimal(20,2)").alias("revenue"))
    total = completed.agg(F.count(F.lit(1)).alias("orders")).crossJoin(by_drug.agg(F.sum("amount").alias("all")))
    out = grouped.crossJoin(total).select("category", "item_rows", "revenue", percent(F.col("item_rows"), F.col("orders")).alias("items_per_100_orders"), F.round(F.col("revenue").cast("double") / F.col("all").cast("double") * 100, 4).alias("share_pct"))
    return out.orderBy(F.desc("revenue"), "category").limit(limit)


def model_speed(runs: DataFrame) -> DataFrame:
    """Means over runs with a duration (model, first_token_s, total_s, tokens, gaps): time to first token, tokens a second, mean and largest gap between tokens."""
    timed = runs.filter(F.col("total_s") > 0)
    gaps = timed.select("model", F.explode("gaps").alias("gap")).groupBy("model").agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    speed = timed.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.avg("first_token_s").alias("first_token_s"), F.avg(F.col("tokens") / F.col("total_s")).alias("tokens_per_s"))
    return speed.join(gaps, "model", "left")


def error_summary(rows: DataFrame, error: str) -> DataFrame:
    """Mean character error, how many rows are within .15 and .30, and how many are exact."""
    e = F.col(error)
    return rows.agg(F.count(error).alias("n"), F.round(F.avg(e), 4).alias("mean"), F.count_if(e <= 0.15).alias("within_15"), F.count_if(e <= 0.30).alias("within_30"), F.count_if(e == 0).alias("exact"))


def weekly_variants(results: DataFrame, sent_at: str = "sent_at") -> DataFrame:
    """Sent, converted and rate of every variant by week (from Monday). results: (variant, converted, sent_at)."""
    week = F.to_date(F.date_trunc("week", sent_at)).alias("week")
    grouped = results.groupBy(week, "variant").agg(F.count(F.lit(1)).alias("sent"), F.count_if("converted").alias("converted"))
    return grouped.withColumn("rate_pct", percent(F.col("converted"), F.col("sent")))


def variant_stats(results: DataFrame, variants: DataFrame) -> DataFrame:
    """Sent, converted and rate for every listed variant, zeros where one has no rows. results: (variant, converted)."""
    grouped = results.groupBy("variant").agg(F.count(F.lit(1)).alias("sent"), F.count_if("converted").alias("converted"))
    zero = F.lit(0).cast("long")
    full = variants.join(grouped, "variant", "left").select("variant", F.coalesce("sent", zero).alias("sent"), F.coalesce("converted", zero).alias("converted"))
    return full.withColumn("rate_pct", percent(F.col("converted"), F.col("sent")))


def ab_winner(stats: DataFrame, a: str, b: str, least: int = 10, margin: float = 2.0) -> DataFrame:
    """One row: the variant that leads by more than `margin` points, `tie`, or null while one has under `least` sent."""
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{'a' if v == a else 'b'}")
    row = stats.agg(*(pick(v, c) for v in (a, b) for c in ("sent", "rate_pct")))
    enough = (F.col("sent_a") >= least) & (F.col("sent_b") >= least)
    ahead = F.col("rate_pct_a") - F.col("rate_pct_b")
    return row.withColumn("winner", F.when(enough & (ahead > margin), a).when(enough & (-ahead > margin), b).when(enough, "tie"))


def period_sales(orders: DataFrame, items: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Revenue of completed orders of the last days; item rows and distinct orders apart, as sources count one or the other."""
    recent = orders.filter((F.col("status") == "completed") & (F.col("order_date") >= days_before(as_of, days))).select("order_id")
    return items.join(recent, "order_id").agg(
        F.count(F.lit(1)).alias("item_rows"), F.countDistinct("order_id").alias("orders"), F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("revenue")
    )


def status_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def top_seller(orders: DataFrame, items: DataFrame, drugs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = orders.filter((F.col("status") == "completed") & (F.col("order_date") >= days_before(as_of, days))).select("order_id")
    sold = items.join(recent, "order_id").groupBy("drug_id").agg(F.sum("quantity").alias("quantity"))
    return sold.join(drugs.select("drug_id", "name"), "drug_id").groupBy("name").agg(F.sum("quantity").alias("quantity")).orderBy(F.desc("quantity"), "name").limit(1)


def category_census(drugs: DataFrame) -> DataFrame:
    return drugs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def customer_value(customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Orders, spending, average order, lifetime value and tenure (at least 0.1 years) of every customer with an order."""
    spent = items.groupBy("order_id").agg(F.sum("amount").alias("amount"))
    done = orders.filter(F.col("status") == "completed").join(spent, "order_id", "left")
    grouped = done.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_spent"), F.min("order_date").alias("first"))
    average = F.round(F.col("total_spent") / F.col("order_count"), 6)
    tenure = F.greatest(F.datediff(F.lit(as_of).cast("date"), "first") / 365.25, F.lit(0.1))
    return customers.select("customer_id").join(grouped, "customer_id").select("customer_id", "order_count", "total_spent", average.alias("average_order"), F.round("total_spent", 0).alias("lifetime_value"), F.round(tenure, 4).alias("tenure_years"))


def recent_orders_with_names(orders: DataFrame, items: DataFrame, drugs: DataFrame, limit: int = 5) -> DataFrame:
    """The newest orders that have items, with amount and the names of their drugs in order."""
    newest = orders.join(items.select("order_id").distinct(), "order_id", "left_semi").orderBy(F.desc("order_date"), F.desc("order_id")).limit(limit)
    lines = items.join(F.broadcast(newest.select("order_id", "order_date")), "order_id").join(drugs.select("drug_id", "name"), "drug_id")
    return lines.groupBy("order_id", "order_date").agg(F.sum("amount").cast("decimal(20,2)").alias("amount"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))


def orders_per_customer(customers: DataFrame, orders: DataFrame, limit: int = 5) -> DataFrame:
    counts = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return customers.select("customer_id").join(counts, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("orders")).orderBy(F.desc("orders"), "customer_id").limit(limit)


#: Sorted blocks of values in nearest_rank(); so many bounds at most reach the driver.
RANK_BLOCKS = 64


def nearest_rank(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """sorted[int(n * q)] for each q, capped at the last; the rank is found on counts of distinct values, not on all rows in one task.

    The values are cut into up to RANK_BLOCKS sorted blocks at bounds that are looked up first, so that a block is the same however often
    the plan is run.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    from pyspark.sql import Window

    bounds = counts.agg(F.percentile_approx("v", [i / RANK_BLOCKS for i in range(1, RANK_BLOCKS)])).first()[0] or []
    block = sum((F.when(F.col("v") > F.lit(b), 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    blocks = counts.withColumn("block", block)
    starts = blocks.groupBy("block").agg(F.sum("n").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("v"))
    ranked = blocks.withColumn("upto", within).join(F.broadcast(starts.select("block", "before")), "block").crossJoin(total)
    upto = F.col("upto") + F.col("before")
    picks = [F.min(F.when(upto >= F.least(F.floor(F.col("total") * q) + 1, F.col("total")), F.col("v"))).alias(f"p{round(q * 100)}") for q in shares]
    return ranked.agg(F.max("total").alias("n"), *picks)


def distribution(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts with per cent of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).crossJoin(total).select(*keys, "n", percent(F.col("n"), F.col("total")).alias("pct"))


def table_census(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts and scores of a 0/1 prediction; ratios without a denominator are 0."""
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p))
    row = rows.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return row.select("*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def threshold_sweep(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Precision, recall and F1 at 0.05, 0.06, ..., 0.94; counts by the hundredth first, so the grid meets a hundred rows and not all."""
    cell = F.floor(F.round(F.col(score) * 100, 6)).cast("int")
    counts = rows.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = rows.sparkSession.range(5, 95).select(F.col("id").cast("int").alias("t"))
    at = counts.crossJoin(F.broadcast(grid)).groupBy("t").agg(F.sum(F.when(F.col("cell") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("all"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))
    tp, fp, every = F.col("tp"), F.col("fp"), F.col("all")
    return at.select((F.col("t") / 100).alias("threshold"), ratio(tp, tp + fp).alias("precision"), ratio(tp, every).alias("recall"), ratio(2 * tp, tp + fp + every).alias("f1"))


def best_threshold(rows: DataFrame, label: str, score: str) -> DataFrame:
    """The first threshold of the sweep with the best F1."""
    return threshold_sweep(rows, label, score).orderBy(F.desc("f1"), "threshold").limit(1)
