"""Filters, joins, sorting and paging over the retail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter values that mean "no filter".
NO_FILTER = ("", "all", "all statuses")


def filter_optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; None and the words for "all" are skipped, a text status is compared in lower case."""
    for column, value in wanted.items():
        if value is None or (isinstance(value, str) and value.lower() in NO_FILTER):
            continue
        df = df.filter(F.col(column) == (value.lower() if column == "status" else value))
    return df


def search(df: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows where any column contains the trimmed text, whatever the case."""
    if not text or not text.strip():
        return df
    pattern = "%" + text.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit: Column | None = None
    for c in columns:
        hit = F.col(c).ilike(pattern) if hit is None else hit | F.col(c).ilike(pattern)
    return df.filter(hit)


def between_days(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Both ends inclusive by day, written as a half-open range so that row groups are pruned."""
    if first:
        df = df.filter(F.col(column) >= F.lit(first).cast("date"))
    if last:
        df = df.filter(F.col(column) < F.date_add(F.lit(last).cast("date"), 1))
    return df


def scoped(df: DataFrame, customers: DataFrame, tenant_id: int) -> DataFrame:
    """Rows of the tenant's customers."""
    return df.join(customers.filter(F.col("tenant_id") == tenant_id).select("customer_id"), "customer_id", "left_semi")


def blank(c: Column) -> Column:
    """Null, blank after trimming, or the word null."""
    return c.isNull() | F.trim(c).isin("", "null")


def contact_route(customers: DataFrame) -> DataFrame:
    """Channels that need a phone fall back to email without one; other channels use email."""
    phone = F.nullif(F.trim("phone"), F.lit(""))
    by_phone = F.col("preferred_channel").isin("whatsapp", "sms")
    return customers.select(
        "customer_id", "preferred_channel", F.when(by_phone & phone.isNotNull(), phone).otherwise(F.col("email")).alias("contact"),
        F.when(by_phone & phone.isNull(), "email").otherwise(F.col("preferred_channel")).alias("used_channel"), (by_phone & phone.isNull()).alias("is_fallback"),
    )


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    value = F.col(column)
    for old, new in mapping.items():
        value = F.when(F.col(column) == old, F.lit(new)).otherwise(value)
    return df.withColumn(column, value)


def loose_boolean(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))) == "true"


def safe_sort(df: DataFrame, by: str | None, descending: bool, allowed: tuple[str, ...], key: str) -> DataFrame:
    column = by if by in allowed else allowed[0]
    return df.orderBy(F.desc(column) if descending else F.asc(column), key)


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page in a total order, with the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(total)


def page_after(df: DataFrame, size: int, key: str, last=None) -> DataFrame:
    """Keyset paging: the next rows after the last key seen, without counting over the earlier ones."""
    return (df if last is None else df.filter(F.col(key) > last)).orderBy(key).limit(size)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """The n rows of smallest hash: the same rows at every run and any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def customers_with_counts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"))
    return customers.join(counts, "customer_id", "left").withColumn("order_count", F.coalesce("order_count", F.lit(0)))


def order_view(orders: DataFrame, items: DataFrame, drugs: DataFrame) -> DataFrame:
    """Every order with its total and its items nested in line order; orders without items have an empty list."""
    named = items.join(drugs.select("drug_id", "name"), "drug_id", "left")
    line = F.struct("line", "part_id", "supplier_id", "ship_date", "name", "quantity", "amount")
    nested = named.groupBy("order_id").agg(F.sum("amount").alias("total"), F.sort_array(F.collect_list(line)).alias("items"))
    return orders.join(nested, "order_id", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("decimal(20,2)")).withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)))


def unique_name_resolution(requests: DataFrame, people: DataFrame) -> DataFrame:
    """requests (request_id, customer_id?, tenant_id, full_name): by id, else by name if the tenant has exactly one such name."""
    by_name = people.groupBy("tenant_id", "full_name").agg(F.count(F.lit(1)).alias("n"), F.min("customer_id").alias("named")).filter("n = 1").drop("n")
    known = people.select(F.col("customer_id").alias("known"))
    joined = requests.join(known, F.col("customer_id") == F.col("known"), "left").join(by_name, ["tenant_id", "full_name"], "left")
    return joined.select("request_id", F.coalesce("known", "named").alias("resolved"))


def name_join(left: DataFrame, right: DataFrame, name: str, key: str) -> DataFrame:
    """Join on the trimmed lower-case name; of several right rows the one with the smallest key."""
    norm = F.lower(F.trim(name))
    first = Window.partitionBy("__name").orderBy(key)
    one = right.withColumn("__name", norm).withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth", name)
    return left.withColumn("__name", norm).join(one, "__name").drop("__name")


def latest_child(parents: DataFrame, children: DataFrame, key: str, *order: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return parents.join(children.withColumn("__nth", F.row_number().over(newest)).filter("__nth = 1").drop("__nth"), key, "left")


def recent_n(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= n)


def best_and_margin(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Best row of each key and its lead over the second (null without one)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = df.withColumn("margin", F.col(score) - F.lead(score).over(w)).withColumn("__nth", F.row_number().over(w))
    return ranked.filter("__nth = 1").drop("__nth")


def top_with_backfill(scored: DataFrame, catalog: DataFrame, k: int, key: str, score: str, fill: str) -> DataFrame:
    """The k best by score; missing places go to the highest `fill` among the others."""
    best = scored.orderBy(F.desc(score), key).limit(k).select(key, F.lit(0).alias("source"), F.col(score).cast("double").alias("value"))
    rest = catalog.join(best.select(key), key, "left_anti").orderBy(F.desc(fill), key).limit(k).select(key, F.lit(1).alias("source"), F.col(fill).cast("double").alias("value"))
    return best.unionByName(rest).orderBy("source", F.desc("value"), key).limit(k)


#: Rows of a stratum are dealt in 16 to this power cells by the first digits of their digest.
CELL_DIGITS = 3


def first_share(rows: DataFrame, stratum: str, digest: Column, keys: tuple[str, ...], share: float, flag: str) -> DataFrame:
    """rows with `flag`: true for the first floor(share * n) rows of each stratum in the order of digest (hexadecimal) and keys.

    Ranks are counted inside cells of the digest and offset by the sizes of the cells before, so that no stratum is one task's.
    """
    dealt = rows.withColumn("__digest", digest).withColumn("__cell", F.substring("__digest", 1, CELL_DIGITS))
    sizes = dealt.groupBy(F.col(stratum).alias("__stratum"), F.col("__cell").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__stratum")
    before = F.sum("__n").over(w.orderBy("__at")) - F.col("__n")
    quota = F.floor(F.sum("__n").over(w) * F.lit(share))
    cells = sizes.select("__stratum", "__at", before.alias("__before"), quota.alias("__quota"))
    nth = F.row_number().over(Window.partitionBy(stratum, "__cell").orderBy("__digest", *keys))
    ranked = dealt.withColumn("__nth", nth)
    joined = ranked.join(cells, F.col(stratum).eqNullSafe(F.col("__stratum")) & (F.col("__cell") == F.col("__at")))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns if c != flag), (F.col("__before") + F.col("__nth") <= F.col("__quota")).alias(flag))
