"""The retail model over the driver's star-schema tables.

Each function makes one table of the model (tenants, customers, drugs, orders, ...) from the Parquet tables of a folder, with
only the columns that the model needs, so that projections reach the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last order date of the tables: the default day of every rolling query.
AS_OF = "2001-08-01"
MONEY = "decimal(18,2)"


@dataclass
class Retail:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tenants(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("int").alias("tenant_id"), F.col("n_name").alias("name"))

    def customers(self) -> DataFrame:
        c = F.col("c_custkey")
        channel = F.element_at(F.array(*(F.lit(x) for x in ("whatsapp", "email", "sms"))), (c % 3 + 1).cast("int"))
        phone = F.when(c % 7 != 0, F.concat(F.lit("+20"), c.cast("string")))
        return self.raw("customer").select(
            c.alias("customer_id"), F.col("c_nationkey").cast("int").alias("tenant_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("age_group"),
            channel.alias("preferred_channel"), phone.alias("phone"), F.concat(F.lit("c"), c.cast("string"), F.lit("@example.com")).alias("email"),
        )

    def _brand(self) -> DataFrame:
        return self.raw("part").select("p_partkey", F.expr("cast(substring(p_brand, 7) as int)").alias("drug_id"), "p_brand", F.col("p_retailprice").cast(MONEY).alias("price"))

    def drugs(self) -> DataFrame:
        """One row for each brand: bounded by the brands, small enough to broadcast."""
        d = F.col("drug_id")
        grouped = self._brand().groupBy("drug_id", F.col("p_brand").alias("name")).agg((F.sum("price").cast("double") / F.count("price")).alias("mean"))
        return grouped.select(
            "drug_id", "name", F.concat(F.lit("cat"), (d % 5).cast("string")).alias("category"), F.round("mean", 2).cast("decimal(10,2)").alias("base_price"),
            (d % 2 == 0).alias("is_chronic"), (30 + 15 * (d % 4)).cast("int").alias("default_cycle_days"),
        )

    def orders(self) -> DataFrame:
        status = F.expr("case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end")
        channel = F.element_at(F.array(*(F.lit(x) for x in ("web", "app", "store"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
        return self.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"), status.alias("status"), channel.alias("channel"))

    def items(self) -> DataFrame:
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), F.to_date("l_shipdate").alias("ship_date"),
            F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        )
        brands = self._brand().select(F.col("p_partkey").alias("part_id"), "drug_id")
        return lines.join(brands, "part_id")

    def inventory(self) -> DataFrame:
        key = (F.col("supplier_id") + F.col("drug_id")) % 2 == 0
        grouped = self.items().groupBy("supplier_id", "drug_id").agg((F.sum("quantity") % 50).cast("int").alias("stock_level"), F.sum("amount").alias("sold"))
        return grouped.select("supplier_id", "drug_id", "stock_level", F.lit(10).alias("reorder_point"), F.when(~key, (F.col("sold") % 900).cast("decimal(10,2)")).alias("tenant_price"))

    def interactions(self) -> DataFrame:
        d = self.drugs().select("drug_id")
        pairs = d.select(F.col("drug_id").alias("a")).join(d.select(F.col("drug_id").alias("b")), F.col("a") < F.col("b"))
        severity = F.element_at(F.array(*(F.lit(x) for x in ("low", "medium", "high"))), ((F.col("a") + F.col("b")) % 3 + 1).cast("int"))
        return pairs.filter((F.col("a") * 31 + F.col("b")) % 7 == 0).select("a", "b", severity.alias("severity"))

    def events(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("event_seq"), "event_id", "ts", "event_type", "value", F.col("props").alias("payload"))

    def notifications(self) -> DataFrame:
        """Clicks as messages sent, with their A/B variant."""
        variant = F.when(F.col("event_id") % 2 == 0, "discount").otherwise("plain")
        return self.events().filter(F.col("event_type") == "click").select(F.col("event_id").alias("notification_id"), F.col("session_id").alias("customer_id"), variant.alias("variant"), F.col("ts").alias("sent_at"))

    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    def documents(self) -> DataFrame:
        return self.raw("documents")

    def embeddings(self) -> DataFrame:
        return self.raw("embeddings")
