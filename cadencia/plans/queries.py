"""The registered queries over the driver's tables, each beside its DuckDB form.

name: (query over a Retail adapter, DuckDB SQL or None). Names begin with the operator's number in the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadencia.functions import text as tx
from cadencia.functions import vectors as vc
from cadencia.operators import baskets, chain, conversation, cycles, dataset, features, governance, kpi, lookups, matching, retrieval
from cadencia.plans.oracle import sql
from cadencia.sources import scratch
from cadencia.sources.fixtures import AS_OF, Retail
from cadencia.sources.keyed import KeyedTable

Query = Callable[[Retail], DataFrame]
D = f"date '{AS_OF}'"
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, oracle: str | None = None):
    def put(f: Query) -> Query:
        REGISTRY[name] = (f, sql(oracle) if oracle else None)
        return f

    return put


def bought(r: Retail) -> DataFrame:
    return cycles.purchases(r.orders(), r.items())


def the_cycles(r: Retail) -> DataFrame:
    return cycles.purchase_cycles(bought(r))


# ---- dashboards and aggregates -------------------------------------------------------------------------------------------------

query("a1_dashboard", f"""select (select count(*) from customers) customers, c.*, (select count(*) from cycles) cycles,
 case when (select count(*) from customers)=0 then 0 else round(active_customers*100.0::double/(select count(*) from customers),1) end activity_pct,
 case when completed_orders=0 then 0 else round(revenue/completed_orders,2) end average_order from (
 select count(distinct case when status='completed' and order_date>={D}-30 then customer_id end) active_customers, count(*) filter (status='completed') completed_orders,
 count(*) filter (order_date>={D}-7) orders_7d, (select coalesce(sum(amount)::double,0) from done) revenue from ord) c""")(
    lambda r: kpi.dashboard(r.customers(), r.orders(), r.items(), the_cycles(r), AS_OF)
)
query("a2_top_categories", """select coalesce(category,'Unknown') category, count(*) item_rows, sum(amount)::decimal(20,2) revenue, round(count(*)*100::double/(select count(*) from ord where status='completed'),1) items_per_100_orders,
 round(sum(amount)::double/(select sum(amount)::double from done)*100,4) share_pct from done left join drugs using(drug_id) group by 1 order by revenue desc, category limit 5""")(
    lambda r: kpi.top_categories(r.orders(), r.items(), r.drugs())
)

VARIANTS = "(select n.variant, exists(select 1 from ev e where e.session_id=n.customer_id and e.event_type='purchase' and e.ts>n.sent_at and e.ts<=n.sent_at + interval 3 day) converted from notifications n)"


def ab_rows(r: Retail) -> DataFrame:
    """Messages with whether their customer bought within three days; both sides meet on customer and day blocks, not on all days."""
    n = r.notifications()
    buys = r.events().filter(F.col("event_type") == "purchase").select(F.col("session_id").alias("customer_id"), F.col("ts").alias("bought"))
    near = n.withColumn("day", F.explode(F.sequence(F.to_date("sent_at"), F.date_add(F.to_date("sent_at"), 3))))
    met = near.join(buys.withColumn("day", F.to_date("bought")), ["customer_id", "day"]).filter((F.col("bought") > F.col("sent_at")) & (F.col("bought") <= F.col("sent_at") + F.expr("interval 3 days")))
    hit = met.select("notification_id").distinct().withColumn("converted", F.lit(True))
    return n.join(hit, "notification_id", "left").withColumn("converted", F.coalesce("converted", F.lit(False)))


def variants(r: Retail) -> DataFrame:
    return r.spark.createDataFrame([("discount",), ("plain",), ("control",)], "variant string")


STATS = f"(select v.variant, count(x.variant) sent, count(*) filter (x.converted) converted, case when count(x.variant)=0 then 0 else round(count(*) filter (x.converted)*100::double/count(x.variant),1) end rate_pct from (values ('discount'),('plain'),('control')) v(variant) left join {VARIANTS} x on x.variant=v.variant group by v.variant)"
query("a3_variant_stats", f"select * from {STATS}")(lambda r: kpi.variant_stats(ab_rows(r), variants(r)))
query("a4_ab_winner", f"""select *, case when sent_a>=10 and sent_b>=10 then case when rate_pct_a-rate_pct_b>2 then 'discount' when rate_pct_b-rate_pct_a>2 then 'plain' else 'tie' end end winner from (select max(sent) filter (variant='discount') sent_a,
 max(rate_pct) filter (variant='discount') rate_pct_a, max(sent) filter (variant='plain') sent_b, max(rate_pct) filter (variant='plain') rate_pct_b from {STATS})""")(
    lambda r: kpi.ab_winner(kpi.variant_stats(ab_rows(r), variants(r)), "discount", "plain")
)
query("a5_weekly_sales", f"select count(*) item_rows, count(distinct order_id) orders, coalesce(sum(amount)::double,0) revenue from done where order_date>={D}-7")(lambda r: kpi.period_sales(r.orders(), r.items(), AS_OF))
query("a6_status_counts", "select count(*) total, count(*) filter (status='completed') n_completed, count(*) filter (status='pending') n_pending, count(*) filter (status='cancelled') n_cancelled from ord")(lambda r: kpi.status_counts(r.orders(), "status", ["completed", "pending", "cancelled"]))
query("a7_top_seller", f"select name, sum(quantity) quantity from done join drugs using(drug_id) where order_date>={D}-30 group by name order by 2 desc, 1 limit 1")(lambda r: kpi.top_seller(r.orders(), r.items(), r.drugs(), AS_OF))
query("a9_category_census", "select category, count(*) n from drugs group by 1")(lambda r: kpi.category_census(r.drugs()))
query("a10_max_confidence", "select b, max(confidence) confidence from affinities group by b")(lambda r: baskets.affinities(r.items()).groupBy("b").agg(F.max("confidence").alias("confidence")))
query("a11_repeat_pairs", "select customer_id, drug_id, count(*) purchases from done group by all having count(*)>=2")(lambda r: cycles.repeat_pairs(bought(r)))
query("a12_purchase_cycles", "select customer_id, drug_id, round(avg_cycle_days,6) avg_cycle_days, last_purchase_date, purchases, reminder_day from cycles")(lambda r: the_cycles(r).withColumn("avg_cycle_days", F.round("avg_cycle_days", 6)))
query("a13_distinct_orders", f"select count(distinct order_id) orders, coalesce(sum(amount)::double,0) revenue from done where order_date>={D}-30")(lambda r: kpi.period_sales(r.orders(), r.items(), AS_OF, 30).select("orders", "revenue"))
query("a14_at_risk", f"select count(*) total, count(*) filter (last_purchase_date+floor(avg_cycle_days)::int<{D}) at_risk, round(count(*) filter (last_purchase_date+floor(avg_cycle_days)::int<{D})*100::double/greatest(count(*),1),1) rate_pct from cycles")(lambda r: cycles.at_risk(the_cycles(r), AS_OF))
query("a15_customer_value", f"""select customer_id, count(*) order_count, coalesce(sum(amt),0)::double total_spent, round(coalesce(sum(amt),0)::double/count(*),6) average_order, round(coalesce(sum(amt),0)::double,0) lifetime_value,
 round(greatest(({D}-min(order_date))/365.25::double,0.1::double),4) tenure_years from customers join ord using(customer_id) left join (select order_id, sum(amount) amt from items group by 1) using(order_id) where status='completed' group by customer_id""")(
    lambda r: kpi.customer_value(r.customers(), r.orders(), r.items(), AS_OF)
)
query("a16_recent_orders", "select order_id, order_date, sum(amount)::decimal(20,2) amount, string_agg(name, ', ' order by name) as names from items join (select order_id, order_date from ord semi join items using(order_id) order by order_date desc, order_id desc limit 5) using(order_id) join drugs using(drug_id) group by 1,2")(lambda r: kpi.recent_orders_with_names(r.orders(), r.items(), r.drugs()))
query("a17_orders_per_customer", "select customer_id, count(order_id) orders from customers left join ord using(customer_id) group by 1 order by 2 desc, 1 limit 5")(lambda r: kpi.orders_per_customer(r.customers(), r.orders()))
query("a18_due_nested", f"""select customer_id, string_agg(drug_id||':'||reminder_day, ',' order by drug_id, name, reminder_day) due, full_name, preferred_channel, count(*) n_due from cycles join drugs using(drug_id) join customers using(customer_id)
 where reminder_day<={D} and customer_id not in (select customer_id from ord where order_date>={D}-60) group by customer_id, full_name, preferred_channel""")(
    lambda r: cycles.due_for_reminder(the_cycles(r), r.customers(), r.drugs(), r.orders().filter(F.col("order_date") >= kpi.days_before(AS_OF, 60)).select("customer_id"), AS_OF)
    .withColumn("due", F.array_join(F.transform("due", lambda d: F.concat_ws(":", d["drug_id"].cast("string"), d["reminder_day"].cast("string"))), ","))
)
query("a19_gap_dispersion", "select customer_id, drug_id, count(*) purchases, round(coalesce(stddev_pop(gap),0),4) gap_sd from gaps group by 1,2")(lambda r: cycles.gap_dispersion(cycles.with_gaps(bought(r))).withColumn("gap_sd", F.round("gap_sd", 4)))
query("a20_nearest_rank", "select count(*) n, min(v) filter (k>=least(floor(n*0.5)+1,n)) p50, min(v) filter (k>=least(floor(n*0.95)+1,n)) p95 from (select value v, row_number() over (order by value) k, count(*) over () n from ev where value is not null)")(lambda r: kpi.nearest_rank(r.events(), "value", [0.5, 0.95]))
query("a21_pass_rate", "select round(avg((quality=1)::int)*100,4) pass_pct, count(*) n from labels")(lambda r: r.raw("labels").agg(F.round(F.avg((F.col("quality") == 1).cast("int")) * 100, 4).alias("pass_pct"), F.count(F.lit(1)).alias("n")))
query("a26_text_statistics", "select count(*) n, round(avg(n_chars),4) mean, min(n_chars) least, max(n_chars) most, sum(n_chars)::bigint total, max(n_chars) filter (k=n//2+1) upper_median from (select n_chars, row_number() over (order by n_chars) k, count(*) over () n from documents)")(lambda r: dataset.set_statistics(r.documents(), F.col("n_chars")))
query("a27_distribution", "select lang, count(*) n, round(count(*)*100::double/(select count(*) from documents),1) pct from documents group by lang")(lambda r: kpi.distribution(r.documents(), "lang"))
query("a31_table_census", "select 'customers' table_name, count(*) n from customers union all select 'orders', count(*) from ord union all select 'items', count(*) from items union all select 'orders_without_items', count(*) from ord anti join items using(order_id)")(
    lambda r: kpi.table_census({"customers": r.customers(), "orders": r.orders(), "items": r.items(), "orders_without_items": r.orders().join(r.items(), "order_id", "left_anti")})
)

SCORED = "(select doc_id, quality y, (doc_id*7919%100)/100.0::double score from labels where quality is not null)"


def scored(r: Retail) -> DataFrame:
    return r.raw("labels").filter(F.col("quality").isNotNull()).select(F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 100) / 100).alias("score"))


query("a23_confusion", f"""select *, round((tp+tn)/(tp+fp+tn+fn),6) accuracy, case when tp+fp=0 then 0 else round(tp/(tp+fp),6) end as precision, case when tp+fn=0 then 0 else round(tp/(tp+fn),6) end recall, case when 2*tp+fp+fn=0 then 0 else round(2*tp/(2*tp+fp+fn),6) end f1,
 case when fp+tn=0 then 0 else round(fp/(fp+tn),6) end fpr from (select count(*) filter (y=1 and score>=.5) tp, count(*) filter (y=0 and score>=.5) fp, count(*) filter (y=0 and score<.5) tn, count(*) filter (y=1 and score<.5) fn from {SCORED})""")(
    lambda r: kpi.confusion(scored(r).withColumn("p", (F.col("score") >= 0.5).cast("int")), "y", "p")
)
query("a24_absolute_error", f"select round(avg(abs(y-score)),6) mae from {SCORED}")(lambda r: scored(r).agg(F.round(F.avg(F.abs(F.col("y") - F.col("score"))), 6).alias("mae")))
SWEEP = f"(select t/100.0::double threshold, tp, fp, n from (select t, count(*) filter (y=1 and floor(round(score*100,6))>=t) tp, count(*) filter (y=0 and floor(round(score*100,6))>=t) fp, count(*) filter (y=1) n from {SCORED} cross join range(5,95) g(t) group by t))"
SWEPT = f"(select threshold, case when tp+fp=0 then 0 else round(tp/(tp+fp),6) end as precision, case when n=0 then 0 else round(tp/n,6) end recall, case when tp+fp+n=0 then 0 else round(2*tp/(tp+fp+n),6) end f1 from {SWEEP})"
query("a25_threshold_sweep", f"select * from {SWEPT}")(lambda r: kpi.threshold_sweep(scored(r), "y", "score"))
query("a25_best_threshold", f"select * from {SWEPT} order by f1 desc, threshold limit 1")(lambda r: kpi.best_threshold(scored(r), "y", "score"))

# ---- filters, joins, paging ----------------------------------------------------------------------------------------------------

query("p1_conjunction", "select order_id from ord where status='completed' and customer_id=7")(lambda r: r.orders().filter((F.col("status") == "completed") & (F.col("customer_id") == 7)).select("order_id"))
query("p2_optional_filters", "select * from ord where status='pending'")(lambda r: lookups.filter_optional(r.orders(), status="Pending", channel="All", customer_id=None))
query("p3_search", "select * from drugs where name ilike '%#1%' or category ilike '%#1%'")(lambda r: lookups.search(r.drugs(), " #1 ", "name", "category"))
query("p4_day_range", "select order_id, order_date from ord where order_date between date '1997-03-01' and date '1997-03-31'")(lambda r: lookups.between_days(r.orders(), "order_date", "1997-03-01", "1997-03-31").select("order_id", "order_date"))
query("p5_rolling_window", f"select count(*) n from ord where order_date>={D}-30")(lambda r: r.orders().filter(F.col("order_date") >= kpi.days_before(AS_OF, 30)).agg(F.count(F.lit(1)).alias("n")))
query("p6_in_lists", "select drug_id, count(*) n from items where drug_id in (11,12,13) and supplier_id not in (1,2) group by 1")(lambda r: r.items().filter(F.col("drug_id").isin(11, 12, 13) & ~F.col("supplier_id").isin(1, 2)).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")))
query("p7_tenant_scope", "select o.* from ord o semi join (select customer_id from customers where tenant_id=3) using(customer_id)")(lambda r: lookups.scoped(r.orders(), r.customers(), 3).select("order_id", "customer_id", "order_date", "status", "channel"))
query("p8_null_fallback", "select supplier_id, drug_id, coalesce(tenant_price, base_price) price from inventory join drugs using(drug_id)")(lambda r: r.inventory().join(r.drugs(), "drug_id").select("supplier_id", "drug_id", F.coalesce("tenant_price", "base_price").alias("price")))
query("p9_contact_route", """select customer_id, preferred_channel, case when preferred_channel in ('whatsapp','sms') and phone is not null then phone else email end contact, case when preferred_channel in ('whatsapp','sms') and phone is null then 'email' else preferred_channel end used_channel,
 preferred_channel in ('whatsapp','sms') and phone is null is_fallback from customers""")(lambda r: lookups.contact_route(r.customers()))  # fmt: skip
query("p10_line_subtotal", "select order_id, line, part_id, supplier_id, ship_date, base_price*quantity subtotal from items join drugs using(drug_id)")(lambda r: r.items().join(r.drugs(), "drug_id").select("order_id", "line", "part_id", "supplier_id", "ship_date", (F.col("base_price") * F.col("quantity")).alias("subtotal")))
query("p11_missing_text", "select count(*) filter (phone is null or trim(phone) in ('','null')) missing, count(*) n from customers")(lambda r: r.customers().agg(F.count_if(lookups.blank(F.col("phone"))).alias("missing"), F.count(F.lit(1)).alias("n")))
query("p12_like_census", "select count(*) filter (full_name like 'Customer#0000001%') prefixed, count(*) filter (email like '%@example.com') suffixed from customers")(lambda r: r.customers().agg(F.count_if(F.col("full_name").like("Customer#0000001%")).alias("prefixed"), F.count_if(F.col("email").like("%@example.com")).alias("suffixed")))
query("p13_loose_casts", "select event_id, lower(trim((value>50)::varchar))='true' flag, coalesce(try_cast(props as double),0) number from events")(lambda r: r.events().select("event_id", lookups.loose_boolean(F.col("value") > 50).alias("flag"), F.coalesce(F.expr("try_cast(payload as double)"), F.lit(0.0)).alias("number")))
query("p14_recode", "select case category when 'cat0' then 'vitamins' when 'cat1' then 'skin' else category end category, count(*) n from drugs group by 1")(lambda r: lookups.recode(r.drugs(), "category", {"cat0": "vitamins", "cat1": "skin"}).groupBy("category").agg(F.count(F.lit(1)).alias("n")))
query("j1_inner", "select status, count(*) n, sum(amount)::decimal(20,2) amount from ord join items using(order_id) group by 1")(lambda r: r.orders().join(r.items(), "order_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(20,2)").alias("amount")))
query("j2_star", "select category, channel, sum(quantity)::bigint quantity from items join ord using(order_id) join drugs using(drug_id) group by 1,2")(lambda r: r.items().join(r.orders(), "order_id").join(r.drugs(), "drug_id").groupBy("category", "channel").agg(F.sum("quantity").alias("quantity")))
query("j3_dimension_lookup", "select supplier_id, drug_id, name, category, stock_level, stock_level<reorder_point low from inventory join drugs using(drug_id)")(lambda r: r.inventory().join(r.drugs(), "drug_id").select("supplier_id", "drug_id", "name", "category", "stock_level", (F.col("stock_level") < F.col("reorder_point")).alias("low")))
query("j4_customer_counts", "select customer_id, full_name, count(order_id) order_count from customers left join ord using(customer_id) group by 1,2")(lambda r: lookups.customers_with_counts(r.customers(), r.orders()).select("customer_id", "full_name", "order_count"))
query("j5_left_outer", "select order_id, full_name, email from ord left join customers using(customer_id)")(lambda r: r.orders().join(r.customers(), "customer_id", "left").select("order_id", "full_name", "email"))
query("j6_left_chain", "select customer_id, count(distinct o.order_id) orders, coalesce(sum(amount),0)::decimal(20,2) amount from customers left join (select * from ord where status='completed') o using(customer_id) left join items i on i.order_id=o.order_id group by 1")(
    lambda r: r.customers().join(r.orders().filter("status = 'completed'"), "customer_id", "left").join(r.items(), "order_id", "left").groupBy("customer_id").agg(F.countDistinct("order_id").alias("orders"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(20,2)").alias("amount"))
)
query("j7_orders_without_items", "select order_id from ord anti join items using(order_id)")(lambda r: r.orders().join(r.items(), "order_id", "left_anti").select("order_id"))
query("j8_recent_excluded", f"select customer_id from customers where customer_id not in (select customer_id from ord where order_date>={D}-90)")(lambda r: r.customers().join(r.orders().filter(F.col("order_date") >= kpi.days_before(AS_OF, 90)), "customer_id", "left_anti").select("customer_id"))
query("j9_exists", "select count(*) n from ev where exists(select 1 from customers c where c.customer_id=ev.session_id and tenant_id<5)")(lambda r: r.events().join(r.customers().filter("tenant_id < 5").select(F.col("customer_id").alias("session_id")), "session_id", "left_semi").agg(F.count(F.lit(1)).alias("n")))
query("j10_basket_interactions", "select order_id, a, b, severity from (select distinct x.order_id, x.drug_id a, y.drug_id b from items x join items y on x.order_id=y.order_id and x.drug_id<y.drug_id) join interactions using(a,b)")(lambda r: baskets.basket_interactions(r.items(), r.interactions()).select("order_id", "a", "b", "severity"))
query("j11_cross_sell", "select drug_id, rank, partner, name, base_price, confidence from (select *, row_number() over (partition by drug_id order by confidence desc, partner) rank from (select a drug_id, b partner, confidence from affinities union all select b, a, confidence from affinities)) s join (select drug_id partner, name, base_price from drugs) using(partner) where rank<=5")(lambda r: baskets.cross_sell(baskets.affinities(r.items()), r.drugs()))
query("j12_either_end", "select a, b, confidence from affinities where a=11 or b=11")(lambda r: baskets.symmetric(baskets.affinities(r.items())).filter("drug_id = 11").select(F.least("drug_id", "partner").alias("a"), F.greatest("drug_id", "partner").alias("b"), "confidence"))
query("j13_name_join", "select p_partkey, drug_id from part join (select min(drug_id) drug_id, lower(trim(name)) k from drugs group by 2) on lower(trim(p_brand))=k")(lambda r: lookups.name_join(r.raw("part").select("p_partkey", F.upper("p_brand").alias("name")), r.drugs().select("drug_id", "name"), "name", "drug_id").select("p_partkey", "drug_id"))
query("j16_unique_names", "select p_partkey request_id, case when n=1 then part_id end resolved from part left join (select p_name, count(*) n, min(p_partkey) part_id from part group by 1) using(p_name)")(
    lambda r: lookups.unique_name_resolution(r.raw("part").select(F.col("p_partkey").alias("request_id"), F.lit(None).cast("long").alias("customer_id"), F.lit(0).alias("tenant_id"), F.col("p_name").alias("full_name")), r.raw("part").select(F.col("p_partkey").alias("customer_id"), F.lit(0).alias("tenant_id"), F.col("p_name").alias("full_name")))
)
query("j17_around_moment", "select customer_id, drug_id, max(order_date) filter (order_date<=date '1998-01-01') last_before, min(order_date) filter (order_date>date '1998-01-01') next_after from done group by 1,2")(lambda r: cycles.around(bought(r), bought(r).select("customer_id", "drug_id").distinct().withColumn("at", F.lit("1998-01-01").cast("date"))).drop("at"))
query("j20_order_view", "select order_id, customer_id, order_date, status, channel, coalesce(sum(amount),0)::decimal(20,2) total, count(line)::int n_items, string_agg(line||'x'||quantity, ',' order by line, part_id, supplier_id, ship_date) as lines from ord left join items using(order_id) group by 1,2,3,4,5")(
    lambda r: lookups.order_view(r.orders(), r.items(), r.drugs()).withColumn("lines", F.when(F.col("n_items") > 0, F.array_join(F.transform("items", lambda i: F.concat(i["line"].cast("string"), F.lit("x"), i["quantity"].cast("string"))), ","))).drop("items")
)
query("l1_safe_sort", "select drug_id, name, base_price from drugs order by base_price desc, drug_id")(lambda r: lookups.safe_sort(r.drugs(), "base_price", True, ("name", "base_price", "default_cycle_days"), "drug_id").select("drug_id", "name", "base_price"))
query("l2_page", "select order_id, (select count(*) from ord where status='pending') total from ord where status='pending' order by order_date desc, order_id limit 20 offset 40")(lambda r: lookups.page(r.orders().filter("status = 'pending'").select("order_id", "order_date"), 3, 20, F.desc("order_date"), "order_id").select("order_id", "total"))
query("l2_keyset_page", "select order_id from ord where order_id>100 order by order_id limit 20")(lambda r: lookups.page_after(r.orders().select("order_id"), 20, "order_id", 100))
query("l4_recommended", "select drug_id, source, value from (select drug_id, 0 source, score::double value from (select b drug_id, max(confidence) score from affinities group by 1) order by score desc, drug_id limit 4)")(lambda r: baskets.recommended(baskets.affinities(r.items()), r.drugs()))
query("l5_queue_read", "select order_id, order_date from ord where status='pending' order by order_date, order_id limit 100")(lambda r: r.orders().filter("status = 'pending'").orderBy("order_date", "order_id").limit(100).select("order_id", "order_date"))
query("l6_hashed_sample", "select * from customers order by md5('7:'||customer_id), customer_id limit 50")(lambda r: lookups.hashed_sample(r.customers(), "customer_id", 50))
query("u1_union_all", "select a drug_id, b partner, severity from interactions union all select b, a, severity from interactions")(lambda r: baskets.symmetric(r.interactions()))
query("u2_distinct", "select distinct category, is_chronic from drugs")(lambda r: r.drugs().select("category", "is_chronic").distinct())
query("u3_difference", "select p_partkey from part except select part_id from items where quantity>45")(lambda r: r.raw("part").select("p_partkey").join(r.items().filter("quantity > 45").select(F.col("part_id").alias("p_partkey")), "p_partkey", "left_anti"))
query("d6_safety_gate", """with f as (select x.order_id, count(*) filter (severity='high') high, count(*) filter (severity<>'high') other from (select distinct x.order_id, x.drug_id a, y.drug_id b from items x join items y on x.order_id=y.order_id and x.drug_id<y.drug_id) x join interactions using(a,b) group by 1)
 select order_id, coalesce(high,0)>0 rejected, case when coalesce(high,0)>0 then 0 else coalesce(other,0) end warnings from (select distinct order_id from items) left join f using(order_id)""")(lambda r: baskets.safety_gate(r.items(), r.interactions()))
query("q7_pair_rules", "select (select count(*) from interactions where a>=b) bad_order, (select coalesce(sum(n-1),0)::bigint from (select count(*) n from interactions group by a,b)) repeated, (select count(*) from (select a k from interactions union all select b from interactions) where k not in (select drug_id from drugs)) unknown_ends")(lambda r: baskets.pair_violations(r.interactions(), r.drugs()))
query("q5_unmatched_names", "select distinct p_name from part where lower(trim(p_name)) not in (select lower(trim(p_name)) from part where p_partkey%50=0)")(lambda r: r.raw("part").select("p_name", F.lower(F.trim("p_name")).alias("k")).join(r.raw("part").filter("p_partkey % 50 = 0").select(F.lower(F.trim("p_name")).alias("k")), "k", "left_anti").select("p_name").distinct())

# ---- windows, cycles, decisions ------------------------------------------------------------------------------------------------

query("w1_gaps", "select customer_id, drug_id, order_date, order_id, line, part_id, supplier_id, ship_date, gap from gaps")(lambda r: cycles.with_gaps(bought(r)).select("customer_id", "drug_id", "order_date", "order_id", "line", "part_id", "supplier_id", "ship_date", "gap"))
query("w3_split_last", "select customer_id, drug_id, count(*) n, max(gap) filter (k=1) target from (select *, count(*) over (partition by customer_id, drug_id) c, row_number() over (partition by customer_id, drug_id order by order_date desc, order_id desc, line desc, part_id desc, supplier_id desc, ship_date desc) k from gaps) where c>=3 group by 1,2")(
    lambda r: cycles.split_last(cycles.with_gaps(bought(r))).groupBy("customer_id", "drug_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("is_target"), F.col("gap"))).alias("target"))
)
query("w4_latest_child", "select customer_id, max_by(order_id, (order_date, order_id)) order_id from customers left join ord using(customer_id) group by 1")(lambda r: lookups.latest_child(r.customers().select("customer_id"), r.orders(), "customer_id", "order_date", "order_id").select("customer_id", "order_id"))
query("w5_recent_n", "select session_id, event_id, nth from (select *, row_number() over (partition by session_id order by ts desc, event_id desc) nth from ev) where nth<=20")(lambda r: lookups.recent_n(r.events(), "session_id", 20, "ts", "event_id").select("session_id", "event_id", "nth"))
query("w6_best_and_margin", "select drug_id, partner, round(margin,6) margin from (select *, confidence-lead(confidence) over w margin, row_number() over w k from (select a drug_id, b partner, confidence from affinities union all select b, a, confidence from affinities) window w as (partition by drug_id order by confidence desc, partner)) where k=1")(lambda r: lookups.best_and_margin(baskets.symmetric(baskets.affinities(r.items())), "drug_id", "confidence", "partner").select("drug_id", "partner", F.round("margin", 6).alias("margin")))
query("w7_keep_first", "select min(doc_id) doc_id from documents group by md5(lower(trim(text)))")(lambda r: dataset.keep_first(r.documents().select("doc_id", "text"), tx.fingerprint(F.col("text")), "doc_id").select("doc_id"))
query("w9_history", "select conv_id, turn, count(text) over w n_before, coalesce(sum(length(text)) over w,0)::bigint chars_before from turns window w as (partition by conv_id order by turn rows between 4 preceding and 1 preceding)")(lambda r: conversation.history(r.conversations()).select("conv_id", "turn", F.size("context").cast("long").alias("n_before"), F.aggregate("context", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("chars_before")))
query("w10_last_entity", "select conv_id, turn, last_value(e ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) entity from (select *, nullif(regexp_extract(text,'\\b(th[a-z]{4,8})\\b',1),'') e from turns)")(lambda r: conversation.last_entity(r.conversations(), r"\b(th[a-z]{4,8})\b").select("conv_id", "turn", "entity"))
query("d1_governance", f"""select customer_id, drug_id, days, round(confidence,6) confidence, round(churn,6) churn, case when churn>=.7 then 'human_review' when confidence>=.8 then 'auto_send' when confidence>=.5 then 'human_review' else 'cold_start' end decision, case when churn>=.5 then 'human_review' else 'auto_send' end churn_action,
 case when churn>=.6 then 'high' when churn>=.33 then 'medium' else 'low' end tier from (select *, {D}-last_purchase_date as days, case when avg_cycle_days>0 then round(greatest(0,least(1,1-200/avg_cycle_days)),3) else 0.5 end confidence,
 round(case when {D}-last_purchase_date>avg_cycle_days then case when avg_cycle_days=0 then .95 else least(.95,({D}-last_purchase_date-avg_cycle_days)/avg_cycle_days) end else .05 end,6) churn from cycles)""")(
    lambda r: governance.evaluate(the_cycles(r), AS_OF, mae=200.0).drop("avg_cycle_days", "evaluated_on")
)
query("d5_heuristic_churn", f"select customer_id, drug_id, case when c>=.7 then 'high' when c>=.4 then 'medium' else 'low' end tier from (select *, round(case when {D}-last_purchase_date>avg_cycle_days then case when avg_cycle_days=0 then .95 else least(.95,({D}-last_purchase_date-avg_cycle_days)/avg_cycle_days) end else .05 end,6) c from cycles)")(
    lambda r: governance.evaluate(the_cycles(r), AS_OF).select("customer_id", "drug_id", governance.heuristic_tier(F.col("churn")).alias("tier"))
)
query("d7_transitions", "select order_id, status, new_status, case when status=new_status then 'no_op' when (status='pending' and new_status in ('completed','cancelled')) or (status='completed' and new_status='cancelled') then 'valid' else 'rejected' end result, status='completed' and new_status='cancelled' needs_audit from (select *, ['completed','cancelled','pending'][(order_id%3+1)::int] new_status from ord)")(
    lambda r: governance.transition_check(r.orders().select("order_id", "status", F.element_at(F.array(F.lit("completed"), F.lit("cancelled"), F.lit("pending")), (F.col("order_id") % 3 + 1).cast("int")).alias("new_status")))
)
query("d8_sla_breaches", f"select order_id, round(date_diff('second', order_date::timestamp, {D}::timestamp)/3600.0,1)::double as hours from ord where status='pending' and date_diff('second', order_date::timestamp, {D}::timestamp)>=86400")(
    lambda r: governance.sla_breaches(r.orders().filter("status = 'pending'").select("order_id", F.col("order_date").alias("created_at"), F.lit("human_review").alias("decision")), AS_OF).select("order_id", "hours")
)
query("d9_refill_alert", f"select customer_id, drug_id, days_left, case when days_left<0 then 'overdue' when days_left<=14 then 'due' else 'none' end alert from (select *, ceil(last_purchase_date-{D}+avg_cycle_days)::int days_left from cycles)")(lambda r: cycles.refill_alert(the_cycles(r), AS_OF))
query("m17_queue", f"select decision, count(*) n from (select case when churn>=.7 then 'human_review' when confidence>=.8 then 'auto_send' when confidence>=.5 then 'human_review' else 'cold_start' end decision from (select case when avg_cycle_days>0 then round(greatest(0,least(1,1-200/avg_cycle_days)),3) else 0.5 end confidence, round(case when {D}-last_purchase_date>avg_cycle_days then case when avg_cycle_days=0 then .95 else least(.95,({D}-last_purchase_date-avg_cycle_days)/avg_cycle_days) end else .05 end,6) churn from cycles)) where decision<>'cold_start' group by 1")(
    lambda r: governance.queue(governance.evaluate(the_cycles(r), AS_OF, mae=200.0))[0].groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
)
query("q8_audit_rows", f"select 'purged' action_type, order_id target, {D} as day from ord where order_date<{D}-1500")(lambda r: governance.purge(r.orders(), r.items(), "order_id", "order_date", AS_OF, 1500)[2].select("action_type", "target", "day"))

# ---- writes as tables ----------------------------------------------------------------------------------------------------------

def upserted(r: Retail) -> DataFrame:
    """Zeros for all pairs, then the even customers' counts, twice under one token; read from the written table."""
    table = KeyedTable(r.spark, scratch.new_path(r.spark, "upserts"), "customer_id long, drug_id int, purchases long, bucket int", ["customer_id", "drug_id"], "bucket")
    rows = the_cycles(r).select(F.col("customer_id").cast("long").alias("customer_id"), "drug_id", "purchases", (F.col("customer_id") % 8).cast("int").alias("bucket"))
    table.upsert(rows.withColumn("purchases", F.lit(0).cast("long")), "first")
    for _ in range(2):
        table.upsert(rows.filter("customer_id % 2 = 0"), "second")
    return table.read().select("customer_id", "drug_id", "purchases")


def retained(r: Retail) -> DataFrame:
    """Orders in a table by month; those that are too old go."""
    table = KeyedTable(r.spark, scratch.new_path(r.spark, "orders"), "order_id long, customer_id long, order_date date, month string", ["order_id"], "month")
    table.upsert(r.orders().select(F.col("order_id").cast("long").alias("order_id"), F.col("customer_id").cast("long").alias("customer_id"), "order_date", F.date_format("order_date", "yyyy-MM").alias("month")))
    table.purge(f"order_date < date '{AS_OF}' - 1500")
    return table.read().select("order_id", "order_date")


UPSERTED = "select customer_id, drug_id, case when customer_id%2=0 then purchases else 0 end purchases from cycles"
query("s8_upsert_written", UPSERTED)(upserted)
query("s13_retention_written", f"select order_id, order_date from ord where order_date>={D}-1500")(retained)
query("s8_upsert", "select customer_id, drug_id, purchases from cycles where customer_id%2=0 union all select customer_id, drug_id, 0 from cycles where customer_id%2=1")(
    lambda r: governance.upsert(the_cycles(r).select("customer_id", "drug_id", F.lit(0).cast("long").alias("purchases")), the_cycles(r).filter("customer_id % 2 = 0").select("customer_id", "drug_id", "purchases"), "customer_id", "drug_id")
)
query("s9_insert_absent", "select drug_id, name from drugs")(lambda r: governance.insert_absent(r.drugs().filter("drug_id % 3 = 0").select("drug_id", "name"), r.drugs().select("drug_id", "name"), "drug_id"))
query("s10_keyed_update", "select order_id, case when order_id%5=0 then 'sent' else status end status from ord")(lambda r: governance.keyed_update(r.orders().select("order_id", "status"), r.orders().filter("order_id % 5 = 0").select("order_id", F.lit("sent").alias("new")), "order_id", status="new"))
query("s11_backfill", "select p_partkey, coalesce(u, 'none') url from part left join (select lower(trim(name)) k, min('img'||drug_id) u from drugs where drug_id%2=0 group by 1) on lower(trim(p_brand))=k")(
    lambda r: governance.backfill_by_name(r.raw("part").select("p_partkey", F.col("p_brand").alias("name"), F.lit("none").alias("url")), r.drugs().filter("drug_id % 2 = 0").select(F.upper("name").alias("name"), F.concat(F.lit("img"), F.col("drug_id").cast("string")).alias("url")), "name", "url").select("p_partkey", "url")
)
query("s12_keep_listed", "select drug_id, count(*) n from items where drug_id in (select drug_id from drugs where is_chronic) group by 1")(lambda r: governance.keep_listed(r.drugs(), r.items(), r.drugs().filter("is_chronic"), "drug_id")[1].groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")))
query("s13_retention", f"select count(*) items, count(distinct order_id) orders from items semi join (select order_id from ord where order_date>={D}-1500) using(order_id)")(lambda r: governance.purge(r.orders(), r.items(), "order_id", "order_date", AS_OF, 1500)[1].agg(F.count(F.lit(1)).alias("items"), F.countDistinct("order_id").alias("orders")))
query("s14_knowledge_chunks", "select 'drug' source_type, 'Drug: '||name||'. Category: '||category||'. Price: '||base_price||'. Cycle: '||default_cycle_days||' days.' as content from drugs union all select 'policy', 'Orders can be cancelled while pending.'")(
    lambda r: r.drugs().select(F.lit("drug").alias("source_type"), F.format_string("Drug: %s. Category: %s. Price: %s. Cycle: %s days.", "name", "category", "base_price", "default_cycle_days").alias("content")).unionByName(r.spark.createDataFrame([("policy", "Orders can be cancelled while pending.")], "source_type string, content string"))
)

# ---- hash chains ---------------------------------------------------------------------------------------------------------------


def actor():
    """Who acted in an event: one of five, or nobody."""
    return F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("staff"), (F.col("event_id") % 5).cast("string")))


def log(r: Retail) -> DataFrame:
    return r.events().select("session_id", "event_seq", "event_id", "payload", actor().alias("actor"))


def damaged(r: Retail) -> DataFrame:
    """The signed log with every 97th row unsigned and every 101st row's payload changed."""
    signed = chain.sign(log(r)).join(log(r).select("event_id", "payload", "actor"), "event_id")
    gone = F.col("event_id") % 97 == 0
    lost = lambda c: F.when(~gone, F.col(c)).alias(c)
    return signed.select("session_id", "event_seq", "event_id", F.when(F.col("event_id") % 101 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"), "actor", lost("prev_hash"), lost("payload_hash"))


ZERO = "repeat('0',64)"
ACTOR = "case when event_id%3<>0 then 'staff'||(event_id%5) else '' end"
CHAIN = f"""with recursive e as (select session_id, event_seq, event_id, coalesce(payload,'{{}}') payload, {ACTOR} actor, row_number() over (partition by session_id order by event_seq, event_id) k from ev),
 c as (select session_id, event_seq, event_id, k, payload, actor, {ZERO} prev_hash, sha256(payload||'|'||{ZERO}||'|'||actor) payload_hash from e where k=1 union all select e.session_id, e.event_seq, e.event_id, e.k, e.payload, e.actor, c.payload_hash, sha256(e.payload||'|'||c.payload_hash||'|'||e.actor) from e join c on e.session_id=c.session_id and e.k=c.k+1)"""
BROKEN = CHAIN + f""", d as (select session_id, event_seq, event_id, actor, case when event_id%101=0 then payload||'!' else payload end payload, case when event_id%97<>0 then prev_hash end prev_hash, case when event_id%97<>0 then payload_hash end payload_hash from c),
 v as (select *, coalesce(lag(payload_hash) over (partition by session_id order by event_seq, event_id), {ZERO}) due_prev, sha256(payload||'|'||coalesce(prev_hash,{ZERO})||'|'||actor) due_hash from d),
 f as (select session_id, event_seq, event_id, 'unsigned' reason, null::varchar expected_hash, null::varchar actual_hash from v where payload_hash is null union all select session_id, event_seq, event_id, 'prev_hash_mismatch', due_prev, prev_hash from v where payload_hash is not null and prev_hash is distinct from due_prev
 union all select session_id, event_seq, event_id, 'payload_hash_mismatch', due_hash, payload_hash from v where payload_hash is not null and payload_hash<>due_hash)"""
query("q1_sign_chain", CHAIN + " select session_id, event_seq, event_id, prev_hash, payload_hash from c")(lambda r: chain.sign(log(r)).drop("is_new"))
query("w8_sign_long", CHAIN + " select session_id, event_seq, event_id, prev_hash, payload_hash from c")(lambda r: chain.sign_long(log(r)))
query("q2_verify_chain", BROKEN + " select * from f")(lambda r: chain.verify(damaged(r)))
query("q3_unsigned", "select count(*) filter (event_id%97=0) unsigned from ev")(lambda r: chain.unsigned_count(damaged(r)))
query("q4_chain_report", BROKEN + " select count(*) filter (reason='unsigned') unsigned, count(*) filter (reason<>'unsigned') mismatches, min(event_seq) first_break, min_by(session_id, (event_seq, session_id)) first_session from f")(lambda r: chain.chain_report(chain.verify(damaged(r))))

# ---- features ------------------------------------------------------------------------------------------------------------------

ORDERED = "(select *, count(*) over (partition by customer_id, drug_id) c, row_number() over (partition by customer_id, drug_id order by order_date desc, order_id desc, line desc, part_id desc, supplier_id desc, ship_date desc) k, row_number() over (partition by customer_id, drug_id order by order_date, order_id, line, part_id, supplier_id, ship_date) u from gaps)"
query("m1_cycle_training", f"""select customer_id, drug_id, max(gap) filter (k=1) target, max(c)-1 purchases, round(avg(gap) filter (k>1),6) avg_cycle_days, round(coalesce(stddev_pop(gap) filter (k>1),0),4) gap_sd, max(gap) filter (k=2) days_since_last, max(c_mktsegment) age_group,
 max(category) category, max(default_cycle_days)::double default_cycle_days, max(base_price)::double base_price, max(is_chronic::int) is_chronic from {ORDERED} join drugs using(drug_id) join customer on c_custkey=customer_id where c>=3 group by 1,2""")(
    lambda r: features.cycle_training(bought(r), r.customers(), r.drugs()).withColumn("avg_cycle_days", F.round("avg_cycle_days", 6)).withColumn("gap_sd", F.round("gap_sd", 4))
)
SNAP = f"(select customer_id, drug_id, mean_gap, (second_day + ((customer_id*7919+drug_id*104729)%(span+1))::int)::date as t0 from (select *, ({D}-floor(1.5*mean_gap)::int)::date-second_day span from (select customer_id, drug_id, count(*) n, ((max(order_date)-min(order_date))::double/(count(*)-1)) mean_gap, min(order_date) filter (u=2) second_day from {ORDERED} group by 1,2 having count(*)>=2)) where span>=0)"
query("m2_churn_training", f"""select customer_id, drug_id, purchases, days_since_last, round(days_since_last/default_cycle_days::double,6) ratio_to_default, gap_sd, case when nxt-t0<=1.5*mean_gap then 0 else 1 end target from (select customer_id, drug_id, t0, mean_gap, count(*) filter (order_date<=t0) purchases, (t0-max(order_date) filter (order_date<=t0)) days_since_last,
 min(order_date) filter (order_date>t0) nxt, round(coalesce(stddev_pop(gap) filter (order_date<=t0),0),4) gap_sd from gaps join {SNAP} using(customer_id, drug_id) group by 1,2,3,4) join drugs using(drug_id)""")(
    lambda r: features.churn_training(bought(r), r.customers(), r.drugs(), AS_OF).select("customer_id", "drug_id", "purchases", "days_since_last", F.round("ratio_to_default", 6).alias("ratio_to_default"), F.round("gap_sd", 4).alias("gap_sd"), "target")
)
query("m5_serving", f"select customer_id, drug_id, count(*) purchases, round(coalesce(avg(gap),max(default_cycle_days)),6)::double avg_cycle_days, {D}-max(order_date) days_since_last, count(*)<2 is_cold from gaps join drugs using(drug_id) group by 1,2")(
    lambda r: features.serving(bought(r), r.customers(), r.drugs(), AS_OF).select("customer_id", "drug_id", "purchases", F.round("avg_cycle_days", 6).alias("avg_cycle_days"), "days_since_last", "is_cold")
)
query("m10_split", "select doc_id, quality, row_number() over (partition by quality order by md5('42:'||doc_id), doc_id)<=floor(count(*) over (partition by quality)*0.8) is_train from labels")(lambda r: features.split_80_20(r.raw("labels").select("doc_id", "quality"), "quality", "doc_id"))

# ---- conversation sets ---------------------------------------------------------------------------------------------------------

CONVS = "(select conv_id, count(*) n, min_by(role, turn) head, max_by(role, turn) tail, max((text is null or trim(text)='')::int) empty, coalesce(string_agg(text,' ' order by turn) filter (role='user'),'') u, coalesce(string_agg(text,' ' order by turn) filter (role='assistant'),'') a, string_agg(text,' ' order by turn) every, coalesce(string_agg(text,' ' order by turn) filter (role<>'system'),'') said from turns group by conv_id)"
LOOSE = "md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(u),'[^\\p{L}\\p{N}_\\s]','','g'),'\\p{N}+','','g'),'\\s+',' ','g')))"
EARLY = "case when n<3 then 'too_short' when head<>'system' then 'no_system' when empty=1 then 'empty_message' when tail<>'assistant' then 'no_answer' end"
GENERIC = "contains(lower(a),'as an ai language model')"
REASONS = f"(select x.*, coalesce(early, case when conv_id>f then 'duplicate' end, case when generic then 'generic' end) reason from (select *, min(case when early is null and not generic then conv_id end) over (partition by fp) f from (select *, {EARLY} early, {LOOSE} fp, {GENERIC} generic from {CONVS})) x)"


def convs(r: Retail) -> DataFrame:
    return dataset.conversations(r.conversations())


query("t1_validate", f"select conv_id, n::int n_messages, n>=3 and head='system' and empty=0 as valid from {CONVS}")(lambda r: dataset.validate(convs(r)).select("conv_id", "n_messages", "valid"))
query("t2_first_reason", f"select conv_id, reason from {REASONS}")(lambda r: dataset.first_reason(convs(r)).select("conv_id", "reason"))
query("a30_reason_census", f"select coalesce(reason,'kept') reason, count(*) n from {REASONS} group by 1")(lambda r: dataset.first_reason(convs(r)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")))
query("t3_exact_dedupe", "select min(doc_id) doc_id, count(*) copies from documents group by md5(lower(trim(text)))")(lambda r: r.documents().groupBy(tx.fingerprint(F.col("text")).alias("fp")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("fp"))
query("t4_loose_dedupe", f"select min(conv_id) conv_id, count(*) copies from {CONVS} group by {LOOSE}")(lambda r: convs(r).groupBy(tx.loose_fingerprint(dataset.role_text("user")).alias("fp")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).drop("fp"))
query("t5_repaired_prompt", "select conv_id, string_agg(case when k=1 and role='system' then 'You help customers.' else text end, ' ' order by turn) said from (select *, row_number() over (partition by conv_id order by turn) k from turns) group by conv_id")(lambda r: dataset.repaired(convs(r), "You help customers.").select("conv_id", dataset.all_text().alias("said")))

TOPIC = {"th": ("thshing", "then", "that"), "er": ("erti", "heror"), "and": ("and", "ande", "hand")}


def topic_sql(text: str, count) -> str:
    scores = [(name, "(" + "+".join(count(k) for k in words) + ")") for name, words in TOPIC.items()]
    best = f"greatest({','.join(s for _, s in scores)})"
    cases = " ".join(f"when {s}={best} then '{n}'" for n, s in scores)
    return f"case when {best}=0 then 'general' {cases} end"


def present(t: str):
    return lambda k: f"contains(lower({t}),'{k}')::int"


def occurs(t: str):
    return lambda k: f"((length(lower({t}))-length(replace(lower({t}),'{k}','')))//{len(k)})"


query("t6_topic_present", f"select conv_id, {topic_sql('every', present('every'))} topic from {CONVS}")(lambda r: dataset.topic(convs(r), dataset.all_text(), TOPIC).select("conv_id", "topic"))
query("t7_topic_occurrences", f"select conv_id, {topic_sql('said', occurs('said'))} topic from {CONVS}")(lambda r: dataset.topic(convs(r), dataset.all_text(True), TOPIC, occurrences=True).select("conv_id", "topic"))
query("t8_stratified_split", "select doc_id, lang, case when row_number() over (partition by lang order by md5('42:'||doc_id), doc_id)<=floor(count(*) over (partition by lang)*0.9::double) then 'train' else 'validation' end split from documents")(lambda r: dataset.stratified_split(r.documents().select("doc_id", "lang"), "lang", "doc_id"))
query("t9_quality_report", f"""select *, round((least(arabic,english)/greatest(n,1)::double*2*.25+least(1,topics/10::double)*.25+least(1,n/10000::double)*.3+greatest(0,1-(duplicates*100::double/greatest(total,1))/100)*.2)*10,4) score_ten,
 100-(case when abs(arabic*100::double/greatest(n,1)-50)>15 then 10 else 0 end)-(case when removed>n*5 then 10 else 0 end)-(case when n<1000 then 20 else 0 end)-(case when topics<5 then 15 else 0 end) score_hundred from (select count(*) filter (reason is null) n, coalesce(sum(n) filter (reason is null),0)::bigint messages,
 count(*) filter (reason is null and ar>la) arabic, count(*) filter (reason is null and ar<=la) english, count(distinct case when reason is null then topic end) topics, coalesce(sum(length(every)//4) filter (reason is null),0)::bigint tokens, count(*) filter (reason is not null) removed, count(*) filter (reason='duplicate') duplicates, count(*) total
 from (select *, len(regexp_extract_all(every,'[؀-ۿ]')) ar, len(regexp_extract_all(every,'[a-zA-Z]')) la, {topic_sql('said', present('said'))} topic from {REASONS}))""")(lambda r: dataset.quality_report(convs(r), TOPIC))  # fmt: skip
query("t21_chat_template", "select conv_id, string_agg('<|im_start|>'||role||chr(10)||text||'<|im_end|>', chr(10) order by turn) rendered from turns group by 1")(lambda r: dataset.chat_template(convs(r)).select("conv_id", "rendered"))
query("f9_script_language", "select doc_id, case when ar>la then 'Arabic' when la>ar then 'English' else 'Mixed' end script from (select doc_id, len(regexp_extract_all(text,'[؀-ۿ]')) ar, len(regexp_extract_all(text,'[a-zA-Z]')) la from documents)")(lambda r: r.documents().select("doc_id", tx.script_language(F.col("text")).alias("script")))
query("f10_token_estimate", "select sum(length(text)//4)::bigint tokens from documents")(lambda r: r.documents().agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens")))
query("f8_slug", "select distinct lower(regexp_replace(regexp_replace(p_name,'[^a-zA-Z0-9-]','-','g'),'-+','-','g')) slug from part")(lambda r: r.raw("part").select(tx.slug(F.col("p_name")).alias("slug")).distinct())
query("f5_normalize_line", "select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name||' '||p_size||'mg'),'([0-9])([a-z])','\\1 \\2','g'),'([a-z])([0-9])','\\1 \\2','g'),'\\s+',' ','g')) line from part")(lambda r: r.raw("part").select("p_partkey", tx.normalize_line(F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("mg")))).alias("line")))
query("f6_strength", "select p_partkey, case when p_size%2=0 then (p_size*1000)||'mg' else p_size||'ml' end strength from part")(lambda r: r.raw("part").select("p_partkey", tx.strength_token(F.concat(F.col("p_name"), F.lit(" 5 mg "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " g").otherwise(" ML"))).alias("strength")))
query("f7_sig_tail", "select p_partkey, p_name as cleaned, (p_size%300) quantity from part where p_size>0")(lambda r: r.raw("part").filter("p_size > 0").select("p_partkey", tx.strip_sig_tail(F.concat(F.lit("3. "), F.col("p_name"), F.lit(" - 1 tab BID"))).alias("cleaned"), tx.quantity_tail(F.concat(F.col("p_name"), F.lit(" - "), (F.col("p_size") % 300).cast("string"))).alias("quantity")))
query("f11_fingerprints", "select doc_id, md5(lower(trim(text))) exact from documents")(lambda r: r.documents().select("doc_id", tx.fingerprint(F.col("text")).alias("exact")))
query("f12_event_hash", "select event_id, sha256(coalesce(payload,'{}')||'|'||repeat('0',64)||'|'||" + ACTOR + ") h from ev")(lambda r: log(r).select("event_id", chain.event_hash(F.col("payload"), F.lit(chain.GENESIS), F.col("actor")).alias("h")))
query("f16_dates", f"select order_id, {D}-order_date as days, order_date+30 later, strftime(order_date,'%Y-%m') as month from ord")(lambda r: r.orders().select("order_id", F.datediff(F.lit(AS_OF).cast("date"), "order_date").alias("days"), F.date_add("order_date", 30).alias("later"), F.date_format("order_date", "yyyy-MM").alias("month")))
query("f19_price_and_boxes", "select part.p_partkey, round_even(base_price::double*3*(1-15/100::double),2) total, ceil(p_size*7/10::double)::bigint boxes from part join brands using(p_partkey) join drugs using(drug_id)")(lambda r: r.raw("part").select("p_partkey", "p_size", F.expr("cast(substring(p_brand, 7) as int)").alias("drug_id")).join(r.drugs(), "drug_id").select("p_partkey", tx.price_after_discount(F.col("base_price").cast("double"), F.lit(3), F.lit(15.0)).alias("total"), tx.boxes_needed(F.col("p_size"), F.lit(7), F.lit(10)).alias("boxes")))
query("f26_truncate", "select doc_id, trim(substr(trim(text),1,1500)) kept, length(trim(text))>1500 cut from documents")(lambda r: r.documents().select("doc_id", tx.truncated(F.col("text")).alias("kept"), (F.length(F.trim("text")) > 1500).alias("cut")))

# ---- retrieval and turns -------------------------------------------------------------------------------------------------------

query("j19_dense_top_k", "select query_id, rank, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from (select q.vec_id query_id, c.vec_id chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]),6) score from embeddings q cross join embeddings c where q.vec_id%50=0)) where rank<=5")(lambda r: retrieval.dense_top_k(r.embeddings().filter("vec_id % 50 = 0"), r.embeddings(), 5, "vec_id", "vec_id", "embedding"))
query("f20_cosine", "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id=0)),6) similarity from embeddings")(lambda r: r.embeddings().crossJoin(F.broadcast(r.embeddings().filter("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", F.round(vc.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")))
CENTROIDS = "(select label, list(x order by i) centroid from (select label, i, avg(v/n) x from (select label, unnest(embedding)::double v, generate_subscripts(embedding,1) i, sqrt(list_dot_product(embedding::double[],embedding::double[])) n from embeddings) group by 1,2) group by 1)"
query("t14_nearest_intent", f"select vec_id, label, score, score>=.5 confident from (select vec_id, c.label, round(greatest(0,least(1,list_cosine_similarity(e.embedding::double[],centroid))),4) score, row_number() over (partition by vec_id order by round(greatest(0,least(1,list_cosine_similarity(e.embedding::double[],centroid))),4) desc, c.label) k from embeddings e cross join {CENTROIDS} c) where k=1")(
    lambda r: retrieval.nearest_intent(r.embeddings().drop("label"), vc.centroids(r.embeddings(), "label", "embedding"), "vec_id", "embedding", "label").drop("margin")
)
query("f21_centroids", f"select label, i::int i, round(x,8) x from (select label, unnest(centroid) x, generate_subscripts(centroid,1)-1 i from {CENTROIDS})")(lambda r: vc.centroids(r.embeddings(), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 8).alias("x")))


def passages(r: Retail) -> DataFrame:
    """Every benchmark passage, whole: the stated query set."""
    return r.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def reranked(r: Retail) -> DataFrame:
    """The twenty nearest documents of each passage (by the vectors of these numbers), ranked by similarity and words."""
    vectors = r.embeddings().select("vec_id", "embedding")
    asked = vectors.join(passages(r).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    held = vectors.join(r.documents().select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieval.dense_top_k(asked, held, 20, "vec_id", "vec_id", "embedding").withColumn("similarity", F.floor((1 + F.col("score")) / 2 * 10000) / 10000).drop("rank", "score")
    texts = near.join(passages(r), "query_id").join(r.documents().select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return retrieval.hybrid(texts).select("query_id", "chunk_id", "score", "rank")


def stem_sql(word: str) -> str:
    """light_stem() of an expression."""

    def first(w: str, affixes: tuple[str, ...], front: bool) -> str:
        cuts = " ".join(f"when {'starts_with' if front else 'ends_with'}({w},'{a}') and length({w})>={len(a) + 3} then {f'substr({w},{len(a) + 1})' if front else f'substr({w},1,length({w})-{len(a)})'}" for a in affixes)
        return f"case {cuts} else {w} end"

    front = first(word, tx.PREFIXES, True)
    return f"case when length({word})<=3 then {word} else {first(f'({front})', tx.SUFFIXES, False)} end"


PLAIN = f"trim(translate(regexp_replace(lower(text),'{tx.MARKS}','','g'),'إأآةىؤئ','اااهيوي'))"
STEMS = f"(select id, w, {stem_sql('w')} stem from (select id, unnest(regexp_split_to_array({PLAIN},'\\s+')) w from {{0}}) where length(w)>1)"
def sides(q: str, d: str) -> str:
    """Definitions up to `lexical`: lexical_index() of the queries q and the chunks d (id, text)."""
    return f"""qt as ({q}), dt as ({d}), qs as {STEMS.format('qt')}, cs as (select distinct id, stem from {STEMS.format('dt')}),
 asked as (select id query_id, stem, count(*) times from qs group by all), total as (select id query_id, count(*) n from qs group by 1),
 inside as (select v.stem held, w.stem from (select distinct stem from cs) v join (select distinct stem from asked) w on contains(v.stem, w.stem)),
 found as (select query_id, chunk_id, sum(times) found from (select distinct cs.id chunk_id, i.stem from cs join inside i on i.held=cs.stem) join asked using(stem) group by all),
 qn as (select distinct id query_id, unnest(regexp_extract_all(text,'[0-9]+')) number from qt), dn as (select distinct id chunk_id, unnest(regexp_extract_all(text,'[0-9]+')) number from dt semi join cs using(id)),
 numbers as (select query_id, chunk_id, count(*) shared from qn join dn using(number) group by all),
 lexical as (select query_id, chunk_id, least(1.0::double, coalesce(found,0)/n + .3::double*coalesce(shared,0)) score from (found full join numbers using(query_id, chunk_id)) join total using(query_id))"""


SIDES = "with " + sides("select item_id id, text from benchmark", "select doc_id id, text from documents")
query("t11_lexical_score", SIDES + " select query_id, chunk_id, round(score,6) score from lexical")(
    lambda r: retrieval.lexical_index(passages(r), r.documents(), "query_id", "query", "doc_id", "text").withColumn("score", F.round("score", 6))
)
query("t12_hybrid_rank", SIDES + """, near as (select * from (select q.vec_id query_id, c.vec_id chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]),6) s from embeddings q cross join embeddings c
 where q.vec_id in (select item_id from benchmark) and c.vec_id in (select doc_id from documents)) qualify row_number() over (partition by query_id order by s desc, chunk_id)<=20),
 scored as (select query_id, chunk_id, round(.6::double*(floor((1+s)/2*10000)/10000)+.4::double*coalesce(l.score,0),6) score from near left join lexical l using(query_id, chunk_id)) select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from scored""")(reranked)  # fmt: skip
query("t16_category_listing", "select category, count(*) n, string_agg(name, ',' order by name) listed from drugs group by 1")(lambda r: retrieval.category_listing(r.drugs()).select("category", "n", F.array_join(F.transform("drugs", lambda d: d["name"]), ",").alias("listed")))
query("d10_escalation", "select conv_id, turn, case when contains(lower(text),'blehe') then 'critical_emergency' when contains(lower(text),'than') then 'high_priority' else 'normal' end priority from turns")(lambda r: r.conversations().select("conv_id", "turn", conversation.escalation(F.col("text"), ("blehe",), ("than",))["priority"].alias("priority")))
query("d11_guard", "select conv_id, turn, case when regexp_matches(lower(trim(substr(trim(text),1,1500))),'(and the)|(of that)') then 'role_assumption' when regexp_matches(lower(trim(substr(trim(text),1,1500))),'(is to)') then 'prompt_injection' end blocked from turns")(lambda r: r.conversations().select("conv_id", "turn", conversation.guard(F.col("text"), ("and the", "of that"), ("is to",)).alias("blocked")))
query("t17_resolved", "select conv_id, turn, case when role='user' and regexp_matches(trim(text),'(?i)^(the|of|is)\\b') and entity is not null then text||' about '||entity else text end resolved from (select *, last_value(nullif(regexp_extract(text,'\\b(th[a-z]{4,8})\\b',1),'') ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) entity from turns)")(lambda r: conversation.resolve(r.conversations(), r"\b(th[a-z]{4,8})\b", r"(?i)^(the|of|is)\b").select("conv_id", "turn", "resolved"))

#: Names with signs and numbers; besides, the first one to eight words of every third conversation are a name.
SIGNED_NAMES = ("co-amoxiclav 625", "0.9% saline", "vitamin b-12", "la, une")
NAMED = "select 1000000+i drug_id, w as name from (values " + ",".join(f"({i},'{w}')" for i, w in enumerate(SIGNED_NAMES)) + ") v(i,w) union all select conv_id, array_to_string(string_split(min_by(text,turn),' ')[1:conv_id//3%8+1],' ') from turns where conv_id%3=0 group by conv_id"


def spoken_names(r: Retail) -> DataFrame:
    first = r.conversations().filter("conv_id % 3 = 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    names = first.select(F.col("conv_id").cast("long").alias("drug_id"), F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.floor(F.col("conv_id") / 3) % 8 + 1).cast("int")), " ").alias("name"))
    return names.unionByName(r.spark.createDataFrame([(1_000_000 + i, w) for i, w in enumerate(SIGNED_NAMES)], "drug_id long, name string"))


def spoken_sql(text: str, turns: str, key: str = "conv_id, turn") -> str:
    """mentions() of a column: the whole name, or its first word of three letters or more, stands in the text."""
    return f"(select distinct {key}, drug_id from {turns} cross join (select drug_id, trim(lower(name)) n, regexp_split_to_array(trim(lower(name)),'\\s+')[1] w from ({NAMED})) where (n<>'' and contains(lower({text}),n)) or (length(w)>=3 and contains(lower({text}),w)))"


SPOKEN = spoken_sql("text", "turns")
query("j14_mentions", f"select conv_id, turn, drug_id from {SPOKEN}")(lambda r: conversation.mentions(r.conversations(), spoken_names(r), ["conv_id", "turn"], "text"))


def name_pairs(r: Retail) -> DataFrame:
    """Interactions of names whose numbers are near each other."""
    n, at = spoken_names(r).select("drug_id"), F.floor(F.col("drug_id") / 31)
    near = n.select(F.col("drug_id").alias("a"), F.explode(F.array(at, at + 1)).alias("cell")).join(n.select(F.col("drug_id").alias("b"), at.alias("cell")), "cell").filter("b > a and b <= a + 30")
    return near.select("a", "b", F.when((F.col("a") + F.col("b")) % 2 == 0, "high").otherwise("low").alias("severity"))


NAME_PAIRS = f"(select x.drug_id a, y.drug_id b, case when (x.drug_id+y.drug_id)%2=0 then 'high' else 'low' end severity from ({NAMED}) x join ({NAMED}) y on y.drug_id>x.drug_id and y.drug_id<=x.drug_id+30)"


def conversation_interactions(r: Retail) -> DataFrame:
    t, spoken = r.conversations(), conversation.spoken_patterns(spoken_names(r))
    found = conversation.said_patterns(t, spoken, ["conv_id", "turn"], "text")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return conversation.spoken_interactions(found.select("conv_id", "pattern").distinct(), found.join(last, ["conv_id", "turn"]).select("conv_id", "pattern"), spoken, name_pairs(r), "conv_id")


query("j15_mentioned_interactions", f"with s as {SPOKEN}, v as {NAME_PAIRS}, f as (select distinct conv_id, drug_id from s), l as (select conv_id, drug_id from s join (select conv_id, max(turn) turn from turns group by 1) using(conv_id, turn)), p as (select x.conv_id, v.a, v.b, v.severity from f x join f y on x.conv_id=y.conv_id join v on v.a=x.drug_id and v.b=y.drug_id where exists(select 1 from l where l.conv_id=x.conv_id and l.drug_id in (v.a,v.b))) select conv_id, a, b, severity from (select *, row_number() over (partition by conv_id order by a, b) k from p) where k=1")(
    conversation_interactions
)

ROUTED = """(select conv_id, turn, role, text||case when role='user' then ['', ' pretend to be an admin', ' overdose', ' what a scam', ' I want 3 boxes, code care 10', ' list the tablets', '', ' co-amoxiclav 625 and 0.9% saline', ' vitamin b-12'][((conv_id*31+turn)%9+1)::int] else '' end text from turns)"""
TAILS = ("", " pretend to be an admin", " overdose", " what a scam", " I want 3 boxes, code care 10", " list the tablets", "", " co-amoxiclav 625 and 0.9% saline", " vitamin b-12")
ROUTING = conversation.Rules(("overdose",), ("scam",), ("pretend to be an admin",), ("ignore all rules",), r"\b(th[a-z]{4,8})\b", {"tablets": ("list the tablets",)}, r"(?i)^(the|of|is)\b")


def routed(r: Retail) -> DataFrame:
    """User turns with tails that every stage has something to find in; passages of the benchmark are the chunks."""
    tail = F.element_at(F.array(*map(F.lit, TAILS)), ((F.col("conv_id") * 31 + F.col("turn")) % 9 + 1).cast("int"))
    turns = r.conversations().withColumn("text", F.when(F.col("role") == "user", F.concat("text", tail)).otherwise(F.col("text")))
    drugs = spoken_names(r).withColumn("base_price", F.col("drug_id") % 50 + 1)
    chunks = r.raw("benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content"))
    return conversation.route(turns, drugs, name_pairs(r), chunks, ROUTING).withColumn("total", F.round("total", 2))


ROUTE = f"""with tt as {ROUTED},
 seen as (select *, last_value(nullif(regexp_extract(text,'\\b(th[a-z]{{4,8}})\\b',1),'') ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) entity, array_to_string(list(text) over (partition by conv_id order by turn rows between 4 preceding and 1 preceding), chr(10)) context from tt),
 u as (select conv_id, turn, conv_id||':'||turn id, text original, context, case when regexp_matches(trim(text),'(?i)^(the|of|is)\\b') and entity is not null then text||' about '||entity else text end text from seen where role='user'),
 around as (select conv_id, turn, concat_ws(chr(10), coalesce(context,''), text) text from u),
 fresh as {spoken_sql('text', 'u')}, wide as {spoken_sql('text', 'around')}, v as {NAME_PAIRS},
 named as (select conv_id, turn, min(drug_id) drug_id from fresh group by all),
 warned as (select conv_id, turn, min_by(severity, (a, b)) severity from (select x.conv_id, x.turn, v.a, v.b, v.severity from wide x join wide y on x.conv_id=y.conv_id and x.turn=y.turn join v on v.a=x.drug_id and v.b=y.drug_id
  where exists (select 1 from fresh f where f.conv_id=x.conv_id and f.turn=x.turn and f.drug_id in (v.a, v.b))) group by all),
 {sides('select id, text from u', 'select item_id id, text from benchmark')},
 best as (select query_id, chunk_id, round(score,6) best from lexical where round(score,6)>=.35 qualify row_number() over (partition by query_id order by round(score,6) desc, chunk_id)=1),
 e as (select u.conv_id, u.turn, case when contains(lower(trim(substr(trim(original),1,1500))),'pretend to be an admin') then 'role_assumption' when contains(lower(trim(substr(trim(original),1,1500))),'ignore all rules') then 'prompt_injection' end blocked,
  case when contains(lower(original),'overdose') then 'critical_emergency' when contains(lower(original),'scam') then 'high_priority' else 'normal' end priority, u.text<>original rewritten, case when contains(lower(u.text),'list the tablets') then 'tablets' end category,
  drug_id, severity, chunk_id, best, case when contains(u.text,'3 boxes, code care 10') then round_even((drug_id%50+1)*3*(1-10/100::double),2) when contains(u.text,'0.9% saline') then round_even((drug_id%50+1)*(1-9/100::double),2) end total from u left join named using(conv_id, turn) left join warned using(conv_id, turn) left join best on query_id=u.id)
 select conv_id, turn, case when blocked is not null then 'guard' when priority<>'normal' then 'escalation' when category is not null then 'intent' when total is not null then 'math' when severity is not null then 'interaction' when drug_id is not null then 'catalog'
  when best is not null then 'retrieval' when rewritten then 'reference' else 'general' end stage, blocked, priority, rewritten, category, drug_id, severity, chunk_id, best, total,
  case when total is not null then .99::double when severity is not null then .96::double when best>=.70 then .88::double when best is not null then .72::double else .60::double end confidence from e"""
query("t19_route", ROUTE)(routed)

# ---- matching ------------------------------------------------------------------------------------------------------------------


def catalog(r: Retail) -> DataFrame:
    named = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))
    return r.raw("part").groupBy(named.alias("name")).agg(F.min("p_partkey").alias("drug_id"))


def messy_lines(r: Retail) -> DataFrame:
    """Catalog names with a character dropped and a dosing tail."""
    k = F.col("p_partkey")
    full = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))
    at = (k % F.length("p_name") + 1).cast("int")
    broken = F.when(k % 3 == 0, full).otherwise(F.concat(F.substring(full, F.lit(1), at - 1), F.substring(full, at + 1, F.length(full))))
    none = F.lit(None).cast("string")
    return r.raw("part").select(k.alias("line_id"), F.concat(broken, F.lit(" - 1 tab BID")).alias("raw_name"), none.alias("instructions"), none.alias("form"), none.alias("strength"), F.lit(0.9).alias("ocr_confidence"))


query("e4_exact_matches", """with c as (select p_name, p_size, min(p_partkey) m from part group by 1,2),
 l as (select p_partkey line_id, p_size, case when p_partkey%3=0 then p_name else trim(substr(p_name,1,k-1)||substr(p_name,k+1)) end as called from (select *, (p_partkey%length(p_name)+1)::int k from part))
 select line_id, m drug_id, case when c.p_size=l.p_size then 'matched' else 'needs_review' end status, case when c.p_size=l.p_size then 1.0::double else .70::double end score from l join c on p_name=called
 qualify row_number() over (partition by line_id order by c.p_size=l.p_size desc, m)=1""")(lambda r: matching.exact_matches(messy_lines(r), catalog(r)).drop("options"))  # fmt: skip
query("j18_fuzzy_entities")(lambda r: matching.match_lines(messy_lines(r), catalog(r)).select("line_id", F.inline("candidates")).select("line_id", F.col("nth").alias("rank"), "drug_id", "score"))
query("e7_match_lines")(lambda r: matching.match_lines(messy_lines(r), catalog(r)).drop("candidates"))
# names far from each other, so that only a line's own name can reach the shortlist and SQL can tell its score
FAR = "translate(md5(s_suppkey::varchar),'0123456789','ghijklmnop')"


def far_catalog(r: Retail) -> DataFrame:
    k = F.col("s_suppkey")
    word = F.translate(F.md5(k.cast("string")), "0123456789", "ghijklmnop")
    return r.raw("supplier").select(k.alias("drug_id"), word.alias("word"), F.concat(word, F.lit(" "), (k % 40 + 5).cast("string"), F.lit("mg")).alias("name"))


def far_lines(r: Retail) -> DataFrame:
    """Each name as it is, without its last or its first letter, or with another strength."""
    k, word = F.col("drug_id"), F.col("word")
    strength = lambda more: F.concat(F.lit(" "), (k % 40 + more).cast("string"), F.lit("mg"))
    cut = F.when(k % 4 == 1, F.substring("word", 1, 31)).when(k % 4 == 2, F.substring("word", 2, 31)).otherwise(word)
    raw = F.concat(cut, F.when(k % 4 == 3, strength(50)).otherwise(strength(5)))
    none = F.lit(None).cast("string")
    return far_catalog(r).select(k.alias("line_id"), raw.alias("raw_name"), none.alias("instructions"), none.alias("form"), none.alias("strength"), F.lit(0.9).alias("ocr_confidence"))


FAR_SCORE = "case when s_suppkey%4=3 then .70::double else 1.0::double end"
query("e7_far_names", f"select s_suppkey line_id, case when s_suppkey%4=3 then 'needs_review' else 'matched' end status, case when s_suppkey%4<>3 then s_suppkey end drug_id, {FAR_SCORE} score, null::double margin from supplier")(lambda r: matching.match_lines(far_lines(r), far_catalog(r)).drop("candidates"))
query("j18_far_entities", f"select s_suppkey line_id, 1::int rank, s_suppkey drug_id, {FAR_SCORE} score from supplier")(lambda r: matching.match_lines(far_lines(r), far_catalog(r)).select("line_id", F.inline("candidates")).select("line_id", F.col("nth").alias("rank"), "drug_id", "score"))
query("e10_final_score", "select event_id, round(case when b<.75 then least(.5,b) else greatest(0,least(1,case when event_id%3=0 then case when event_id%2=0 then least(case when b>=.95 then 1.0 else .88 end,b+.05) else b-.25 end else b end)) end,6) score from (select event_id, (event_id*37%101)/100.0::double b from ev)")(
    lambda r: r.events().select("event_id", F.round(matching.final_score(F.col("event_id") * 37 % 101, F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.lit(False), F.lit(False)), 6).alias("score"))
)
query("e13_fused_readers", "select p_partkey line_id, least(.97::double, greatest((p_partkey%100)/100.0::double,.5::double)+.05::double) fused_confidence, false disagree from part")(lambda r: matching.fuse_readers(messy_lines(r).select("line_id", F.col("raw_name").alias("a"), F.lower("raw_name").alias("b"), (F.col("line_id") % 100 / 100).alias("ca"), F.lit(0.5).alias("cb")), "a", "b", "ca", "cb").select("line_id", "fused_confidence", "disagree"))
query("d12_line_status", "select event_id, case when value is null then 'illegible' when event_id%2=0 and event_id%3=0 then 'needs_review' when event_id%3<>0 and value<50 then 'needs_review' when event_id%3=0 then 'matched' else 'not_found' end status from ev")(lambda r: r.events().select("event_id", matching.line_status(F.when(F.col("event_id") % 3 == 0, "matched").otherwise("not_found"), F.col("value") / 100, F.col("event_id") % 2 == 0, F.col("value").isNotNull()).alias("status")))
query("d14_finalise", "select order_id, bool_and(line<>3) ready, string_agg(case when line=1 then part_id when line=2 then supplier_id end, ',' order by case when line=1 then part_id when line=2 then supplier_id end) chosen from items group by 1")(
    lambda r: matching.finalise(r.items().select("order_id", F.when(F.col("line") == 1, "confirmed").when(F.col("line") == 2, "overridden").when(F.col("line") == 3, F.lit(None).cast("string")).otherwise("rejected").alias("decision"), F.col("part_id").alias("matched_id"), F.col("supplier_id").alias("selected_id")), "order_id").withColumn("chosen", F.nullif(F.array_join("chosen", ","), F.lit("")))
)

# ---- models and streams --------------------------------------------------------------------------------------------------------


def model_decisions(r: Retail) -> DataFrame:
    """Trained on the history, applied to every pair: predicted days, churn and decision."""
    from cadencia.operators import models

    rows = bought(r)
    c, d = r.customers(), r.drugs()
    # models read their rows many times; written down, the items behind them are joined and dealt once for each table
    cycle_rows = features.split_80_20(scratch.written(features.cycle_training(rows, c, d).fillna(0.0), "cycle-rows"), "is_chronic", "customer_id", "drug_id")
    churn_rows = features.split_80_20(scratch.written(features.churn_training(rows, c, d, AS_OF), "churn-rows"), "target", "customer_id", "drug_id")
    cycle_rows, churn_rows = scratch.written(cycle_rows, "cycle-split"), scratch.written(churn_rows, "churn-split")
    cycle_model = models.fit(cycle_rows.filter("is_train"), features.CYCLE_FEATURES, models.regressors(8)["forest"])
    churn_model = models.fit(churn_rows.filter("is_train"), features.CHURN_FEATURES, models.classifiers(8)["logistic"], scale=True)
    bundle = models.tuned_bundle(churn_model, churn_rows.filter("not is_train"))
    serve = scratch.written(features.serving(rows, c, d, AS_OF), "serving")
    return models.evaluate(models.predict_cycles(cycle_model, serve, AS_OF), models.predict_churn(bundle, serve))


query("m15_model_decisions")(model_decisions)


def line_decisions(r: Retail) -> DataFrame:
    """A straight line from the mean gap to the next one, and a forest that has learned "ten days or more": both have closed forms."""
    from cadencia.operators import models

    rows, c, d = bought(r), r.customers(), r.drugs()
    line = models.fit(features.cycle_training(rows, c, d).fillna(0.0), ("avg_cycle_days",), models.regressors()["linear"], groups=())
    learned = r.events().select((F.col("event_id") % 20).cast("double").alias("days_since_last")).withColumn("target", (F.col("days_since_last") >= 10).cast("double"))
    bundle = models.tuned_bundle(models.fit(learned, ("days_since_last",), models.classifiers(5)["forest"], groups=()), learned)
    serve = features.serving(rows, c, d, AS_OF)
    return models.evaluate(models.predict_cycles(line, serve, AS_OF), models.predict_churn(bundle, serve))


query("m15_line_decisions", f"""with t as (select max(gap) filter (k=1) target, coalesce(avg(gap) filter (k>1),0) m from {ORDERED} join drugs using(drug_id) join customer on c_custkey=customer_id where c>=3 group by customer_id, drug_id),
 f as (select regr_intercept(target,m) i, regr_slope(target,m) s from t),
 v as (select customer_id, drug_id, coalesce(avg(gap),max(default_cycle_days))::double m, {D}-max(order_date) since, count(*)<2 cold from gaps join drugs using(drug_id) group by 1,2),
 p as (select *, greatest(1.0::double, round_even(i+s*m,1)) predicted_days, case when cold then .40::double when m>0 then round(greatest(0.0::double,least(1.0::double,1-3.27::double/m)),3) else .50::double end confidence, (since>=10)::int predicted from v cross join f)
 select customer_id, drug_id, predicted_days, ({D}+round_even(predicted_days,0)::int)::date next_date, confidence, predicted::double churn, predicted, case when predicted=1 then 'high' else 'low' end tier,
 case when predicted=1 then 'human_review' when confidence>=.80 then 'auto_send' when confidence>=.50 then 'human_review' else 'cold_start' end decision, case when predicted=1 then 'human_review' else 'auto_send' end churn_action from p""")(line_decisions)  # fmt: skip


def streamed(r: Retail, job) -> DataFrame:
    """The events folder read as a stream of one file, run through a job until it is empty."""
    out = scratch.new_path(r.spark, "stream")
    batch = r.raw("events")
    stream = r.spark.readStream.schema(batch.schema).parquet(f"{r.sf_dir}/events.parquet*").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.col("props").alias("payload"))
    job(stream).writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    scratch.delete(r.spark, f"{out}/state")
    return r.spark.read.parquet(f"{out}/data")


#: Longer than the whole log: no event is late, in whatever order it comes.
DECADE = "3650 days"


def replayed(r: Retail, job, batches: int = 3, batch=None) -> DataFrame:
    """The events as a stream of so many batches, dealt by a hash and not by time, run through a job until it is empty.

    A last event of nobody (session -1), a decade later, moves the watermark past all others. With `batch` a foreachBatch function gets the rows, in update mode.
    """
    home = scratch.new_path(r.spark, "replay")
    events = r.raw("events").select(F.col("user_id").cast("long").alias("session_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"), F.col("props").alias("payload"))
    files = max(1, int(r.spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(batches):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(batches)) == k).repartition(files, "event_id").write.mode("append").parquet(f"{home}/in")
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("session_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 7300 days")).alias("ts"))
    closing = [last.select("session_id", "event_id", "ts", F.lit(kind).alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("payload")) for kind in ("click", "purchase")]
    closing[0].unionByName(closing[1]).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = r.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/in")
    out = job(stream).writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    if batch is not None:
        out.outputMode("update").foreachBatch(batch).start().awaitTermination()
        scratch.delete(r.spark, home)
        return r.spark.range(0)
    out.outputMode("append").format("parquet").option("path", f"{home}/data").start().awaitTermination()
    for done in ("in", "state"):
        scratch.delete(r.spark, f"{home}/{done}")
    return r.spark.read.parquet(f"{home}/data")


def daily_activity(r: Retail) -> DataFrame:
    from cadencia.streaming import jobs

    done = streamed(r, lambda s: jobs.activity(s, "1 day"))
    return done.select("start", "event_type", "n")


query("st3_daily_activity", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) n from events where time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2")(daily_activity)


def ingested(r: Retail) -> DataFrame:
    from cadencia.streaming import jobs

    return streamed(r, jobs.ingest).select("event_id", "session_id", "event_type")


query("st1_ingest", "select event_id, user_id session_id, event_type from events")(ingested)

from cadencia.plans import steps  # noqa: E402, F401  registers the queries of single steps
