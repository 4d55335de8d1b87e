"""DuckDB forms of the model's tables, and a builder that puts those that a query names before it."""

from __future__ import annotations

import re

TABLES = {
    "tenants": "select n_nationkey::int tenant_id, n_name as name from nation",
    "customers": "select c_custkey customer_id, c_nationkey::int tenant_id, c_name full_name, c_mktsegment age_group, ['whatsapp','email','sms'][(c_custkey%3+1)::int] preferred_channel, case when c_custkey%7<>0 then '+20'||c_custkey end phone, 'c'||c_custkey||'@example.com' email from customer",
    "brands": "select p_partkey, substr(p_brand,7)::int drug_id, p_brand, p_retailprice::decimal(18,2) price from part",
    "drugs": "select drug_id, p_brand as name, 'cat'||(drug_id%5) category, round(sum(price)::double/count(price),2)::decimal(10,2) base_price, drug_id%2=0 is_chronic, (30+15*(drug_id%4))::int default_cycle_days from brands group by drug_id, p_brand",
    "ord": "select o_orderkey order_id, o_custkey customer_id, o_orderdate::date order_date, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end status, ['web','app','store'][(o_orderkey%3+1)::int] channel from orders",
    "items": "select l_orderkey order_id, l_linenumber line, l_partkey part_id, l_suppkey supplier_id, l_shipdate::date ship_date, l_quantity::int quantity, l_extendedprice::decimal(18,2) amount, drug_id from lineitem join brands on l_partkey=p_partkey",
    "inventory": "select supplier_id, drug_id, (sum(quantity)%50)::int stock_level, 10 reorder_point, case when (supplier_id+drug_id)%2<>0 then (sum(amount)%900)::decimal(10,2) end tenant_price from items group by supplier_id, drug_id",
    "interactions": "select a.drug_id a, b.drug_id b, ['low','medium','high'][((a.drug_id+b.drug_id)%3+1)::int] severity from drugs a join drugs b on a.drug_id<b.drug_id where (a.drug_id*31+b.drug_id)%7=0",
    "ev": "select user_id session_id, event_id event_seq, event_id, ts, event_type, value, props payload from events",
    "notifications": "select event_id notification_id, session_id customer_id, case when event_id%2=0 then 'discount' else 'plain' end variant, ts sent_at from ev where event_type='click'",
    "done": "select o.customer_id, i.drug_id, o.order_date, o.order_id, i.line, i.part_id, i.supplier_id, i.ship_date, i.quantity, i.amount from ord o join items i using(order_id) where o.status='completed'",
    "gaps": "select *, order_date - lag(order_date) over (partition by customer_id, drug_id order by order_date, order_id, line, part_id, supplier_id, ship_date) gap from done",
    "cycles": "select customer_id, drug_id, avg(gap)::double avg_cycle_days, max(order_date) last_purchase_date, count(*) purchases, (max(order_date) + round_even(0.85*avg(gap),0)::int)::date reminder_day from gaps group by customer_id, drug_id having count(*)>=2",
    "pairs": "select a, b, count(*) orders from (select distinct x.order_id, x.drug_id a, y.drug_id b from items x join items y on x.order_id=y.order_id and x.drug_id<y.drug_id) group by a,b",
    "singles": "select drug_id, count(distinct order_id) orders from items group by drug_id",
    "affinities": "select p.a, p.b, round(p.orders::double/least(s.orders,t.orders),6) confidence from pairs p join singles s on p.a=s.drug_id join singles t on p.b=t.drug_id",
    "turns": "select conv_id, turn, role, text from conversations",
}


def sql(body: str) -> str:
    """`body` behind the definitions of every model table that it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ", ".join(f"{n} as ({TABLES[n]})" for n in needed)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}" if head else body
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}" if head else body
    return f"with {head} {body}" if head else body
