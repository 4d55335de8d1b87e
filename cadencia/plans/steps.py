"""Registered queries of single steps: sources and sinks, text and similarity functions, decisions, matching steps, models and streams.

Each stands beside its DuckDB form, as in queries.py, which imports this module at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencia.functions import similarity as sm
from cadencia.functions import text as tx
from cadencia.operators import baskets, chain, conversation, cycles, features, governance, kpi, matching, retrieval
from cadencia.plans.queries import BROKEN, DECADE, REGISTRY, SCORED, VARIANTS, ab_rows, actor, bought, convs, damaged, query, replayed, scored, stem_sql, streamed, the_cycles
from cadencia.sources import io, scratch
from cadencia.sources.fixtures import Retail
from cadencia.sources.keyed import KeyedTable

RATE = "case when count(*)=0 then 0 else round(count(*) filter (converted)*100::double/count(*),1) end"

# ---- sources and sinks: written to the shared folder and read back -----------------------------------------------------------------


def json_events(r: Retail, keep=None) -> DataFrame:
    """Events as lines of JSON; every tenth is cut off in its middle."""
    rows = r.events() if keep is None else r.events().filter(keep)
    line = F.to_json(F.struct("event_id", "event_type"))
    return rows.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))


def event_schema(r: Retail):
    return r.raw("events").select("event_id", "event_type").schema


def text_file(df: DataFrame, r: Retail, name: str) -> str:
    path = scratch.new_path(r.spark, name)
    df.write.text(path)
    return path


def csv_round_trip(r: Retail, df: DataFrame) -> DataFrame:
    path = scratch.new_path(r.spark, "csv")
    io.write_csv(df, path)
    return io.read_csv(r.spark, path, df.schema)


def parquet_round_trip(r: Retail) -> DataFrame:
    path = scratch.new_path(r.spark, "parquet")
    io.write_parquet(r.orders(), path, "status")
    return r.spark.read.parquet(path).filter("status = 'completed'").select("order_id", "customer_id", "order_date", "status", "channel")


def jsonl_split(r: Retail) -> DataFrame:
    path = scratch.new_path(r.spark, "jsonl")
    io.write_jsonl(r.raw("labels").select("doc_id", "quality", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split")), path)
    return r.spark.read.schema("doc_id long, quality int").json(f"{path}/split=validation")


query("s1_table_scan", "select customer_id, tenant_id, full_name, age_group, preferred_channel, phone, email from customers")(lambda r: r.customers())
query("s2_csv_scan", "select customer_id, full_name, email from customers")(lambda r: csv_round_trip(r, r.customers().select("customer_id", "full_name", "email")))
query("s3_jsonl_strict", "select count(*) as lines, count(*) filter (event_id%10=0) broken from ev")(lambda r: io.count_broken(io.read_jsonl(r.spark, text_file(json_events(r), r, "lines"), event_schema(r))))
query("s4_jsonl_dropping", "select event_id, event_type from ev where event_id%10<>0")(lambda r: io.read_jsonl_dropping(r.spark, text_file(json_events(r), r, "lines"), event_schema(r)))
query("s5_parquet_sink", "select order_id, customer_id, order_date, status, channel from ord where status='completed'")(parquet_round_trip)
query("s6_jsonl_split", "select doc_id, quality from labels where doc_id%10=0")(jsonl_split)
query("s7_csv_sink", "select doc_id, md5(coalesce(text,'')) h from documents")(lambda r: csv_round_trip(r, r.documents().select("doc_id", "text")).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h")))
query("u5_batches", "select event_id, event_type from ev where event_id%10<>0")(
    lambda r: io.read_jsonl_dropping(r.spark, [text_file(json_events(r, F.col("event_id") % 2 == k), r, f"batch{k}") for k in (0, 1)], event_schema(r))
)

# ---- aggregates and windows ------------------------------------------------------------------------------------------------------

query("a8_weekly_variants", f"select date_trunc('week', sent_at)::date as week, variant, count(*) sent, count(*) filter (converted) converted, {RATE} rate_pct from {VARIANTS.replace('select n.variant,', 'select n.variant, n.sent_at,')} group by 1, 2")(lambda r: kpi.weekly_variants(ab_rows(r)))


def model_runs(r: Retail) -> DataFrame:
    """Events as runs of a model: value as the time to the first token, a second more in all, two gaps."""
    v = F.col("value")
    total = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(v + 1)
    return r.events().filter(v.isNotNull()).select(F.col("event_type").alias("model"), v.alias("first_token_s"), total.alias("total_s"), (F.col("event_id") % 50).alias("tokens"), F.array(v / 2, v / 4).alias("gaps"))


query("a22_model_speed", """select event_type model, count(*) runs, round(avg(value),6) first_token_s, round(avg((event_id%50)/(value+1)),6) tokens_per_s, round(avg(value*3/8),6) mean_gap, round(max(value/2),6) max_gap
 from ev where value is not null and event_id%7<>0 and value+1>0 group by 1""")(
    lambda r: kpi.model_speed(model_runs(r)).select("model", "runs", *(F.round(c, 6).alias(c) for c in ("first_token_s", "tokens_per_s", "mean_gap", "max_gap")))
)


def misread(r: Retail) -> DataFrame:
    """Part names beside a reading that lost some of their end, with the edit distance over the length."""
    name = F.col("p_name")
    read = F.substring(name, F.lit(1), F.length(name) - (F.col("p_partkey") % 4).cast("int"))
    return r.raw("part").select("p_partkey", (F.levenshtein(name, read) / F.length(name)).alias("error"))


query("a32_error_summary", """select count(e) n, round(avg(e),4) mean, count(*) filter (e<=.15::double) within_15, count(*) filter (e<=.30::double) within_30, count(*) filter (e=0) exact from (
 select levenshtein(p_name, substr(p_name,1,length(p_name)-(p_partkey%4)::int))::double/length(p_name) e from part)""")(lambda r: kpi.error_summary(misread(r), "error"))  # fmt: skip
REPORT = REGISTRY["t9_quality_report"]
REGISTRY["a28_score_ten"] = (lambda r: REPORT[0](r).select("n", "score_ten"), f"select n, score_ten from ({REPORT[1]})")
REGISTRY["a29_score_hundred"] = (lambda r: REPORT[0](r).select("n", "score_hundred"), f"select n, score_hundred from ({REPORT[1]})")
query("w2_previous_hash", BROKEN + " select session_id, event_seq, event_id, due_prev from v")(lambda r: chain.with_previous(damaged(r)).select("session_id", "event_seq", "event_id", "due_prev"))
SAID = r"\b(th[a-z]{4,8})\b"
query("w11_first_last_name", f"select conv_id, min_by(n, turn) first_name, max_by(n, turn) last_name from (select conv_id, turn, nullif(regexp_extract(text,'{SAID}',1),'') n from turns where role='user') where n is not null group by 1")(lambda r: conversation.user_names(r.conversations(), SAID))
query("w12_share", "select category, count(*) n, round(count(*)*100::double/(select count(*) from drugs),1) pct from drugs group by 1")(lambda r: kpi.distribution(r.drugs(), "category"))
query("l3_cross_sell", """select drug_id, rank, partner, name, base_price, confidence from (select drug_id, partner, confidence, row_number() over (partition by drug_id order by confidence desc, partner) rank from (
 select a drug_id, b partner, confidence from affinities union all select b, a, confidence from affinities)) join (select drug_id partner, name, base_price from drugs) using(partner) where rank<=5""")(
    lambda r: baskets.cross_sell(baskets.affinities(r.items()), r.drugs())
)
query("q6_cycle_sanity", "select d.drug_id, d.default_cycle_days intended, round(avg(c.avg_cycle_days),6) computed, count(c.avg_cycle_days) pairs, round(avg(c.avg_cycle_days)-d.default_cycle_days,6) difference from drugs d join cycles c using(drug_id) group by 1, 2")(
    lambda r: cycles.cycle_sanity(the_cycles(r), r.drugs()).filter("pairs > 0").select("drug_id", "intended", F.round("computed", 6).alias("computed"), "pairs", F.round("difference", 6).alias("difference"))
)
query("u4_shared_numbers", "select p_partkey, len(list_intersect([p_size::varchar, '7'], [(p_partkey%50)::varchar, '7', '8'])) shared from part")(
    lambda r: r.raw("part").select("p_partkey", retrieval.shared_numbers(F.concat_ws(" ", F.lit("size"), F.col("p_size").cast("string"), F.lit("or 7")), F.concat_ws(" ", (F.col("p_partkey") % 50).cast("string"), F.lit("x7-8"))).alias("shared"))
)

# ---- text and similarity ---------------------------------------------------------------------------------------------------------

query("f1_strings", "select p_partkey, lower(trim('  '||p_name||' ')) low, replace(p_name,' ','_') joined, split_part(p_name,' ',1) as head, starts_with(p_name,'s') starts, ends_with(p_name,'g') ends from part")(
    lambda r: r.raw("part").select("p_partkey", F.lower(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("low"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.startswith("p_name", F.lit("s")).alias("starts"), F.endswith("p_name", F.lit("g")).alias("ends"))
)
query("f2_patterns", "select doc_id, md5(regexp_replace(text,'[0-9]+','#','g')) masked, regexp_extract(text,'([a-z]+)',1) as head, len(regexp_extract_all(text,'[0-9]+')) numbers, regexp_extract_all(text,'[0-9]+')[-1] last_number from documents")(
    lambda r: r.documents().select("doc_id", F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("masked"), F.regexp_extract("text", "([a-z]+)", 1).alias("head"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"), F.try_element_at(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), F.lit(-1)).alias("last_number"))
)
ARABIC = "إأآ ةىؤئ مـدرَسةٌ "
query("f3_normalized", f"select conv_id, turn, trim(translate(regexp_replace('{ARABIC}'||text,'{tx.MARKS}','','g'),'إأآةىؤئ','اااهيوي')) plain from turns")(lambda r: r.conversations().select("conv_id", "turn", tx.normalize_arabic(F.concat(F.lit(ARABIC), "text")).alias("plain")))


AFFIXED = "['ال','وال','لل',''][(p_partkey%4+1)::int]||split_part(p_name,' ',1)||['ات','ها','ية',''][(p_partkey//4%4+1)::int]"


def affixed(r: Retail) -> DataFrame:
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % 4 + 1).cast("int"))
    k = F.col("p_partkey")
    return r.raw("part").select("p_partkey", F.concat(pick(("ال", "وال", "لل", ""), k), F.split_part("p_name", F.lit(" "), F.lit(1)), pick(("ات", "ها", "ية", ""), F.floor(k / 4))).alias("word"))


query("f4_light_stem", f"select p_partkey, {stem_sql('x')} stem from (select p_partkey, {AFFIXED} x from part)")(lambda r: affixed(r).select("p_partkey", tx.light_stem(F.col("word")).alias("stem")))
# a word of the name against the word without its first two letters and a tail of other signs: the best window hangs over the end, and SQL can tell both ratios
query("f13_ratios", "select p_partkey, round(200.0::double*(n-2)/(2*n+4),6) as first, round(200.0::double*(n-2)/(2*n-2),6) partial from (select p_partkey, length(split_part(p_name,' ',1)) n from part)")(
    lambda r: r.raw("part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).withColumn("s", sm.name_scores("w", F.concat(F.substring("w", F.lit(3), F.length("w")), F.lit("######")))).select("p_partkey", F.round("s.first", 6).alias("first"), F.round("s.partial", 6).alias("partial"))
)
#: The keys of the words of the names, by the published rules.
KEYS = {"anvil": "ANFL", "blue": "BL", "bolt": "BLT", "cold": "KLT", "gear": "JR", "gizmo": "JSM", "hot": "HT", "large": "LRJ", "new": "N", "old": "OLT", "plate": "PLT", "red": "RT", "ring": "RNK", "rod": "RT", "small": "SML", "widget": "WJT"}


def key_sql(name: str) -> str:
    return f"array_to_string([map {{{', '.join(repr(w) + ': ' + repr(k) for w, k in KEYS.items())}}}[w] for w in string_split({name}, ' ')], ' ')"


query("f14_phonetic", f"select p_partkey, round(100*jaro_winkler_similarity({key_sql('p_name')}, {key_sql('o')}),4) score from part join (select p_partkey k, p_name o from part) on k=p_partkey%64+1")(
    lambda r: r.raw("part").join(r.raw("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("o")), F.expr("k = p_partkey % 64 + 1")).select("p_partkey", F.round(sm.phonetic_similarity("p_name", "o"), 4).alias("score"))
)
query("f15_sequence_error", "select p_partkey, round(1-2.0::double*3/(length(p_name)+3),4) error from part")(lambda r: r.raw("part").select("p_partkey", sm.sequence_error("p_name", F.substring("p_name", 1, 3)).alias("error")))
query("f17_elapsed", "select event_id, round((epoch(timestamp '2024-03-01')-floor(epoch(ts)))/3600.0::double,1) as hours from ev where event_id%2=0 and (epoch(timestamp '2024-03-01')-floor(epoch(ts)))/3600.0::double>=24")(
    lambda r: governance.sla_breaches(r.events().select("event_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 2 == 0, "human_review").otherwise("auto_send").alias("decision")), "2024-03-01").select("event_id", "hours")
)
query("f18_clamped", "select customer_id, drug_id, round(greatest(0.0::double,least(1.0::double,1-20/nullif(avg_cycle_days,0))),3) inside from cycles where avg_cycle_days>0")(
    lambda r: the_cycles(r).filter("avg_cycle_days > 0").select("customer_id", "drug_id", governance.cycle_confidence(F.col("avg_cycle_days"), F.lit(False), 20.0).alias("inside"))
)
query("f22_json_or_fields", "select event_id, regexp_extract(payload,'\"k\": *([0-9]+)',1) k from ev where payload is not null")(
    lambda r: r.events().filter("payload is not null").select("event_id", tx.json_or_fields(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "payload", F.lit(" and more"))), "k")["k"].alias("k"))
)
query("f23_labelled_field", "select p_partkey, p_name as name, p_size::varchar as size, null::varchar form from part")(
    lambda r: r.raw("part").withColumn("t", F.concat(F.lit("Name: "), "p_name", F.lit("\n size :"), F.col("p_size").cast("string"), F.lit("\nend"))).select("p_partkey", tx.labelled_field(F.col("t"), "NAME").alias("name"), tx.labelled_field(F.col("t"), "SIZE").alias("size"), tx.labelled_field(F.col("t"), "FORM").alias("form"))
)
query("f24_canonical_pairs", "select distinct least(part_id, supplier_id) a, greatest(part_id, supplier_id) b from items")(lambda r: r.items().select(*baskets.canonical("part_id", "supplier_id")).distinct())
KEYS = ("than", "that", "thing")
query("f25_keywords", "select conv_id, turn, " + " or ".join(f"contains(lower(text),'{k}')" for k in KEYS) + " found, " + "+".join(f"contains(lower(text),'{k}')::int" for k in KEYS) + " n, array_to_string([w for w in regexp_split_to_array(text,'\\s+') if w<>''][-3:],' ') tail from turns")(
    lambda r: r.conversations().select("conv_id", "turn", tx.contains_any(F.lower("text"), KEYS).alias("found"), tx.count_words(F.lower("text"), KEYS).alias("n"), F.array_join(tx.last_words(F.col("text"), 3), " ").alias("tail"))
)

# ---- decisions -------------------------------------------------------------------------------------------------------------------

query("d2_churn_action", f"select doc_id, case when score>=.5 then 'human_review' else 'auto_send' end as action from {SCORED}")(
    lambda r: r.raw("labels").filter("quality is not null").select("doc_id", governance.churn_action(F.col("doc_id") * 7919 % 100 / 100).alias("action"))
)
query("d3_confidence", "select customer_id, drug_id, case when purchases<3 then .40::double when avg_cycle_days>0 then round(greatest(0.0::double,least(1.0::double,1-3.27::double/avg_cycle_days)),3) else .50::double end confidence from cycles")(
    lambda r: the_cycles(r).select("customer_id", "drug_id", governance.cycle_confidence(F.col("avg_cycle_days"), F.col("purchases") < 3).alias("confidence"))
)
query("d4_churn_tiers", "select doc_id, case when s>=.60 then 'high' when s>=.33 then 'medium' else 'low' end tier from (select doc_id, (doc_id*7919%100)/100.0::double s from labels)")(lambda r: r.raw("labels").select("doc_id", governance.churn_tier(F.col("doc_id") * 7919 % 100 / 100).alias("tier")))
query("d13_traffic_light", """select event_id, case when s>=.65 and s>=.95 and (m is null or m>=.10) and event_id%11<>0 and event_id%13<>0 and o>=.85 then 'matched' when s>=.65 then 'needs_review' else 'not_found' end status from (
 select event_id, (50+event_id*37%51)/100.0::double s, case when event_id%3<>0 then (event_id%20)/100.0::double end m, (80+event_id%20)/100.0::double o from ev)""")(
    lambda r: r.events().select("event_id", matching.traffic_light((50 + F.col("event_id") * 37 % 51) / 100, F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 20 / 100), F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0, (80 + F.col("event_id") % 20) / 100).alias("status"))
)
query("d15_badge", "select event_id, case when event_id%5=0 then .99 when event_id%7=0 then .96 when value>=70 then .88 when value is not null then .72 else .60 end::double confidence from ev")(lambda r: r.events().select("event_id", conversation.badge(F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0, F.col("value") / 100).alias("confidence")))
query("d16_scope", "select event_id, (event_id%100)/100.0::double>=.50 or (event_id*7%60)/100.0::double>=.35 or (event_id*13%90)/100.0::double>=.65 in_scope from ev")(lambda r: r.events().select("event_id", retrieval.in_scope(F.col("event_id") % 100 / 100, F.col("event_id") * 7 % 60 / 100, F.col("event_id") * 13 % 90 / 100).alias("in_scope")))

# ---- steps of line matching --------------------------------------------------------------------------------------------------------


def written_lines(r: Retail) -> DataFrame:
    """Product lines with a name, instructions only, or a form only."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    none = F.lit(None).cast("string")
    full = F.concat(F.lit("2. "), name, F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg - 1 tab BID"))
    return r.raw("part").select(F.col("p_partkey").alias("line_id"), F.when(k == 0, full).when(k == 1, F.lit("  ")).alias("raw_name"), F.when(k == 1, F.concat(F.lit("take "), name)).alias("instructions"), F.lit("syrup").alias("form"), none.alias("strength"), F.lit(0.9).alias("ocr_confidence"))


def catalog_of_sizes(r: Retail) -> DataFrame:
    """One entry for each name and size."""
    full = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))
    return r.raw("part").groupBy(full.alias("name")).agg(F.min("p_partkey").alias("drug_id"))


def bare_lines(r: Retail, name) -> DataFrame:
    none = F.lit(None).cast("string")
    return r.raw("part").select(F.col("p_partkey").alias("line_id"), name.alias("raw_name"), none.alias("instructions"), none.alias("form"), none.alias("strength"), F.lit(0.9).alias("ocr_confidence"))


query("e1_picked_text", "select p_partkey line_id, case p_partkey%3 when 0 then lower(p_name) when 1 then 'take '||lower(p_name) else 'syrup' end as name from part")(lambda r: matching.picked_text(written_lines(r)).select("line_id", "name"))
query("e2_inline_strength", "select p_partkey line_id, case when p_partkey%3=0 then p_size||'mg' end strength from part")(lambda r: matching.picked_text(written_lines(r)).select("line_id", "strength"))
query("e3_too_short", "select p_partkey line_id, 'not_found' status, 0.0::double score from part")(lambda r: matching.match_lines(bare_lines(r, F.substring("p_name", 1, 2)), catalog_of_sizes(r)).select("line_id", "status", "score"))
query("e5_name_only", """select p_partkey line_id, drug_id, case when sizes>1 then 'needs_review' else 'matched' end status, case when sizes>1 then .70 else 1.0 end::double score, case when sizes>1 then entries else 0 end::bigint options
 from part join (select lower(p_name) n, min(p_partkey) drug_id, count(distinct p_size) sizes, count(distinct p_name||p_size) entries from part group by 1) on n=lower(p_name)""")(
    lambda r: matching.exact_matches(bare_lines(r, F.col("p_name")), catalog_of_sizes(r)).withColumn("options", F.coalesce(F.size("options"), F.lit(0)).cast("long"))
)


def guarded(r: Retail) -> DataFrame:
    k = F.col("event_id")
    a = F.when(k % 7 != 0, F.concat((k % 5).cast("string"), F.lit("mg")))
    b = F.concat((k % 3).cast("string"), F.when(k % 2 == 0, "mg").otherwise("ml"))
    match, conflict = matching.strength_guard(a, b)
    return r.events().select("event_id", match.alias("same"), conflict.alias("conflict"))


query("e6_strength_guard", "select event_id, event_id%7<>0 and event_id%5=event_id%3 same, event_id%7<>0 and event_id%5<>event_id%3 conflict from ev")(guarded)
BASE = "(event_id*37%101)::double fuzzy, (event_id*53%101)::double phonetic, (event_id*29%101)::double first_ratio"


def name_scores(r: Retail) -> DataFrame:
    k = F.col("event_id")
    return r.events().select("event_id", *((k * m % 101).cast("double").alias(n) for m, n in ((37, "fuzzy"), (53, "phonetic"), (29, "first_ratio"))))


query("e8_phonetic_blend", f"select event_id, round(case when phonetic>80 or fuzzy>50 then greatest(fuzzy,.9::double*phonetic) else fuzzy end,6) score from (select event_id, {BASE} from ev)")(lambda r: name_scores(r).select("event_id", F.round(matching.blended(F.col("fuzzy"), F.col("phonetic")), 6).alias("score")))
query("e9_first_word_cap", f"select event_id, case when first_ratio<65 then least(phonetic,(fuzzy+first_ratio)/2) else phonetic end score from (select event_id, {BASE} from ev)")(lambda r: name_scores(r).select("event_id", matching.first_word_cap(F.col("phonetic"), F.col("fuzzy"), F.col("first_ratio")).alias("score")))
query("e11_conflict_and_look_alike", """select p_partkey, least(case when p_partkey%2=0 then .70::double else 1.0::double end, (p_partkey%101)/100.0::double) score,
 p_partkey%101<95 and not (length(tail)>=4 and length(tail)<length(head)) look_alike from (select p_partkey, split_part(p_name,' ',1) head, substr(split_part(p_name,' ',1),3) tail from part)""")(
    lambda r: r.raw("part").withColumn("head", F.split_part("p_name", F.lit(" "), F.lit(1))).select("p_partkey", matching.conflict_cap(F.col("p_partkey") % 101 / 100, F.col("p_partkey") % 2 == 0).alias("score"), matching.look_alike(F.col("p_partkey") % 101, F.expr("substr(head, 3)"), F.col("head")).alias("look_alike"))
)
query("e12_shortlist", """with s as (select session_id, event_id, (event_id*37%101)/100.0::double score, row_number() over (partition by session_id order by (event_id*37%101)/100.0::double desc, event_id) k from ev where (event_id*37%101)/100.0::double>=.60)
 select session_id, string_agg(event_id::varchar, ',' order by k) ids, round(max(score) filter (k=1)-max(score) filter (k=2),6) margin from s where k<=3 group by 1""")(
    lambda r: matching.shortlist(r.events().select("session_id", "event_id", (F.col("event_id") * 37 % 101 / 100).alias("score")), "session_id", "event_id").select("session_id", F.array_join(F.transform("candidates", lambda c: c["event_id"].cast("string")), ",").alias("ids"), "margin")
)

# ---- retrieval and conversations ---------------------------------------------------------------------------------------------------

THESAURUS = {"than": "compared with", "thing": "object", "that": "which"}
query("t10_expanded", "select conv_id, turn, concat_ws(' ', text, array_to_string([x for x in [" + ",".join(f"case when contains(lower(text),'{k}') then '{v}' end" for k, v in THESAURUS.items()) + "] if x is not null],' ')) expanded from turns")(
    lambda r: retrieval.expand_query(r.conversations(), "text", THESAURUS).select("conv_id", "turn", "expanded")
)
query("t13_dense_top", REGISTRY["j19_dense_top_k"][1].replace("rank<=5", "rank<=3"))(lambda r: retrieval.dense_top_k(r.embeddings().filter("vec_id % 50 = 0"), r.embeddings(), 3, "vec_id", "vec_id", "embedding"))
INTENTS = {"compare": ("than", "better"), "point": ("that", "and the"), "other": ("thing",)}
PARTS = ("over-the", "for you")
WORDS = "regexp_split_to_array(trim(lower(text)),'\\s+')"


def intent_sql() -> str:
    hit = lambda k: f"contains(trim(lower(text)),'{k}')" if " " in k else f"list_contains({WORDS},'{k}')"
    first = " ".join(f"when {' or '.join(map(hit, ks))} then '{n}'" for n, ks in INTENTS.items())
    parts = " ".join("when " + " or ".join(hit(p) for p in c.replace("-", " ").split() if len(p) > 2) + f" then '{c}'" for c in PARTS)
    return f"case {first} {parts} end"


query("t15_category_intent", f"select conv_id, turn, {intent_sql()} category from turns")(lambda r: retrieval.category_intent(r.conversations(), "text", INTENTS, PARTS).select("conv_id", "turn", "category"))
query("t15_category_plain", "select conv_id, turn, case " + " ".join("when " + " or ".join(f"contains(lower(text),'{k}')" for k in ks) + f" then '{n}'" for n, ks in INTENTS.items()) + " end category from turns")(lambda r: retrieval.category_intent_plain(r.conversations(), "text", INTENTS).select("conv_id", "turn", "category"))
query("t18_invoice", """select p_partkey, (p_size+2)::int quantity, (p_partkey%30)::double discount, case when p_size+2>1 or p_partkey%30>0 then round_even((p_size+1.0::double)*(p_size+2)*(1-(p_partkey%30)/100.0::double),2) end total from part""")(
    lambda r: conversation.invoice(r.raw("part").withColumn("said", F.concat(F.lit("I want "), (F.col("p_size") + 2).cast("string"), F.lit(" boxes of it, code CARE "), (F.col("p_partkey") % 30).cast("string"))), "said", F.col("p_size") + 1.0).select("p_partkey", "quantity", "discount", "total")
)
query("t20_line_fields", "select p_partkey, p_name||' '||p_size||' mg tabs' as text, p_size||'mg' strength, 'tabs' form, (p_partkey%300)::int quantity from part")(
    lambda r: r.raw("part").select("p_partkey", tx.line_fields(F.concat(F.lit("4) "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg tabs"))).alias("f"), tx.line_fields(F.concat("p_name", F.lit(" x "), (F.col("p_partkey") % 300).cast("string")))["quantity"].alias("q")).select("p_partkey", "f.text", "f.strength", "f.form", F.col("q").alias("quantity"))
)

# ---- features and models -----------------------------------------------------------------------------------------------------------

query("m3_leaky_mean", "select customer_id, drug_id, round(avg(gap),6) avg_cycle_days from gaps join drugs using(drug_id) join customer on c_custkey=customer_id group by 1, 2 having count(*)>=3")(
    lambda r: features.cycle_training(bought(r), r.customers(), r.drugs(), leak_free=False).select("customer_id", "drug_id", F.round("avg_cycle_days", 6).alias("avg_cycle_days"))
)
query("m4_label_noise", "select doc_id, case when ('0x'||substr(md5('42:'||doc_id),1,8))::bigint%10000<1000 then 1-quality else quality end quality from labels where quality is not null")(
    lambda r: features.flip_labels(r.raw("labels").filter("quality is not null").select("doc_id", "quality"), "quality", 0.10, "doc_id")
)


def encoded(r: Retail) -> DataFrame:
    """The place of a drug's one-hot category and its numbers, from the assembled vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from cadencia.operators import models

    rows = r.drugs().select("drug_id", "category", F.col("base_price").cast("double").alias("base_price"))
    out = Pipeline(stages=models.preprocessor(("base_price",), ("category",))).fit(rows).transform(rows).select("drug_id", vector_to_array("features").alias("v"))
    return out.select("drug_id", (F.array_position("v", 1.0) - 1).alias("hot"), F.element_at("v", -1).alias("base_price"))


query("m6_one_hot", "select drug_id, hot, base_price::double base_price from drugs join (select category, row_number() over (order by count(*) desc, category)-1 hot from drugs group by 1) using(category)")(encoded)
POINTS = "(select event_id, event_id%20 x, event_id%7 z, 3*(event_id%20)+event_id%3 target from ev)"


def points(r: Retail) -> DataFrame:
    k = F.col("event_id")
    return r.events().select("event_id", (k % 20).cast("double").alias("x"), (k % 7).cast("double").alias("z"), (3 * (k % 20) + k % 3).cast("double").alias("target"))


def parted(r: Retail) -> DataFrame:
    return points(r).withColumn("target", (F.col("x") >= 10).cast("double"))


def line_fit(r: Retail, *numbers: str) -> DataFrame:
    """Straight lines through one number each, and the mean of their predictions."""
    from cadencia.operators import models

    rows = points(r)
    fitted = {n: models.fit(rows, (n,), models.regressors()["linear"], groups=()) for n in numbers}
    return models.ensemble(fitted, rows, classify=False).select("event_id", F.round("prediction", 4).alias("prediction"))


def predicted_classes(r: Retail, rows: DataFrame) -> DataFrame:
    from cadencia.operators import models

    out = rows.select("event_id")
    for name, kind in models.classifiers(5).items():
        p = models.probability(models.fit(rows, ("x", "z"), kind, groups=()), rows)
        out = out.join(p.select("event_id", (F.col("probability_1") >= 0.5).cast("int").alias(name)), "event_id")
    return out


def searched(r: Retail) -> DataFrame:
    from cadencia.operators import models

    rows = points(r)
    best = models.search(rows, ("x",), models.regressors()["linear"], {"regParam": [0.0, 1000.0]}, folds=5, groups=()).bestModel
    return best.transform(rows).select("event_id", F.round("prediction", 4).alias("prediction"))


def most_important(r: Retail) -> DataFrame:
    from cadencia.operators import models

    rows = parted(r).withColumn("z", F.lit(1.0))
    found = models.importance(models.fit(rows, ("x", "z"), models.classifiers(5)["forest"], groups=()), rows, 2)
    return r.spark.createDataFrame(found, "feature string, importance double")


def bundled(r: Retail) -> DataFrame:
    from cadencia.operators import models

    rows = parted(r)
    bundle = models.tuned_bundle(models.fit(rows.filter("event_id % 3 != 0"), ("x", "z"), models.classifiers(5)["forest"], groups=()), rows.filter("event_id % 3 = 0"))
    return bundle.predict(rows).select("event_id", "predicted")


def batch_churn(r: Retail) -> DataFrame:
    from cadencia.operators import models

    rows = parted(r).withColumn("customer_id", F.col("event_id")).withColumn("drug_id", F.lit(1))
    bundle = models.tuned_bundle(models.fit(rows, ("x",), models.classifiers(5)["forest"], groups=()), rows)
    return models.predict_churn(bundle, rows).select("customer_id", "drug_id", "predicted")


def permuted(r: Retail) -> DataFrame:
    """A straight line through x, with x and z exchanged in turn; z has no part in it."""
    from cadencia.operators import models

    rows = points(r)
    line = models.fit(rows, ("x",), models.regressors()["linear"], groups=())
    found = models.permutation_importance(line.transform, rows, ("x", "z"), "event_id")
    return found.select("feature", (F.round("importance", 6) + 0.0).alias("importance"))


PERMUTED = f"""with p as {POINTS}, n as (select greatest(1, (count(*)+4095)//4096) blocks from p), d as (select *, md5('42:'||event_id) digest from p),
 b as (select *, ('0x'||substr(digest,1,8))::bigint % blocks block from d cross join n),
 m as (select *, coalesce(lead(x) over w, first_value(x) over (partition by block order by digest, event_id rows between unbounded preceding and unbounded following)) nx from b window w as (partition by block order by digest, event_id)),
 f as (select regr_intercept(target,x) i, regr_slope(target,x) s from p)
 select 'x' feature, round(avg(abs(target-(i+s*nx)))-avg(abs(target-(i+s*x))),6) importance from m cross join f union all select 'z', 0.0::double"""


def minority(r: Retail) -> DataFrame:
    return points(r).filter("event_id % 5 = 0")


def oversampled(r: Retail) -> DataFrame:
    rows = points(r).select("event_id", "x", "z", (F.col("event_id") % 5 == 0).cast("int").alias("target"))
    return features.oversample(rows, "target", ["x", "z"], "event_id").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


query("m7_linear", f"select event_id, round(i+s*x,4) prediction from {POINTS} cross join (select regr_intercept(target,x) i, regr_slope(target,x) s from {POINTS})")(lambda r: line_fit(r, "x"))
query("m9_ensemble", f"select event_id, round((i+s*x+j+t*z)/2,4) prediction from {POINTS} cross join (select regr_intercept(target,x) i, regr_slope(target,x) s, regr_intercept(target,z) j, regr_slope(target,z) t from {POINTS})")(lambda r: line_fit(r, "x", "z"))
query("m8_classifiers", f"select event_id, (x>=10)::int logistic, (x>=10)::int forest, (x>=10)::int boosted from {POINTS}")(lambda r: predicted_classes(r, parted(r)))
query("m11_oversampled", "select (event_id%5=0)::int target, (select count(*) filter (event_id%5<>0) from ev) n, min(event_id%20)::double least, max(event_id%20)::double most from ev group by 1")(oversampled)
query("m12_search", f"select event_id, round(i+s*x,4) prediction from {POINTS} cross join (select regr_intercept(target,x) i, regr_slope(target,x) s from {POINTS})")(searched)
query("m11_nearest", "with p as (select event_id, event_id%20 x, event_id%7 z from ev where event_id%5=0) select event_id, row_number() over (partition by event_id order by distance, other)::int rank, other, distance from (select a.event_id, b.event_id other, ((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z))::double distance from p a join p b on a.event_id<>b.event_id) qualify rank<=5")(lambda r: features.nearest_rows(minority(r), ["x", "z"], "event_id", 5))
query("m13_permutation", PERMUTED)(permuted)
query("m13_importance", "select 'x' feature, 1.0::double importance union all select 'z', 0.0")(most_important)
query("m14_bundle", f"select event_id, (x>=10)::int predicted from {POINTS}")(bundled)
query("m16_batch_churn", f"select event_id customer_id, 1 drug_id, (x>=10)::int predicted from {POINTS}")(batch_churn)

# ---- streams -----------------------------------------------------------------------------------------------------------------------


def stateful(r: Retail, job, run=streamed, **more) -> DataFrame:
    """streamed() with the RocksDB state store that jobs with own state need."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = r.spark.conf.get(key, None)
    r.spark.conf.set(key, kind)
    try:
        return run(r, job, **more)
    finally:
        r.spark.conf.unset(key) if before is None else r.spark.conf.set(key, before)


def signed_stream(r: Retail) -> DataFrame:
    """Events in three batches without regard to their time; the delay is longer than the log."""
    from cadencia.streaming import jobs

    acted = lambda s: s.withColumn("event_seq", F.col("event_id")).withColumn("actor", actor())
    return stateful(r, lambda s: jobs.sign_stream(acted(s), DECADE), replayed).filter("session_id >= 0")


def breached(r: Retail) -> DataFrame:
    """Clicks as reminders; every third is reviewed, up to 47 hours later."""
    from cadencia.streaming import jobs

    def changes(s: DataFrame) -> DataFrame:
        made = F.struct(F.lit("created").alias("kind"), "ts")
        seen = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("reviewed").alias("kind"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("ts")))
        rows = s.filter("event_type = 'click'").select(F.col("event_id").alias("reminder_id"), F.explode(F.array_compact(F.array(made, seen))).alias("x"))
        return rows.select("reminder_id", "x.kind", "x.ts")

    return stateful(r, lambda s: jobs.sla_breaches(changes(s)))


def rolling_week(r: Retail) -> DataFrame:
    """Daily panes of three batches in a keyed table, and the weeks that they add up to."""
    from cadencia.streaming import jobs

    table = KeyedTable(r.spark, scratch.new_path(r.spark, "panes"), "day date, event_type string, n long, value double", ["day", "event_type"], "day")
    replayed(r, lambda s: jobs.panes(s.filter("session_id >= 0"), DECADE), batch=jobs.keep_panes(table))
    return jobs.rolling(table.read()).select("start", "event_type", "n")


def attributed(r: Retail) -> DataFrame:
    """Messages and purchases as two streams of three batches each."""
    from cadencia.streaming import jobs

    def job(s: DataFrame) -> DataFrame:
        sent = s.filter("event_type = 'click'").select(F.col("event_id").alias("notification_id"), F.col("session_id").alias("customer_id"), F.col("ts").alias("sent_at"))
        buys = s.filter("event_type = 'purchase'").select(F.col("session_id").alias("customer_id"), "ts")
        return jobs.attribution(sent, buys, delay=DECADE)

    return replayed(r, job).select("notification_id", "customer_id").distinct()


def suppressed(r: Retail) -> DataFrame:
    """Every event as a reminder, in three batches without regard to their time."""
    from cadencia.streaming import jobs

    reminders = lambda s: s.select(F.col("session_id").alias("customer_id"), F.col("event_id").alias("reminder_id"), "ts")
    return stateful(r, lambda s: jobs.suppress(reminders(s), 24, DECADE), replayed).filter("customer_id >= 0").select("customer_id", "reminder_id")


SUPPRESSED = """with recursive e as (select session_id customer_id, event_id reminder_id, ts, row_number() over (partition by session_id order by ts, event_id) k from ev),
 f as (select customer_id, reminder_id, k, ts as last_sent, true sent from e where k=1 union all
 select e.customer_id, e.reminder_id, e.k, case when e.ts > f.last_sent + interval 24 hour then e.ts else f.last_sent end, e.ts > f.last_sent + interval 24 hour from e join f on e.customer_id=f.customer_id and e.k=f.k+1) select customer_id, reminder_id from f where sent"""
REGISTRY["st2_signed_stream"] = (signed_stream, REGISTRY["q1_sign_chain"][1])
query("st4_rolling_week", "select (time_bucket(interval 1 day, ts) - k * interval 1 day)::date as start, event_type, count(*) n from events cross join range(7) g(k) group by 1, 2")(rolling_week)
query("st5_breaches", "with c as (select event_id reminder_id, ts::timestamp created_at, case when event_id%3=0 then ts::timestamp + (event_id%48) * interval 1 hour end reviewed from ev where event_type='click') select reminder_id, created_at from c where reviewed >= created_at + interval 24 hour or (reviewed is null and created_at + interval 24 hour <= (select max(coalesce(reviewed, created_at)) from c) - interval 1 minute)")(breached)
query("st6_attribution", "select distinct n.notification_id, n.customer_id from notifications n join ev e on e.session_id=n.customer_id and e.event_type='purchase' and e.ts>n.sent_at and e.ts<=n.sent_at + interval 3 day")(attributed)
query("st7_suppressed", SUPPRESSED)(suppressed)
query("st7_suppressed_batch", SUPPRESSED)(lambda r: governance.suppress(r.events().select(F.col("session_id").alias("customer_id"), F.col("event_id").alias("reminder_id"), "ts")).select("customer_id", "reminder_id"))
