"""Conversation turns: history frames, mentions, references, guards, invoices and the routing of each user turn."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.functions import automaton
from cadencia.functions import text as tx
from cadencia.operators import retrieval
from cadencia.sources import scratch

PRONOUN = r"(?i)^(?:how much is it|its price|is it available|سعره|سعرها|بكام|متوفر)"
NAME = r"(?i)(?:my name is|اسمي(?: هو)?)\s+([^\s?.!,،؟]+)"


def history(turns: DataFrame, back: int = 4) -> DataFrame:
    """Each turn with the texts of up to `back` turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    return turns.withColumn("context", F.collect_list("text").over(w))


def last_entity(turns: DataFrame, pattern: str) -> DataFrame:
    """The newest match of the pattern in the turns before."""
    found = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("entity", F.last(found, ignorenulls=True).over(w))


def user_names(turns: DataFrame, pattern: str = NAME) -> DataFrame:
    """First and newest name that the user gave, for each conversation with one."""
    found = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    named = turns.filter(F.col("role") == "user").select("conv_id", "turn", found.alias("name")).filter(F.col("name").isNotNull())
    return named.groupBy("conv_id").agg(F.min_by("name", "turn").alias("first_name"), F.max_by("name", "turn").alias("last_name"))


def resolve(turns: DataFrame, pattern: str, pronoun: str = PRONOUN) -> DataFrame:
    """User turns that begin with a reference get the last entity spelt out."""
    seen = last_entity(turns, pattern)
    refers = (F.col("role") == "user") & F.rlike(F.trim("text"), F.lit(pronoun)) & F.col("entity").isNotNull()
    return seen.withColumn("resolved", F.when(refers, F.concat(F.col("text"), F.lit(" about "), F.col("entity"))).otherwise(F.col("text")))


def escalation(c: Column, emergency: tuple[str, ...], anger: tuple[str, ...]) -> Column:
    """(priority, status) by the caller's word lists; emergencies win over anger."""
    low = F.lower(c)
    urgent, angry = tx.contains_any(low, emergency), tx.contains_any(low, anger)
    priority = F.when(urgent, "critical_emergency").when(angry, "high_priority").otherwise("normal")
    status = F.when(urgent, "escalated_to_doctor").when(angry, "escalated_to_support").otherwise("automated")
    return F.struct(priority.alias("priority"), status.alias("status"))


def guard(c: Column, role: tuple[str, ...], override: tuple[str, ...], most: int = 1500) -> Column:
    """Why a text is blocked, by the caller's patterns: role_assumption, prompt_injection or null; roles are tried first, and only the first `most` characters count."""
    low = F.lower(tx.truncated(c, most))
    hit = lambda patterns: F.rlike(low, F.lit("|".join(f"(?:{p})" for p in patterns)))
    return F.when(hit(role), "role_assumption").when(hit(override), "prompt_injection")


def spoken_patterns(drugs: DataFrame) -> DataFrame:
    """(drug_id, pattern): the text that names a drug. A first word of three letters or more stands wherever the whole name does, so then it alone counts."""
    name = F.lower(F.trim("name"))
    first = F.element_at(F.split(name, r"\s+"), 1)
    return drugs.select("drug_id", F.when(F.length(first) >= 3, first).otherwise(name).alias("pattern")).filter("pattern <> ''").distinct()


def said_patterns(texts: DataFrame, spoken: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pattern), each once: the patterns that the texts contain, in whatever case. All of them are met in one walk over each text."""
    low = texts.select(*key, F.lower(F.col(text)).alias("__low"))
    return automaton.matches(low, key, "__low", spoken.select("pattern")).distinct()


def mentions(texts: DataFrame, drugs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Drugs whose whole name, or first word of three letters or more, the text contains, in whatever case; inside of words too.

    Names may have any number of words and any signs. Null and empty names are never mentioned. Only what a drug of several names gives is made distinct: the result is
    as large as texts times drugs, so it is not dealt once more.
    """
    spoken = spoken_patterns(drugs)
    n = F.count(F.lit(1)).over(Window.partitionBy("drug_id"))
    found = said_patterns(texts, spoken, key, text).join(spoken.withColumn("__names", n), "pattern").select(*key, "drug_id", "__names")
    return found.filter("__names = 1").drop("__names").unionByName(found.filter("__names > 1").drop("__names").distinct())


#: Pairs in which all keys are looked up first; pairs that a task holds while the keys that are left stream past them, and keys that meet them.
FIRST_PAIRS, BLOCK_PAIRS, PART_KEYS = 4_096, 1_000_000, 256


class _Pairs:
    """Pairs of items (x, y, a, b, severity) in their order, to look up the first that a set of items holds."""

    def __init__(self, table: pa.Table) -> None:
        codes: dict = {}
        self.x, self.y = (np.array([codes.setdefault(i, len(codes)) for i in table.column(c).to_pylist()], np.int64) for c in ("x", "y"))
        self.codes, self.own, self.new = codes, np.zeros(len(codes), bool), np.zeros(len(codes), bool)

    def _first(self) -> int | None:
        at, portion = 0, 1_024
        while at < len(self.x):
            i, j = self.x[at : at + portion], self.y[at : at + portion]
            hit = self.own[i] & self.own[j] & (self.new[i] | self.new[j])
            if hit.any():
                return at + int(hit.argmax())
            at, portion = at + portion, 4 * portion

    def first(self, found: list, fresh: list) -> int | None:
        """The first pair of which both items are found and one is fresh."""
        for marks, items in ((self.own, found), (self.new, fresh)):
            marks[:] = False
            marks[[self.codes[k] for k in items if k in self.codes]] = True
        return self._first()

    def of_rows(self, rows: pa.RecordBatch) -> list[int | None]:
        return [self.first(f, n) for f, n in zip(rows.column("found").to_pylist(), rows.column("fresh").to_pylist(), strict=True)]


def _first_pairs(found: DataFrame, newest: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, a, b, severity): the first, by these, of the pairs (x, y, a, b, severity) of two items found for the key, one of them among its newest. found, newest: (key, item).

    The items of each key are looked up in the pairs, in their order, until one is found: no pairs of items are made. Most keys find theirs among the first pairs of all; for
    the others all pairs are held in blocks of bounded size.
    """
    marks = found.select(key, "item", F.lit(False).alias("is_fresh")).unionByName(newest.select(key, "item", F.lit(True).alias("is_fresh")))
    sets = marks.groupBy(F.col(key).alias("key")).agg(F.collect_set(F.when(~F.col("is_fresh"), F.col("item"))).alias("found"), F.collect_set(F.when(F.col("is_fresh"), F.col("item"))).alias("fresh"))
    pairs = scratch.written(pairs.select("x", "y", "a", "b", "severity"), "pairs")
    some = pairs.orderBy("a", "b", "severity").limit(FIRST_PAIRS).toArrow()

    def among_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Pairs(some)
        for rows in batches:
            at = pa.array(held.of_rows(rows), pa.int64())
            own = [pa.array([None if i is None else v[i] for i in at.to_pylist()], some.schema.field(c).type) for c, v in values.items()]
            yield pa.RecordBatch.from_arrays([rows.column("key"), *own, rows.column("found"), rows.column("fresh")], names=["key", "a", "b", "severity", "found", "fresh"])

    values = {c: some.column(c).to_pylist() for c in ("a", "b", "severity")}
    results = T.StructType([T.StructField("key", sets.schema["key"].dataType), *(pairs.schema[c] for c in ("a", "b", "severity"))])
    both = T.StructType([*results.fields, *(T.StructField(c, sets.schema[c].dataType) for c in ("found", "fresh"))])
    tried = scratch.written(sets.filter(F.col("key").isNotNull() & (F.size("fresh") > 0)).mapInArrow(among_first, both), "tried")
    done = tried.filter("a is not null").select("key", "a", "b", "severity")
    left = tried.filter("a is null")
    n, partitions = left.count(), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n:
        done = done.unionByName(_in_all_pairs(left.select("key", "found", "fresh"), pairs, results, max(1, min(partitions, -(-n // PART_KEYS)))))
    return done.select(F.col("key").alias(key), "a", "b", "severity")


def _in_all_pairs(sets: DataFrame, pairs: DataFrame, results: T.StructType, parts: int) -> DataFrame:
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    each = lambda k, c: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c)
    held = pairs.select(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).cast("int").alias("block"), each(parts, "part"), F.lit(0).alias("role"), "a", "b", "severity", "x", "y")
    asked = sets.select(each(blocks, "block"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "key", "found", "fresh")
    dealt = held.unionByName(asked, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", "role", "a", "b", "severity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table, own = None, [], None, None
        for b in batches:
            block, part, role = (b.column(c).to_numpy() for c in ("block", "part", "role"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                rows = b.slice(lo, hi - lo)
                if (block[lo], part[lo]) != now:
                    now, parts, own = (block[lo], part[lo]), [], None
                if role[lo] == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                if own is None:
                    table = pa.Table.from_batches(parts)
                    own = _Pairs(table)
                at = [(i, k) for i, k in enumerate(own.of_rows(rows)) if k is not None]
                if at:
                    got = table.select(["a", "b", "severity"]).take(pa.array([k for _, k in at])).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array([i for i, _ in at])), *got.columns], names=["key", "a", "b", "severity"])

    return dealt.mapInArrow(run, results).groupBy("key").agg(F.min(F.struct("a", "b", "severity")).alias("m")).select("key", "m.*")


def mentioned_interactions(found: DataFrame, newest: DataFrame, interactions: DataFrame, key: str) -> DataFrame:
    """The first interaction (by pair) of two mentioned drugs, at least one of them mentioned in the newest turn."""
    item = F.col("drug_id").alias("item")
    pairs = interactions.filter("a < b").select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "severity")
    return _first_pairs(found.select(key, item), newest.select(key, item), pairs, key)


def spoken_interactions(found: DataFrame, newest: DataFrame, spoken: DataFrame, interactions: DataFrame, key: str) -> DataFrame:
    """mentioned_interactions() of texts by their patterns (key, pattern) and what these name: of the drugs of two patterns only the first interaction can be a text's first."""
    item = F.col("pattern").alias("item")
    side = lambda drug, name: spoken.select(F.col("drug_id").alias(drug), F.col("pattern").alias(name))
    named = interactions.filter("a < b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    pairs = named.groupBy("x", "y").agg(F.min(F.struct("a", "b", "severity")).alias("m")).select("x", "y", "m.*")
    return _first_pairs(found.select(key, item), newest.select(key, item), pairs, key)


def invoice(df: DataFrame, text: str, price: Column) -> DataFrame:
    """Quantity and discount read from the text, and the total at the price; null total where neither stands in it."""
    low = F.lower(F.col(text))
    quantity = F.coalesce(F.nullif(F.regexp_extract(low, r"(\d+)\s*(?:boxes|box|packs|pack|strips|strip|علب|علبة|شريط|عبوة)", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"(?:buy|need|order|عايز|محتاج)\s*(\d+)", 1), F.lit(""))).cast("int")
    code = F.nullif(F.regexp_extract(low, r"\bcare\s*(\d+)\b", 1), F.lit("")).cast("double")
    pct = F.nullif(F.regexp_extract(low, r"(\d+)\s*%", 1), F.lit("")).cast("double")
    df = df.withColumn("quantity", F.coalesce(quantity, F.lit(1))).withColumn("discount", F.coalesce(code, pct, F.lit(0.0)))
    total = tx.price_after_discount(price, F.col("quantity"), F.col("discount"))
    return df.withColumn("total", F.when((F.col("quantity") > 1) | (F.col("discount") > 0), total))


def badge(has_math: Column, has_interaction: Column, best_hybrid: Column) -> Column:
    return F.when(has_math, 0.99).when(has_interaction, 0.96).when(best_hybrid >= 0.70, 0.88).when(best_hybrid.isNotNull(), 0.72).otherwise(0.60)


@dataclass(frozen=True)
class Rules:
    """The caller's word lists and patterns for routing."""

    emergency: tuple[str, ...]
    anger: tuple[str, ...]
    role: tuple[str, ...]
    override: tuple[str, ...]
    entity: str
    intents: dict[str, tuple[str, ...]]
    pronoun: str = PRONOUN


def route(turns: DataFrame, drugs: DataFrame, interactions: DataFrame, chunks: DataFrame, rules: Rules, back: int = 4) -> DataFrame:
    """One row for each user turn with what every stage finds, and the stage that takes it.

    blocked (guard), priority (escalation), rewritten (a reference was spelt out), category (intent), drug_id (the smallest one named), severity (interaction of drugs named in
    the turn or the `back` turns before, one of them in the turn), chunk_id and best (retrieval: the chunk with the best lexical score, if it is in scope), total (invoice) and
    confidence (badge). drugs: drug_id, name, base_price; interactions: a, b, severity; chunks: chunk_id, content. All that follows the guard looks at the rewritten text.
    """
    key = ["conv_id", "turn"]
    spoken = history(resolve(turns, rules.entity, rules.pronoun), back).filter(F.col("role") == "user")
    rows = spoken.select(
        *key, guard(F.col("text"), rules.role, rules.override).alias("blocked"), escalation(F.col("text"), rules.emergency, rules.anger)["priority"].alias("priority"), (~F.col("resolved").eqNullSafe(F.col("text"))).alias("rewritten"),
        "resolved", F.concat_ws("\n", F.array_join("context", "\n"), "resolved").alias("around"))
    rows = retrieval.category_intent_plain(rows, "resolved", rules.intents)
    spoken = spoken_patterns(drugs)
    fresh = said_patterns(rows, spoken, key, "resolved")
    named = fresh.join(spoken.groupBy("pattern").agg(F.min("drug_id").alias("drug_id")), "pattern").groupBy(*key).agg(F.min("drug_id").alias("drug_id"))
    both = F.struct(*key).alias("k")
    warned = spoken_interactions(said_patterns(rows, spoken, key, "around").select(both, "pattern"), fresh.select(both, "pattern"), spoken, interactions, "k").select("k.*", "severity")
    asked = rows.select(F.to_json(F.struct(*key)).alias("query_id"), *key, "resolved")
    scores = retrieval.lexical_index(asked, chunks, "query_id", "resolved", "chunk_id", "content").withColumn("score", F.round("score", 6))
    top = scores.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("t")).select("query_id", (-F.col("t.s")).alias("best"), "t.chunk_id")
    top = asked.select("query_id", *key).join(top.filter(F.col("best") >= 0.35), "query_id").drop("query_id")
    joined = rows.join(named, key, "left").join(warned, key, "left").join(top, key, "left").join(drugs.select("drug_id", F.col("base_price").cast("double").alias("price")), "drug_id", "left")
    joined = invoice(joined, "resolved", F.col("price"))
    has = lambda c: F.col(c).isNotNull()
    stage = F.when(has("blocked"), "guard").when(F.col("priority") != "normal", "escalation").when(has("category"), "intent").when(has("total"), "math").when(has("severity"), "interaction")
    stage = stage.when(has("drug_id"), "catalog").when(has("best"), "retrieval").when(F.col("rewritten"), "reference").otherwise("general")
    return joined.select(*key, stage.alias("stage"), "blocked", "priority", "rewritten", "category", "drug_id", "severity", "chunk_id", "best", "total", badge(has("total"), has("severity"), F.col("best")).alias("confidence"))
