"""Messy product lines to catalog entries, as one set-based job.

Exact names first, then for each distinct name the best of all catalog names, found in blocks through an index that bounds scores from above, with
guards for strengths and look-alikes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencia.functions import similarity as sm
from cadencia.functions import text as tx
from cadencia.functions.nameindex import NameIndex
from cadencia.functions.phonetics import metaphone
from cadencia.sources import scratch

CANDIDATES, KEPT = 15, 3
#: A name below this score never reaches the shortlist; first words below this ratio cap a name's score.
LEAST_NAME, FIRST_WORDS = 0.75, 65
#: Catalog names that a task holds, and line names that it looks up among them.
BLOCK_NAMES, PART_NAMES = 16_384, 65_536


def picked_text(lines: DataFrame) -> DataFrame:
    """Name, else instructions, else form; cleaned, with its strength apart."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    raw = F.coalesce(some("raw_name"), some("instructions"), some("form"), F.lit(""))
    clean = tx.strip_sig_tail(raw)
    name = F.trim(F.regexp_replace(F.regexp_replace(tx.normalize_line(clean), rf"(?i)\d+(?:\.\d+)?\s*(?:{tx.UNITS})(?![a-z])", " "), r"\s+", " "))
    return lines.withColumn("strength", F.coalesce(tx.strength_token(clean), tx.strength_token(some("strength")))).withColumn("name", name).withColumn("full", tx.normalize_line(clean))


def catalog_names(catalog: DataFrame) -> DataFrame:
    full = tx.normalize_line(F.col("name"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(full, rf"(?i)\d+(?:\.\d+)?\s*(?:{tx.UNITS})(?![a-z])", " "), r"\s+", " "))
    return catalog.select("drug_id", F.col("name").alias("catalog_name"), bare.alias("c_name"), full.alias("c_full"), tx.strength_token(F.col("name")).alias("c_strength"))


def strength_guard(a: Column, b: Column) -> tuple[Column, Column]:
    """(match, conflict): equal, or the same number in mg and ml; no strength asked for is neither."""
    swapped = (F.regexp_replace(a, "(mg|ml)$", "") == F.regexp_replace(b, "(mg|ml)$", "")) & F.rlike(a, F.lit("(mg|ml)$")) & F.rlike(b, F.lit("(mg|ml)$"))
    same = F.coalesce((a == b) | swapped, F.lit(False))
    return same, a.isNotNull() & b.isNotNull() & ~same


def final_score(name: Column, match: Column, has_strength: Column, form_match: Column, has_form: Column) -> Column:
    """0 to 1 from a name score of 0 to 100; a mediocre name is never lifted by its strength or form."""
    base = name / 100
    top = F.when(base >= 0.95, 1.0).otherwise(0.88)
    s = F.when(has_strength & match, F.least(top, base + 0.05)).when(has_strength, base - 0.25).otherwise(base)
    s = F.when(has_form & form_match, F.least(top, s + 0.02)).when(has_form, s - 0.05).otherwise(s)
    return F.when(base < LEAST_NAME, F.least(F.lit(0.50), base)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def blended(fuzzy: Column, phonetic: Column) -> Column:
    """The fuzzy score, or nine tenths of the phonetic one where that is larger and either speaks for the name."""
    return F.when((phonetic > 80) | (fuzzy > 50), F.greatest(fuzzy, 0.9 * phonetic)).otherwise(fuzzy)


def first_word_cap(score: Column, fuzzy: Column, first: Column) -> Column:
    """Names whose first words differ reach the mean of both ratios at most."""
    return F.when(first < FIRST_WORDS, F.least(score, (fuzzy + first) / 2)).otherwise(score)


def conflict_cap(score: Column, conflict: Column) -> Column:
    return F.when(conflict, F.least(F.lit(0.70), score)).otherwise(score)


def look_alike(first: Column, name: Column, target: Column) -> Column:
    """First words that are near but not equal, unless the name's is the target's without its beginning."""
    a, b = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(target, F.lit(" "), F.lit(1))
    cut_off = (F.length(a) >= 4) & F.endswith(b, a) & (F.length(a) < F.length(b))
    return (first < 95) & ~cut_off


def traffic_light(score: Column, margin: Column, conflict: Column, alike: Column, ocr: Column, sure: float = 0.95, lead: float = 0.10, seen: float = 0.85) -> Column:
    """matched, needs_review or not_found for the best candidate of a line."""
    found = F.coalesce(score >= 0.65, F.lit(False))
    safe = found & (score >= sure) & (margin.isNull() | (margin >= lead)) & ~conflict & ~alike & (F.coalesce(ocr, F.lit(0.0)) >= seen)
    return F.when(safe, "matched").when(found, "needs_review").otherwise("not_found")


def shortlist(scored: DataFrame, line: str, item: str, *more: str, least: float = 0.60, kept: int = KEPT) -> DataFrame:
    """(line, candidates, margin): the best candidates of each line, and the lead of the first; ties to the smaller item."""
    w = Window.partitionBy(line).orderBy(F.desc("score"), item)
    ranked = scored.filter(F.col("score") >= least).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= kept)
    best = ranked.groupBy(line).agg(F.sort_array(F.collect_list(F.struct("nth", item, "score", *more))).alias("candidates"))
    margin = F.round(F.col("candidates")[0]["score"] - F.try_element_at("candidates", F.lit(2))["score"], 6)
    return best.withColumn("margin", margin)


def _blocked(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, part, catalog, name): the stated names against all catalog names, in blocks of bounded size on either side."""
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, blocks = left.count(), max(1, -(-right.count() // BLOCK_NAMES))
    parts = max(-(-n // PART_NAMES), min(partitions, -(-n // 64)), 1)
    each = lambda k, c: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c)
    at = lambda c, k, name: F.pmod(F.xxhash64(c), F.lit(k)).cast("int").alias(name)
    held = right.select(at("c_name", blocks, "block"), each(parts, "part"), F.lit(0).alias("role"), F.col("c_name").alias("name"))
    asked = left.select(each(blocks, "block"), at("name", parts, "part"), F.lit(1).alias("role"), "name")
    return held.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "role", "name")


def _looked_up(left: DataFrame, right: DataFrame, look, more: str = "") -> DataFrame:
    """(name, c_name, score and more): the rows look(index, name) of each name and the index of each block of catalog names."""
    schema = f"name string, c_name string, score double{more}"
    kinds = [pa.string(), pa.string(), pa.float64(), pa.bool_()][: schema.count(",") + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, index = None, [], None
        for b in batches:
            found = []
            for block, part, role, name in zip(*(b.column(c).to_pylist() for c in ("block", "part", "role", "name")), strict=True):
                if (block, part) != now:
                    now, names, index = (block, part), [], None
                if not role:
                    names.append(name)
                    continue
                index = index or NameIndex(names)
                found += look(index, name)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return _blocked(left, right).mapInArrow(run, schema)


def _best(found: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("name").orderBy(F.desc("score"), "c_name")
    kept = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= most)
    return kept.select("name", "c_name", sm.name_scores("name", "c_name").alias("s"))


def _both_names(lines: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    return lines.select("name").filter(F.length("name") > 2).distinct(), catalog.select("c_name").filter(F.col("c_name").isNotNull()).distinct()


def candidates(lines: DataFrame, catalog: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(name, c_name, s): the `most` best catalog names of each distinct line name, by score and then by name, with all their scores.

    These are the best of all names: an index bounds what a name can reach, and only names that cannot reach the best are not scored.
    """
    return _best(_looked_up(*_both_names(lines, catalog), lambda index, name: [(name, c, s) for s, c in index.top(name, most)]), most)


def _sounds(name: str, target: str) -> bool:
    """Whether the phonetic score alone can lift a name to the shortlist; a little more than that, never less."""
    p, q = metaphone(name), metaphone(target)
    return bool(p and q) and 90 * sm.jaro_winkler(p, q) >= 100 * LEAST_NAME - 0.01


def fit_candidates(lines: DataFrame, catalog: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Those of candidates() that the shortlist can keep, with their capped score: a name below LEAST_NAME scores a half at most, whatever its entries' strengths.

    Such a name has that score itself, or sounds alike and has a near first word. Names of the first kind are the best there are, so they are found without the others. Only
    where a block has one of the second kind, which may or may not be among the best, all names' bests are found.
    """
    left, right = _both_names(lines, catalog)
    floor = 100 * LEAST_NAME

    def look(index: NameIndex, name: str) -> list[tuple]:
        best, more = index.reaching(name, most, floor, FIRST_WORDS, _sounds)
        return [(name, c, s, more) for s, c in best] + [(name, None, None, True)] * (more and not best)

    fuzzy, first = F.col("s.name"), F.col("s.first")
    capped = first_word_cap(blended(fuzzy, F.col("s.phonetic")), fuzzy, first)
    found = scratch.written(_looked_up(left, right, look, ", more boolean"), "names")
    doubtful = found.filter("more").select("name").distinct()
    sure = _best(found.join(doubtful, "name", "left_anti").select("name", "c_name", "score"), most)
    pairs = sure if doubtful.isEmpty() else sure.unionByName(candidates(doubtful, right, most))
    return scratch.written(pairs.withColumn("capped", capped).filter(F.col("capped") / 100 >= LEAST_NAME), "pairs")


def _offered(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(c_name, strength, form, drug_id, catalog_name, match, conflict, in_form): the entries of a catalog name that a strength and form can get.

    Entries of a name that agree in match, conflict and form have the same score whatever the line's name, so only the first KEPT of them can be listed.
    """
    entries = pairs.select("c_name", "strength", "form").distinct().join(names, "c_name")
    match, conflict = strength_guard(F.col("strength"), F.col("c_strength"))
    kinds = entries.select("c_name", "strength", "form", "drug_id", "catalog_name", match.alias("match"), conflict.alias("conflict"), F.coalesce(F.contains("c_full", "form"), F.lit(False)).alias("in_form"))
    first = Window.partitionBy("c_name", "strength", "form", "match", "conflict", "in_form").orderBy("drug_id")
    return kinds.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= KEPT).drop("nth")


def match_lines(lines: DataFrame, catalog: DataFrame, sure: float = 0.95, lead: float = 0.10, seen: float = 0.85) -> DataFrame:
    """One row for each line (line_id, raw_name, instructions, form, strength, ocr_confidence): status, drug_id, score, margin, candidates."""
    form = F.coalesce(F.lower(F.trim("form")), F.lit(""))
    rows, names = picked_text(lines).withColumn("form", form), catalog_names(catalog)
    # lines that ask for the same are scored once
    asked = ["name", "strength", "form"]
    pairs = rows.select(*asked).distinct().join(fit_candidates(rows, names), "name")
    offered = _offered(pairs, names)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("c_name", "strength", "form")]
    joined = pairs.alias("p").join(offered.alias("o"), same).select(*(f"p.{c}" for c in pairs.columns), "drug_id", "catalog_name", "match", "conflict", "in_form")
    score = final_score(F.col("capped"), F.col("match"), F.col("strength").isNotNull(), F.col("in_form"), F.col("form") != "")
    scored = joined.select(F.struct(*asked).alias("asked"), "drug_id", "catalog_name", F.round(conflict_cap(score, F.col("conflict")), 6).alias("score"), "conflict", look_alike(F.col("s.first"), F.col("name"), F.col("c_name")).alias("look_alike"))
    best = shortlist(scored, "asked", "drug_id", "catalog_name", "conflict", "look_alike").select(*(F.col(f"asked.{c}").alias(f"asked_{c}") for c in asked), "candidates", "margin")
    full = rows.select("line_id", "ocr_confidence", *asked).join(best, [F.col(c).eqNullSafe(F.col(f"asked_{c}")) for c in asked], "left")
    top = F.col("candidates")[0]
    status = traffic_light(top["score"], F.col("margin"), top["conflict"], top["look_alike"], F.col("ocr_confidence"), sure, lead, seen)
    found = status != "not_found"
    return full.select(
        "line_id", status.alias("status"), F.when(status == "matched", top["drug_id"]).alias("drug_id"),
        F.when(found, top["score"]).otherwise(0.0).alias("score"), F.when(found, F.col("margin")).alias("margin"), F.when(found, F.col("candidates")).alias("candidates"),
    )


def exact_matches(lines: DataFrame, catalog: DataFrame, seen: float = 0.85) -> DataFrame:
    """Lines whose name equals a catalog name, with the traffic light of exact matches."""
    rows, names = picked_text(lines), catalog_names(catalog)
    strengths = Window.partitionBy("c_name")
    kinds = names.withColumn("strengths", F.size(F.collect_set("c_strength").over(strengths)))
    joined = rows.join(kinds, F.col("name") == F.col("c_name"))
    match, conflict = strength_guard(F.col("strength"), F.col("c_strength"))
    ranked = joined.withColumn("match", match).withColumn("conflict", conflict).withColumn("nth", F.row_number().over(Window.partitionBy("line_id").orderBy(F.desc("match"), "conflict", "drug_id"))).filter("nth = 1")
    sure = F.coalesce("ocr_confidence", F.lit(0.0)) >= seen
    status = F.when(F.col("conflict"), "needs_review").when(F.col("strength").isNull() & (F.col("strengths") > 1), "needs_review").when(sure, "matched").otherwise("needs_review")
    # a name of several strengths without one asked for comes with all its entries to choose from
    several = F.col("strength").isNull() & (F.col("strengths") > 1)
    listed = names.groupBy("c_name").agg(F.sort_array(F.collect_list(F.struct("drug_id", "catalog_name"))).alias("entries"))
    joined = ranked.join(listed, "c_name", "left")
    return joined.select("line_id", "drug_id", status.alias("status"), F.when(status == "matched", 1.0).otherwise(0.70).alias("score"), F.when(several, F.col("entries")).alias("options"))


def fuse_readers(df: DataFrame, a: str, b: str, ca: str, cb: str) -> DataFrame:
    """Two readings of a line: the surer text; agreement lifts the confidence (at most 0.97), disagreement caps it at 0.70 and is flagged."""
    agree = tx.normalize_line(F.col(a)) == tx.normalize_line(F.col(b))
    top = F.greatest(ca, cb)
    return df.withColumn("fused", F.when(F.col(ca) >= F.col(cb), F.col(a)).otherwise(F.col(b))).withColumn("fused_confidence", F.when(agree, F.least(F.lit(0.97), top + 0.05)).otherwise(F.least(F.lit(0.70), top))).withColumn("disagree", ~agree)


def line_status(match_status: Column, ocr_confidence: Column, disagree: Column, legible: Column) -> Column:
    """not legible, or unmatched from a weak reading or from readers that disagree: review."""
    return F.when(~legible, "illegible").when(disagree & (match_status == "matched"), "needs_review").when((match_status == "not_found") & (ocr_confidence < 0.5), "needs_review").otherwise(match_status)


def finalise(items: DataFrame, parent: str) -> DataFrame:
    """Parents without open decisions, with the chosen drug of each item. items: decision, matched_id, selected_id."""
    chosen = F.when(F.col("decision") == "confirmed", F.col("matched_id")).when(F.col("decision") == "overridden", F.col("selected_id"))
    return items.groupBy(parent).agg(F.bool_and(F.coalesce("decision", F.lit("pending")) != "pending").alias("ready"), F.sort_array(F.collect_list(chosen)).alias("chosen"))
