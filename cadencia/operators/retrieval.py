"""Dense and lexical retrieval: exact top-k in query blocks, overlap scores, hybrid ranking, intents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.functions import automaton
from cadencia.functions import text as tx
from cadencia.functions import vectors as vc

#: Chunks that a task holds while the queries stream past them, and queries that meet them in one matrix product.
BLOCK_CHUNKS, STREAM_QUERIES = 16_384, 256


def _unit_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): vectors of finite numbers that are not all zero, as doubles."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, chunk_id: str, vector: str) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k chunks of largest cosine (six places, ties to the smaller id) for each query of a stated query set.

    Chunks are held in blocks of bounded size; all queries stream past each block in matrix products, and a block keeps k chunks of a query at most.
    Vectors that are null or zero, or hold null or non-finite numbers, take no part; vectors meet those of their own dimension. Chunk ids are distinct.
    """
    q, c = _unit_rows(queries, query_id, vector), _unit_rows(chunks, chunk_id, vector)
    partitions, n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), c.count()
    blocks = max(1, -(-n // BLOCK_CHUNKS), min(partitions, -(-n // 512)))
    size = F.size("v").alias("dim")
    none = lambda df: F.lit(None).cast(df.schema["id"].dataType)
    held = c.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), size, F.lit(0).alias("role"), none(q).alias("query_id"), F.col("id").alias("chunk_id"), "v")
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), size, F.lit(1).alias("role"), F.col("id").alias("query_id"), none(c).alias("chunk_id"), "v")

    def unit(b: pa.RecordBatch, dim: int) -> np.ndarray:
        v = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
        v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
        return v / np.sqrt((v * v).sum(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, own = None, [], None
        for whole in batches:
            for a in range(0, whole.num_rows, STREAM_QUERIES):
                b = whole.slice(a, STREAM_QUERIES)
                place = np.column_stack([b.column(c).to_numpy() for c in ("block", "dim", "role")])
                cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                    block, dim, role = place[lo].tolist()
                    if (block, dim) != now:
                        now, parts, own = (block, dim), [], None
                    rows = b.slice(lo, hi - lo)
                    if role == 0:
                        parts.append((rows.column("chunk_id"), unit(rows, dim)))
                        continue
                    if own is None:
                        if not parts:
                            continue
                        own = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    score = np.rint(unit(rows, dim) @ own[1].T * 1e6) / 1e6
                    # a block's chunks come in the order of their ids: a stable sort breaks ties by id
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(hi - lo), best.shape[1])
                    yield pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(i)), own[0].take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel() + 0.0)], names=["query_id", "chunk_id", "score"])

    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "dim", "role", "chunk_id", "query_id")
    found = dealt.mapInArrow(run, T.StructType([T.StructField("query_id", held.schema["query_id"].dataType), T.StructField("chunk_id", held.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def words(c: Column) -> Column:
    plain = F.filter(F.split(tx.normalize_arabic(F.lower(c)), r"\s+"), lambda w: F.length(w) > 1)
    return F.transform(plain, tx.light_stem)


def shared_numbers(query: Column, content: Column) -> Column:
    return F.size(F.array_intersect(F.regexp_extract_all(query, F.lit(r"(\d+)"), F.lit(1)), F.regexp_extract_all(content, F.lit(r"(\d+)"), F.lit(1))))


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's stems found in the content's (equal or inside), plus 0.3 for each shared number, at most 1."""
    q = words(query)
    # both lists of stems are made once for each pair, not once for each stem
    both = F.array(F.struct(q.alias("q"), words(content).alias("c")))
    found = F.transform(both, lambda b: F.when(F.size(b["c"]) > 0, F.size(F.filter(b["q"], lambda w: F.exists(b["c"], lambda x: F.contains(x, w))))))[0]
    numbers = shared_numbers(query, content)
    return F.when((F.size(q) == 0) | found.isNull(), 0.0).otherwise(F.least(F.lit(1.0), found / F.size(q) + 0.3 * numbers))


#: Queries, or chunks if they are fewer, that a worker holds while the others stream past them; those that it scores at a time; the stems of which it remembers what they hold.
HELD_TEXTS, STREAM_TEXTS, KNOWN_STEMS = 512, 256, 100_000


def _by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (id, stems, numbers) with those of an id together; ids are theirs, without what it takes to make the rows."""
    several = ids.groupBy("id").count().filter("count > 1").select("id")
    if several.isEmpty():
        return rows
    joined = rows.join(several, "id").groupBy("id").agg(F.flatten(F.collect_list("stems")).alias("stems"), F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    return rows.join(several, "id", "left_anti").unionByName(joined)


class _Overlap:
    """Found stems and shared numbers of a text with each of the held ones, which are queries or chunks."""

    def __init__(self, stems: list[list[str]], numbers: list[list[str]], of_queries: bool) -> None:
        self.n, self.of_queries, self.known = len(stems), of_queries, {}
        self.words = sorted({w for s in stems for w in s if w})
        at = {w: i for i, w in enumerate(self.words)}
        self.times = np.zeros((len(self.words), self.n), np.int32)
        for j, s in enumerate(stems):
            for w in s:
                if w:
                    self.times[at[w], j] += 1
        if of_queries:
            self.machine = automaton.machine(tuple(self.words)) if self.words else None
        else:
            self.text = "\n".join(self.words)
            self.begin = np.cumsum([0, *(len(w) + 1 for w in self.words)])[:-1]
        self.numbers: dict[str, np.ndarray] = {}
        for j, s in enumerate(numbers):
            for d in set(s):
                self.numbers.setdefault(d, np.zeros(self.n, np.int32))[j] = 1

    def _held_by(self, stem: str) -> tuple:
        """The wanted stems inside of a chunk's stem."""
        return tuple({i for _, i in self.machine.iter(stem)}) if self.machine and stem else ()

    def _holding(self, stem: str) -> np.ndarray:
        """1 for each chunk with a stem that has this one of a query inside."""
        spots, at = [], self.text.find(stem) if stem else -1
        while at >= 0:
            spots.append(int(np.searchsorted(self.begin, at, "right")) - 1)
            at = self.text.find(stem, int(self.begin[spots[-1]]) + len(self.words[spots[-1]]) + 1)
        return (self.times[spots] > 0).any(axis=0).astype(np.int32)

    def _known(self, stem: str, look):
        if stem not in self.known:
            if len(stem) > 64:
                return look(stem)
            if len(self.known) >= KNOWN_STEMS:
                self.known.clear()
            self.known[stem] = look(stem)
        return self.known[stem]

    def found(self, stems: list[str]) -> np.ndarray:
        """For each held text: how many stems of the query, repeats counted, stand in stems of the chunk."""
        if self.of_queries:
            rows = set().union(*(self._known(w, self._held_by) for w in stems))
            return self.times[list(rows)].sum(axis=0)
        return sum((self._known(w, self._holding) for w in stems), np.zeros(self.n, np.int32))

    def shared(self, numbers: list[str]) -> np.ndarray:
        return sum((self.numbers[d] for d in set(numbers) if d in self.numbers), np.zeros(self.n, np.int32))


def _scores(held: DataFrame, streamed: DataFrame, of_queries: bool, schema: T.StructType) -> DataFrame:
    """(query_id, chunk_id, score) of the held rows (id, stems, numbers) with all streamed ones that have anything in common."""
    table = held.toArrow()
    table = table.filter(pa.array([bool(s) for s in table.column("stems").to_pylist()], pa.bool_()))
    ids, stems, numbers = table.column("id").combine_chunks(), table.column("stems").to_pylist(), table.column("numbers").to_pylist()
    counts = np.array([len(s) for s in stems], np.int64)
    names = ["query_id", "chunk_id"] if of_queries else ["chunk_id", "query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overlap = _Overlap(stems, numbers, of_queries)
        for whole in batches:
            for a in range(0, whole.num_rows, STREAM_TEXTS):
                b = whole.slice(a, STREAM_TEXTS)
                # not a filter of the frame, which would make the stems once more for itself
                b = b.filter(pa.array([bool(x) for x in b.column("stems").to_pylist()], pa.bool_()))
                if not b.num_rows or not len(ids):
                    continue
                said = b.column("stems").to_pylist()
                found = np.stack([overlap.found(x) for x in said])
                shared = np.stack([overlap.shared(x) for x in b.column("numbers").to_pylist()])
                n = counts[None, :] if of_queries else np.array([len(x) for x in said], np.int64)[:, None]
                score = np.minimum(1.0, found / n + 0.3 * shared)
                i, j = np.nonzero((found > 0) | (shared > 0))
                got = {names[0]: ids.take(pa.array(j)), names[1]: b.column("id").take(pa.array(i)), "score": pa.array(score[i, j])}
                yield pa.RecordBatch.from_arrays([got[c] for c in ("query_id", "chunk_id", "score")], names=["query_id", "chunk_id", "score"])

    return streamed.mapInArrow(run, schema)


def lexical_index(queries: DataFrame, chunks: DataFrame, query_id: str, query: str, chunk_id: str, content: str) -> DataFrame:
    """(query_id, chunk_id, score): lexical_score() of every query and chunk that have anything in common; all other pairs score 0.

    The fewer of both are held by the workers, in blocks of bounded size, and the others stream past each block: what a distinct stem holds or stands in is looked up once in
    a worker, and nothing is shuffled. Texts of the same id count as one; those without an id or a stem have no scores.
    """

    def said(df: DataFrame, key: str, text: str, stems: Column) -> DataFrame:
        numbers = F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))), F.array().cast("array<string>"))
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), stems.alias("stems"), numbers.alias("numbers"))
        return _by_id(rows, df.select(F.col(key).alias("id")).filter("id is not null"))

    asked = said(queries, query_id, query, words(F.col(query)))
    offered = said(chunks, chunk_id, content, F.array_distinct(words(F.col(content))))
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("chunk_id", offered.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    few, more = queries.count(), chunks.count()
    of_queries = few <= more
    held, streamed = (asked, offered) if of_queries else (offered, asked)
    blocks = max(1, -(-min(few, more) // HELD_TEXTS))
    return reduce(DataFrame.unionByName, [_scores(held.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), streamed, of_queries, schema) for i in range(blocks)])


def hybrid(df: DataFrame, dense: float = 0.6, lexical: float = 0.4) -> DataFrame:
    """df (query_id, chunk_id, query, content, similarity) ranked by the weighted sum; a missing similarity counts 0.5."""
    score = F.round(dense * F.coalesce("similarity", F.lit(0.5)) + lexical * lexical_score(F.col("query"), F.col("content")), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(best))


def in_scope(hybrid_score: Column, lexical: Column, similarity: Column, least: float = 0.65) -> Column:
    return (hybrid_score >= 0.50) | (lexical >= 0.35) | (similarity >= least)


def nearest_intent(rows: DataFrame, centroids: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """The label of the nearest centroid, its clamped score, the lead over the second and whether it is confident (0.50).

    centroids has one row for each label; labels are the fixed set of intents.
    """
    cos = vc.cosine(F.col(vector), F.col("centroid"))
    scored = rows.select(key, vector).crossJoin(F.broadcast(centroids)).select(key, label, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)), 4).alias("score"))
    two = scored.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(label).alias("l")))), 1, 2).alias("t"))
    first, second = F.col("t")[0], F.try_element_at("t", F.lit(2))
    return two.select(key, first["l"].alias(label), (-first["s"]).alias("score"), F.round(-first["s"] + F.coalesce(second["s"], F.lit(0.0)), 4).alias("margin"), (-first["s"] >= 0.50).alias("confident"))


def expand_query(df: DataFrame, text: str, thesaurus: dict[str, str]) -> DataFrame:
    """df with the expansions of all thesaurus terms that the normalised text contains."""
    named = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(thesaurus)], "i int, term string")
    plain = {r["i"]: r["plain"] for r in named.select("i", tx.normalize_arabic(F.lower("term")).alias("plain")).collect()}  # the caller's own terms
    told: dict[str, list[str]] = {}
    for i, e in enumerate(thesaurus.values()):
        told.setdefault(plain[i], []).append(e)
    more = F.create_map(*(x for p, es in told.items() for x in (F.lit(p), F.array(*map(F.lit, es))))) if told else F.lit(None).cast("map<string, array<string>>")
    hits = automaton.contained(tx.normalize_arabic(F.lower(F.col(text))), list(told))
    out = df.withColumn("__hits", hits).withColumn("expansions", F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.element_at(more, h))))).drop("__hits")
    return out.withColumn("expanded", F.concat_ws(" ", F.col(text), F.array_join("expansions", " ")))


def category_listing(drugs: DataFrame) -> DataFrame:
    item = F.struct("name", "base_price", "is_chronic")
    return drugs.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("drugs"))


def category_intent_plain(df: DataFrame, text: str, mapping: dict[str, tuple[str, ...]]) -> DataFrame:
    """The second variant: the first category of which a keyword stands anywhere in the text."""
    plain = tx.normalize_arabic(F.lower(F.col(text)))
    picked = F.lit(None).cast("string")
    for name, keys in reversed(list(mapping.items())):
        picked = F.when(tx.contains_any(plain, [k.lower() for k in keys]), F.lit(name)).otherwise(picked)
    return df.withColumn("category", picked)


def category_intent(df: DataFrame, text: str, mapping: dict[str, tuple[str, ...]], categories: tuple[str, ...] = ()) -> DataFrame:
    """The first category of which a keyword is a word of the text (with or without its article), or, in several words, inside it.

    Without one, the first of `categories` of which a part of three letters or more is a word of the text.
    """
    plain = tx.normalize_arabic(F.lower(F.col(text)))
    tokens = F.split(plain, r"\s+")
    both = F.concat(tokens, F.transform(tokens, lambda w: F.regexp_replace(w, "^(?:ال|و|ف|ب|ل)", "")))
    picked = F.lit(None).cast("string")
    for name, keys in reversed(list(mapping.items())):
        hit = F.lit(False)
        for k in keys:
            n = tx.normalize_arabic(F.lit(k.lower()))
            hit = hit | (F.contains(plain, n) if " " in k else F.array_contains(both, n))
        picked = F.when(hit, F.lit(name)).otherwise(picked)
    by_part = F.lit(None).cast("string")
    for name in reversed(categories):
        parts = [p for p in re.split(r"[^\w]+", name.lower()) if len(p) > 2]
        if parts:
            by_part = F.when(F.arrays_overlap(both, F.array(*map(F.lit, parts))), F.lit(name)).otherwise(by_part)
    picked = F.coalesce(picked, by_part)
    return df.withColumn("category", picked)
