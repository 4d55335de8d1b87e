"""Phrases of two to four words that stand together more often than their parts suggest, by lossless counting quotient filters.

Texts are read once. A block of documents lists its distinct words of each language with their counts, and its word sequence in block
numbers. The words meet in one table; those that occur at least min_count times get dense corpus-wide ids (no phrase with another word can
reach min_count) and the ids go back to the blocks. A block counts its n-grams of two, three and four ids in quotient filters (quotient.py),
cut by the upper bits of the permuted n-gram; filters of a part merge as sorted runs, and what reaches min_count is turned back to ids. An id stands for
a word of one language, so languages do not mix. Everything after that joins tables of frequent phrases only.

A task holds one block, or the filters of one part; the number of parts follows the number of words.

Defined results: null texts and texts without words count nothing; a null language is `und`; a text that occurs in several rows counts in each; texts of any length are
read whole (a text is never cut between blocks); phrases that tie in score and count are ordered by their bytes; with no candidates, or no rows, no rows;
columns other than the text's and the language's are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadencia.llm import common, quotient

BLOCK_BYTES = 12_000_000
#: n-grams of a part of the corpus-wide table; a task's memory follows it.
PART_GRAMS = 3_000_000
_LONGEST = 4
_WORD, _BLANK, _BREAK = range(3)
_CLASS = np.full(256, _WORD, np.uint8)
_CLASS[[9, 32]] = _BLANK
_CLASS[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word lengths, text of each word, whether a word begins a piece) of UTF-8 texts."""
    low = _LOWER[raw]
    kind = _CLASS[low]
    word = kind == _WORD
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = word & (edge[:-1] | np.r_[True, ~word[:-1]])[: len(raw)]
    stop = word & (edge[1:] | np.r_[~word[1:], True])[: len(raw)]
    starts = np.flatnonzero(start)
    lengths = np.flatnonzero(stop) + 1 - starts
    owner = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == _BREAK)[starts]
    fresh = np.r_[True, (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])][: len(starts)]
    return low, starts, lengths, owner, fresh


class _Block:
    """Words of documents in the order of their first place, and the sequence as word numbers from 1, with 0 before each piece."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, bytes], int] = {}
        self.sequences: list[np.ndarray] = []
        self.bytes = 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        raw, offsets = common.text_bytes(texts)
        self.bytes += len(raw)
        names = langs.cast(pa.string()).fill_null("und").dictionary_encode()
        low, starts, lengths, owner, fresh = split_words(raw, offsets)
        if not len(starts):
            return
        lang = names.indices.to_numpy(zero_copy_only=False)[owner].astype(np.int64)
        first, kind = common.distinct_segments(low, starts, lengths, lang)
        named, known, data = names.dictionary.to_pylist(), self.known, low.tobytes()
        numbers = np.array([known.setdefault((named[g], data[a : a + n]), len(known) + 1) for g, a, n in zip(lang[first].tolist(), starts[first].tolist(), lengths[first].tolist(), strict=True)], np.uint32)
        at = np.arange(len(starts)) + np.cumsum(fresh)
        out = np.zeros(len(starts) + int(fresh.sum()), np.uint32)
        out[at] = numbers[kind]
        self.sequences.append(out)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The words, the most frequent first, and the sequence by these numbers."""
        size = len(self.known) + 1
        times = np.sum([np.bincount(s, minlength=size) for s in self.sequences], axis=0)
        times[0] = np.iinfo(np.int64).max  # the mark of a piece keeps its number
        order = np.argsort(-times, kind="stable")
        rank = np.empty(size, np.uint32)
        rank[order] = np.arange(size, dtype=np.uint32)
        langs, words = zip(*self.known, strict=True)
        own, code = times[1:], rank[1:]
        step = 100_000
        for a in range(0, size - 1, step):
            k = len(own[a : a + step])
            yield _batch(block, 0, k, lang=pa.array(langs[a : a + step], pa.string()), word=pa.array(words[a : a + step], pa.binary()).cast(pa.string()), code=pa.array(code[a : a + step], pa.int64()), n=pa.array(own[a : a + step], pa.int64()))
        for place, s in enumerate(self.sequences):
            yield _batch(block, 1, 1, code=pa.array([place], pa.int64()), sequence=pa.array([common.planes(rank[s])], pa.binary()))


_SCHEMA = "block long, kind int, lang string, word string, code long, n long, sequence binary"
_KINDS = {"lang": pa.string(), "word": pa.string(), "code": pa.int64(), "n": pa.int64(), "sequence": pa.binary()}


def _batch(block: int, kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array(np.full(rows, block), pa.int64()), pa.array(np.full(rows, kind), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays + [columns.get(c, pa.nulls(rows, k)) for c, k in _KINDS.items()], names=["block", "kind", *_KINDS])


def _read(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, block = common.block_numbers(), _Block()
        for whole in batches:
            for b in common.slices(whole, "t", 2_000_000):
                block.add(b.column("t"), b.column("l"))
                if block.bytes >= BLOCK_BYTES and block.known:
                    yield from block.rows(next(numbers))
                    block = _Block()
        if block.known:
            yield from block.rows(next(numbers))

    return df.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).mapInArrow(run, _SCHEMA)


def _numbered(words: DataFrame, keep) -> tuple[DataFrame, int]:
    """(words with dense ids from 1, their number)."""
    placed = keep(words.withColumn("place", F.monotonically_increasing_id()), "words")
    sizes = sorted((r["p"], r["c"]) for r in placed.groupBy(F.shiftright("place", 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())  # a row for each task that wrote
    total, starts = 0, []
    for p, c in sizes:
        starts.append((p, total + 1))
        total += c
    starts = words.sparkSession.createDataFrame(starts, "p long, first long")
    row = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("p")).select("lang", "word", "f", (F.col("first") + row).alias("id"))
    return out, total


def _count_grams(rows: DataFrame, bits: int, part_bits: int) -> DataFrame:
    """(n, part, filter) of each block, from its rows (block, kind, code, id) of words and its sequences."""

    def filters(sequence: np.ndarray) -> Iterator[pa.RecordBatch]:
        for n in range(2, _LONGEST + 1):
            places = [sequence[i : len(sequence) - n + 1 + i] for i in range(n)]
            whole = np.flatnonzero(np.logical_and.reduce([p > 0 for p in places]))
            if not len(whole):
                continue
            high, low, counts = quotient.tally(*quotient.pack([p[whole] for p in places], bits))
            part = quotient.parts_of(high, low, n, bits, part_bits).astype(np.int64)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            made = [quotient.dump(high[a:z], low[a:z], counts[a:z], n, bits, part_bits) for a, z in zip(first, np.r_[first[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), n), pa.int32()), pa.array(part[first], pa.int64()), pa.array(made, pa.binary())], names=["n", "part", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, ids, sequences = None, [], [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if not codes or not sequences:
                return
            code, number = np.concatenate(codes), np.concatenate(ids)
            most = max(int(s.max(initial=0)) for s in sequences)
            of = np.zeros(most + 1, np.uint32)
            of[code] = number
            yield from filters(of[np.concatenate(sequences)])

        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if a == z:
                    continue
                if block[a] != now:
                    yield from finish()
                    now, codes, ids, sequences = block[a], [], [], []
                if kind[a] == 0:
                    codes.append(b.column("code").slice(a, z - a).to_numpy())
                    ids.append(b.column("id").slice(a, z - a).to_numpy())
                else:
                    sequences += [common.unplaned(x) for x in b.column("sequence").slice(a, z - a).to_pylist()]
        yield from finish()

    return rows.mapInArrow(run, "n int, part long, filter binary")


def _merge(filters: DataFrame, bits: int, part_bits: int, min_count: int) -> DataFrame:
    """(key, f): the n-grams that occur at least min_count times, as their ids in four bytes each; rows of a part come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, entries = None, [], 0

        def merged() -> tuple:
            return quotient.tally(*(np.concatenate([h[i] for h in held]) for i in range(3)))

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            high, low, counts = merged()
            often = counts >= min_count
            if often.any():
                ids = quotient.unpack(high[often], low[often], now[0], bits)
                keys = np.ascontiguousarray(np.stack(ids, axis=1).astype(">u4")).view(np.uint8).reshape(int(often.sum()), -1)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(counts[often].astype(np.int64))], names=["key", "f"])

        for b in batches:
            for n, part, raw in zip(b.column("n").to_pylist(), b.column("part").to_pylist(), b.column("filter"), strict=True):
                if (n, part) != now:
                    yield from finish()
                    now, held, entries = (n, part), [], 0
                held.append(quotient.load(raw.as_py(), part, n, bits, part_bits))
                entries += len(held[-1][0])
                if entries > 2 * PART_GRAMS and len(held) > 1:  # repeated n-grams take no more room than one
                    held = [merged()]
                    entries = len(held[0][0]) // 2
        yield from finish()

    return filters.mapInArrow(run, "key binary, f long")


def phrase_counts(df: DataFrame, keep, min_count: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, f, id; phrases: key, f; totals: lang, n): all words and phrases of up to four words that occur at least min_count times.

    A key holds the ids of the phrase's words in four bytes each. `keep` writes an intermediate table (common.scratch).
    """
    blocks = keep(_read(df, text_col, lang_col), "blocks")
    own = blocks.filter("kind = 0").select("block", "lang", "word", "code", "n")
    counted = keep(own.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words, size = _numbered(counted.filter(F.col("f") >= min_count), keep)
    bits = max(1, size.bit_length())
    if bits > quotient.MOST_ID_BITS:
        raise ValueError(f"{size} frequent words; ids of {quotient.MOST_ID_BITS} bits cannot name them")
    all_words = counted.agg(F.sum(F.when(F.col("f") >= min_count, F.col("f")))).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(bits, max(math.ceil(math.log2(max(1, all_words / PART_GRAMS))), math.ceil(math.log2(partitions)) + 1))
    known = own.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", F.lit(0).alias("kind"), "code", "id", F.lit(None).cast("binary").alias("sequence"))
    texts = blocks.filter("kind = 1").select("block", F.lit(1).alias("kind"), "code", F.lit(None).cast("long").alias("id"), "sequence")
    placed = known.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind", "code")
    filters = _count_grams(placed, bits, part_bits).repartition("n", "part").sortWithinPartitions("n", "part")
    one = words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f")
    return words, keep(_merge(filters, bits, part_bits, min_count).unionByName(one), "phrases"), totals


def _size(key: str):
    return (F.octet_length(key) / 4).cast("int")


def _cut(key: str, first, size):
    return F.substring(F.col(key), first * 4 + 1, size * 4)


def _inner(candidates: DataFrame) -> DataFrame:
    """(key, most): the shorter phrases inside longer ones, and the count of the most frequent of these."""
    inner = candidates.select("key", "a", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("key", "a", "k", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("at"))
    return inner.select(_cut("key", F.col("at"), F.col("k")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))


def collocations(df: DataFrame, min_count: int = 30, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    a, l, r: counts of the phrase and of both sides of its weakest cut; score floor(2000000 * a / (l + r)) at that cut; n: all words of the language. Phrases that
    lie inside a longer one with 80 % of their count or more are left out.
    """
    with common.scratch() as keep:
        words, phrases, totals = phrase_counts(df, keep, min_count, text_col, lang_col)
        candidates = phrases.select("key", F.col("f").alias("a"), _size("key").alias("size")).filter("size >= 2")
        side = lambda key, f: phrases.select(F.col("key").alias(key), F.col("f").alias(f))
        cuts = candidates.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        cuts = cuts.select("key", "a", "k", _cut("key", F.lit(0), F.col("k")).alias("left"), _cut("key", F.col("k"), F.col("size") - F.col("k")).alias("right"))
        cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
        score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
        scored = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("key", "c.*")
        inner = _inner(candidates.filter("size >= 3"))
        whole = scored.join(inner, "key", "left").filter("most is null or cast(most as decimal(22,0)) * 100 < cast(a as decimal(22,0)) * 80")
        first = F.conv(F.hex(_cut("key", F.lit(0), F.lit(1))), 16, 10).cast("long")
        named = whole.withColumn("id", first).join(words.select("id", "lang"), "id").select("lang", "key", "a", "l", "r", "score")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        named = keep(named.withColumn("rank", F.rank().over(best)).filter(F.col("rank") <= most).drop("rank"), "best")
        ids = named.select("key", F.posexplode(F.sequence(F.lit(0), _size("key") - 1)).alias("at", "k")).select("key", "at", F.conv(F.hex(_cut("key", F.col("k"), F.lit(1))), 16, 10).cast("long").alias("id"))
        spelt = ids.join(words.select("id", "word"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("key", F.array_join("w.word", " ").alias("phrase"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = named.join(spelt, "key").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most).join(totals, "lang")
        return common.materialize(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


OP13_SQL = r"""
with texts as (
  select row_number() over () d, coalesce(lang, 'und') lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from texts),
split as (select lang, regexp_extract_all(p, '[^ \t]+') w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) i from split where len(w) > 0),
sized as (select lang, w, i, unnest([1, 2, 3, 4]) k from places),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase, w[i : i + k - 1] ws from sized where i + k - 1 <= len(w)),
f as (select lang, k, phrase, any_value(ws) ws, count(*) c from grams group by all),
totals as (select lang, sum(c) n from f where k = 1 group by lang),
cand as (select * from f where k >= 2 and c >= 30),
cuts as (select lang, phrase, k, ws, c a, unnest(range(1, k)) cut from cand),
sides as (
  select x.lang, x.phrase, x.a, x.cut, l.c l, r.c r, (2000000::hugeint * x.a) // (l.c + r.c) score
  from cuts x join f l on l.lang = x.lang and l.phrase = array_to_string(x.ws[1 : x.cut], ' ')
  join f r on r.lang = x.lang and r.phrase = array_to_string(x.ws[x.cut + 1 : x.k], ' ')),
weakest as (select * from sides qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_sizes as (select lang, ws, k, c, unnest(range(2, k)) s from cand where k > 2),
inner_places as (select lang, ws, c, s, unnest(range(1, k - s + 2)) i from inner_sizes),
inside as (select lang, array_to_string(ws[i : i + s - 1], ' ') phrase, max(c) most from inner_places group by all),
kept as (
  select w.* from weakest w left join inside i using (lang, phrase)
  where i.most is null or 100::hugeint * i.most < 80::hugeint * w.a)
select lang, rank, phrase, a, l, r, n::bigint n, score::bigint score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept) join totals using (lang)
where rank <= 2000
"""


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(common.read_table(spark, sf_dir, "documents"))
