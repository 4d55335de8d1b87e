"""Language identification by interpolated Kneser-Ney character models.

One model for each language over lower-cased letters and single blanks. N-gram counts come from a bounded sample
of labelled documents; each order is kept as one sorted array of 64-bit n-gram hashes with a column
of log probabilities for each language, so one search serves all languages. A text goes to the language with the
lowest cross-entropy per character; it is accepted if that is not above the language's limit, a high
quantile on sampled documents that were kept out of the counts.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the alphabetically
first language; without any labelled document all texts are `und`, without any document there are no rows; repeated rows are treated each; texts of any
length are scored whole; columns of the names made here are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common

ORDER = 4
#: Bound of the sample for each language: documents with the smallest hash of their id. One in CALIBRATION of them sets the limits.
MAX_DOCS_PER_LANGUAGE = 400
CALIBRATION = 8
UNKNOWN = "und"
#: A language's limit is this quantile of its held-out texts; scores take the temperature that makes their own languages likeliest.
REJECTED = 0.99
TEMPERATURES = [2.0**k for k in range(12)]
_P = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(code: np.ndarray) -> np.ndarray:
    x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def letter_codes(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, letters): letters in lower case, runs of others as one blank, order - 1 blanks before each text and one after."""
    texts = [t.lower() for t in common.text_array(column).to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[code]
    keep = letter.copy()
    if len(code):
        keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    who = doc[keep]
    kept = np.bincount(who, minlength=len(texts))
    spans = kept + order
    first = np.r_[0, np.cumsum(spans)]
    out = np.full(first[-1], 32, np.uint32)
    starts = np.r_[0, np.cumsum(kept)]
    out[np.arange(len(who)) - starts[who] + first[who] + order - 1] = np.where(letter[keep], code[keep], 32)
    return out, first, np.bincount(doc[letter], minlength=len(texts))


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[n - 1][i]: of the n codes from i on."""
    mixed = _mix(codes)
    out = [mixed]
    for n in range(2, order + 1):
        out.append(out[-1][:-1] * _P + mixed[n - 1 :] if len(out[-1]) else out[-1])
    return out


def _count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, prefix, suffix, times), summed."""
    schema = "lang string, n int, gram long, prefix long, suffix long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "text", 2_000_000):
                langs = np.array(b.column("lang").to_pylist(), object)
                for lang in sorted(set(langs)):
                    codes, first, _ = letter_codes(b.column("text").filter(pa.array(langs == lang)), order)
                    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    hashes = _hashes(codes, order)
                    for n in range(1, order + 1):
                        h = hashes[n - 1]
                        fits = owner[: len(h)] == owner[n - 1 :][: len(h)]
                        # only grams that end on a scored position
                        within = np.arange(len(h)) - first[owner[: len(h)]]
                        at = np.flatnonzero(fits & (within + n >= order))
                        gram, where, times = np.unique(h[at], return_index=True, return_counts=True)
                        where = at[where]
                        zero = np.zeros(len(where), np.uint64)
                        prefix = hashes[n - 2][where] if n > 1 else zero
                        suffix = hashes[n - 2][where + 1] if n > 1 else zero
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n), pa.int32()), *(pa.array(x.view(np.int64)) for x in (gram, prefix, suffix)), pa.array(times, pa.int64())], names=["lang", "n", "gram", "prefix", "suffix", "times"])

    return rows.mapInArrow(run, schema).groupBy("lang", "n", "gram", "prefix", "suffix").agg(F.sum("times").alias("times"))


@dataclass
class LanguageModels:
    languages: list[str]
    grams: list[np.ndarray]  # of order n at n - 1: sorted hashes
    logp: list[np.ndarray]  # len(grams) x languages
    backoff: list[np.ndarray]  # at n - 1: log weight that the context (of n codes) leaves to shorter ones
    unseen: float
    limits: np.ndarray | None = None
    temperature: float = 1.0

    def _at(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.grams[n - 1]
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return at, keys[at] == h

    def _log(self, hashes: list[np.ndarray], n: int, start: np.ndarray) -> np.ndarray:
        """Log probability in each language of the last of the n codes from start on, given those before it."""
        at, found = self._at(n, hashes[n - 1][start])
        out = np.empty((len(start), len(self.languages)), np.float32)
        out[found] = self.logp[n - 1][at[found]]
        if not found.all():
            rest = start[~found]
            if n == 1:
                out[~found] = self.unseen
            else:
                low = self._log(hashes, n - 1, rest + 1)
                context, known = self._at(n - 1, hashes[n - 2][rest])
                low[known] += self.backoff[n - 2][context[known]]
                out[~found] = low
        return out

    def cross_entropy(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents x languages nats a character, characters, letters)."""
        order = len(self.grams)
        codes, first, letters = letter_codes(column, order)
        hashes, n = _hashes(codes, order), len(first) - 1
        total = np.zeros((n, len(self.languages)))
        for a in range(0, len(hashes[-1]), 500_000):
            start = np.arange(a, min(a + 500_000, len(hashes[-1])))
            owner = np.searchsorted(first, start, "right") - 1
            inside = start + order <= first[owner + 1]
            start, owner = start[inside], owner[inside]
            if len(start):
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                total[owner[cuts]] -= np.add.reduceat(self._log(hashes, order, start), cuts, axis=0, dtype=np.float64)
        size = np.maximum(np.diff(first) - order + 1, 1)
        return total / size[:, None], size, letters


def _smooth(table: pa.Table, order: int) -> LanguageModels:
    """Interpolated Kneser-Ney from the counts of all orders; lower orders count the different codes before a gram."""
    names = table.column("lang").to_numpy(zero_copy_only=False)
    languages = sorted(set(names))
    lang = np.searchsorted(languages, names)
    n, gram, prefix, suffix = (table.column(c).to_numpy() for c in ("n", "gram", "prefix", "suffix"))
    gram, prefix, suffix = gram.view(np.uint64), prefix.view(np.uint64), suffix.view(np.uint64)
    times = table.column("times").to_numpy().astype(float)
    width = len(languages)
    grams = [np.unique(gram[n == k]) for k in range(1, order + 1)]
    counts = []
    for k in range(1, order + 1):
        c = np.zeros((len(grams[k - 1]), width))
        if k == order:
            np.add.at(c, (np.searchsorted(grams[k - 1], gram[n == k]), lang[n == k]), times[n == k])
        else:
            up = n == k + 1
            np.add.at(c, (np.searchsorted(grams[k - 1], suffix[up]), lang[up]), 1)
        counts.append(c)
    alphabet = len(grams[0]) + 1
    low = np.full((1, width), 1 / alphabet)
    logp, backoff = [], []
    for k in range(1, order + 1):
        c, own = counts[k - 1], n == k
        pre, suf = np.zeros(len(grams[k - 1]), np.uint64), np.zeros(len(grams[k - 1]), np.uint64)
        at = np.searchsorted(grams[k - 1], gram[own])
        pre[at], suf[at] = prefix[own], suffix[own]
        below = grams[k - 2] if k > 1 else np.zeros(1, np.uint64)
        context = np.minimum(np.searchsorted(below, pre), len(below) - 1)
        known = below[context] == pre
        one, two = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(np.where(one + two > 0, one / np.maximum(one + 2 * two, 1), 0.5), 0.1, 0.9)
        sums, kinds = np.zeros((len(below), width)), np.zeros((len(below), width))
        np.add.at(sums, context[known], c[known])
        np.add.at(kinds, context[known], c[known] > 0)
        weight = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        shorter = low[np.minimum(np.searchsorted(below, suf), len(below) - 1)] if k > 1 else low
        p = np.maximum(c - discount, 0) / np.maximum(sums[context], 1) * known[:, None] + np.where(known[:, None], weight[context], 1.0) * shorter
        low = p
        logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        if k > 1:
            backoff.append(np.log(np.maximum(weight, 1e-12)).astype(np.float32))
    backoff.append(np.zeros((len(grams[-1]), width), np.float32))
    return LanguageModels(languages, grams, logp, backoff, float(np.log(1 / alphabet)))


def fit_languages(documents: DataFrame, train=None, order: int = ORDER, max_docs: int = MAX_DOCS_PER_LANGUAGE) -> LanguageModels | None:
    """Models from at most max_docs documents of each language for which the condition `train` (over doc_id) holds."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if train is not None:
        rows = rows.filter(train)
    # first in parts, so that a language with most documents is not ranked in one task
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(64))
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    few = rows.select("doc_id", "lang", part.alias("part")).withColumn("__nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by_hash))).filter(F.col("__nth") <= max_docs)
    picked = few.select("doc_id", "lang").withColumn("__nth", F.row_number().over(Window.partitionBy("lang").orderBy(*by_hash))).filter(F.col("__nth") <= max_docs)
    # at most max_docs ids for each language
    # rows that repeat an id and its language count once
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(picked.dropDuplicates(["doc_id", "lang"])), ["doc_id", "lang"])
    sample = common.materialize(chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.min("__nth").alias("__nth")), "langid")
    held = F.col("__nth") % CALIBRATION == 0
    counts = _count_grams(sample.filter(~held).select("lang", "text"), order).toArrow()
    if counts.num_rows == 0:
        common.drop_materialized(sample)
        return None
    models = _smooth(counts, order)
    scored = _scored(sample.filter(held).select("lang", "text"), models)
    best = scored.filter(F.col("lang") == F.col("lang_pred")).groupBy("lang").agg(F.percentile("nats", REJECTED).alias("high")).collect()
    limit = {r["lang"]: r["high"] for r in best}
    models.limits = np.array([limit.get(x, np.inf) for x in models.languages])
    models.temperature = _calibrated(sample.filter(held).select("lang", "text"), models)
    common.drop_materialized(sample)
    return models


def _beliefs(nats: np.ndarray, size: np.ndarray, temperature: float) -> np.ndarray:
    """The models' shares of belief (texts x languages) from the cross-entropies and lengths."""
    belief = np.exp(-(nats - nats.min(1, keepdims=True)) * size[:, None] / temperature)
    return belief / belief.sum(1, keepdims=True)


def _calibrated(held: DataFrame, models: LanguageModels) -> float:
    """The temperature under which the held-out texts' own languages are likeliest."""
    place = {x: i for i, x in enumerate(models.languages)}

    def make(b: pa.RecordBatch) -> dict:
        nats, size, _ = models.cross_entropy(b.column("text"))
        own = np.array([place.get(x, 0) for x in b.column("lang").to_pylist()], np.int64)
        each = [-np.log(np.maximum(_beliefs(nats, size, t)[np.arange(len(own)), own], 1e-9)) for t in TEMPERATURES]
        return {"losses": pa.array(list(np.stack(each, 1)), pa.list_(pa.float64()))}

    losses = common.add_columns(held, make, [T.StructField("losses", T.ArrayType(T.DoubleType()))])
    sums = {r["pos"]: r["loss"] for r in losses.select(F.posexplode("losses").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("loss")).collect()}
    return TEMPERATURES[min(sums, key=lambda i: (sums[i], i))] if sums else 1.0


def _scored(df: DataFrame, models: LanguageModels | None, text_col: str = "text") -> DataFrame:
    names = None if models is None else np.array(models.languages, object)

    def make(b: pa.RecordBatch) -> dict:
        if models is None:
            return {"lang_pred": [UNKNOWN] * b.num_rows, "score": np.zeros(b.num_rows), "nats": np.full(b.num_rows, np.inf), "accepted": np.zeros(b.num_rows, bool)}
        nats, size, letters = models.cross_entropy(b.column(text_col))
        best = nats.argmin(1)
        low = nats[np.arange(len(best)), best]
        belief = _beliefs(nats, size, models.temperature)[np.arange(len(best)), best]
        none = letters == 0
        limits = np.full(len(names), np.inf) if models.limits is None else models.limits
        return {"lang_pred": np.where(none, UNKNOWN, names[best]).tolist(), "score": np.where(none, 0.0, belief), "nats": low, "accepted": ~none & (low <= limits[best])}

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("nats", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return common.add_columns(df, make, fields, text_col)


def identify_language(df: DataFrame, models: LanguageModels | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1), nats (a character, in that language) and accepted; such columns are replaced."""
    return _scored(df, models, text_col)


def op5_language(spark, sf_dir: str) -> DataFrame:
    documents = common.read_table(spark, sf_dir, "documents")
    models = fit_languages(documents, common.remainder("doc_id", 5) != 0)
    held = F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False))
    return identify_language(documents.select("doc_id", "text"), models).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
