"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts, for a batch of documents at once, in numpy. Trees are grown by
level from binned histograms on a bounded sample of labelled documents and kept as flat arrays, so that
scoring follows all documents through all trees at once.

Defined results: a null or empty text is scored from its (zero) statistics; without labels of both kinds
every score is the share of label 1 (0.5 without labels); repeated rows are scored each; null labels and
labels of unknown documents do not count; conflicting labels of one document both count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common

#: Bound of the sample of labelled documents that the trees are grown on; the ones with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000

SYMBOLS = b"#$%&*@^~<>=+_\\/{}[]"
_CLASSES = ("lower", "upper", "digit", "space", "newline", "high", "bar", "bang", "symbol", "stop", "other")
_LUT = np.full(256, 10, np.uint8)
_LUT[ord("a") : ord("z") + 1] = 0
_LUT[ord("A") : ord("Z") + 1] = 1
_LUT[ord("0") : ord("9") + 1] = 2
_LUT[[9, 11, 12, 13, 32]] = 3
_LUT[10] = 4
_LUT[128:] = 5
_LUT[ord("|")] = 6
_LUT[ord("!")] = 7
_LUT[list(SYMBOLS)] = 8
_LUT[[ord("."), ord(","), ord(";"), ord(":"), ord("?")]] = 9

FEATURES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "repeat_next", "distinct_words", "top_word",
    "caps_pairs", "symbol_words", "words_a_line", "short_lines", "distinct_lines",
)


def _repeats(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: how many different keys, and how often the commonest occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(key):
        order = np.lexsort((key, owner))
        o, k = owner[order], key[order]
        first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])])
        runs = np.diff(np.r_[first, len(o)])
        distinct = np.bincount(o[first], minlength=n).astype(float)
        np.maximum.at(top, o[first], runs)
    return distinct, top


def document_statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, offs = common.text_bytes(column)
    n, sizes = len(offs) - 1, np.diff(offs)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    kind = _LUT[raw]
    counts = np.bincount(doc.astype(np.int64) * 16 + kind, minlength=n * 16).reshape(n, 16)[:, : len(_CLASSES)].astype(float)
    size = np.maximum(sizes, 1).astype(float)
    is_start = np.zeros(len(raw) + 1, bool)
    is_start[offs] = True
    is_start = is_start[: len(raw)]
    blank = (kind == 3) | (kind == 4)
    begin = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | is_start)) if len(raw) else np.zeros(0, np.int64)
    ends_at = np.r_[is_start[1:], True] if len(raw) else is_start
    end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | ends_at)) + 1 if len(raw) else begin
    length = end - begin
    mixed = common.BYTE_MIX[raw]
    word, owner = common.segment_hashes(mixed, begin, length), doc[begin] if len(begin) else np.zeros(0, np.int32)
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(owner, length, n) / some
    square = np.bincount(owner, length.astype(float) ** 2, n) / some
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _repeats(owner, word, n)
    upper = kind == 1
    pairs = np.bincount(doc[1:][upper[1:] & upper[:-1]], minlength=n) if len(raw) > 1 else np.zeros(n)
    tail = np.isin(kind[end - 1], (6, 7, 8)) if len(end) else np.zeros(0, bool)
    newline = kind == 4
    line_begin = np.flatnonzero(is_start | np.r_[False, newline[:-1]]) if len(raw) else np.zeros(0, np.int64)
    line_end = np.flatnonzero(newline | ends_at) + 1 if len(raw) else line_begin
    line_owner = doc[line_begin] if len(line_begin) else np.zeros(0, np.int32)
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1).astype(float)
    line_length = line_end - line_begin
    line_distinct, _ = _repeats(line_owner, common.segment_hashes(mixed, line_begin, line_length - newline[line_end - 1] if len(line_end) else line_length), n)
    own = lambda mask, who: np.bincount(who[mask], minlength=n)
    return np.column_stack([
        counts / size[:, None], np.log1p(sizes), np.log1p(words), mean, np.sqrt(np.maximum(square - mean**2, 0)), own(length > 20, owner) / some,
        np.bincount(owner, again, n) / some, distinct / some, top / some, pairs / size, own(tail, owner) / some, words / lines, own(line_length < 30, line_owner) / lines, line_distinct / lines,
    ])


@dataclass
class Trees:
    """All trees as arrays: inner nodes in heap order, x > threshold goes right; the raw score is a logit."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if len(self.leaf):
            inner = self.feature.shape[1]
            row, tree = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            at = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            raw += self.leaf[tree, at - inner].sum(1)
        return 1 / (1 + np.exp(-raw))


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought over histograms of at most `bins` bins."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    limit = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        limit[f, : len(e)] = e
    cell = binned + np.arange(width) * bins
    raw = np.full(n, base)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            keys = ((node - first)[:, None] * (width * bins) + cell).ravel()
            shape = (count, width, bins)
            g = np.bincount(keys, np.repeat(gradient, width), count * width * bins).reshape(shape).cumsum(2)
            h = np.bincount(keys, np.repeat(weight, width), count * width * bins).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
            gain[(h < least) | (ht - h < least) | ~np.isfinite(limit)[None]] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            split = flat[np.arange(count), best] > 1e-6
            out.feature[t, first : first + count] = np.where(split, best // bins, 0)
            out.threshold[t, first : first + count] = np.where(split, limit[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        spot = node - inner
        out.leaf[t] = -rate * np.bincount(spot, gradient, inner + 1) / (np.bincount(spot, weight, inner + 1) + penalty)
        raw += out.leaf[t][spot]
    return out


def fit_quality(documents: DataFrame, labels: DataFrame, train=None, max_rows: int = MAX_TRAIN_ROWS, **settings) -> Trees:
    """Trees grown on at most max_rows labelled documents for which the condition `train` (over doc_id) holds."""
    picked = labels.select("doc_id", F.col("quality").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull())
    if train is not None:
        picked = picked.filter(train)
    # at most max_rows ids: small enough to broadcast at any size of the corpus
    picked = picked.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(max_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    stats = common.add_columns(rows, lambda b: {"__x": pa.array(list(document_statistics(b.column("text"))), pa.list_(pa.float64()))}, [T.StructField("__x", T.ArrayType(T.DoubleType()))])
    # rows that repeat an id count once, so that no more than max_rows come to the driver
    sample = stats.groupBy("doc_id", "__y").agg(F.min("__x").alias("__x")).toPandas().sort_values(["doc_id", "__y"])
    x = np.array(sample["__x"].tolist(), float).reshape(len(sample), len(FEATURES))
    return grow_trees(x, sample["__y"].to_numpy(float), **settings)


def score_quality(documents: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """documents with score (0 to 1) and predicted (1 if score >= 0.5); columns with these names are replaced."""

    def make(batch: pa.RecordBatch) -> dict:
        score = model.score(document_statistics(batch.column(text_col)))
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return common.add_columns(documents, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text_col)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    documents, labels = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels")
    model = fit_quality(documents, labels, common.remainder("doc_id", 3) != 1)
    held = F.coalesce(common.remainder("doc_id", 3) == 1, F.lit(False))
    return score_quality(documents.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
