"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

The patterns (assignments, access keys, long hex) always count. Besides, every run of 16 token characters or more
gets an inferred encoding (the smallest alphabet that holds it, from digits to base64) and three tests against "drawn
uniformly from that alphabet": chi-squared uniformity, runs about the median symbol, and lag-one serial
correlation. Their p-values join into one randomness score.

What ordinary writing scores is measured on decoys: every document gives runs of its ordinary letters, of the least length of a class and in an alphabet,
both picked by a digest of its text. For each encoding and class of length the share of decoys that score as high, times all candidates,
bounds how many of the candidates above a score are ordinary. Scores at which that is at most `rate` of them are reported as kind `random`. So the
battery decides alone: runs of letters or of digits only are tested like all others, and what cannot be told from writing at its
length (a short run of small letters) is not reported. The tallies are sums over all
documents; their size is fixed by the numbers of encodings, length classes and score bins.

Spans are in code points, end exclusive. Defined results: null and empty texts have no spans; repeated rows are
scanned each; without candidates there are no added spans; columns of the names made here are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common

#: The patterns of the base kinds. All classes are ASCII, so that bytes of UTF-8 match as code points do.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # a match takes the whole run, so the least length can stand in the pattern
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_DIGITS, _CAPITALS, _SMALL = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Alphabets, the smaller ones first.
ENCODINGS = ("decimal", "hex", "small", "capital", "base32", "base36", "base62", "base64")
_ALPHABETS = (_DIGITS, _DIGITS + _SMALL[:6], _SMALL, _CAPITALS, _CAPITALS + b"234567", _DIGITS + _SMALL, _DIGITS + _CAPITALS + _SMALL, _CAPITALS + _SMALL + _DIGITS + b"+/")
_CODES = np.full((len(ENCODINGS), 256), -1, np.int64)
for _e, _letters in enumerate(_ALPHABETS):
    _CODES[_e, list(_letters)] = np.arange(len(_letters))
_CODES[1, list(b"ABCDEF")] = np.arange(10, 16)
_CODES[-1, list(b"-_")] = (62, 63)
#: Least lengths of the classes of length: tallies are kept apart, as short runs look random by chance.
LENGTH_CLASSES = (16, 20, 24, 32, 48, 64, 128)
BINS = 100
#: Runs of ordinary letters that each document gives.
DECOYS = 6
FALSE_DISCOVERY_RATE = 0.01


def infer_encoding(run: bytes) -> int:
    """Number in ENCODINGS: the smallest alphabet that holds the run (padding and separators apart)."""
    codes = np.frombuffer(run.rstrip(b"="), np.uint8)
    for e in range(len(ENCODINGS) - 1):
        if (_CODES[e, codes] >= 0).all():
            return e
    return len(ENCODINGS) - 1


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Two-sided tail of the normal distribution (a rational approximation of erfc, error below 2e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return np.clip(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x), 1e-12, 1)


def randomness(run: bytes, encoding: int) -> float:
    """0 to 1: high where uniformity, runs and serial correlation all agree with random symbols of the encoding."""
    code = _CODES[encoding, np.frombuffer(run, np.uint8)]
    return _score(code[code >= 0], len(_ALPHABETS[encoding]))


def _score(code: np.ndarray, size: int) -> float:
    n = len(code)
    if n < 8:
        return 0.0
    # chi-squared over the whole alphabet, as a normal deviate from its exact mean and variance for n draws
    chi = (np.bincount(code, minlength=size) ** 2).sum() * size / n - n
    uniform = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    high = code >= size // 2
    ones = int(high.sum())
    changes = int((high[1:] != high[:-1]).sum()) + 1
    share = ones / n
    expected = 2 * n * share * (1 - share) + 1
    spread = np.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    runs = (changes - expected) / spread if 0 < ones < n else 9.0
    centred = code - code.mean()
    power = (centred**2).sum()
    serial = (centred[1:] * centred[:-1]).sum() / power * np.sqrt(n) if power else 9.0
    # English-like text fails by excess only in chi-squared: one side; the others on both
    p = np.array([_normal_tail(np.array(max(uniform, 0.0))), _normal_tail(np.array(runs)), _normal_tail(np.array(serial))])
    # a harmonic mean: one failed test is enough to look ordinary
    return float(len(p) / (1 / p).sum())


def _class(length: int) -> int:
    return int(np.searchsorted(LENGTH_CLASSES, length, "right")) - 1


def _bin(score: float) -> int:
    return min(int((1 + np.log10(max(score, 1e-10)) / 10) * BINS), BINS - 1)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return sorted(found)


def candidates(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, end, encoding, length class, score bin) of runs that are long enough, in bytes."""
    out = []
    for m in CANDIDATE.finditer(raw):
        run = m.group()
        encoding = infer_encoding(run)
        out.append((m.start(), m.end(), encoding, _class(len(run)), _bin(randomness(run, encoding))))
    return out


def decoys(raw: bytes) -> list[tuple[int, int, int]]:
    """(encoding, length class, score bin) of DECOYS runs of the document's ordinary letters: those of no candidate.

    Encodings, lengths and places follow from the digest of the text. Letters beyond an alphabet are folded into it, which keeps how unevenly they are used.
    """
    letters = np.frombuffer(re.sub(rb"[^A-Za-z]", b"", CANDIDATE.sub(b"", raw)), np.uint8)
    if not len(letters):
        return []
    seed, out = zlib.crc32(raw), []
    for k in range(DECOYS):
        place = (seed + k * 0x9E3779B1) % (1 << 32)
        e, c = place % len(ENCODINGS), place // len(ENCODINGS) % len(LENGTH_CLASSES)
        n = LENGTH_CLASSES[c]
        if len(letters) < n:
            continue
        at = place // 97 % (len(letters) - n + 1)
        own = _CODES[-1, letters[at : at + n]]
        size = len(_ALPHABETS[e])
        small = own % 26
        code = _CODES[e, letters[at : at + n]] if ENCODINGS[e] in ("base62", "base64") else small % size
        out.append((e, c, _bin(_score(code, size))))
    return out


def tally(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts over all documents by (encoding, length class, score bin, candidate or decoy)."""
    shape = (len(ENCODINGS), len(LENGTH_CLASSES), BINS, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for b in (b for whole in batches for b in common.slices(whole, text_col)):
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                for _, _, e, c, score in candidates(raw or b""):
                    total[e, c, score, 0] += 1
                for e, c, score in decoys(raw or b""):
                    total[e, c, score, 1] += 1
        cell = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total.ravel()[cell], pa.int64())], names=["cell", "n"])

    sums = df.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most prod(shape) rows
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in sums:
        out[r["cell"]] = r["n"]
    return out.reshape(shape)


def thresholds(counts: np.ndarray, rate: float = FALSE_DISCOVERY_RATE) -> np.ndarray:
    """Least score bin to report for each (encoding, length class): ordinary runs are at most `rate` of the candidates above it.

    At most as many candidates are ordinary as there are, and of these the decoys' share scores so high. Stricter bins need not meet the rate by themselves (a q-value is
    the least rate at which a score is reported). Where a class has no decoys, those of the next shorter class stand in, as longer runs of writing look
    less random. A bin under BINS - 20 (a combined p-value below 0.01) is never enough: it would not agree with randomness.
    """
    above = counts[:, :, ::-1].cumsum(2)[:, :, ::-1].astype(float)
    out = np.full(counts.shape[:2], BINS)
    for e in range(counts.shape[0]):
        share = np.zeros(BINS)
        for c in range(counts.shape[1]):
            made = above[e, c, 0, 1]
            share = above[e, c, :, 1] / made if made else share
            ok = (share * above[e, c, 0, 0] <= rate * np.maximum(above[e, c, :, 0], 1)) & (np.arange(BINS) >= BINS - 20)
            out[e, c] = ok.argmax() if ok.any() else BINS
    return out


def _apart(extra: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of `extra` that overlap none of `found`; both are sorted and walked once, spans of `extra` do not overlap."""
    out, at, reach = [], 0, 0
    for span in extra:
        while at < len(found) and found[at][0] < span[2]:
            reach, at = max(reach, found[at][2]), at + 1
        if reach <= span[0]:
            out.append(span)
    return out


def find_spans(raw: bytes, limits: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes: the base spans, and random runs that no base span overlaps."""
    found = base_spans(raw)
    if limits is not None:
        extra = [(a, 3, z) for a, z, e, c, score in candidates(raw) if score >= limits[e, c]]
        found = sorted(found + _apart(extra, found))
    return found


def _code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if raw.isascii():
        return spans
    before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return [(int(before[a]), k, int(before[z])) for a, k, z in spans]


def redact(raw: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with every span (overlapping ones as one) replaced by a mark of its kind."""
    out, at, n = [], 0, 0
    while n < len(spans):
        start, kind, end = spans[n]
        while n + 1 < len(spans) and spans[n + 1][0] < end:
            n += 1
            end = max(end, spans[n][2])
        out += [raw[at:start], b"[" + KINDS[kind].encode() + b"]"]
        at, n = end, n + 1
    return b"".join([*out, raw[at:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan_secrets(df: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE, with_text: bool = False) -> DataFrame:
    """df with secret_spans (array of kind, start, end); with_text also replaces the text by its redacted form."""
    limits = thresholds(tally(df, text_col), rate)

    def make(b: pa.RecordBatch) -> dict:
        spans, texts = [], []
        for raw in b.column(text_col).cast(pa.binary()).to_pylist():
            found = find_spans(raw or b"", limits)
            spans.append([{"kind": KINDS[k], "start": a, "end": z} for a, k, z in _code_points(raw or b"", found)])
            if with_text:
                texts.append(None if raw is None else redact(raw, found).decode())
        return {"secret_spans": spans, text_col: texts}

    if not with_text:
        return common.add_columns(df, make, [T.StructField("secret_spans", T.ArrayType(SPAN))], text_col)
    order = [*df.columns, "secret_spans"]
    return common.add_columns(df, make, [T.StructField(text_col, T.StringType()), T.StructField("secret_spans", T.ArrayType(SPAN))], text_col).select(order)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secret_spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("random"),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("secret_spans", shown), ",").alias("spans"),
    )
