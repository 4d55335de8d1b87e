"""Alignment of two tokenizers' tokens by white-space anchors.

Each text is tokenised in full by a byte-level vocabulary (A, after a blank) and by a piece vocabulary (B, which adds the blank itself). Where a
token that begins with a blank starts in A at the same byte as one in B, both have an end there: these verified anchors split the document into
windows. A window is known by its token ids on both sides. Windows repeat like words do, so a block of documents aligns each distinct window once:
groups between bytes where tokens of both end, and links of all A-B tokens whose bytes overlap.

How often an id pair is linked in the whole corpus is counted from the blocks' distinct pairs; the counts return to the block, which sums them over the windows of
each document. Documents travel as window numbers of their block: neither texts nor a row for each link move. A block is bounded by
BLOCK_BYTES of text (a longer text is a block by itself).

Defined results: texts that are null or empty, and those whose tokens of A or of B do not give back the bytes of blank and text (such as those that hold the
mark that B has for a blank), have no tokens: zeros, and '' for the groups; strings of special tokens are plain text; rows that repeat an id or
a text are aligned each and count each; a null id stays null; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common, tokens

BLOCK_BYTES = 8_000_000
_SLICE_BYTES = 300_000
_SPACE = 32


class _Vocabulary:
    """Bytes of all tokens in one array."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.spaced = np.array([p[:1] == b" " for p in pieces])

    def text(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[common.ragged(self.first[ids], self.size[ids])]


class Aligner:
    """Both tokenizers, and the alignment of windows."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a_path, (self.model, b_pieces) = a_path, tokens.load_pieces(b_path)
        table = tokens.piece_table(a_path)
        self.a, self.b = _Vocabulary([table.get(i, b"") for i in range(max(table) + 1)]), _Vocabulary(b_pieces)

    def tokenize(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none where either does not give the text back."""
        none = np.zeros(0, np.uint32)
        a, b = [none] * len(texts), [none] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for i, found in zip(full, self.model.encode([texts[i] for i in full], num_threads=1), strict=True):
            raw = np.frombuffer(b" " + texts[i].encode(), np.uint8)
            left, right = tokens.encode(self.a_path, " " + texts[i], plain=True), np.array(found, np.uint32)
            if np.array_equal(self.a.text(left), raw) and np.array_equal(self.b.text(right), raw):
                a[i], b[i] = left, right
        return a, b

    def anchors(self, a: np.ndarray, b: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Bytes at which a space-marked token starts in both, or a document does."""
        at = [np.cumsum(v.size[ids]) - v.size[ids] for v, ids in ((self.a, a), (self.b, b))]
        marked = [x[v.spaced[ids]] for x, v, ids in zip(at, (self.a, self.b), (a, b), strict=True)]
        return np.union1d(np.intersect1d(*marked, assume_unique=True), doc_starts)

    def align(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(groups of each window as text, number of groups, number of links, linked pairs of all windows) of windows laid end to end.

        a_ends: the number of A tokens up to the end of each window.
        """
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        stops = ends_a[a_ends - 1]
        every = np.union1d(ends_a, ends_b)  # between two of these ends one A and one B token overlap
        pairs = (a[np.searchsorted(ends_a, every)].astype(np.int64) << 32) | b[np.searchsorted(ends_b, every)]
        links = np.diff(np.searchsorted(every, stops, "right"), prepend=0)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        groups = np.diff(np.searchsorted(shared, stops, "right"), prepend=0)
        names = [list(map(str, x.tolist())) for x in (a, b)]
        cuts = [np.r_[0, np.searchsorted(e, shared, "right")].tolist() for e in (ends_a, ends_b)]
        told = [f"{','.join(names[0][p:q])}|{','.join(names[1][r:s])}" for p, q, r, s in zip(cuts[0][:-1], cuts[0][1:], cuts[1][:-1], cuts[1][1:], strict=True)]
        at = np.r_[0, np.cumsum(groups)].tolist()
        return [";".join(told[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)], groups, links, pairs


class _Block:
    def __init__(self, aligner: Aligner, with_groups: bool) -> None:
        self.aligner, self.with_groups = aligner, with_groups
        self.memo: dict[bytes, int] = {}
        self.told: list[str] = []
        self.groups, self.links, self.pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.docs, self.bytes = [], 0

    def add(self, ids: pa.Array, texts: list[str], size: int) -> None:
        self.bytes += size
        of_a, of_b = self.aligner.tokenize(texts)
        a, b = np.concatenate(of_a), np.concatenate(of_b)
        n_a, n_b = np.array([len(x) for x in of_a], np.int64), np.array([len(x) for x in of_b], np.int64)
        code = np.zeros(0, np.uint32)
        n_windows = np.zeros(len(texts), np.int64)
        if len(a):
            size_a, size_b = self.aligner.a.size[a], self.aligner.b.size[b]
            start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
            full = np.flatnonzero(n_a)
            doc_starts = start_a[(np.cumsum(n_a) - n_a)[full]]
            anchors = self.aligner.anchors(a, b, doc_starts)
            first_a, first_b = np.searchsorted(start_a, anchors), np.searchsorted(start_b, anchors)
            n_windows[full] = np.diff(np.r_[np.searchsorted(anchors, doc_starts), len(anchors)])
            code = self._number(a, b, first_a, np.diff(np.r_[first_a, len(a)]), first_b, np.diff(np.r_[first_b, len(b)]))
        self.docs.append((ids, n_a, n_b, n_windows, code))

    def _number(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, size_a: np.ndarray, first_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """The number of each window in the block; those that are new to it are aligned."""
        size = size_a + size_b
        start = np.cumsum(size) - size
        both = np.empty(int(size.sum()), np.uint32)
        both[common.ragged(start, size_a)] = a[common.ragged(first_a, size_a)]
        both[common.ragged(start + size_a, size_b)] = b[common.ragged(first_b, size_b)] | np.uint32(1 << 31)
        first, kind = common.distinct_segments(both, start, size)
        known = len(self.memo)
        number = np.array([self.memo.setdefault(both[s : s + n].tobytes(), len(self.memo)) for s, n in zip(start[first].tolist(), size[first].tolist(), strict=True)], np.uint32)
        new = first[number >= known]
        if len(new):
            told, groups, links, pairs = self.aligner.align(a[common.ragged(first_a[new], size_a[new])], b[common.ragged(first_b[new], size_b[new])], np.cumsum(size_a[new]))
            self.told += told
            self.groups.append(groups)
            self.links.append(links)
            self.pairs.append(pairs)
        return number[kind]

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        groups, links, pairs = (np.concatenate(x) for x in (self.groups, self.links, self.pairs))
        codes = [d[4] for d in self.docs]
        times = np.sum([np.bincount(c, minlength=len(groups)) for c in codes], axis=0)
        own, pair_code = np.unique(pairs, return_inverse=True)
        often = np.zeros(len(own), np.int64)
        np.add.at(often, pair_code, np.repeat(times, links))
        for a in range(0, len(own), 200_000):
            part = own[a : a + 200_000]
            yield _batch(block, 0, len(part), code=pa.array(np.arange(a, a + len(part))), pair=pa.array(part), times=pa.array(often[a : a + len(part)]))
        rank = np.empty(len(groups), np.uint32)
        order = np.argsort(-times, kind="stable")
        rank[order] = np.arange(len(groups), dtype=np.uint32)
        by_rank = pair_code[common.ragged((np.cumsum(links) - links)[order], links[order])]
        yield _batch(block, 1, 1, sizes=pa.array([common.planes(links[order])], pa.binary()), windows=pa.array([common.planes(by_rank)], pa.binary()))
        for ids, n_a, n_b, n_windows, code in self.docs:
            ends = np.r_[0, np.cumsum(n_windows)]
            n_groups = np.diff(np.r_[0, np.cumsum(groups[code])][ends])
            told = [";".join([self.told[c] for c in code[p:q].tolist()]) for p, q in zip(ends[:-1], ends[1:], strict=True)]
            ranked = rank[code]
            yield _batch(
                block, 2, len(ids), doc_id=ids, n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups), groups=pa.array(told if self.with_groups else [None] * len(told), pa.string()),
                groups_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]), windows=pa.array([common.planes(ranked[p:q]) for p, q in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            )


_KINDS = {"code": pa.int64(), "pair": pa.int64(), "times": pa.int64(), "sizes": pa.binary(), "windows": pa.binary(), "doc_id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string()}


def _batch(block: int, kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array(np.full(rows, block), pa.int64()), pa.array(np.full(rows, kind), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays + [columns[c] if c in columns else pa.nulls(rows, k or pa.null()) for c, k in _KINDS.items()], names=["block", "kind", *_KINDS])


def _align_blocks(df: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    kinds = {"sizes": "binary", "windows": "binary", "groups": "string", "groups_sha256": "string"}
    fields = [T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType())]
    fields += [T.StructField(c, id_type if c == "doc_id" else {"binary": T.BinaryType(), "string": T.StringType()}.get(kinds.get(c, ""), T.LongType())) for c in _KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, aligner = common.block_numbers(), Aligner(a_path, b_path)
        place = 2 + list(_KINDS).index("doc_id")

        def rows(block: _Block) -> Iterator[pa.RecordBatch]:
            for b in block.rows(next(numbers)):
                yield b.set_column(place, "doc_id", b.column(place).cast(arrow_id))

        block = _Block(aligner, with_groups)
        for whole in batches:
            for b in common.slices(whole, "text", _SLICE_BYTES):
                block.add(b.column("doc_id"), common.text_array(b.column("text")).to_pylist(), len(common.text_bytes(b.column("text"))[0]))
                if block.bytes >= BLOCK_BYTES:
                    yield from rows(block)
                    block = _Block(aligner, with_groups)
        if block.docs:
            yield from rows(block)

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def _sum_windows(rows: DataFrame, docs: list[str]) -> DataFrame:
    """`docs` columns with n_best and count_sum, from rows of each block in the order pairs, windows, documents."""
    schema = T.StructType([rows.schema[c] for c in docs] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, of_window = None, [], None
        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if block[lo] != now:
                    now, held, of_window = block[lo], [], None
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append([part.column(c).to_numpy() for c in ("code", "total", "best")])
                elif kind[lo] == 1:
                    size, links = (common.unplaned(part.column(c)[0].as_py()).astype(np.int64) for c in ("sizes", "windows"))
                    total, best = np.zeros(len(held) and sum(len(h[0]) for h in held), np.int64), None
                    best = total.copy()
                    for code, t, g in held:
                        total[code], best[code] = t, g
                    first = np.cumsum(size) - size
                    of_window = [np.add.reduceat(x[links], first) if len(size) else x for x in (total, best)]
                else:
                    codes = [common.unplaned(w) for w in part.column("windows").to_pylist()]
                    sums = [pa.array([int(x[c].sum()) for c in codes], pa.int64()) for x in (of_window[1], of_window[0])]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in docs] + sums, names=schema.names)

    return rows.mapInArrow(run, schema)


def align_documents(df: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of df, and the groups themselves as text if asked for."""
    with common.scratch() as keep:
        blocks = keep(_align_blocks(df, a_path or tokens.default_path(), b_path or tokens.pieces_path(), with_groups), "aligned")
        own = blocks.filter("kind = 0").select("block", "code", "pair", "times")
        totals = own.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
        totals = keep(totals, "pairs")
        most = totals.groupBy("b").agg(F.max("total").alias("most"))
        totals = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
        docs = ["doc_id", "n_a", "n_b", "n_groups", "groups", "groups_sha256"]
        rest = blocks.filter("kind > 0").drop("pair", "times").withColumn("total", F.lit(None).cast("long")).withColumn("best", F.lit(None).cast("long"))
        back = own.join(totals, "pair").select("block", F.lit(0).alias("kind"), "code", "total", "best")
        rows = back.unionByName(rest, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "code")
        out = _sum_windows(rows, docs).withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups"))
        out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
        return common.materialize(out, "alignments")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(common.read_table(spark, sf_dir, "documents"))
