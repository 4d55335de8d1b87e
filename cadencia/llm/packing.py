"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Best fit only looks at lengths, and there are at most `capacity` different ones. So the plan is made from the
histogram of lengths: lengths go down from the longest, a segment tree over remaining capacities finds the
tightest open sequences in logarithmic time, and all documents of one length that meet equal sequences
move in one step. This gives the packing of best-fit decreasing over all documents at once, whatever
their number, and the driver holds a table bounded by the capacity. Documents then find their place by their
rank among those of their length, which counts over (partition, length) give without sorting documents.

Defined results: a null or empty text is one end token; a document longer than the capacity is cut into pieces
of the whole capacity, the first may be shorter; repeated rows and null ids are packed each; among pieces of one length the order is that of the scan's
partitions; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadencia.llm import common, tokens

CAPACITY = 1024
END_ID = 2


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` tokens."""
    first = total % capacity or capacity
    return [(0, min(first, total))] + [(s, capacity) for s in range(first, total, capacity)]


def tokenize_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece, with the task's partition and the rank of the piece among those of its length there."""
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()),
    ]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (b for whole in batches for b in common.slices(whole, text_col)):
            owner, rows, ids_out = [], [], []
            for i, text in enumerate(common.text_array(batch.column(text_col)).to_pylist()):
                ids = np.append(tokens.encode(path, text), np.uint32(end_id))
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    piece = ids[start : start + length]
                    owner.append(i)
                    rows.append((n, start, length, zlib.crc32(piece.astype("<u4").tobytes()), seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [batch.column(id_col).take(pa.array(owner, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns[:4], arrow.types[1:5], strict=True)]
            arrays += [pa.array(np.full(len(rows), part), pa.int32()), pa.array(columns[4], pa.int64())] + ([pa.array(ids_out, arrow.types[-1])] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


class OpenSequences:
    """Segment tree over remaining capacities 0 .. capacity; a leaf tells whether sequences with that much room are open."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.width, bool)

    def set(self, room: int, value: bool) -> None:
        at = room + self.width
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int:
        """Least room >= length, or -1."""
        at = length + self.width
        while not self.any[at]:
            while at & 1:  # a right child: go up until there is something to the right
                at //= 2
            if at <= 1:
                return -1
            at += 1
        while at < self.width:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.width


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): the pieces of that length from that rank on go to consecutive sequences."""
    tree, stacks, plan = OpenSequences(capacity), {}, []
    sequences = 0

    def push(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            stacks.setdefault(room, []).append((first, number))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            each = (capacity if room < 0 else room) // length
            if room < 0:
                room, number = capacity, -(-left // each)
                first, sequences = sequences, sequences + number
            else:
                first, number = stacks[room].pop()
                if not stacks[room]:
                    tree.set(room, False)
                used = min(number, -(-left // each))
                push(room, first + used, number - used)
                number = used
            placed = min(left, number * each)
            last = placed - (number - 1) * each  # what the last of these sequences gets
            for layer in range(each):
                here = number if layer < last else number - 1
                if here:
                    plan.append((length, rank, first, capacity - room + layer * length))
                    rank += here
            left -= placed
            push(room - each * length, first, number - 1)
            push(room - last * length, first + number - 1, 1)
    return np.array(plan, np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of tokenize_pieces() with sequence_id and offset."""
    pieces = common.materialize(pieces, "pieces")  # ranks were dealt by the tasks: they must not be dealt again
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_best_fit(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    key = plan[:, 0] * (1 << 50) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            row = plan[np.searchsorted(key, b.column("length").to_numpy() * (1 << 50) + rank, "right") - 1] if len(rank) else plan[:0]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(row[:, 2] + rank - row[:, 1], pa.int64()), pa.array(row[:, 3], pa.int64())], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(starts, ["part", "length"]).select(*kept, (F.col("nth") + F.col("before")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    return pack(tokenize_pieces(df, path or tokens.default_path(), capacity, end_id, with_ids=with_ids), capacity)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.read_table(spark, sf_dir, "documents"))
