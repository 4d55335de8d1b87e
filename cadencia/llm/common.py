"""Helpers shared by the corpus operators: Arrow column maps, materialised tables, text bytes."""

from __future__ import annotations

import contextlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.sources import scratch as scratch_files

def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch_files.new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cadencia_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a materialize() result that nothing will read again."""
    jvm, path = df.sparkSession._jvm, df._cadencia_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """materialize() for tables that nothing reads after the block; they are deleted at its end."""
    made = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    yield keep
    for df in made:
        drop_materialized(df)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of the id as text, mod n: the fold that the contracts fix. A null id has none (null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def text_array(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, 64-bit offsets."""
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and their n + 1 offsets, without a copy for each text."""
    arr = text_array(column)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text_col: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` text bytes, so that memory follows bytes and not rows."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], text_col: str = "text") -> DataFrame:
    """df with the columns that make(batch) returns as arrays, in the order of fields.

    A column of df with the name of a new one is replaced. Rows stay where they are: no shuffle.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(kept + fields)
    kept_names = [f.name for f in kept]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                made = make(batch)
                arrays = [batch.column(n) for n in kept_names]
                arrays += [v if isinstance(v := made[f.name], pa.Array) else pa.array(v, k) for f, k in zip(fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept_names + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def _random_table(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: One random odd 64-bit number for each byte value, and the multiplier of the position.
BYTE_MIX = _random_table(256, 11)
POSITION_MIX = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    """POSITION_MIX to the powers 0 .. n-1, modulo 2**64."""
    out = np.full(max(n, 1), POSITION_MIX, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def segment_hashes(mixed: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment [start, start + length) of values that were mixed before; equal segments, equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    full = lengths > 0
    if not full.all():  # reduceat has no empty runs
        out = np.zeros(len(starts), np.uint64)
        out[full] = segment_hashes(mixed, starts[full], lengths[full])
        return out
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    within = np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)
    power = powers(int(lengths.max()))
    first = ends - lengths
    values = mixed[np.repeat(starts, lengths) + within] * power[within]
    out = np.add.reduceat(values, first)
    out ^= lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def power_scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: exact, and squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1]) if len(vectors) else vectors


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of each of the runs, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def distinct_segments(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first segment of each kind, kind of each segment): segments of equal values, and of equal `extra`, are one kind.

    Kinds are found by a 64-bit hash and every segment is then compared in full with the first of its kind, so that two kinds of one hash stay apart.
    """
    mixed = (values.astype(np.uint64) + np.uint64(1)) * POSITION_MIX
    mixed ^= mixed >> np.uint64(29)
    hashes = segment_hashes(mixed * np.uint64(0xBF58476D1CE4E5B9), starts, lengths)
    if extra is not None:
        hashes = hashes ^ (extra.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[kind]
    same = np.array_equal(lengths, lengths[like]) and (extra is None or np.array_equal(extra, extra[like]))
    if same and np.array_equal(values[ragged(starts, lengths)], values[ragged(starts[like], lengths)]):
        return first, kind
    known: dict = {}
    kind = np.array([known.setdefault((values[a : a + n].tobytes(), None if extra is None else extra[i]), len(known)) for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True))], np.int64)
    return np.unique(kind, return_index=True)[1], kind


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes, compressed: high planes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unplaned(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def block_numbers() -> Iterator[int]:
    """Numbers for the blocks that a task makes; no other task of the stage has them, and a retried task has the same."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return itertools.count((task.partitionId() if task else 0) << 32)
