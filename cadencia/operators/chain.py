"""Hash-chained event logs: signing, verification and reports.

payload_hash = sha256(payload | prev_hash | actor) in hex; the chain of each session starts from GENESIS. A null payload counts as
{} and a null actor as the empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the hash before the first event of a session.
GENESIS = "0" * 64


def event_hash(payload: Column, prev: Column, actor: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(payload, F.lit("{}")), prev, F.coalesce(actor, F.lit(""))), 256)


def sign(events: DataFrame, force: bool = False) -> DataFrame:
    """events (session_id, event_seq, event_id, payload, actor[, prev_hash, payload_hash]) with both hashes, and is_new.

    Without force, rows that are signed keep their hashes and the chain goes on from them. Rows stream through in order and only
    the last hash is held, so sessions may have any length.
    """
    old = ("prev_hash", "payload_hash") if "payload_hash" in events.columns and not force else ()
    order = ("session_id", "event_seq", "event_id")
    dealt = events.select(*order, "payload", "actor", *old).repartition("session_id")
    made = [T.StructField(n, T.StringType()) for n in ("prev_hash", "payload_hash")]
    schema = T.StructType([*dealt.select(*order).schema.fields, *made, T.StructField("is_new", T.BooleanType())])
    return dealt.sortWithinPartitions(*order, "payload", "actor").mapInArrow(_signer(bool(old)), schema)


def _signer(signed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = None, GENESIS
        for b in batches:
            prev, own, new = [], [], []
            none = [None] * b.num_rows
            values = [b.column(c).to_pylist() for c in ("session_id", "payload", "actor")]
            before = [b.column(c).to_pylist() for c in ("prev_hash", "payload_hash")] if signed else [none, none]
            for s, p, a, old_prev, old_own in zip(*values, *before, strict=True):
                if s != session:
                    session, last = s, GENESIS
                new.append(old_own is None)
                prev.append(last if old_own is None else old_prev)
                last = old_own if old_own is not None else hashlib.sha256(f"{'{}' if p is None else p}|{last}|{a or ''}".encode()).hexdigest()
                own.append(last)
            arrays = [*(b.column(c) for c in ("session_id", "event_seq", "event_id")), pa.array(prev, pa.string()), pa.array(own, pa.string()), pa.array(new, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["session_id", "event_seq", "event_id", "prev_hash", "payload_hash", "is_new"])

    return run


def sign_long(events: DataFrame) -> DataFrame:
    """The hashes of all rows anew, without is_new."""
    return sign(events, force=True).drop("is_new")


def sign_summary(signed: DataFrame) -> DataFrame:
    new = F.col("is_new")
    return signed.agg(F.count_if(new).alias("rebuilt_rows"), F.count_if(~new).alias("skipped_rows"), F.min(F.when(new, F.col("event_seq"))).alias("first_seq"), F.max(F.when(new, F.col("event_seq"))).alias("last_seq"))


def with_previous(events: DataFrame, skip_unsigned: bool = False) -> DataFrame:
    """events with due_prev: the hash of the row before in the session, the genesis hash without one."""
    w = Window.partitionBy("session_id").orderBy("event_seq", "event_id")
    before = F.last("payload_hash", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if skip_unsigned else F.lag("payload_hash").over(w)
    return events.withColumn("due_prev", F.coalesce(before, F.lit(GENESIS)))


def verify(events: DataFrame, skip_unsigned: bool = False) -> DataFrame:
    """One row for each fault: unsigned, prev_hash_mismatch or payload_hash_mismatch; a row can have two.

    The row before is the one right before in the session, and after an unsigned row the genesis hash is due; skip_unsigned
    looks back to the last signed row instead.
    """
    rows = with_previous(events, skip_unsigned).withColumn("due_hash", event_hash(F.col("payload"), F.coalesce("prev_hash", F.lit(GENESIS)), F.col("actor")))
    fault = lambda name, on, due, got: F.when(on, F.struct(F.lit(name).alias("reason"), due.alias("expected_hash"), got.alias("actual_hash")))
    signed = F.col("payload_hash").isNotNull()
    none = F.lit(None).cast("string")
    faults = F.array_compact(F.array(
        fault("unsigned", ~signed, none, none),
        fault("prev_hash_mismatch", signed & ~F.col("prev_hash").eqNullSafe(F.col("due_prev")), F.col("due_prev"), F.col("prev_hash")),
        fault("payload_hash_mismatch", signed & (F.col("payload_hash") != F.col("due_hash")), F.col("due_hash"), F.col("payload_hash")),
    ))
    return rows.select("session_id", "event_seq", "event_id", F.explode(faults).alias("f")).select("session_id", "event_seq", "event_id", "f.reason", "f.expected_hash", "f.actual_hash")


def unsigned_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("payload_hash").isNull()).alias("unsigned"))


def chain_report(faults: DataFrame) -> DataFrame:
    return faults.agg(
        F.count_if(F.col("reason") == "unsigned").alias("unsigned"), F.count_if(F.col("reason") != "unsigned").alias("mismatches"),
        F.min("event_seq").alias("first_break"), F.min_by("session_id", F.struct("event_seq", "session_id")).alias("first_session"),
    )
