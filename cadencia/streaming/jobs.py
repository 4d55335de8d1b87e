"""Structured Streaming forms of what arrives event by event: ingest, signing, windows, SLA timers, attribution, suppression.

Every function takes a streaming (or batch) frame of events (session_id, event_id, ts, event_type, payload, ...) and returns
one; the caller picks the sink, the trigger and the checkpoint folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cadencia.operators.chain import GENESIS
from cadencia.sources.keyed import KeyedTable


def ingest(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event once, whatever repeats arrive within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def activity(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events, sessions (approximate) and value by tumbling or sliding window and type."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("session_id").alias("sessions"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "sessions", "value")


def visits(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by gap of each visitor."""
    w = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", delay).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def panes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily panes (day, event_type, n, value), for update mode: a day's row comes again whenever it grows."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.to_date(F.col("window.start")).alias("day"), "event_type", "n", "value")


def keep_panes(table: KeyedTable):
    """A foreachBatch function that puts panes in a table with the key day, event_type; a batch that is run again changes nothing."""
    return lambda batch, number: table.upsert(batch, token=f"batch-{number}")


def rolling(daily: DataFrame, days: int = 7) -> DataFrame:
    """(start, end, event_type, n, value) of the windows of so many days that move by a day, summed from daily panes."""
    own = daily.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("start", F.date_sub("day", F.col("back")))
    return own.groupBy("start", F.date_add("start", days).alias("end"), "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def attribution(messages: DataFrame, purchases: DataFrame, days: int = 3, delay: str = "1 hour") -> DataFrame:
    """Messages with a purchase of the same customer within the days after: a stream-stream interval join."""
    m = messages.withWatermark("sent_at", delay)
    p = purchases.select(F.col("customer_id").alias("buyer"), F.col("ts").alias("bought_at")).withWatermark("bought_at", delay)
    near = (F.col("customer_id") == F.col("buyer")) & (F.col("bought_at") > F.col("sent_at")) & (F.col("bought_at") <= F.col("sent_at") + F.expr(f"interval {days} days"))
    return m.join(p, near).select("notification_id", "customer_id", "sent_at", "bought_at")


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed their time, so that rows of a key are judged in order however they arrive. A key has one timer for its next row, not one for each row. Times are in microseconds, timers in milliseconds."""

    #: Columns that are held, as DDL; `at` is the time.
    held = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        columns = [batch[c.split()[0]] for c in self.held.split(", ")]
        plain = [[None if x is not None and x != x else x for x in c.tolist()] if c.dtype == object else c.tolist() for c in columns]
        self.waiting.appendList(list(zip(*plain, strict=True)))
        self._wake(int(batch["at"].min()))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def due(self, timerValues) -> list[tuple]:
        """The rows whose time has passed; the others go on waiting, with one timer for the next of them."""
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = self.ready(rows, limit)
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        if later := [r[0] for r in rest if r[0] > limit]:
            self._wake(min(later))
        return sorted(ready, key=self.order)

    def ready(self, rows: list[tuple], limit: int) -> tuple[list[tuple], list[tuple]]:
        return [r for r in rows if r[0] <= limit], [r for r in rows if r[0] > limit]

    def order(self, row: tuple):
        return row

    def close(self) -> None:
        pass


SENT = StructType([StructField("customer_id", LongType()), StructField("reminder_id", LongType()), StructField("at", LongType())])


class Suppressor(_Ordered):
    """The time of the last reminder that was sent to the customer, for as long as it matters."""

    held = "at long, reminder_id long"

    def __init__(self, hours: int) -> None:
        self.wait = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, sent = self.last.get()[0] if self.last.exists() else None, []
        for at, reminder in self.due(timerValues):
            if last is None or at - last > self.wait:
                sent.append((int(key[0]), reminder, at))
                last = at
        if sent:
            self.last.update((last,))
            self.handle.registerTimer((last + self.wait) // 1000 + 1)
        elif last is not None and not self.waiting.exists() and timerValues.getCurrentWatermarkInMs() * 1000 > last + self.wait:
            self.last.clear()
        if sent:
            yield pd.DataFrame(sent, columns=SENT.names).astype("int64")


def suppress(reminders: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Reminders (customer_id, reminder_id, ts) that are sent: no other was sent to the customer in the hours before, these included.

    Each is judged against the last one sent, in the order of time and then of number, once the watermark has passed it; so the result
    does not depend on how the stream is cut. Rows later than the delay are dropped. Needs the RocksDB state store.
    """
    timed = reminders.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    sent = timed.groupBy("customer_id").transformWithStateInPandas(Suppressor(hours), SENT, "Append", "EventTime")
    return sent.select("customer_id", "reminder_id", F.timestamp_micros("at").alias("ts"))


SIGNED = StructType([StructField("session_id", LongType()), StructField("event_seq", LongType()), StructField("event_id", LongType()), StructField("prev_hash", StringType()), StructField("payload_hash", StringType())])


class ChainSigner(_Ordered):
    """The last hash of a session; events are signed in the order of their sequence, and wait for those before them that are not due yet."""

    held = "at long, event_seq long, event_id long, payload string, actor string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", StructType([StructField("hash", StringType())]))

    def ready(self, rows: list[tuple], limit: int) -> tuple[list[tuple], list[tuple]]:
        first = min((r[1:3] for r in rows if r[0] > limit), default=None)
        free = [r[0] <= limit and (first is None or r[1:3] < first) for r in rows]
        return [r for r, f in zip(rows, free, strict=True) if f], [r for r, f in zip(rows, free, strict=True) if not f]

    def order(self, row: tuple):
        return row[1], row[2], row[3] or "", row[4] or ""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, out = self.last.get()[0] if self.last.exists() else GENESIS, []
        for _, seq, event, payload, actor in self.due(timerValues):
            own = hashlib.sha256(f"{'{}' if payload is None else payload}|{last}|{actor or ''}".encode()).hexdigest()
            out.append((int(key[0]), seq, event, last, own))
            last = own
        if out:
            self.last.update((last,))
            yield pd.DataFrame(out, columns=SIGNED.names).astype({"session_id": "int64", "event_seq": "int64", "event_id": "int64"})


def sign_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """prev_hash and payload_hash of each event (session_id, event_seq, event_id, ts, payload, actor), signed once the watermark has passed it; needs the RocksDB state store.

    Events that arrive out of order within the delay are signed in the order of event_seq, as chain.sign() does; later ones are dropped.
    """
    timed = events.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("session_id").transformWithStateInPandas(ChainSigner(), SIGNED, "Append", "EventTime")


BREACH = StructType([StructField("reminder_id", LongType()), StructField("at", LongType())])


class SlaTimer(StatefulProcessor):
    """Waits for a review of each reminder; an event-time timer, or a review that comes too late, reports it. Times are in microseconds, timers in milliseconds."""

    def __init__(self, hours: int) -> None:
        self.wait = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, late = pd.concat(list(rows)).sort_values(["at", "kind"]), []
        for kind, at in zip(batch["kind"], batch["at"], strict=True):
            if kind == "created":
                self.open.update((int(at),))
                self.handle.registerTimer(-(-(int(at) + self.wait) // 1000))
            elif self.open.exists():
                since = self.open.get()[0]
                late += [since] if at - since >= self.wait else []
                self.open.clear()
        yield pd.DataFrame({"reminder_id": [int(key[0])] * len(late), "at": late}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a reminder may have been made anew since this timer was set
        if self.open.exists() and (since := self.open.get()[0]) + self.wait <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield pd.DataFrame([(int(key[0]), since)], columns=BREACH.names)

    def close(self) -> None:
        pass


def sla_breaches(changes: DataFrame, hours: int = 24, delay: str = "1 minute") -> DataFrame:
    """(reminder_id, created_at) of reminders (reminder_id, ts, kind: created or reviewed) that nobody reviewed within the hours; needs the RocksDB state store."""
    timed = changes.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    breaches = timed.groupBy("reminder_id").transformWithStateInPandas(SlaTimer(hours), BREACH, "Append", "EventTime")
    return breaches.select("reminder_id", F.timestamp_micros("at").alias("created_at"))
