"""Streams give what a batch gives; text formats round trip; models beat the mean."""

from __future__ import annotations

import collections
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.operators import chain, features, governance, models
from cadencia.plans import queries
from cadencia.sources import io
from cadencia.sources.fixtures import AS_OF, Retail
from cadencia.sources.keyed import KeyedTable
from cadencia.streaming import jobs


def run_stream(spark, tmp_path, frames, schema, job, mode="append", conf=None):
    """Each frame is a batch of its own."""
    source = tmp_path / "in"
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(source / f"b{i}"))
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = job(stream).writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def events(spark, sf_dir):
    return Retail(spark, sf_dir).events().withColumn("ts", F.col("ts").cast("timestamp")).drop("event_seq").orderBy("ts", "event_id")


def test_ingest_drops_repeats(spark, sf_dir, tmp_path):
    e = events(spark, sf_dir).limit(200)
    got = run_stream(spark, tmp_path, [e, e.limit(50)], e.schema, lambda s: jobs.ingest(s, "60 days"))
    assert got.count() == 200 and got.select("event_id").distinct().count() == 200


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LAST = dt.datetime(2030, 1, 1)


def shuffled(df, n):
    """df in n parts without regard to time, and a last row of nobody that moves the watermark past all."""
    parts = [df.filter(F.pmod(F.xxhash64("event_id", F.lit(n)), F.lit(n)) == k) for k in range(n)]
    end = df.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long"), "ts": F.lit(LAST)}).select(df.columns)
    return [*parts, end]


def test_signing_on_arrival_equals_batch(spark, sf_dir, tmp_path):
    """Three files, events of each session in all of them; some have an actor, some no payload."""
    e = events(spark, sf_dir).filter("session_id < 12").withColumn("event_seq", F.col("event_id") * 2)
    e = e.withColumn("actor", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), F.col("event_id") % 4))).withColumn("payload", F.when(F.col("event_id") % 5 != 0, F.col("payload")))
    got = run_stream(spark, tmp_path, shuffled(e, 3), e.schema, lambda s: jobs.sign_stream(s, "900 days"), conf=ROCKS).filter("session_id >= 0")
    want = chain.sign(e).select("session_id", "event_seq", "event_id", "prev_hash", "payload_hash").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 50


def test_signing_waits_for_earlier_numbers(spark, tmp_path):
    """An event whose time has come waits for one with a smaller number whose time has not."""
    t = lambda d: dt.datetime(2024, 1, d)
    e = spark.createDataFrame([(1, 2, 20, t(1), "b", None), (1, 1, 10, t(9), "a", "x"), (1, 3, 30, t(20), "c", None)], "session_id long, event_seq long, event_id long, ts timestamp, payload string, actor string")
    frames = [e.filter("event_id < 30"), e.filter("event_id = 30"), e.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "ts": F.lit(LAST)})]
    got = run_stream(spark, tmp_path, frames, e.schema, lambda s: jobs.sign_stream(s, "1 day"), conf=ROCKS).filter("session_id >= 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chain.sign(e).drop("is_new").collect()))


def test_long_keys_have_one_timer(spark, tmp_path):
    """All events are of one session, in two batches; what waits is not gone through once for each of them."""
    n = 40_000
    e = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("event_seq"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("actor"))
    frames = [e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), e.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "ts": F.lit(LAST)})]
    began = time.monotonic()
    got = run_stream(spark, tmp_path, frames, e.schema, lambda s: jobs.sign_stream(s, "900 days"), conf=ROCKS).filter("session_id >= 0")
    assert time.monotonic() - began < 60
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chain.sign(e).drop("is_new").collect())) and got.count() == n


def brute_sent(rows, hours=24):
    last, out = {}, []
    for customer, number, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if customer not in last or ts - last[customer] > dt.timedelta(hours=hours):
            last[customer] = ts
            out.append((customer, number))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 3])
def test_suppression_does_not_depend_on_the_batches(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(c, 100 * c + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.choice([0, 1, 1439, 1440, 1441, rng.randint(0, 20_000)]))) for c in range(6) for i in range(25)]
    df = spark.createDataFrame(rows, "customer_id long, reminder_id long, ts timestamp")
    named = df.toDF("session_id", "event_id", "ts")
    job = lambda s: jobs.suppress(s.toDF("customer_id", "reminder_id", "ts"), 24, "30 days")
    got = run_stream(spark, tmp_path, shuffled(named, files), named.schema, job, conf=ROCKS).filter("customer_id >= 0")
    want = brute_sent(rows)
    assert sorted(map(tuple, got.select("customer_id", "reminder_id").collect())) == want
    assert sorted(map(tuple, governance.suppress(df).select("customer_id", "reminder_id").collect())) == want
    assert max(collections.Counter(c for c, _ in want).values()) > 3


def test_suppression_of_days_apart_and_of_nulls(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, 1, t(1)), (1, 2, t(5)), (1, 3, t(9)), (2, 4, None), (None, 5, t(1)), (None, 6, t(1))], "customer_id long, reminder_id long, ts timestamp")
    assert sorted(r["reminder_id"] for r in governance.suppress(df).collect()) == [1, 2, 3, 5]


def test_panes_in_a_keyed_table_add_up(spark, sf_dir, tmp_path):
    e = events(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    table = KeyedTable(spark, f"file://{tmp_path}/panes", "day date, event_type string, n long, value double", ["day", "event_type"], "day")
    for i, f in enumerate(shuffled(e, 3)[:3]):
        f.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.panes(stream, "900 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(jobs.keep_panes(table)).start().awaitTermination()
    daily = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    assert sorted(map(str, table.read().select(daily.columns).collect())) == sorted(map(str, daily.collect()))
    weeks = {(r["start"], r["event_type"]): r["n"] for r in jobs.rolling(table.read()).collect()}
    day = daily.agg(F.min("day")).first()[0]
    one = e.filter(F.to_date("ts").between(day, day + dt.timedelta(days=6))).groupBy("event_type").count().collect()
    assert {r["event_type"]: r["count"] for r in one} == {k[1]: n for k, n in weeks.items() if k[0] == day}


def test_attribution_equals_batch(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    m = spark.createDataFrame([(1, 10, t(1)), (2, 10, t(5)), (3, 11, t(1))], "notification_id long, customer_id long, sent_at timestamp")
    p = spark.createDataFrame([(10, t(2)), (10, t(9)), (11, t(4, 1))], "customer_id long, ts timestamp")
    assert {r["notification_id"] for r in jobs.attribution(m, p).collect()} == {1}


def test_suppression_in_batch(spark):
    assert jobs.visits(spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 59)], "session_id long, ts timestamp")).count() == 2


def test_jsonl_counts_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n{"id": 2, "t": null}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    assert tuple(io.count_broken(io.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).cache()).first()) == (3, 1)
    assert io.read_jsonl_dropping(spark, str(tmp_path / "a.jsonl"), schema).filter("id is not null").count() == 2


def test_csv_and_split_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', "train"), (2, "line\nbreak", "validation")], "id long, t string, split string")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    io.write_jsonl(df, str(tmp_path / "j"))
    assert (tmp_path / "j" / "split=train").exists()
    io.write_parquet(df, str(tmp_path / "p"), "split")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_models(spark, sf_dir):
    r = Retail(spark, sf_dir)
    rows = features.split_80_20(features.cycle_training(queries.bought(r), r.customers(), r.drugs()).fillna(0.0), "is_chronic", "customer_id", "drug_id").cache()
    fitted = {n: models.fit(rows.filter("is_train"), features.CYCLE_FEATURES, m) for n, m in models.regressors(5).items()}
    both = models.ensemble(fitted, rows, classify=False)
    mean = rows.agg(F.avg("target")).first()[0]
    assert models.mean_absolute_error(both) < models.mean_absolute_error(rows.withColumn("prediction", F.lit(mean)))
    assert len(models.importance(fitted["forest"], rows)) == 5
    churn = models.class_weights(features.churn_training(queries.bought(r), r.customers(), r.drugs(), AS_OF)).cache()
    bundle = models.tuned_bundle(models.fit(churn, features.CHURN_FEATURES, models.classifiers(5, weighted=True)["logistic"], scale=True), churn)
    assert bundle.predict(churn).filter("predicted in (0, 1)").count() == churn.count()


def test_models_read_rows_that_are_written_once(spark, sf_dir, monkeypatch):
    """Training does not join and deal the items anew in each pass."""
    plans, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda train, *a, **k: (plans.append(train._jdf.queryExecution().executedPlan().toString()), fit(train, *a, **k))[1])
    assert queries.model_decisions(Retail(spark, sf_dir)).count() > 0
    assert len(plans) == 2 and not any("Exchange" in p or "Join" in p for p in plans)
