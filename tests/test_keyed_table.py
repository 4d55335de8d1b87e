"""The keyed table: upserts and purges by partition, repeated batches, and jobs that die before the swap."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadencia.sources.keyed import KeyedTable

SCHEMA = "id long, day string, n long"


def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], "day")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(t):
    return sorted(map(tuple, t.read().collect()))


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == []
    assert t.upsert(rows(spark, (1, "a", 1), (2, "a", 2), (3, "b", 3)))
    before = t._manifest()["parts"]
    assert t.upsert(rows(spark, (2, "a", 20), (4, "c", 4), (None, "a", 9), (5, None, 9)))
    after = t._manifest()["parts"]
    assert held(t) == [(1, "a", 1), (2, "a", 20), (3, "b", 3), (4, "c", 4)]
    assert after["v-b"] == before["v-b"] and after["v-a"] != before["v-a"]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.upsert(rows(spark, (1, "a", 1)), "x") and not t.upsert(rows(spark, (1, "a", 7)), "x")
    assert held(t) == [(1, "a", 1)]
    assert not t.purge("true", "x") and held(t) == [(1, "a", 1)]


def test_a_job_that_dies_between_write_and_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 1), (3, "b", 3)))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(RuntimeError):
            t.upsert(rows(spark, (1, "a", 100)), "retry")
    assert held(t) == [(1, "a", 1), (3, "b", 3)]
    assert t.upsert(rows(spark, (1, "a", 100)), "retry") and held(table(spark, tmp_path)) == [(1, "a", 100), (3, "b", 3)]
    t.vacuum()
    versions = {p.name.split("=")[1] for p in (tmp_path / "t" / "data").iterdir()}
    assert versions == set(t._manifest()["parts"].values()) and held(t) == [(1, "a", 100), (3, "b", 3)]


def test_two_writers_cannot_make_the_same_version(spark, tmp_path):
    t = table(spark, tmp_path)
    before = t._manifest()
    t.upsert(rows(spark, (1, "a", 1)))
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(before, {}, None)


def test_purge_drops_rows_and_empty_partitions(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 1), (2, "a", None), (3, "b", 3), (4, "c c/d=é", 9)))
    t.purge("n >= 3")
    assert held(t) == [(1, "a", 1), (2, "a", None)] and set(t._manifest()["parts"]) == {"v-a"}
    t.purge("n > 100")
    assert len(held(t)) == 2


def test_partition_values_of_odd_letters(spark, tmp_path):
    t = table(spark, tmp_path)
    values = [(1, "a b", 1), (2, "x/y=z", 2), (3, "é%41", 3), (4, "2024-01-01", 4)]
    t.upsert(rows(spark, *values))
    t.upsert(rows(spark, (2, "x/y=z", 20)))
    assert held(t) == sorted([values[0], (2, "x/y=z", 20), *values[2:]])


def test_dates_as_partitions(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/d", "day date, n long", ["day"], "day")
    t.upsert(spark.range(3).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"), F.col("id").alias("n")))
    t.upsert(spark.createDataFrame([(dt.date(2024, 1, 2), 50)], "day date, n long"))
    assert held(t) == [(dt.date(2024, 1, 1), 0), (dt.date(2024, 1, 2), 50), (dt.date(2024, 1, 3), 2)]
