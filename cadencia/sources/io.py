"""Readers and writers of text formats with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A header line, UTF-8 with or without a byte-order mark, quotes and line breaks inside quotes."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """All lines; those that are no JSON have their text in BROKEN and nulls elsewhere. Blank lines are skipped."""
    with_broken = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    return spark.read.schema(with_broken).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)


def count_broken(df: DataFrame) -> DataFrame:
    """One row: all lines, and those that are broken."""
    # lines are counted over the fields, as Spark does not read the column of broken lines alone
    some = F.coalesce(*(F.col(c).cast("string") for c in df.columns if c != BROKEN))
    return df.agg((F.count(some) + F.count_if(some.isNull())).alias("lines"), F.count(BROKEN).alias("broken"))


def read_jsonl_dropping(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Only the lines that are JSON."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_jsonl(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each value of the split column."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')
