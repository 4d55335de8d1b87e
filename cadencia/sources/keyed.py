"""A keyed table on files: upserts and purges rewrite only the partitions that they touch, and show all at once.

    data/version=<n>/folder=<name>/part-*.parquet    written once, never changed; a folder for each value of the partition column
    manifests/<n>                                          which version holds each partition; the largest n counts

A change writes the new files of the touched partitions, then its manifest under a name of its own, and last renames that to the next number. Readers see the table
before or after the change, never between; a job that dies before the rename leaves files that no manifest names (vacuum() deletes them) and can be run again. A
change may carry a token: one that was carried out before is skipped, so that repeated batches of a stream count once. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, FOLDER = "version", "folder"
#: Tokens that a manifest remembers.
TOKENS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], partition: str) -> None:
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), key, partition
        self.schema = spark.createDataFrame([], schema).schema
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._jvm, self._at = jvm, lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(conf)

    def _folder(self) -> Column:
        """A name for the value of the partition column that is safe in paths."""
        text = F.col(self.partition).cast("string")
        return F.when(F.rlike(text, F.lit("^[A-Za-z0-9_-]{1,60}$")), F.concat(F.lit("v-"), text)).otherwise(F.concat(F.lit("h-"), F.sha2(text, 256)))

    # ---- manifests

    def _numbers(self) -> list[int]:
        where = self._at("manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self) -> dict:
        """{number, parts: folder -> version, tokens}."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "parts": {}, "tokens": []}
        stream = self._fs.open(self._at(f"manifests/{numbers[-1]}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, before: dict, parts: dict, token: str | None) -> None:
        number = before["number"] + 1
        told = {"number": number, "parts": parts, "tokens": (before["tokens"] + [token] * (token is not None))[-TOKENS:]}
        aside = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not self._fs.rename(aside, self._at(f"manifests/{number}")):
            raise RuntimeError(f"another writer made version {number} of {self.path}")

    # ---- reading

    def _read(self, parts: dict[str, str]) -> DataFrame:
        """The partitions given as folder -> version."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{VERSION}={v}/{FOLDER}={p}" for p, v in sorted(parts.items())))

    def read(self) -> DataFrame:
        return self._read(self._manifest()["parts"])

    # ---- changes

    def _touched(self, rows: DataFrame) -> set[str]:
        """The folders of these rows; as many as the change writes."""
        return {r[0] for r in rows.select(self._folder()).distinct().collect()}

    def _write(self, rows: DataFrame) -> tuple[str, set[str]]:
        version = uuid.uuid4().hex
        rows.select(*self.schema.names, self._folder().alias(FOLDER)).repartition(FOLDER).write.partitionBy(FOLDER).parquet(f"{self.path}/data/{VERSION}={version}")
        made = {x.getPath().getName().split("=", 1)[1] for x in self._fs.listStatus(self._at(f"data/{VERSION}={version}")) if "=" in x.getPath().getName()}
        return version, made

    def _replace(self, before: dict, touched: set[str], rows: DataFrame, token: str | None) -> None:
        version, made = self._write(rows)
        parts = {p: v for p, v in before["parts"].items() if p not in touched} | dict.fromkeys(made, version)
        self._commit(before, parts, token)

    def upsert(self, new: DataFrame, token: str | None = None) -> bool:
        """Rows of `new` in place of those of their keys, which must not move to another partition; False if the token was carried out before.

        Keys of `new` are distinct; null keys and null partitions are not kept.
        """
        before = self._manifest()
        if token is not None and token in before["tokens"]:
            return False
        new = new.select(*self.schema.names).filter(" and ".join(f"{c} is not null" for c in {*self.key, self.partition}))
        touched = self._touched(new)
        old = self._read({p: v for p, v in before["parts"].items() if p in touched})
        self._replace(before, touched, new.unionByName(old.join(new.select(*self.key), self.key, "left_anti")), token)
        return True

    def purge(self, gone: str, token: str | None = None) -> bool:
        """Rows for which the condition holds go; only partitions that have such rows are written again."""
        before = self._manifest()
        if token is not None and token in before["tokens"]:
            return False
        touched = self._touched(self.read().filter(gone))
        left = self._read({p: v for p, v in before["parts"].items() if p in touched}).filter(f"not coalesce({gone}, false)")
        self._replace(before, touched, left, token)
        return True

    def vacuum(self) -> None:
        """Deletes all files that the newest manifest does not name, and the manifests before it."""
        now = self._manifest()
        held = {f"{VERSION}={v}" for v in now["parts"].values()}
        where = self._at("data")
        for x in self._fs.listStatus(where) if self._fs.exists(where) else []:
            name = x.getPath().getName()
            if name not in held:
                self._fs.delete(x.getPath(), True)
            else:
                for y in self._fs.listStatus(x.getPath()):
                    part = y.getPath().getName()
                    if "=" in part and now["parts"].get(part.split("=", 1)[1]) != name.split("=", 1)[1]:
                        self._fs.delete(y.getPath(), True)
        for n in self._numbers()[:-1]:
            self._fs.delete(self._at(f"manifests/{n}"), False)
