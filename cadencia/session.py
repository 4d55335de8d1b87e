"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's checkout (local mode, shared folders).

    On a cluster without such a folder ship the package with --py-files; the extra path is then ignored.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root
