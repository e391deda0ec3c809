"""Queries by name, each with the SQL that gives the same rows on another engine where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables -> DataFrame) under its name; ``tables`` reads a table by its name as attribute."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def new_folder(self) -> str:
        """A new folder under the cluster's shared one; under a temporary one where none is set and all runs on this
        machine, as in tests."""
        root = self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not self.spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
        return f"{root.rstrip('/')}/{uuid.uuid4().hex[:12]}"
