"""The book of registered queries: each with its Spark form and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables of one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scratch(t: Tables) -> str:
    """The folder that driver and executors share."""
    import tempfile

    found = t.spark.conf.get("spark.checkpoint.dir", None)
    master = t.spark.sparkContext.master
    if not found and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="spark-rosterlake-")).rstrip("/")


def new_folder(t: Tables, kind: str) -> str:
    """A new folder in the shared one."""
    from uuid import uuid4

    return f"{scratch(t)}/{kind}-{uuid4().hex}"


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
