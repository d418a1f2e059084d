"""Streams: new keys as batches arrive, errors classified as they are logged, resumed from a checkpoint."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.joblog import diagnose
from rosterlake.operators.merge import first_seen


def batches(spark: SparkSession, folder: str, schema: T.StructType, files_each: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def new_keys(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen for ``delay`` of event time; the state holds no more than that."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def add_new_keys(stream: DataFrame, keys: list[str], order: list[Column], store: str, checkpoint: str) -> None:
    """Works through what is there: the first row of each key that the table ``store`` does not hold is added to it.

    The stream keeps no state of its own. Each batch is an anti-join with the stored keys and one write, into a
    folder of its own, so a batch that is repeated after a failure replaces what it wrote before and finds the same
    rows new. Null keys are keys too. ``store`` holds the stream's columns, ``run`` and ``batch``.
    """
    run = "r" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = first_seen(batch, keys, order)
        stored = T.StructType([*batch.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
        try:
            known = spark.read.schema(stored).parquet(store).where((F.col("run") != run) | (F.col("batch") != number)).select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
            same = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
            fresh = fresh.join(known.hint("merge"), same, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("overwrite").parquet(f"{store.rstrip('/')}/run={run}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def classified(stream: DataFrame, message, stage=None) -> DataFrame:
    """Error records with source and cause; stateless."""
    d = diagnose(message) if stage is None else diagnose(message, stage)
    return stream.withColumn("_d", d).withColumns({"error_source": F.col("_d.source"), "error_cause": F.col("_d.cause")}).drop("_d")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work through what is there and stop; a later call goes on behind it, so no batch is done twice."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
