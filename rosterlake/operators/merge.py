"""Survivorship merge of near-duplicate records, priority merges and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import glossary, missing_pending, number_in, string


def combined_texts(rows: DataFrame, key: str, place: str, columns: list[str], missing, separator: str, joiner: str) -> DataFrame:
    """(key, one column for each of ``columns``): the distinct parts of a group's texts in order of place; a single distinct text is left as it is.

    Copies are dropped by partial aggregation before texts are split, and parts likewise before they are listed,
    so a list is as long as the merged text, however many rows a group has.
    """
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.when(~missing(c), F.trim(string(c))).alias("v")) for c in columns])
    texts = rows.select(key, place, F.explode(each).alias("_x")).where("_x.v is not null").groupBy(key, F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v")).agg(F.min(place).alias(place))
    parts = texts.select(key, "_c", "_v", place, F.posexplode(F.transform(F.split("_v", separator), lambda p: F.trim(p))).alias("_at", "_p"))
    first = parts.groupBy(key, "_c", "_p").agg(F.min(F.struct(place, "_at")).alias("_first"), F.min("_v").alias("_one"), F.max("_v").alias("_other"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(~missing("_p"), F.struct("_first", "_p")))), lambda x: x["_p"])
    whole = first.groupBy(key, "_c").agg(listed.alias("_l"), F.min("_one").alias("_one"), F.max("_other").alias("_other"))
    merged = F.when(F.col("_one") == F.col("_other"), F.col("_one")).otherwise(F.array_join("_l", joiner))
    return whole.groupBy(key).agg(*[F.max(F.when(F.col("_c") == c, merged)).alias(c) for c in columns])


def survivorship(rows: DataFrame, key: Column, place: Column, numeric: list[str], combine: list[str], others: list[str], missing=missing_pending, separator: str = r"[；;]\s*", joiner: str = "；") -> DataFrame:
    """One row for each key, merged field by field: (merge_key, n_rows, first, fields...), ``first`` being the least place.

    place: a struct that orders the rows of a group. Numeric fields keep the value with the greatest number, the
    first on ties. Combined fields list the distinct parts of what is not missing (a single distinct value is left
    as it is). Other fields keep the longest text that is not missing, the first on ties. Where all are missing, the
    first row's value stays. All are partial aggregations: no group is ordered or gathered as a whole.
    """
    placed = rows.withColumns({"_key": key, "_place": place})
    aggregates = [F.count("*").alias("n_rows"), F.min("_place").alias("first")]
    for c in numeric:
        aggregates.append(F.min_by(F.col(c), F.struct((-number_in(c)).alias("less"), "_place")).alias(c))
    for c in others:
        best = F.min_by(F.when(~missing(c), F.col(c)), F.when(~missing(c), F.struct((-F.length(string(c))).alias("less"), "_place")))
        aggregates.append(F.coalesce(best, F.min_by(F.col(c), "_place")).alias(c))
    aggregates += [F.min_by(F.col(c).cast("string"), "_place").alias(f"_f_{c}") for c in combine]
    merged = placed.groupBy("_key").agg(*aggregates)
    if combine:
        listed = combined_texts(placed, "_key", "_place", combine, missing, separator, joiner)
        merged = merged.join(listed.withColumnRenamed("_key", "_k").hint("merge"), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
        merged = merged.withColumns({c: F.coalesce(c, f"_f_{c}") for c in combine}).drop(*[f"_f_{c}" for c in combine])
    return merged.withColumnRenamed("_key", "merge_key")


def priority_merge(base: DataFrame, new: DataFrame, key: str, columns: list[str], replace: bool = False) -> DataFrame:
    """Base rows and the new keys; where both have a row, the new values replace the base's or not."""
    joined = base.alias("b").join(new.alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    first, second = ("n", "b") if replace else ("b", "n")
    inside = F.col(f"{first}.{key}").isNotNull()
    return joined.select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), *[F.when(inside, F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c) for c in columns])


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def new_rows(rows: DataFrame, known: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key that is not known yet."""
    return first_seen(rows, [key], order).join(known.select(key).distinct(), key, "left_anti")


def overlay(cells: DataFrame, changes: DataFrame, keys: list[str], column: str, value: str, accept: Column) -> DataFrame:
    """``column`` replaced by ``value`` of the matching change where ``accept`` holds."""
    return cells.join(changes, keys, "left").withColumn(column, F.when(accept, F.col(value)).otherwise(F.col(column))).drop(value)


def translated(cells: DataFrame, changes: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """``column`` replaced by translations that are not blank, put right by the glossary."""
    return overlay(cells, changes.withColumn(value, glossary(value)), keys, column, value, F.trim(string(value)) != "")
