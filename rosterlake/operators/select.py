"""Selection: balanced quotas, capped queues, budgets, top rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.joins import running_budget, small


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def sorting(order: list[tuple[str, bool]]) -> list[Column]:
    """Sort columns of (name, descending) pairs, nulls last."""
    return [F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_last() for c, falling in order]


def balanced_quota(rows: DataFrame, row_key: str, groups: Column, wanted: DataFrame, n: int, order: list[tuple[str, bool]]) -> DataFrame:
    """``n`` rows, balanced over groups that a row may belong to several of, with their place ``pick``.

    wanted: (grp, pos), pos from 1. Each group has an equal quota, the first groups one more. Rows within
    the quota of a group come first, by group, then the rest in order until there are ``n``. Only the rows
    within quotas and the next ``n`` of the rest are compared with each other.
    """
    total = wanted.agg(F.count("*").alias("k"))  # one row
    quotas = wanted.join(F.broadcast(total)).select("grp", "pos", (F.floor(F.lit(n) / F.col("k")) + (F.col("pos") <= F.lit(n) % F.col("k")).cast("int")).alias("quota"))
    member = rows.select(row_key, F.explode(groups).alias("grp"), *[c for c, _ in order if c != row_key])
    ranked = member.join(small(quotas), "grp").withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(*sorting(order)))).where(F.col("_r") <= n)
    chosen = ranked.where(F.col("_r") <= F.col("quota")).groupBy(row_key).agg(F.min(F.struct("pos", "_r")).alias("_in"))
    first = rows.join(chosen, row_key, "left")
    rest = first.where(F.col("_in").isNull()).orderBy(*sorting(order)).limit(n)
    few = first.where(F.col("_in").isNotNull()).unionByName(rest)  # at most 2 n rows
    place = Window.orderBy(F.col("_in").isNull(), F.col("_in.pos"), F.col("_in._r"), *sorting(order))
    return few.withColumn("pick", F.row_number().over(place)).where(F.col("pick") <= n).drop("_in")


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], text: str, budget: int, extra: int = 0, each: int | None = None, mark: str = "") -> DataFrame:
    """Texts in order as long as a running character budget of each group lasts; the last one is cut; empty texts go.

    each: what a text may take at most, with a mark where it is cut.
    """
    full = rows.where(F.length(text) > 0)
    if each:
        short = F.concat(F.rtrim(F.left(F.col(text), F.lit(each - len(mark)))), F.lit(mark))
        full = full.withColumn(text, F.when(F.length(text) > each, short).otherwise(F.col(text)))
    left = running_budget(full, keys, order, F.length(text) + extra, budget, F.xxhash64(text))
    return left.withColumn(text, F.when(F.length(text) > F.col("_left"), F.rtrim(F.left(F.col(text), F.col("_left")))).otherwise(F.col(text))).drop("_left")


def capped_queue(rows: DataFrame, needs: Column, order: list[Column], cap: int) -> DataFrame:
    """Adds ``queued``: the first ``cap`` rows that need a step. The limit is taken before rows are ranked."""
    few = rows.where(needs).orderBy(*order).limit(cap).select("row_id", F.lit(True).alias("_q"))
    return rows.join(few, "row_id", "left").withColumn("queued", F.coalesce("_q", F.lit(False))).drop("_q")
