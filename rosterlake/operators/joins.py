"""How tables of unsure size are joined, and budgets over hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS, PARTS = 10_000, 64
#: Rows of a few numbers that one task may sort.
TASK_ROWS = 1_000_000


def small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table of a few short columns, sent to every task if it has no more than ``most`` rows, else joined by its keys."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def spread(rows: DataFrame, *keys: str, of: DataFrame | None = None, most: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by keys, in more partitions than are usual where these would hold more than ``most`` rows each, so that a task's memory does not grow with the table.

    of: a table of about as many rows that is quicker to count.
    """
    parts = -(-(rows if of is None else of).count() // most)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts > usual else rows.repartition(*keys)


def running_budget(rows: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int, salt: Column, left: str = "_left", parts: int = PARTS) -> DataFrame:
    """Rows that start within a running budget of their group, with what is ``left`` for them.

    A row that fits has less than the budget before it in its group, so also in any part of the group: each part
    first keeps what fits on its own, in tasks of its own, and only that is ordered as a whole. Rows of no size go.
    """
    sized = rows.withColumn("_size", size).where(F.col("_size") > 0).withColumn("_salt", F.pmod(salt, F.lit(parts)))

    def before(*by: str) -> Column:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(window), F.lit(0))

    kept = sized.withColumn("_before", before(*keys, "_salt")).where(F.col("_before") < budget)
    whole = kept.withColumn(left, F.lit(budget) - before(*keys)).where(F.col(left) > 0)
    return whole.drop("_size", "_salt", "_before")
