"""Shared helpers of the corpus operators: durable intermediates, batch maps, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that leaves the setting empty gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-rosterlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, cut its lineage and return the stored rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame) -> DataFrame:
    """The same for tables of many short rows, which a compressed table holds in a fraction of a checkpoint's space."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(folder: str):
    """Arrow's view of a shared folder, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``id``, ``text`` (null: empty) and further columns; whatever else the table holds is pruned."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in more])


_HELD: dict[str, Callable[[], None]] = {}


def holding(name: str, release: Callable[[], None]) -> None:
    """What a Python worker keeps between tasks for one operator; caches of other operators are released first."""
    for other in [n for n in _HELD if n != name]:
        _HELD.pop(other)()
    _HELD[name] = release


def release_all() -> None:
    holding("", lambda: None)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: T.StructType, rows: int = 1024) -> DataFrame:
    """Apply ``fn(batch) -> list of columns`` to Arrow batches of at most ``rows`` rows."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                columns = fn(whole.slice(at, rows))
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, to, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def pressed(df: DataFrame, column: str) -> DataFrame:
    """A text column compressed, to be moved; null texts stay null."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema.fields])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = pa.array([None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([raw if k == at else c for k, c in enumerate(batch.columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def unpressed(df: DataFrame, column: str) -> DataFrame:
    """A compressed text column as it was."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == column else f for f in df.schema.fields])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                text = pa.array([None if r is None else unpack.decompress(r).decode("utf-8", "surrogatepass") for r in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(batch.columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def text_hash(text: Column | str) -> Column:
    """Tells rows that share an id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit("")))


def first_rows(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each group of groups (id, h, group): one with the smallest id, then text hash ``h``.

    Rows that share an id but not their text may belong to unlike groups. Rows without an id stay.
    """
    first = groups.groupBy("group").agg(F.min(F.struct("id", "h")).alias("first")).select("first.id", "first.h").distinct()
    rows = docs.where(F.col(f"`{id_col}`").isNotNull())
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("row")
    text = F.col(f"`{text_col}`")
    moved = pressed(rows.select(others, F.col(f"`{id_col}`").alias("id"), text_hash(text).alias("h"), text.alias("text")), "text")
    one = F.min_by(F.struct("row", "text"), F.col("text").isNull()).alias("one")  # partial first, so copies may be many
    single = moved.join(first.hint("merge"), ["id", "h"], "left_semi").groupBy("id", "h").agg(one).select("one.row", "one.text")
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return unpressed(single, "text").select(*columns).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id on an edge; the component is its smallest id.

    Alternating large-star and small-star rounds: each round is two partial aggregations and two
    joins, so no neighbourhood is ever gathered in one task, and the number of rounds grows with the
    logarithm of a component's width. Every round is checkpointed.
    """
    a_, b_ = F.col(a), F.col(b)
    links = keep(edges.where(a_ != b_).select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()

    before = mark(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = keep(small)
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
