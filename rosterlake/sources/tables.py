"""Sources and sinks: batch files, Markdown tables, cells of sheets, nested documents, delivered tables."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import rules
from rosterlake.functions.text import preferred_name, string
from rosterlake.functions.urls import normal_url
from rosterlake.operators.filters import is_person
from rosterlake.operators.joins import SMALL_ROWS

#: Places of sources that users give, behind those that are fixed.
GIVEN_FROM = 1_000_000


def read_batches(spark: SparkSession, paths: list[str], schema: T.StructType, name: str = "name") -> DataFrame:
    """Rows of batch files with the file they come from as ``batch_id``; rows that name no person go."""
    read = spark.read.schema(schema).parquet(*paths).withColumn("batch_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))
    return read.where(is_person(name))


def chosen_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("validation", "delivery")) -> list[str]:
    """Files of batches (folder/batch/kind/file): of each batch the first kind that it has.

    Only file names are read, and the list is the one that the scan of these files holds anyway.
    """
    files = spark.read.option("recursiveFileLookup", "true").parquet(folder).select(F.col("_metadata.file_path").alias("path")).distinct()
    part = lambda k: F.element_at(F.split("path", "/"), k)
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), part(-2))
    ranked = files.select("path", part(-3).alias("batch"), rank.alias("rank")).where("rank > 0")
    best = ranked.groupBy("batch").agg(F.min("rank").alias("rank"))
    return [r.path for r in ranked.join(best.hint("merge"), ["batch", "rank"]).select("path").collect()]


def preferred_batches(spark: SparkSession, folder: str, schema: T.StructType, name: str = "name", kinds: tuple[str, ...] = ("validation", "delivery")) -> DataFrame:
    """Rows of all batches below a folder with their ``batch_id``, from the checked table where a batch has one; rows that name no person go."""
    files = chosen_files(spark, folder, kinds)
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.StringType())]))
    read = spark.read.schema(schema).parquet(*files).withColumn("batch_id", F.element_at(F.split("_metadata.file_path", "/"), -3))
    return read.where(is_person(name))


def markdown_rows(docs: DataFrame, key: str, text: str, header: str, least_cells: int = 10) -> DataFrame:
    """Rows of the first Markdown table of each text whose header holds ``header``.

    ``(key, line, cells)``: short rows and dividers go, the table ends at the first line without a bar.
    """
    lines = docs.select(key, F.posexplode(F.split(string(text), "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    parts = F.transform(F.split(F.regexp_replace("raw", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    bars = lines.withColumn("cells", F.when(F.col("raw").contains("|"), parts))
    by = Window.partitionBy(key).orderBy("line")
    head = F.array_contains("cells", header) & (F.size("cells") >= least_cells)
    first = F.min(F.when(head, F.col("line"))).over(Window.partitionBy(key))
    end = F.min(F.when((F.col("line") > F.col("_first")) & F.col("cells").isNull(), F.col("line"))).over(Window.partitionBy(key))
    marked = bars.withColumn("_first", first).withColumn("_end", end)
    inside = marked.where((F.col("line") > F.col("_first")) & F.col("cells").isNotNull() & (F.col("_end").isNull() | (F.col("line") < F.col("_end"))))
    rows = inside.where((F.size("cells") >= least_cells) & ~F.forall("cells", lambda c: c.rlike("^:?-*:?$")))
    return rows.withColumn("row", F.row_number().over(by)).select(key, "row", "cells")


def first_block(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, row, cells)``: the first block of lines that begin and end with a bar; its divider, as second line, goes."""
    lines = docs.select(key, F.posexplode(F.split(string(text), "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    barred = lines.withColumn("_bar", F.col("raw").rlike(r"^\|.*\|$|^\|$"))
    one = barred.groupBy(key).agg(F.min(F.when(F.col("_bar"), F.col("line"))).alias("_first")).where("_first is not null")
    ends = barred.join(one.hint("merge"), key).where(~F.col("_bar") & (F.col("line") > F.col("_first"))).groupBy(key).agg(F.min("line").alias("_end"))
    inside = barred.join(one.hint("merge"), key).join(ends.hint("merge"), key, "left").where((F.col("line") >= F.col("_first")) & (F.col("_end").isNull() | (F.col("line") < F.col("_end"))))
    cells = F.transform(F.split(F.regexp_replace("raw", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = inside.select(key, (F.col("line") - F.col("_first") + 1).alias("row"), cells.alias("cells"))
    divider = (F.col("row") == 2) & F.forall("cells", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^[-:]*$"))
    return rows.where(~divider)


def detect_header(cells: DataFrame, name_words: tuple[str, ...], role_words: tuple[str, ...], rows: int = 30, columns: int = 80) -> DataFrame:
    """The header of each file: (file, sheet, row, score), best score first, then sheet and row; none below 100."""
    head = cells.where((F.col("row") <= rows) & (F.col("col") <= columns) & (F.trim(string("value")) != ""))
    normal = F.lower(F.regexp_replace("value", r"\s+", ""))
    scored = head.groupBy("file", "sheet", "row").agg((F.max(normal.isin(*name_words).cast("int")) * 100 + F.sum(normal.isin(*role_words).cast("int")) * 8 + F.least(F.count("*"), F.lit(20))).alias("score"))
    best = Window.partitionBy("file").orderBy(F.desc("score"), "sheet", "row")
    return scored.where("score >= 100").withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def canonical_rows(cells: DataFrame, layout: DataFrame, roles: DataFrame, name: str = "name", workplace: str = "org") -> DataFrame:
    """Cells below the header by the role of their column: (file, row, role, value), later columns of a role win.

    Rows without a name go. The name is the form that is best to search for; ``raw_name`` holds it as it was, and
    ``institution`` all workplace cells in order of their columns.
    """
    at = layout.select("file", "sheet", F.col("row").alias("header_row"))
    normal = F.lower(F.regexp_replace("value", r"\s+", ""))
    header = cells.join(at.hint("merge"), ["file", "sheet"]).where(F.col("row") == F.col("header_row")).select("file", "sheet", "col", normal.alias("alias")).join(roles.hint("merge"), "alias").select("file", "sheet", "col", "role")
    data = cells.join(at.hint("merge"), ["file", "sheet"]).where(F.col("row") > F.col("header_row"))
    listed = F.array_sort(F.collect_list(F.when((F.col("role") == workplace) & (F.trim(string("value")) != ""), F.struct("col", F.trim("value").alias("v")))))  # a row's columns
    one = data.join(header.hint("merge"), ["file", "sheet", "col"]).groupBy("file", "row", "role").agg(F.max_by("value", "col").alias("value"), F.array_join(F.transform(listed, lambda x: x["v"]), " ").alias("_all"))
    is_name = F.col("role") == name
    people = one.where(is_name & (preferred_name("value") != "")).select("file", "row")
    kept = one.join(people.hint("merge"), ["file", "row"], "left_semi")
    more = F.when(is_name, F.array(F.struct(F.lit(name).alias("role"), preferred_name("value").alias("value")), F.struct(F.lit("raw_name").alias("role"), F.col("value").alias("value"))))
    more = more.when(F.col("role") == workplace, F.array(F.struct("role", "value"), F.struct(F.lit("institution").alias("role"), F.col("_all").alias("value")))).otherwise(F.array(F.struct("role", "value")))
    return kept.select("file", "row", F.inline(more))


def aligned(source: DataFrame, others: dict[str, DataFrame], number: str, at: str) -> DataFrame:
    """Rows of a table with those of other tables that have the same row number, as structs; numbers that are none go, the last row of a number counts."""

    def numbered(t: DataFrame) -> DataFrame:
        rest = [c for c in t.columns if c not in (number, at)]
        return row_numbers(t, number).groupBy(number).agg(F.max_by(F.struct(*rest), at).alias("_r"))

    out = numbered(source).select(number, "_r.*")
    for name, t in others.items():
        out = out.join(numbered(t).withColumnRenamed("_r", name).hint("merge"), number, "left")
    return out


def row_numbers(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose number is one; others go."""
    return rows.withColumn(column, F.trim(string(column)).try_cast("bigint")).where(F.col(column).isNotNull())


def source_records(queries: DataFrame, key: str, query: str, records: DataFrame, given: DataFrame, pattern: str = rules.AGRICULTURE_QUERY) -> DataFrame:
    """(key, ord, name, url, purpose, fetch) of each query: core sources, those of its domain, and web addresses that its user gives, each once.

    records: (ord, kind, name, url, purpose, fetch), few rows, of kind ``core``, or ``domain`` for queries that fit the
    pattern; given: (key, at, url). The first of URLs that differ in case and end slashes counts.
    """
    return source_lists(queries, key, query, records, given, pattern).select(key, F.inline("sources"))


def source_lists(queries: DataFrame, key: str, query: str, records: DataFrame, given: DataFrame, pattern: str = rules.AGRICULTURE_QUERY) -> DataFrame:
    """(key, sources): the same as one array for each query, in order.

    Fixed sources are two lists, one for each answer to whether a query is of the domain; only what users give moves,
    and the URLs of a query are compared in its row.
    """
    fields = ("ord", "name", "url", "purpose", "fetch")
    fixed = records.limit(SMALL_ROWS).withColumn("ord", F.col("ord").cast("long")).withColumn("_u", normal_url("url"))
    one = F.struct(*fields, "_u")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, one)))
    lists = fixed.agg(of(F.col("kind") == "core").alias("_core"), of(F.lit(True)).alias("_all"))  # one row
    asked = queries.select(key, F.col(query).rlike(f"(?i){pattern}").alias("_domain"))
    own = given.withColumn("url", F.trim(string("url"))).where(F.col("url").rlike("^https?://")).select(key, F.col("at").cast("long").alias("at"), "url")
    said = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "url", normal_url("url").alias("_u")))).alias("_own"))  # of one user

    def told(x: Column) -> Column:
        name = F.concat(F.lit("用户补充数据源 "), x["at"].cast("string"))
        return F.struct((x["at"] + GIVEN_FROM).alias("ord"), name.alias("name"), x["url"].alias("url"), F.lit("用户指定的候选专家与公开信息补充来源").alias("purpose"), F.lit(True).alias("fetch"), x["_u"].alias("_u"))

    # queries that share a key share their sources
    every = asked.groupBy(key).agg(F.coalesce(F.bool_or("_domain"), F.lit(False)).alias("_domain"))
    joined = every.join(said.hint("merge"), key, "full_outer").join(F.broadcast(lists))
    least = F.when(F.col("_domain").isNull(), F.slice("_core", 1, 0)).when(F.col("_domain"), F.col("_all")).otherwise(F.col("_core"))
    both = joined.select(key, F.concat(least, F.coalesce(F.transform("_own", told), F.slice("_core", 1, 0))).alias("_both"))
    urls = both.withColumn("_urls", F.transform("_both", lambda x: x["_u"]))
    first = F.filter("_both", lambda x, k: F.array_position("_urls", x["_u"]) == k + 1)
    return urls.select(key, F.transform(first, lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("sources"))


def source_list(*tables: DataFrame) -> DataFrame:
    """(url, ord) of several lists: one row for each URL that differs in more than case and end slashes, the first counts."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    key = normal_url("url")
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where("_rn = 1").drop("_rn")


def search(docs: DataFrame, text: str, phrase: str, by: Column, order: Column, n: int) -> DataFrame:
    """The ``n`` documents that hold a phrase, or where none does all its words, with the greatest numbers first; adds ``place``."""
    low, whole = F.lower(string(text)), phrase.lower().strip()
    every = docs.where(reduce(lambda a, w: a & F.contains(low, F.lit(w)), whole.split(), F.lit(whole != ""))).withColumn("_whole", F.contains(low, F.lit(whole)))
    any_ = every.agg(F.coalesce(F.bool_or("_whole"), F.lit(False)).alias("_any"))  # one row
    fits = every.join(F.broadcast(any_)).where(F.col("_whole") | ~F.col("_any")).drop("_whole", "_any")
    best = fits.orderBy(by.desc(), order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(by.desc(), order)))


def capped_texts(docs: DataFrame, source: str, key: str, text: str, per_file: int = 50_000, files: int = 10, total: int | None = None) -> DataFrame:
    """Cleaned texts of each source: so many characters a file, so many files, and a running total if given."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(string(text), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    by = Window.partitionBy(source).orderBy(key)
    rows = docs.select(source, key, F.left(clean, F.lit(per_file)).alias("text")).withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= files)
    if total is not None:
        before = F.coalesce(F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_left", F.lit(total) - before).where("_left > 0").withColumn("text", F.expr("left(text, _left)")).drop("_left")
    return rows.drop("_rn")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each sheet; an empty table keeps its schema."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


MANIFEST = "run string, at long, name string, path string"


def write_run(tables: dict[str, DataFrame], folder: str) -> str:
    """Several tables as one commit: all under a folder of their own, and a manifest that names them at last.

    Readers follow the manifest, so what a broken run has written is never read.
    """
    folder, run = folder.rstrip("/"), uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    at = time.time_ns()
    spark.createDataFrame([(run, at, name, f"{run}/{name}") for name in tables], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return run


def read_run(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a run, of the last one unless it is named; none if no run is complete."""
    try:
        listed = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if run is None:
        run = (listed.agg(F.max_by("run", F.struct("at", "run"))).first() or [None])[0]
    rows = listed.where(F.col("run") == run).select("name", "path").collect()  # a few names
    return {r["name"]: spark.read.parquet(f"{folder.rstrip('/')}/{r.path}") for r in rows}
