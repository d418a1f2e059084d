"""The queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import neighbours

    return neighbours(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, scores, train

    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(docs, table(spark, sf_dir, "labels").where(fold != 2))
    scored = scores(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_records, write_pages

    folder = archive_folder(spark)
    found = read_records(write_pages(table(spark, sf_dir, "pages"), folder), folder, with_payload=False)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1).try_cast("long")
    refers_to = F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", refers_to)


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("firsts").alias("first_doc_ids"))


def planted_period(doc: int | None, n: int):
    """The places of the words that op11 looks at: in a tenth of the texts, by their id, the end repeats its beginning."""
    import zlib

    import numpy as np

    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import longest, periodic_runs

    found = periodic_runs(table(spark, sf_dir, "documents"), changed=planted_period).withColumn("best", longest())
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *best, milli, "runs_sha256", "collapsed_sha256", "n_words")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    found, _ = align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return found.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .postings import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0, n=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_merkle_fingerprints, op3_source_mixing, op4_token_counts, op5_toxicity, op6_simhash_groups, op7_itq_links, op8_warc, op9_kneser_ney_quality, op10_repeated_passages, op11_periodic_runs, op12_token_alignment, op13_nearest_neighbours, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracle_sql()
