"""A training corpus from documents: toxic texts go, one of each near-duplicate group stays, repeated passages
are cut, sources are mixed to target weights, and what is left is packed into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. Stages but the
last return the columns of ``documents``.

Null and empty texts are clean, are one near-duplicate class with nothing else, repeat nothing and are packed as
one token. Rows without an id are scored, are never dropped as copies, keep their passages and are drawn by a
hash of their text. Rows that share an id are told apart by their text, and each text is in a group of its
own or with what is like it. Without labels of both classes nothing is toxic; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import shared_dir
from rosterlake.llm.mixing import chosen
from rosterlake.llm.packing import pack, token_pieces
from rosterlake.llm.registry import table, tokenizer_file
from rosterlake.llm.similar import one_of_similar
from rosterlake.llm.suffix_dedup import repeated_passages, without_repeats
from rosterlake.llm.toxicity import train, without_toxic

#: SQL can express neither the fit nor the packing; the tests compare every stage with a plain version.
ORACLE_SQL = None
TOKENS_KEPT = 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group that shingle similarities of 0.8 and more connect."""
    return one_of_similar(docs, shingle=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages are cut out; a text of which nothing is left goes."""
    cut = without_repeats(docs, repeated_passages(docs), drop_emptied=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen(docs, budget=TOKENS_KEPT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_file("word_bpe_49k.json"), cache=100_000))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", passages), ("source_mixing", mixing), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
