"""Odd rows on which a query and its SQL, or a smaller and the whole job, would differ."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rosterlake.operators import joins, match
from rosterlake.sources import tables
from test_queries import plain

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL on small tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return QUERIES[name](spark, str(folder)).toPandas(), con.sql(SQL[name]).df()


def test_glossary_ends_words_in_all_scripts(spark, tmp_path):
    texts = ["éaward awardé award", "award award award", "Award ;　x : y z", None, "教授award", " the  la  un ", "co-authoŕ coauthor_ COAUTHOR", "director\ndirector"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got, expected = both(spark, tmp_path, "glossary", documents=docs)
    assert len(got) == len(texts) and plain(got) == plain(expected)


def test_survival_items_of_whole_texts(spark, tmp_path):
    texts = ["No one. Here the and more; " + "x. " * 400, "x" * 9000 + " . Late: the and now.", "Nobody das gut und Ende.", "quiet", None]
    docs = pd.DataFrame({"doc_id": [5, 14, 23, 32, 41], "text": texts, "lang": "en", "source": "a", "n_chars": 1})  # nothing is planted in the last sentence
    got, expected = both(spark, tmp_path, "survival_items", documents=docs)
    assert sorted(got["pos"]) == [5, 14, 23, 32] and plain(got) == plain(expected)
    assert dict(zip(got["pos"], got["snippet"], strict=True))[5] == "Here That le Thin died more;"


def test_candidate_top1_of_hot_values(spark, tmp_path):
    # one nation, many equal balances on either side, ties between the next lower and the next higher one
    customers = pd.DataFrame({"c_custkey": range(1, 20_001), "c_nationkey": 1, "c_acctbal": [round((k * 37 % 400) * 2.02 - 99.99, 2) for k in range(20_000)]})
    customers.loc[[7, 8], "c_nationkey"] = 2
    customers.loc[8, "c_acctbal"] = customers.loc[7, "c_acctbal"]
    values = [-999.99, -99.99, -98.98, 0.0, 1.01, 707.77, 9999.99, 706.01]
    suppliers = pd.DataFrame({"s_suppkey": range(1, 4_001), "s_nationkey": [2 if k % 50 == 0 else 3 if k % 51 == 0 else 1 for k in range(4_000)], "s_acctbal": [values[k % 8] for k in range(4_000)]})
    got, expected = both(spark, tmp_path, "candidate_top1", customer=customers, supplier=suppliers)
    assert len(got) and plain(got) == plain(expected)


def test_works_of_odd_authors(spark):
    def entry(author, country="CN", place="middle"):
        return (author, author, place, [("x", country)])

    works = spark.createDataFrame([(1, "t", 2020, 9, [entry(None), entry("a", "3"), entry("a"), entry("b", "US", "last")]), (2, "t", 2020, None, [entry("b", "US"), entry("a")]), (3, "t", 2020, 5, None), (4, "t", 2020, 5, [entry("c", None), entry("d", "3")])],
        "id int, title string, year int, cited_by_count int, authorships array<struct<author_id: string, name: string, position: string, institutions: array<struct<name: string, country: string>>>>")
    got = match.first_authors(works, [F.desc("cited_by_count"), F.asc("id")], 16, ("3", "7")).collect()
    assert [(r.author_id, r.id, r.pos) for r in got] == [("a", 1, 2), ("b", 1, 3), ("c", 4, 0)]
    got = match.collaborations(works, top=1).orderBy("author_id").collect()
    assert [(r.author_id, r.place, r.id, r.partners) for r in got] == [("a", 1, 1, 1), ("b", 1, 1, 2)]


def test_spread_by_rows(spark):
    rows = spark.range(1000)
    assert joins.spread(rows, "id", most=10).rdd.getNumPartitions() == 100
    assert joins.spread(rows, "id", most=10).distinct().count() == 1000


def test_source_lists_of_odd_queries(spark):
    records = spark.createDataFrame([(1, "core", "A", "http://a.org/", "p", True), (2, "domain", "B", "http://b.org", "p", False), (3, "core", "A2", "HTTP://A.ORG", "p", True)], "ord int, kind string, name string, url string, purpose string, fetch boolean")
    queries = spark.createDataFrame([(1, "crop science"), (2, "physics"), (3, None)], "id int, q string")
    given = spark.createDataFrame([(1, 2, " http://B.org/ "), (2, 1, "http://B.org/"), (2, 2, "http://b.org"), (2, 3, None), (3, 1, "none"), (9, 1, "http://c.org")], "id int, at int, url string")
    got = sorted((r.id, r.ord, r.url) for r in tables.source_records(queries, "id", "q", records, given).collect())
    assert got == [(1, 1, "http://a.org/"), (1, 2, "http://b.org"), (2, 1, "http://a.org/"), (2, 1000001, "http://B.org/"), (3, 1, "http://a.org/"), (9, 1000001, "http://c.org")]
    assert {r.id: len(r.sources) for r in tables.source_lists(queries, "id", "q", records, given).collect()} == {1: 2, 2: 2, 3: 1, 9: 1}


def test_first_hit_by_words(spark, tmp_path):
    texts = ["a. b;" * 50 + " see menu the login. Then los one is, the other is here and more", "x" * 200 + " the end\nof it | the | x. Nobody les autres. Not the last one", "No word. None", None, "short the x", " the hit at once in this one"]
    docs = pd.DataFrame({"doc_id": [3, 2, 1, 4, 5, 6], "text": texts, "source": ["a", "b", "b", "a", "c", "c"]})
    got, expected = both(spark, tmp_path, "segment_hits", documents=docs)
    assert len(got) == 3 and plain(got) == plain(expected)


def test_chunk_budget_of_repeated_and_unnamed_rows(spark, tmp_path):
    rows = [(1, "the and que " * 200, "a"), (1, "the and que " * 200, "a"), (2, "the line\nthe line\nand more", "a"), (2, "quiet\n\nthe third", "a"), (3, "xxx\nyyy", "b"), (4, "the unnamed\nthe other and", None), (5, "zzz", None), (6, "thing ing tion " * 900, "c"), (7, None, "c")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    got = QUERIES["chunk_budget"](spark, str(tmp_path)) if docs.to_parquet(f"{tmp_path}/documents.parquet") is None else None
    got = sorted((str(r.source), r.doc_id, r.chunk_no, r.score) for r in got.collect())
    assert got.count(("a", 1, 0, 12)) == 1 and ("None", 4, 1, 8) in got and got.count(("None", 4, 0, 4)) == 1 and not any(r[1] == 5 for r in got)
    assert ("b", 3, 0, 0) in got and ("b", 3, 1, 0) in got and len(got) == len(set(got))
