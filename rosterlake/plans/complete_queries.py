"""Queries of table completion: documents as rows, labels as evidence and proposals, page addresses as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import names, text
from rosterlake.operators import complete, evidence, report, score, select

from .book import Tables, query

CELLS_SQL = """j AS (SELECT d.doc_id, d.lang, d.source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cells AS (SELECT doc_id, 'lang' AS "column", lang AS value FROM j UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 4 = 0 THEN '暂无' ELSE source END FROM j
 UNION ALL SELECT doc_id, 'quality', CASE WHEN doc_id % 2 = 0 THEN coalesce(CAST(quality AS VARCHAR), '-') ELSE '' END FROM j UNION ALL SELECT doc_id, 'toxic', '' FROM j),
blank AS (SELECT * FROM cells WHERE lower(trim(value)) IN ('', '-', '--', '/', '暂无', '暂无公开信息', '未知', '不详', '待补充', 'nan', 'none', 'null')),
given AS (SELECT doc_id, 'quality' AS "column", CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'lang', 'xx' FROM labels)"""


def joined(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")


def cells(t: Tables) -> DataFrame:
    j = joined(t).withColumns({
        "source": F.when(F.col("doc_id") % 4 == 0, "暂无").otherwise(F.col("source")),
        "quality": F.when(F.col("doc_id") % 2 == 0, F.coalesce(F.col("quality").cast("string"), F.lit("-"))).otherwise(""), "toxic": F.lit(""),
    })
    return j.unpivot("doc_id", ["lang", "source", "quality", "toxic"], "column", "value")


def given(t: Tables) -> DataFrame:
    w = t.labels.withColumns({"quality": F.col("quality").cast("string"), "toxic": F.when(F.col("doc_id") % 3 != 0, F.col("toxic").cast("string")), "lang": F.lit("xx")})
    return w.unpivot("doc_id", ["quality", "toxic", "lang"], "column", "value").where("value is not null")


@query(f"""WITH {CELLS_SQL}, f AS (SELECT c.doc_id, c."column", c.value, b.doc_id IS NOT NULL AND g.value IS NOT NULL AS filled, g.value AS v FROM cells c LEFT JOIN blank b ON c.doc_id = b.doc_id AND c."column" = b."column" LEFT JOIN given g ON c.doc_id = g.doc_id AND c."column" = g."column")
SELECT doc_id, "column", CASE WHEN filled THEN v ELSE value END AS value, filled FROM f""")
def blank_only_fill(t: Tables) -> DataFrame:
    return complete.write_back(cells(t), given(t), "doc_id")


@query(f"""WITH {CELLS_SQL}, f AS (SELECT c.doc_id, c."column", b.doc_id IS NOT NULL AND g.value IS NOT NULL AS filled FROM cells c LEFT JOIN blank b ON c.doc_id = b.doc_id AND c."column" = b."column" LEFT JOIN given g ON c.doc_id = g.doc_id AND c."column" = g."column")
SELECT doc_id, count(CASE WHEN filled THEN 1 END) AS n_filled, coalesce(string_agg(CASE WHEN filled THEN "column" END, '、' ORDER BY "column"), '') AS columns, CASE WHEN count(CASE WHEN filled THEN 1 END) > 0 THEN 'completed' ELSE 'unchanged' END AS note FROM f GROUP BY 1""")
def completion_audit(t: Tables) -> DataFrame:
    return complete.audit(complete.write_back(cells(t), given(t), "doc_id"), "doc_id")


@query(f"""WITH {CELLS_SQL} SELECT doc_id, bool_or("column" IN ('quality', 'toxic')) AS labels, bool_or("column" = 'source') AS origin FROM blank GROUP BY 1""")
def missing_groups(t: Tables) -> DataFrame:
    return complete.missing_groups(cells(t).withColumnRenamed("column", "header"), "doc_id", {"labels": "quality|toxic", "origin": "source"})


@query(f"""WITH {CELLS_SQL} SELECT b.doc_id, b."column", CASE b."column" WHEN 'quality' THEN coalesce(CAST(l.quality AS VARCHAR), d.lang) WHEN 'toxic' THEN CAST(l.toxic AS VARCHAR) ELSE d.lang END AS value
FROM blank b JOIN documents d ON b.doc_id = d.doc_id LEFT JOIN labels l ON b.doc_id = l.doc_id WHERE CASE b."column" WHEN 'quality' THEN coalesce(CAST(l.quality AS VARCHAR), d.lang) WHEN 'toxic' THEN CAST(l.toxic AS VARCHAR) ELSE d.lang END IS NOT NULL""")
def direct_fill(t: Tables) -> DataFrame:
    blank = cells(t).where(text.cell_placeholder("value")).select("doc_id", "column")
    roles = t.spark.createDataFrame([("quality", "quality", 0), ("quality", "lang", 1), ("toxic", "toxic", 0), ("source", "lang", 0)], "column string, field string, prio int")
    facts = joined(t).withColumns({"quality": F.col("quality").cast("string"), "toxic": F.col("toxic").cast("string")}).unpivot("doc_id", ["quality", "toxic", "lang"], "field", "value")
    return complete.direct_proposals(blank, facts, roles, "doc_id")


@query(f"""WITH {CELLS_SQL}, r AS (SELECT doc_id, "column", value, 0 AS prio FROM given WHERE "column" = 'quality' AND doc_id % 2 = 0 UNION ALL SELECT doc_id, "column", 'g' || value, 1 FROM given UNION ALL SELECT doc_id, 'source', 'late', 2 FROM labels),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "column" ORDER BY prio, value) AS rn FROM r) SELECT doc_id, "column", value, prio FROM m WHERE rn = 1""")
def proposal_merge(t: Tables) -> DataFrame:
    first = given(t).where("column = 'quality' and doc_id % 2 = 0")
    second = given(t).withColumn("value", F.concat(F.lit("g"), "value"))
    third = t.labels.select("doc_id", F.lit("source").alias("column"), F.lit("late").alias("value"))
    return complete.merge_proposals("doc_id", first, second, third)


@query(f"""WITH {CELLS_SQL}, a AS (SELECT * FROM given WHERE "column" <> 'lang'), c AS (SELECT doc_id, 'quality' AS "column", CASE WHEN doc_id % 4 = 0 THEN '-' ELSE 'fixed' END AS v FROM documents WHERE doc_id % 2 = 0)
SELECT a.doc_id, a."column", CASE WHEN c.v = 'fixed' THEN c.v ELSE a.value END AS value FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a."column" = c."column" """)
def correction_overlay(t: Tables) -> DataFrame:
    new = t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("quality").alias("column"), F.when(F.col("doc_id") % 4 == 0, "-").otherwise("fixed").alias("value"))
    return complete.correct(given(t).where("column <> 'lang'"), new, "doc_id")


@query("""SELECT doc_id, 'quality ' || quality || ', toxic ' || toxic AS value FROM labels WHERE doc_id % 3 <> 0""")
def derived_fields(t: Tables) -> DataFrame:
    return complete.derived_sentences(given(t), "doc_id", "quality %s, toxic %s", ["quality", "toxic"])


GATE_SQL = """p AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'h_raw' WHEN 1 THEN 'org' WHEN 2 THEN 'gender' ELSE 'basis' END AS role, d.doc_id, d.doc_id % 8 < 4 AS locked, quality, g.url, d.doc_id % 5 AS tail FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages g ON d.doc_id = g.page_id),
c AS (SELECT *, CASE tail WHEN 0 THEN 'edu' WHEN 1 THEN 'org' WHEN 2 THEN 'com' WHEN 3 THEN 'low' ELSE 'none' END AS kind FROM p)"""


@query(f"""WITH {GATE_SQL} SELECT doc_id, role, CASE WHEN kind IN ('low', 'none') THEN 'no source that counts' WHEN role IN ('h_raw', 'basis') AND NOT locked THEN 'identity is not locked'
WHEN role = 'org' AND NOT locked AND kind = 'com' THEN 'narrative without an authority or verified page' WHEN role = 'gender' AND kind = 'com' THEN 'sensitive value without authorities' WHEN role = 'gender' AND NOT coalesce(quality = 1, false) THEN 'sensitive value is not stated'
WHEN role = 'basis' AND kind = 'com' THEN 'title without an authority' END AS reason FROM c""")
def field_gate(t: Tables) -> DataFrame:
    rows = joined(t)
    role = F.element_at(F.array(F.lit("h_raw"), F.lit("org"), F.lit("gender"), F.lit("basis")), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.element_at(F.array(*[F.lit(f"https://{h}/a") for h in ("a.edu", "b.org", "c.com", "x.com", "none.edu")]), (F.col("doc_id") % 5 + 1).cast("int"))
    proposed = rows.select("doc_id", role.alias("role"), F.lit("因公开证据显示其具有重要头衔奖项或行业组织身份入选").alias("value"), F.array(url, url).alias("source_urls"), F.array(*[F.lit(f"https://{h}/a") for h in ("a.edu", "b.org", "c.com", "x.com")]).alias("known_urls"), (F.col("doc_id") % 8 < 4).alias("locked"), F.lit("").alias("homepage"), F.lit(False).alias("homepage_ok"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("stated"))
    return complete.gate(proposed).select("doc_id", "role", "reason")


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 30 OR regexp_matches(text, '(?i)(?:\\.\\.\\.|…)$|error sending|connection error|operation timed out|search results?') OR trim(text) = '' AS low FROM documents""")
def low_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", complete.low_quality(F.lit("org"), "text").alias("low"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '未通过' WHEN c_custkey % 3 > 0 AND (s_acctbal > 0 OR c_custkey % 2 = 0) THEN '已锁定' ELSE '待复核' END AS lock FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def identity_lock(t: Tables) -> DataFrame:
    pairs = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"))
    even = F.col("c_custkey") % 2 == 0
    return pairs.select("c_custkey", complete.identity_lock(F.col("c_acctbal") >= 0, F.col("c_custkey") % 3, F.col("s_acctbal") > 0, even, even).alias("lock"))


@query("""SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage_check(t: Tables) -> DataFrame:
    return complete.coverage(t.documents, t.labels, "doc_id")


@query("""WITH j AS (SELECT d.doc_id, quality, toxic, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT 'quality' AS field, count(*) AS before FROM j WHERE doc_id % 2 = 0 OR quality IS NULL UNION ALL SELECT 'toxic', count(*) FROM j),
a AS (SELECT 'quality' AS field, count(*) AS after FROM j WHERE quality IS NULL UNION ALL SELECT 'toxic', count(*) FROM j WHERE toxic IS NULL)
SELECT b.field, before, after, before - after AS improved FROM b JOIN a ON a.field = b.field""")
def improvement_counts(t: Tables) -> DataFrame:
    j = joined(t)
    missing = lambda checks: j.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("field"))
    before = missing({"quality": (F.col("doc_id") % 2 == 0) | F.col("quality").isNull(), "toxic": F.lit(True)})
    return report.counts_before_after(before, missing({"quality": F.col("quality").isNull(), "toxic": F.col("toxic").isNull()}), "field")


@query(f"""WITH {CELLS_SQL}, b AS (SELECT g.* FROM given g JOIN blank b ON b.doc_id = g.doc_id AND b."column" = g."column") SELECT 'accepted' AS counter, "column" AS field, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'proposed', "column", count(*) FROM given GROUP BY 2
UNION ALL SELECT 'missing', "column", count(*) FROM blank GROUP BY 2 UNION ALL SELECT 'left', k."column", count(*) FROM blank k LEFT JOIN b ON b.doc_id = k.doc_id AND b."column" = k."column" WHERE b.doc_id IS NULL GROUP BY 2""")
def accepted_counts(t: Tables) -> DataFrame:
    """Cells by column: missing, proposed, accepted, and still missing."""
    blank, new = cells(t).where(text.cell_placeholder("value")), given(t)
    valid = complete.valid_proposals(new, blank, "doc_id")
    left = blank.join(valid.select("doc_id", "column").hint("merge"), ["doc_id", "column"], "left_anti")
    return report.counters({"missing": blank, "proposed": new, "accepted": valid, "left": left}, "column")


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://a.org' ELSE 'a.org' END AS homepage, CASE WHEN doc_id % 3 = 0 THEN 'a@b.org' ELSE 'none at all' END AS contact, CASE WHEN doc_id % 5 = 0 THEN '待核验' ELSE lang END AS org, CASE WHEN quality = 1 THEN '约 85' ELSE '0' END AS h FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 1 THEN 'homepage' END, CASE WHEN doc_id % 3 > 0 THEN 'contact' END, 'interests', CASE WHEN doc_id % 5 = 0 THEN 'org' END, 'position', 'career', 'education', 'achievements', 'collab', 'basis', CASE WHEN h = '0' THEN 'h_raw' END, 'i10_raw', 'citations_raw'], lambda x: x IS NOT NULL), ',') AS missing FROM b""")
def profile_gaps(t: Tables) -> DataFrame:
    """The missing fields of profiles by the check of each field."""
    k = F.col("doc_id")
    b = t.documents.join(t.labels, "doc_id", "left")
    given_ = {"homepage": F.when(k % 2 == 0, "https://a.org").otherwise("a.org"), "contact": F.when(k % 3 == 0, "a@b.org").otherwise("none at all"), "org": F.when(k % 5 == 0, "待核验").otherwise(F.col("lang")), "h_raw": F.when(F.col("quality") == 1, "约 85").otherwise("0")}
    checks = score.profile_checks()
    rows = b.select("doc_id", *[given_.get(c, F.lit(None).cast("string")).alias(c) for c in checks])
    return rows.select("doc_id", F.array_join(score.missing_fields(checks), ",").alias("missing"))


@query("""SELECT d.doc_id, coalesce('lang=' || lang, '') || ';source=' || source || ';text=' || CASE WHEN length(x) > 30 THEN rtrim(left(x, 30)) || '...' ELSE x END AS fields FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) d""")
def payload_map(t: Tables) -> DataFrame:
    m = t.documents.select("doc_id", complete.payload({"lang": 10, "source": 20, "text": 30}).alias("m"))
    return m.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@query("""SELECT doc_id, regexp_matches(lower(text), 'ther|ouest') AS stated FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 2 = 1""")
def cited_support(t: Tables) -> DataFrame:
    items = F.array(F.struct(F.lit("http://a").alias("url"), F.col("text").alias("text")))
    rows = t.documents.select("doc_id", items.alias("items"), F.array(F.when(F.col("doc_id") % 2 == 0, "http://a").otherwise("http://b")).alias("urls"))
    return rows.select("doc_id", complete.stated_in_cited("items", "urls", F.lit("ther|ouest")).alias("stated"))


@query("""SELECT doc_id, contains(lower(text), 'anti') OR contains(lower(text), lang || 'er') AS context FROM documents""")
def token_context(t: Tables) -> DataFrame:
    """Documents that hold a token of an institution's name, or of a query."""
    institution = names.institution_tokens(F.lit("The University of Anti"))
    return t.documents.select("doc_id", evidence.identity_context("text", institution, F.array(F.concat("lang", F.lit("er")))).alias("context"))


@query("""WITH j AS (SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), q AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM j WHERE quality IS NULL),
s AS (SELECT j.doc_id, n_chars, toxic, CASE WHEN q.rn <= 30 THEN 'step1' END AS a FROM j LEFT JOIN q ON j.doc_id = q.doc_id), r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM s WHERE toxic IS NULL AND a IS NULL)
SELECT s.doc_id, coalesce(a, CASE WHEN r.rn <= 20 THEN 'step2' END, 'none') AS step FROM s LEFT JOIN r ON s.doc_id = r.doc_id""")
def capped_steps(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").withColumn("row_id", F.col("doc_id"))
    order = [F.desc("n_chars"), F.asc("doc_id")]
    one = select.capped_queue(rows, F.col("quality").isNull(), order, 30).withColumn("step", F.when(F.col("queued"), "step1")).drop("queued")
    two = select.capped_queue(one, F.col("toxic").isNull() & F.col("step").isNull(), order, 20)
    return two.select("doc_id", F.coalesce("step", F.when(F.col("queued"), "step2"), F.lit("none")).alias("step"))
