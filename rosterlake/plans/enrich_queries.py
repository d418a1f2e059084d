"""Queries of sources, homepages, back-fill, collaboration, claims and delivered completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import names, rules, text, urls
from rosterlake.operators import complete, extract, filters, match, pages
from rosterlake.sources import tables

from .book import Tables, new_folder, query
from .detail_queries import AUDIT_SQL, ITEMS_SQL, cells, first_sql, items, parts_sql, proposals, shown
from .join_queries import WORKS_SQL, works
from .profile_queries import METRICS_SQL, customer_metrics


@query("""SELECT 'b' || (c_custkey % 3) AS batch_id, CASE WHEN c_custkey % 3 = 1 THEN 'raw' ELSE 'checked' END AS kind, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 AND (c_custkey % 3 = 1 OR c_custkey % 4 <> 0) GROUP BY 1, 2""")
def preferred_batches(t: Tables) -> DataFrame:
    """Three batches, of which two have a checked table with fewer rows beside the raw one."""
    folder = new_folder(t, "batches")
    named = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_name")).alias("name"))
    for rest in range(3):
        part = named.where(F.col("c_custkey") % 3 == rest)
        part.withColumn("kind", F.lit("raw")).write.parquet(f"{folder}/b{rest}/delivery")
        if rest != 1:
            part.where(F.col("c_custkey") % 4 != 0).withColumn("kind", F.lit("checked")).write.parquet(f"{folder}/b{rest}/validation")
    schema = T.StructType([*named.schema.fields, T.StructField("kind", T.StringType())])
    return tables.preferred_batches(t.spark, folder, schema).groupBy("batch_id", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT unnest({[r[2] for r in rules.SOURCE_RECORDS]}) AS url, unnest({[r[0] for r in rules.SOURCE_RECORDS]}) AS kind, unnest(range(1, {len(rules.SOURCE_RECORDS) + 1})) AS ord, unnest({[bool(r[4]) for r in rules.SOURCE_RECORDS]}) AS fetched),
q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Crop science' ELSE 'physics' END AS q, 'https://a.org/' || c_custkey AS own FROM customer),
u AS (SELECT c_custkey, ord, url, fetched FROM q, r WHERE kind = 'core' OR q = 'Crop science' UNION ALL SELECT c_custkey, 1000001, own, true FROM q UNION ALL SELECT c_custkey, 1000004, 'http://b.org', true FROM q)
SELECT c_custkey, count(*) AS n, count(CASE WHEN fetched THEN 1 END) AS n_fetched, string_agg(url, ' ' ORDER BY ord) AS sources FROM u GROUP BY 1""")
def source_records(t: Tables) -> DataFrame:
    """Sources of each query: fixed ones, those of its field, and what its user gives, twice, in another spelling and without an address."""
    records = t.spark.createDataFrame([(k, *r) for k, r in enumerate(rules.SOURCE_RECORDS, 1)], "ord int, kind string, name string, url string, purpose string, fetch boolean")
    own = F.concat(F.lit("https://a.org/"), F.col("c_custkey").cast("string"))
    asked = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Crop science").otherwise("physics").alias("q"))
    given = t.customer.select("c_custkey", F.posexplode(F.array(own, F.concat(F.lit(" "), F.upper(F.lit("https")), F.substring(own, 6, 100), F.lit("/")), F.lit("no address"), F.lit("http://b.org"))).alias("at", "url"))
    got = tables.source_lists(asked, "c_custkey", "q", records, given.withColumn("at", F.col("at") + 1))
    fetched, listed = F.size(F.filter("sources", lambda x: x["fetch"])), F.transform("sources", lambda x: x["url"])
    return got.select("c_custkey", F.size("sources").cast("bigint").alias("n"), fetched.cast("bigint").alias("n_fetched"), F.array_join(listed, " ").alias("sources"))


CLEAN_SQL = "html"
for _tag in ("script", "style", "noscript"):
    CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '(?s)<!--.*?-->', ' ', 'g')"
CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '(?i)</?(?:p|div|br|li|tr|h[1-6]|section|article)\\b[^>]*>', chr(10), 'g')"
CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '(?s)<[^>]+>', ' ', 'g')"
for _name, _char in text.ENTITIES:
    CLEAN_SQL = f"""replace({CLEAN_SQL}, '{_name}', '{_char.replace("'", "''")}')"""
CLEAN_SQL = f"regexp_replace(regexp_replace(regexp_replace({CLEAN_SQL}, '[ \\t\\r\\f]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {CLEAN_SQL} AS text FROM pages")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_text("html").alias("text"))


PAGES_SQL = f"""u AS (SELECT page_id, url, {CLEAN_SQL} AS x, regexp_replace(lower(trim(url)), '/+$', '') AS k FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS rn FROM u),
p AS (SELECT k, page_id AS pid, x, CASE WHEN page_id % 7 = 0 THEN '500' ELSE '200' END AS status, CASE WHEN page_id % 11 = 0 THEN 'application/pdf' ELSE 'text/html' END AS type FROM f WHERE rn = 1 AND page_id % 13 <> 0),
o AS (SELECT k, page_id AS oid, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS y, CASE WHEN page_id % 4 = 0 THEN 'timeout' ELSE '' END AS error FROM f WHERE rn = 1 AND page_id % 2 = 0),
h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'thea ande' ELSE 'qqzz xxqq' END AS name, CASE WHEN page_id % 17 = 0 THEN 'none' WHEN page_id % 5 = 0 THEN 'http://shared.example.com' WHEN page_id % 2 = 0 THEN upper(url) || '/' ELSE url END AS homepage FROM pages),
j AS (SELECT h.*, p.*, o.y, o.error, o.oid FROM h LEFT JOIN p ON p.k = regexp_replace(lower(trim(homepage)), '/+$', '') LEFT JOIN o ON o.k = regexp_replace(lower(trim(homepage)), '/+$', '')),
w AS (SELECT *, contains(lower(left(x, 4000)), 'the') AND contains(lower(left(x, 4000)), 'and') AND page_id % 3 = 0 AS named, contains(lower(left(y, 6000)), 'the') AND contains(lower(left(y, 6000)), 'and') AND page_id % 3 = 0 AS named2 FROM j),
y AS (SELECT *, CASE WHEN x IS NULL OR status = '500' THEN 'HTTP访问失败: ' || coalesce(status, '') WHEN type = 'application/pdf' THEN 'HTTP返回不支持的内容类型: application/pdf' WHEN x = '' THEN 'HTTP页面未提取到有效正文' WHEN NOT named THEN 'HTTP页面正文未匹配专家姓名' ELSE '' END AS why FROM w)"""


@query(f"""WITH {PAGES_SQL.replace("'thea ande'", "'the and'")} SELECT page_id, CASE WHEN homepage = 'none' THEN '未尝试' WHEN why = '' THEN 'HTTP' WHEN oid IS NULL OR error <> '' THEN 'HTTP失败，OpenCLI未成功' ELSE 'OpenCLI' END AS method,
CASE WHEN homepage = 'none' THEN '缺少有效个人主页 URL' WHEN why = '' THEN '' WHEN oid IS NULL THEN why WHEN error <> '' THEN error WHEN y = '' THEN 'OpenCLI未提取到有效正文' WHEN NOT named2 THEN 'OpenCLI页面正文未匹配专家姓名' ELSE '' END AS failure,
CASE WHEN homepage <> 'none' AND why = '' THEN md5(left(x, 10000)) WHEN homepage <> 'none' AND oid IS NOT NULL AND error = '' AND named2 THEN md5(left(y, 16000)) END AS digest FROM y""")
def homepage_join(t: Tables) -> DataFrame:
    """People of pages, some of one page, some with another spelling of its URL: plain pages that name them, else rendered ones."""
    k = F.col("page_id")
    name = F.when(k % 3 == 0, "the and").otherwise("qqzz xxqq")
    homepage = F.when(k % 17 == 0, "none").when(k % 5 == 0, "http://shared.example.com").when(k % 2 == 0, F.concat(F.upper("url"), F.lit("/"))).otherwise(F.col("url"))
    people = t.pages.select("page_id", name.alias("name"), homepage.alias("homepage"))
    firsts = t.pages.withColumn("_u", urls.normal_url("url")).groupBy("_u").agg(F.min("page_id").alias("page_id")).select("page_id")
    first = t.pages.join(firsts.hint("merge"), "page_id", "left_semi")
    plain = first.where("page_id % 13 <> 0").select("url", k.alias("at"), "html", F.when(k % 7 == 0, 500).otherwise(200).alias("status"), F.when(k % 11 == 0, "application/pdf").otherwise("text/html").alias("content_type"))
    rendered = first.where("page_id % 2 = 0").select("url", k.alias("at"), text.html_text("html").alias("text"), F.when(k % 4 == 0, "timeout").alias("error"))
    got = pages.homepages(people, "page_id", "name", "homepage", plain, rendered, shared=20)
    return got.select("page_id", "method", "failure", F.md5("content").alias("digest"))


PROFILE_SQL = f"""{METRICS_SQL}, n AS (SELECT s_nationkey, count(*) * 10 AS nh, CAST(floor(sum(CAST(s_acctbal AS DECIMAL(18,2)))) AS BIGINT) * 50 AS nc, min(s_name) AS who, 'https://x.org/' || s_nationkey AS id FROM supplier GROUP BY 1),
j AS (SELECT m.*, nh, nc, who, id, nh IS NOT NULL AND NOT ((h >= 20 AND nh > 0 AND nh < h * 0.65) OR (h >= 20 AND nc > 0 AND nc < greatest(100.0, h * 30)) OR (h >= 10 AND nh > 0 AND nh <= 5 AND nc < 500)
 OR (citations >= 1000 AND nc > 0 AND nc < citations * 0.2) OR (h = 0 AND citations = 0 AND nh > 0 AND nh <= 2 AND nc < 100)) AS trusted FROM metrics m LEFT JOIN n ON c_nationkey = s_nationkey)"""
NUMBERS_SQL = "CASE WHEN t AND nh > 0 AND nh >= h THEN nh ELSE h END AS h, CASE WHEN t AND nc > 0 AND nc >= citations THEN nc ELSE citations END AS citations"


def matched_nations(t: Tables) -> DataFrame:
    total = F.floor(F.sum(F.col("s_acctbal").cast("decimal(18,2)"))).cast("bigint") * 50
    page = F.concat(F.lit("https://x.org/"), F.col("c_nationkey").cast("string"))
    return t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg((F.count("*") * 10).alias("nh"), total.alias("nc"), F.min("s_name").alias("who")).withColumn("id", page)


def trusted() -> F.Column:
    return F.col("nh").isNotNull() & filters.metric_trusted(F.col("h"), F.col("citations"), F.col("nh"), F.col("nc"))


@query(f"""WITH {PROFILE_SQL} SELECT c_custkey, {NUMBERS_SQL}, CASE WHEN t THEN who ELSE '' END AS oa_name, CASE WHEN t THEN id ELSE '' END AS oa_id, CASE WHEN t THEN 'http://own ' || id ELSE 'http://own' END AS sources FROM (SELECT *, coalesce(trusted, false) AS t FROM j)""")
def first_backfill(t: Tables) -> DataFrame:
    """Numbers, name, id and source of the first database; without a trusted match the fields are emptied."""
    rows = customer_metrics(t).withColumns({"oa_name": F.lit("before"), "oa_id": F.lit("before"), "sources": F.array(F.lit("http://own"))})
    got = match.backfill(rows, matched_nations(t), "c_nationkey", {"h": "nh", "citations": "nc"}, trusted(), {"oa_name": "who", "oa_id": "id"}, "sources", "id")
    return got.select("c_custkey", "h", "citations", "oa_name", "oa_id", F.array_join("sources", " ").alias("sources"))


@query(f"""WITH {PROFILE_SQL}, l AS (SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 0 END + CASE WHEN citations = 0 THEN 800 ELSE 0 END + least(h, 200) AS p FROM metrics) WHERE p > 0 ORDER BY p DESC, c_custkey DESC LIMIT 60)
SELECT c_custkey, {NUMBERS_SQL}, CASE WHEN t THEN who ELSE 'before' END AS s2_name FROM (SELECT j.*, coalesce(trusted, false) AND l.c_custkey IS NOT NULL AS t FROM j LEFT JOIN l ON j.c_custkey = l.c_custkey)""")
def second_backfill(t: Tables) -> DataFrame:
    """The second database, asked only for the rows that need it most; the others stay as they are."""
    rows = customer_metrics(t).withColumn("s2_name", F.lit("before"))
    points = F.when(F.col("c_custkey") % 3 == 0, 1000).otherwise(0) + F.when(F.col("citations") == 0, 800).otherwise(0) + F.least("h", F.lit(200))
    listed = match.priority_rows(rows, points, 60, F.col("c_custkey"))
    found = listed.select("c_custkey", "c_nationkey").join(matched_nations(t).hint("merge"), "c_nationkey").drop("c_nationkey")
    return match.backfill(rows, found, "c_custkey", {"h": "nh", "citations": "nc"}, trusted(), {"s2_name": "who"}, blank=False).select("c_custkey", "h", "citations", "s2_name")


LINES_SQL = f"""{WORKS_SQL}, me AS (SELECT author_id, id, cited, arg_min(position, ln) AS position, row_number() OVER (PARTITION BY author_id ORDER BY cited DESC, id) AS place FROM w GROUP BY 1, 2, 3),
q AS (SELECT m.author_id, m.id, m.place, m.position AS mp, m.cited, o.author_id AS partner, min(o.ln) AS ln, arg_min(o.position, o.ln) AS position FROM me m JOIN w o ON o.id = m.id AND o.author_id <> m.author_id AND o.country < 5 WHERE place <= 40 GROUP BY 1, 2, 3, 4, 5, 6),
r AS (SELECT *, row_number() OVER (PARTITION BY author_id, id ORDER BY ln, partner) AS nth FROM q),
p AS (SELECT author_id, id, place, mp, cited, count(*) AS partners, bool_or(position IN ('first', 'last')) AS ends, string_agg('s' || partner || '（x(CN)）', '、' ORDER BY nth) FILTER (WHERE nth <= 5) AS who FROM r GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, CASE WHEN (mp IN ('first', 'last') AND ends) OR (partners >= 2 AND cited >= 300) THEN '强合作' WHEN cited >= 100 OR partners >= 2 THEN '中合作' ELSE '弱合作' END AS strength FROM p)"""


def named_works(t: Tables) -> DataFrame:
    """Works whose suppliers of the first five nations have an institution in the country."""
    there = lambda a: F.transform(a["institutions"], lambda i: F.struct(i["name"].alias("name"), F.when(i["country"].cast("int") < 5, "CN").otherwise(i["country"]).alias("country")))
    people = F.transform("authorships", lambda a: F.struct(a["author_id"].alias("author_id"), F.concat(F.lit("s"), a["author_id"].cast("string")).alias("name"), a["position"].alias("position"), there(a).alias("institutions")))
    return works(t).select("id", F.concat(F.lit("Work "), F.col("id").cast("string")).alias("title"), F.lit(2020).alias("year"), "cited_by_count", people.alias("authorships"))


@query(f"WITH {LINES_SQL} SELECT author_id, id, strength, partners FROM k")
def collab_strength(t: Tables) -> DataFrame:
    found = match.collaborations(named_works(t))
    return found.select("author_id", "id", "strength", F.col("partners").cast("bigint").alias("partners"))


@query(f"""WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY place) AS rn FROM k), c AS (SELECT author_id, string_agg(strength || '：' || who || '；合作依据：《Work ' || id || '》（2020，OpenAlex，引用' || cited || '次）', '；' ORDER BY rn) AS collab FROM n WHERE rn <= 5 GROUP BY 1)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '北京大学 王某' WHEN collab IS NOT NULL THEN collab WHEN s_suppkey % 3 = 1 THEN '中国团队' END AS collab FROM supplier LEFT JOIN c ON s_suppkey = author_id""")
def collaboration_delivery(t: Tables) -> DataFrame:
    """Delivered text of an author's works with partners, where nothing definite is known yet."""
    texts = match.collaboration_texts(match.collaborations(named_works(t))).withColumnRenamed("author_id", "s_suppkey")
    known = F.when(F.col("s_suppkey") % 3 == 0, "北京大学 王某").when(F.col("s_suppkey") % 3 == 1, "中国团队")
    rows = t.supplier.select("s_suppkey", known.alias("collab"))
    return match.attach_if(rows, texts, ["s_suppkey"], ["collab"], extract.unproved_collaboration("collab")).select("s_suppkey", "collab")


def best_part_sql(part: tuple[int, str, int]) -> str:
    return f"WITH {ITEMS_SQL.replace('source AS k', 'CAST(doc_id AS VARCHAR) AS k')}, {first_sql(f'list_slice({parts_sql(chr(120), part, 8, 150)}, 1, 1)', 1)} SELECT * FROM found"


#: The words of posts and of institutions do not occur in the texts, so frequent words stand in for two of each.
TEXT_POSTS, TEXT_PLACES = (80, "prize|joined|" + rules.POSITION_PART[1], 80), (80, "china|royal|" + rules.INSTITUTION_PART[1], 80)


@query(best_part_sql(TEXT_POSTS))
def post_segments(t: Tables) -> DataFrame:
    """The first part of a sentence of each document that speaks of a post."""
    return shown(extract.first_part(items(t).withColumn("k", F.col("pos").cast("string")), "k", "pos", "title", "content", TEXT_POSTS))


@query(best_part_sql(TEXT_PLACES))
def institution_segments(t: Tables) -> DataFrame:
    return shown(extract.first_part(items(t).withColumn("k", F.col("pos").cast("string")), "k", "pos", "title", "content", TEXT_PLACES))


@query("""SELECT d.doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN quality = 1 THEN 'page ' || source WHEN toxic IS NOT NULL THEN 'search ' || source ELSE '' END AS org,
CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '暂无公开信息' WHEN 2 THEN 'has ' || lang ELSE 'x' END AS before, CASE WHEN quality IS NULL OR doc_id % 4 = 2 THEN CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '暂无公开信息' WHEN 2 THEN 'has ' || lang ELSE 'x' END
 WHEN doc_id % 4 IN (0, 1) THEN '个人主页成果线索：' || lang ELSE 'x；个人主页成果线索：' || lang END AS achievements FROM documents d LEFT JOIN labels l USING (doc_id)""")
def page_then_search(t: Tables) -> DataFrame:
    """Fields filled where they are missing, from pages before searches; achievements get what is new behind a label."""
    b = t.documents.join(t.labels, "doc_id", "left")
    k = F.col("doc_id")
    before = F.when(k % 4 == 0, "").when(k % 4 == 1, "暂无公开信息").when(k % 4 == 2, F.concat(F.lit("has "), "lang")).otherwise("x")
    rows = b.select("doc_id", F.when(k % 3 == 0, "own").otherwise("").alias("org"), before.alias("before"), F.when(F.col("quality").isNotNull(), F.col("lang")).alias("found"))
    page = b.where("quality = 1").select("doc_id", F.concat(F.lit("page "), "source").alias("org"))
    search = b.where("toxic is not null").select("doc_id", F.concat(F.lit("search "), "source").alias("org"))
    filled = extract.fill_missing(rows, "doc_id", [page, search], {"org": F.trim(text.string("org")) == ""})
    return filled.select("doc_id", "org", "before", extract.with_label(F.col("before"), "个人主页成果线索：", F.col("found")).alias("achievements"))


CLAIM_SQL = """d AS (SELECT doc_id, doc_id % 2 = 0 AS locked, doc_id % 3 > 0 AS fits, doc_id % 5 > 0 AS dated, doc_id % 7 > 0 AS two, doc_id % 11 > 0 AS claimed FROM documents),
s AS (SELECT *, 'died' || CASE WHEN dated THEN ' in 2019' ELSE '' END || ' https://a.edu/x, https://' || CASE WHEN two THEN 'b.gov' ELSE 'a.edu' END || '/y. https://c.com/z' AS said FROM d)"""


@query(f"""WITH {CLAIM_SQL} SELECT doc_id, CASE WHEN claimed AND NOT (locked AND fits AND dated AND two) THEN '待核验' WHEN claimed THEN '确认已故' ELSE '未执行' END AS "check", CASE WHEN claimed AND NOT (locked AND fits AND dated AND two) THEN '' ELSE 'dead' END AS status,
CASE WHEN claimed AND NOT (locked AND fits AND dated AND two) THEN '{rules.CLAIM_REFUSED}' || said ELSE said END AS said FROM s""")
def claim_gate(t: Tables) -> DataFrame:
    """Claims of a death that lack a lock, the institution, a date or a second official domain are open again."""
    k = F.col("doc_id")
    said = F.concat(F.lit("died"), F.when(k % 5 > 0, " in 2019").otherwise(""), F.lit(" https://a.edu/x, https://"), F.when(k % 7 > 0, "b.gov").otherwise("a.edu"), F.lit("/y. https://c.com/z"))
    rows = t.documents.select("doc_id", F.when(k % 11 > 0, "确认已故").otherwise("未执行").alias("check"), F.lit("dead").alias("status"), said.alias("said"))
    return complete.settle_claim(rows, "check", "said", "status", k % 2 == 0, k % 3 > 0)


@query("""WITH a AS (SELECT doc_id, unnest(['education', 'interests']) AS role, lang AS v FROM documents)
SELECT doc_id, role, CASE WHEN role = 'education' AND doc_id % 4 = 1 THEN 'MIT University' WHEN role = 'interests' AND doc_id % 4 = 2 THEN '作物遗传育种' ELSE v END AS value FROM a""")
def correction_quality(t: Tables) -> DataFrame:
    """Corrections count if they are good enough for their column: a degree needs a school, a story is no cut text."""
    both = t.documents.select("doc_id", F.explode(F.array(F.lit("education"), F.lit("interests"))).alias("role"), F.col("lang").alias("value")).withColumn("column", F.col("role"))
    k, school = F.col("doc_id") % 4, F.col("role") == "education"
    new = F.when(school, F.when(k == 0, "Ph.D.").when(k == 1, "MIT University").when(k == 2, "暂无")).otherwise(F.when(k == 1, "cut text...").when(k == 2, "作物遗传育种"))
    corrections = both.select("doc_id", "column", new.alias("value")).where("value is not null")
    return complete.correct(both, corrections, "doc_id").select("doc_id", "role", "value")


@query(f"""WITH {AUDIT_SQL}, w AS (SELECT 'completed' AS tbl, c.doc_id, c.col, coalesce(p.value, c.value) AS value FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND c.col = p.col)
SELECT * FROM w UNION ALL SELECT 'details', doc_id, col, value FROM f WHERE filled UNION ALL SELECT 'audit', n.doc_id, 'remark', '本次补全 ' || n || ' 个空白字段；生存状态：待核验；原有非空单元格未被覆盖。' FROM n
UNION ALL SELECT 'totals', count(*), 'filled', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM n""")
def completed_sink(t: Tables) -> DataFrame:
    """All tables of a completion as one commit; a later run that breaks in its last table is not seen."""
    folder = new_folder(t, "completed")
    known = t.documents.select("doc_id", F.lit(None).cast("string").alias("sources"), F.lit("已锁定").alias("lock"), F.lit(None).cast("string").alias("life_status"))
    final = proposals(t).select("doc_id", "column", "value", F.col("hints").alias("urls"))
    out = complete.completed_tables(cells(t), final, t.documents.select("doc_id", F.col("source").alias("name")), known, "doc_id")
    tables.write_run(out, folder)
    try:
        tables.write_run({"completed": out["completed"].limit(5), "audit": out["audit"].withColumn("remark", F.raise_error(F.lit("no audit")))}, folder)
    except Exception as e:  # noqa: BLE001
        if "no audit" not in str(e):
            raise
    got = tables.read_run(t.spark, folder)
    one = lambda name, key, column, value: got[name].select(F.lit(name).alias("tbl"), key.alias("doc_id"), column.alias("col"), value.cast("string").alias("value"))
    k, c, v = F.col("doc_id"), F.col("column"), F.col("value")
    both = one("completed", k, c, v).unionByName(one("details", k, c, v)).unionByName(one("audit", k, F.lit("remark"), F.col("remark")))
    return both.unionByName(one("totals", F.col("total_rows"), F.lit("filled"), F.col("filled_cells")))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS strict, c_custkey % 3 > 0 AS loose FROM customer""")
def same_author(t: Tables) -> DataFrame:
    """The strict and the loose form of the same person, on names with what the customer's segment adds."""
    first = F.concat(F.lit("Ada Byron "), "c_mktsegment")
    second = F.when(F.col("c_custkey") % 6 == 0, F.concat_ws(" ", "c_mktsegment", F.lit("Byron Ada"))).when(F.col("c_custkey") % 6 == 3, F.lit("Bob Stone Hill"))
    second = second.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ada byron "), F.lower("c_mktsegment"), F.lit(" jr"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("x")))
    second = F.when(F.col("c_custkey") % 6 == 1, F.lit("byron")).when(F.col("c_custkey") % 6 == 5, F.lit("ada")).otherwise(second)
    return t.customer.select("c_custkey", names.same_person(first, second).alias("strict"), names.same_author(first, second).alias("loose"))
