"""Queries of sources, URLs and text evidence on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import names, text, urls
from rosterlake.operators import evidence, select
from rosterlake.sources import tables

from .book import Tables, new_folder, query

DOMAIN_SQL = "regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':\\d+$', ''), '^www\\.', '')"


@query(f"""WITH d AS (SELECT page_id, {DOMAIN_SQL} AS host FROM pages)
SELECT page_id, host, CASE WHEN host = '' OR host = 'example.net' OR suffix(host, '.example.net') THEN 4 WHEN regexp_matches(host, '(?:\\.edu|\\.gov|\\.mil)$|\\.(?:edu|ac|gov)\\.[a-z]{{2}}$') OR host = 'example.com' OR suffix(host, '.example.com') THEN 1 WHEN suffix(host, '.org') THEN 2 ELSE 3 END AS tier FROM d""")
def url_domain_tier(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.domain("url").alias("host"), urls.source_tier("url", ("example.com",), ("example.net",)).alias("tier"))


@query("""WITH r AS (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_replace(lower(trim(url)), '/+$', '') ORDER BY page_id) AS rn FROM pages) SELECT url, page_id AS ord FROM r WHERE rn = 1""")
def url_normal_distinct(t: Tables) -> DataFrame:
    return tables.source_list(t.pages.select("url", F.col("page_id").alias("ord")))


@query("""WITH h AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':\\d+$', '') AS host FROM pages)
SELECT page_id, regexp_matches(url, '(?i)^https?://') AND NOT (host IN ('', 'localhost') OR regexp_matches(host, '\\.(local|localhost|internal)$') OR NOT contains(host, '.')) AS public,
regexp_matches(lower(trim(url)), '^https?://') AND NOT contains(lower(url), 'example.org') AS homepage FROM h""")
def safe_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.public_url("url").alias("public"), urls.valid_homepage("url", ("example.org",)).alias("homepage"))


@query("""SELECT page_id, CASE WHEN lower(url) = url THEN url ELSE url || ' ' || lower(url) END || ' http://example.org/' || page_id AS urls, CASE WHEN lower(url) = url THEN 2 ELSE 3 END AS n FROM pages""")
def url_list(t: Tables) -> DataFrame:
    said = F.concat(F.lit("see "), "url", F.lit("；"), F.lower("url"), F.lit("; "), "url", F.lit(" and http://example.org/"), F.col("page_id").cast("string"), F.lit(".。"))
    listed = t.pages.select("page_id", urls.append_url(urls.url_list(said), F.col("url")).alias("l"))
    return listed.select("page_id", F.array_join("l", " ").alias("urls"), F.size("l").alias("n"))


@query(f"""WITH d AS (SELECT page_id, url, {DOMAIN_SQL} AS host FROM pages), t AS (SELECT *, CASE WHEN host = '' OR suffix(host, 'example.net') THEN 4 WHEN suffix(host, 'example.com') THEN 1 WHEN suffix(host, '.org') THEN 2 ELSE 3 END AS tier FROM d),
r AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY tier, page_id) AS rn FROM t WHERE tier < 4) SELECT host, string_agg(url, ' ' ORDER BY rn) AS sources FROM r WHERE rn <= 5 GROUP BY 1""")
def ordered_sources(t: Tables) -> DataFrame:
    tiered = t.pages.select("page_id", "url", urls.domain("url").alias("host"), urls.source_tier("url", ("example.com",), ("example.net",)).alias("tier")).where("tier < 4")
    best = select.top_n(tiered, ["host"], [F.asc("tier"), F.asc("page_id")], 5)
    return best.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "url"))), lambda x: x["url"]), " ").alias("sources"))


@query("""SELECT doc_id, regexp_extract(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}', 0) AS email FROM documents WHERE contains(text, '@') AND regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}')""")
def email_first(t: Tables) -> DataFrame:
    found = evidence.first_value(t.documents.where(F.contains("text", F.lit("@"))), "doc_id", "n_chars", F.regexp_extract("text", text.EMAIL, 0))
    return found.withColumnRenamed("value", "email")


HIT_PART = (80, "[ ,](?:the|les|die|los)[ ,]", 80)
HIT = r"(?i)[^.;\n]{0,80}[ ,](?:the|les|die|los)[ ,][^.;\n]{0,80}"


@query(f"""WITH l AS (SELECT source, doc_id, string_split(regexp_replace(text, '([。；;.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents), p AS (SELECT source, doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS seg FROM l),
h AS (SELECT *, trim(regexp_extract(part, '{HIT}', 0)) AS hit FROM p)
SELECT source, arg_min(hit, (doc_id, seg)) AS hit FROM h WHERE length(hit) BETWEEN 8 AND 150 AND NOT regexp_matches(lower(hit), '{"|".join(evidence.NAVIGATION)}') AND length(hit) - length(replace(hit, '|', '')) < 2 GROUP BY 1""")
def segment_hits(t: Tables) -> DataFrame:
    return evidence.first_hit(t.documents, "source", "doc_id", "text", HIT_PART)


@query("""WITH s AS (SELECT doc_id, trim(regexp_extract(text, '(?i)(?:the|les|die)\\s*[:：]?\\s*([^.\\n]+?)(?:[.\\n]|$)', 1)) AS span FROM documents) SELECT * FROM s WHERE span <> ''""")
def label_span(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", evidence.label_span("text", "(?:the|les|die)", stops=".\n").alias("span")).where("span <> ''")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '(^|[^A-Za-z0-9_])([A-Za-z][A-Za-z-]{2,})', 2) AS l, text FROM documents)
SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g')) AS meant FROM w""")
def language_audit(t: Tables) -> DataFrame:
    latin, meant = F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", f"[^A-Za-z{text.HAN}]", ""))
    return t.documents.select("doc_id", latin.alias("latin"), meant.alias("meant"))


@query("""WITH l AS (SELECT source, doc_id, unnest(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x))) AS line, generate_subscripts(regexp_split_to_array(text, '\\n+'), 1) AS i FROM documents),
c AS (SELECT source, doc_id, i, k, substr(line, 900 * k + 1, 900) AS chunk FROM (SELECT source, doc_id, i, line, unnest(range(0, (length(line) - 1) // 900 + 1)) AS k FROM l WHERE line <> ''))
SELECT source, doc_id, count(*) AS n, CAST(sum(length(chunk)) AS BIGINT) AS chars, max(length(chunk)) AS longest FROM c GROUP BY 1, 2""")
def text_chunks(t: Tables) -> DataFrame:
    cut = evidence.chunks(t.documents, "source", "doc_id", "text")
    return cut.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


@query("""WITH l AS (SELECT source, doc_id, unnest(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x))) AS line, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS i FROM documents),
p AS (SELECT source, doc_id, i, k, substr(line, 900 * k + 1, 900) AS chunk FROM (SELECT source, doc_id, i, line, unnest(range(0, (length(line) - 1) // 900 + 1)) AS k FROM l WHERE line <> '')),
n AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source, doc_id ORDER BY i, k) - 1 AS INT) AS chunk_no, chunk FROM p),
o AS (SELECT source, chunk, min({'d': doc_id, 'n': chunk_no}) AS at_ FROM n GROUP BY 1, 2),
s AS (SELECT source, at_.d AS doc_id, at_.n AS chunk_no, chunk, 4 * (CAST(contains(lower(chunk), 'and') AS INT) + CAST(contains(lower(chunk), 'the') AS INT) + CAST(contains(lower(chunk), 'que') AS INT)) + least(6, CAST(contains(lower(chunk), 'ing') AS INT) + CAST(contains(lower(chunk), 'tion') AS INT)) AS score FROM o),
h AS (SELECT *, max(score) OVER (PARTITION BY source) AS top FROM s),
r AS (SELECT *, 7000 - coalesce(sum(length(chunk) + 2) OVER (PARTITION BY source ORDER BY score DESC, doc_id, chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM h WHERE score > 0 OR top = 0)
SELECT source, doc_id, chunk_no, rtrim(left(chunk, CAST(l AS BIGINT)), ' ') AS chunk, score FROM r WHERE l > 0""")
def chunk_budget(t: Tables) -> DataFrame:
    cut = evidence.chunks(t.documents, "source", "doc_id", "text")
    return evidence.chunks_within_budget(cut, ["source"], "source", "doc_id", ("and", "the", "que"), ("ing", "tion"), 7000).select("source", "doc_id", "chunk_no", "chunk", "score")


@query("""WITH c AS (SELECT source, doc_id, left(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', '\n\n', 'g')), 5000) AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT *, 20000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM c WHERE rn <= 10) SELECT source, doc_id, md5(left(text, CAST(l AS BIGINT))) AS digest, length(left(text, CAST(l AS BIGINT))) AS n FROM r WHERE l > 0""")
def doc_caps(t: Tables) -> DataFrame:
    capped = tables.capped_texts(t.documents, "source", "doc_id", "text", per_file=5000, files=10, total=20_000)
    return capped.select("source", "doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("""WITH c AS (SELECT source, doc_id, n_chars, CASE WHEN length(text) > 400 THEN rtrim(left(text, 395), ' ') || '[cut]' ELSE text END AS text FROM documents WHERE text <> ''),
r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT source, doc_id, CASE WHEN length(text) > 3000 - b THEN rtrim(left(text, CAST(3000 - b AS BIGINT)), ' ') ELSE text END AS text FROM r WHERE b < 3000""")
def pack_budget(t: Tables) -> DataFrame:
    """Evidence under a cap for each text, marked where it is cut, and a running budget for each source."""
    packed = select.within_budget(t.documents, ["source"], [F.desc("n_chars"), F.asc("doc_id")], "text", 3000, each=400, mark="[cut]")
    return packed.select("source", "doc_id", "text")


WORDS = ("there", "ouest", "ander", "ción", "eaux")


@query("""WITH h AS (SELECT source, doc_id, unnest(range(1, 6)) AS k, unnest(['there', 'ouest', 'ander', 'ción', 'eaux']) AS word, text FROM documents),
f AS (SELECT source, word, min({'d': doc_id, 'k': k}) AS place FROM h WHERE contains(lower(text), word) GROUP BY 1, 2) SELECT source, string_agg(word, ',' ORDER BY place) AS found FROM f GROUP BY 1""")
def keyword_evidence(t: Tables) -> DataFrame:
    return evidence.keyword_evidence(t.documents, "source", "doc_id", "text", WORDS).select("source", F.array_join("found", ",").alias("found"))


@query(f"""WITH d AS (SELECT page_id, {DOMAIN_SQL} AS host, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS net, url, contains(lower(html), 'ouest') AS said, contains(lower(html), 'ouest') AND contains(lower(url), 'utm') AS strong FROM pages),
g AS (SELECT CAST(page_id % 50 AS BIGINT) AS person, bool_or(strong) AS s, count(CASE WHEN said THEN 1 END) AS n_items, count(DISTINCT CASE WHEN said THEN coalesce(nullif(net, ''), url) END) AS n_domains FROM d GROUP BY 1)
SELECT person, CASE WHEN s OR n_domains >= 2 THEN '确认已故' WHEN n_items > 0 THEN '疑似已故待复核' ELSE '未发现死亡证据' END AS verdict, n_items, n_domains FROM g""")
def two_domain_verdict(t: Tables) -> DataFrame:
    items = t.pages.withColumn("person", F.col("page_id") % 50)
    said = text.any_contains("html", ("ouest",))
    return evidence.two_domain_verdict(items, "person", "page_id", "url", said, F.contains(F.lower("url"), F.lit("utm"))).select("person", "verdict", "n_items", "n_domains")


@query(f"""WITH d AS (SELECT page_id, url, {DOMAIN_SQL} AS host, contains(html, 'the') AS a, contains(html, 'les') AS b FROM pages),
s AS (SELECT *, CASE WHEN a THEN 8 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'profile|people|person|staff|faculty|directory|biography|bio|team') THEN 3 ELSE 0 END
 - CASE WHEN regexp_matches(lower(url), 'search|publication|paper|news|event|project') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '\\.(?:edu|org|gov)(?:[./:]|$)') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(lower(url), '\\.(?:pdf|docx?|pptx?|xlsx?)(?:$|[?#])') THEN 6 ELSE 0 END AS score FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY host, regexp_replace(lower(trim(url)), '/+$', '') ORDER BY page_id) AS rn FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS rk FROM n WHERE rn = 1 AND score >= 2)
SELECT host, url, score FROM r WHERE rk = 1""")
def best_url(t: Tables) -> DataFrame:
    rows = t.pages.withColumn("host", urls.domain("url"))
    score = evidence.homepage_score("url", F.contains("html", F.lit("the")), F.lit(False), F.contains("html", F.lit("les")))
    return evidence.best_url(rows, "host", "url", score, [F.asc("page_id")])


@query("""SELECT doc_id, regexp_matches(text, '(?i)menu|login') OR length(text) - length(replace(text, '|', '')) >= 2 AS nav FROM documents""")
def nav_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", evidence.is_navigation("text", ("menu", "login")).alias("nav"))


@query("""SELECT doc_id, trim(text) = '' OR regexp_matches(text, '(?i)暂无|未知|公开信息|nan|None') OR regexp_matches(text, '(?i)stth|eaux') AS generic FROM documents""")
def generic_phrase(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (text.enrich_placeholder("text") | text.any_contains("text", ("stth", "eaux"))).alias("generic"))


@query("""WITH q AS (SELECT c_custkey, c_mktsegment || '领域下的' || c_name || ' crop breeding 作物遗传' AS q FROM customer),
w AS (SELECT c_custkey, regexp_extract_all(lower(regexp_replace(q, '领域下的', ' ', 'g')), '[a-z]{3,}') AS l FROM q) SELECT c_custkey, array_to_string(l, ',') || ',作物遗传' AS terms FROM w""")
def query_terms(t: Tables) -> DataFrame:
    q = t.customer.select("c_custkey", F.concat("c_mktsegment", F.lit("领域下的"), "c_name", F.lit(" crop breeding 作物遗传")).alias("q"))
    return q.select("c_custkey", F.array_join(names.query_terms("q"), ",").alias("terms"))


@query("""SELECT p_partkey, CASE WHEN p_name = regexp_replace(p_name, '\\s+$', '') THEN p_name || '|' || p_name || ' ' || split_part(p_brand, ' ', 1) || '|' || p_name || ' ' || lower(p_type) END AS variants FROM part""")
def name_variants(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(names.name_variants("p_name", "p_brand", F.lower("p_type")), "|").alias("variants"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS org FROM orders WHERE o_orderkey % 5 <> 4""")
def markdown_rows(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    short, full = F.concat(F.lit("| "), key, F.lit(" |")), F.concat(F.lit("| "), key, F.lit(" | "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |"))
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", F.when(F.col("o_orderkey") % 5 == 4, short).otherwise(full).alias("line"))))
    body = F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
    said = t.orders.groupBy("o_custkey").agg(F.concat(F.lit("Before.\n| name | org | key |\n| --- | :-: | --- |\n"), body, F.lit("\nAfter.\n| x | y | z |")).alias("text"))
    rows = tables.markdown_rows(said, "o_custkey", "text", "name", least_cells=3)
    return rows.select("o_custkey", "row", F.element_at("cells", 1).alias("name"), F.element_at("cells", 2).alias("org"))


CELLS_SQL = """cells AS (SELECT 'f' || n_nationkey AS file, 's' AS sheet, 3 AS row, 1 AS col, 'Name' AS value FROM nation UNION ALL SELECT 'f' || n_nationkey, 's', 3, 2, 'Org Unit' FROM nation UNION ALL SELECT 'f' || n_nationkey, 's', 3, 3, 'Org' FROM nation UNION ALL SELECT 'f' || n_nationkey, 's', 1, 1, 'title' FROM nation
UNION ALL SELECT 'f' || c_nationkey, 's', 4 + c_custkey, 1, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '王某; Ada Lovelace' ELSE c_name END FROM customer UNION ALL SELECT 'f' || c_nationkey, 's', 4 + c_custkey, 2, 'Unit ' || c_custkey FROM customer
UNION ALL SELECT 'f' || c_nationkey, 's', 4 + c_custkey, 3, CASE WHEN c_custkey % 3 = 0 THEN 'Hall' ELSE '' END FROM customer)"""


def sheet_cells(t: Tables) -> DataFrame:
    """Customers as sheets: a file for each nation, three columns with a header in the third row."""
    fixed = F.array(*[F.struct(F.lit(r).cast("bigint").alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in ((3, 1, "Name"), (3, 2, "Org Unit"), (3, 3, "Org"), (1, 1, "title"))])
    head = t.nation.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"), F.lit("s").alias("sheet"), F.inline(fixed))
    row, k = (F.col("c_custkey") + 4).alias("row"), F.col("c_custkey")
    name = F.when(k % 4 == 0, " ").when(k % 4 == 1, "王某; Ada Lovelace").otherwise(F.col("c_name"))
    listed = (name, F.concat(F.lit("Unit "), k.cast("string")), F.when(k % 3 == 0, "Hall").otherwise(""))
    data = F.array(*[F.struct(row, F.lit(c).alias("col"), v.alias("value")) for c, v in enumerate(listed, 1)])
    return head.unionByName(t.customer.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file"), F.lit("s").alias("sheet"), F.inline(data)))


def layout(cells: DataFrame) -> DataFrame:
    return tables.detect_header(cells, ("name",), ("name", "orgunit", "org"))


@query(f"WITH {CELLS_SQL}, s AS (SELECT file, sheet, row, max(CASE WHEN value = 'Name' THEN 100 ELSE 0 END) + 8 * count(CASE WHEN value IN ('Name', 'Org Unit', 'Org') THEN 1 END) + least(count(*), 20) AS score FROM cells WHERE row <= 30 AND trim(value) <> '' GROUP BY 1, 2, 3) SELECT * FROM s WHERE score >= 100")
def header_detect(t: Tables) -> DataFrame:
    return layout(sheet_cells(t))


@query("""WITH c AS (SELECT 'f' || c_nationkey AS file, 4 + c_custkey AS row, c_custkey AS k, CASE c_custkey % 4 WHEN 1 THEN '王某; Ada Lovelace' ELSE c_name END AS raw FROM customer WHERE c_custkey % 4 <> 0)
SELECT file, row, 'raw_name' AS role, raw AS value FROM c UNION ALL SELECT file, row, 'name', CASE WHEN k % 4 = 1 THEN 'Ada Lovelace' ELSE raw END FROM c UNION ALL SELECT file, row, 'org', CASE WHEN k % 3 = 0 THEN 'Hall' ELSE '' END FROM c
UNION ALL SELECT file, row, 'institution', 'Unit ' || k || CASE WHEN k % 3 = 0 THEN ' Hall' ELSE '' END FROM c""")
def canonical_rows(t: Tables) -> DataFrame:
    """Names as they are best searched for, rows without one gone, two workplace columns joined."""
    cells = sheet_cells(t)
    roles = t.spark.createDataFrame([("name", "name"), ("orgunit", "org"), ("org", "org")], "alias string, role string")
    return tables.canonical_rows(cells, layout(cells), roles)


@query("""WITH s AS (SELECT c_custkey AS n, c_name AS name FROM customer WHERE c_custkey % 4 <> 0), l AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0)
SELECT n, name, CASE WHEN d.doc_id IS NOT NULL THEN CASE WHEN d.doc_id % 5 = 0 THEN 'later' ELSE lang END END AS evidence, CASE WHEN l.doc_id IS NOT NULL THEN quality END AS verdict FROM s LEFT JOIN documents d ON d.doc_id = n LEFT JOIN l ON l.doc_id = n""")
def row_align(t: Tables) -> DataFrame:
    """Source, evidence and validation rows of one number; numbers come as text, some are none, some twice."""
    text_of = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"))
    k = F.col("c_custkey")
    source = t.customer.select(F.when(k % 4 == 0, F.concat(F.lit("row "), k.cast("string"))).otherwise(text_of("c_custkey")).alias("n"), F.lit(0).alias("at"), F.col("c_name").alias("name"))
    first = t.documents.select(text_of("doc_id").alias("n"), F.lit(0).alias("at"), F.col("lang").alias("found"))
    again = t.documents.where("doc_id % 5 = 0").select(text_of("doc_id").alias("n"), F.lit(1).alias("at"), F.lit("later").alias("found"))
    checked = t.labels.select(F.when(F.col("doc_id") % 3 == 0, "x").otherwise(text_of("doc_id")).alias("n"), F.lit(0).alias("at"), "quality")
    got = tables.aligned(source, {"e": first.unionByName(again), "v": checked}, "n", "at")
    return got.select("n", "name", F.col("e.found").alias("evidence"), F.col("v.quality").alias("verdict"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_explode(t: Tables) -> DataFrame:
    chatty = t.events.select("event_id", F.concat(F.lit("Here you are:\n```json\n["), "props", F.lit("]\n```")).alias("said"))
    return chatty.select("event_id", F.explode(text.json_array("said", "array<struct<k: bigint>>")).alias("x")).select("event_id", "x.k")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice, rn FROM r WHERE rn <= 5""")
def top_n_nested(t: Tables) -> DataFrame:
    return select.top_n(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '、' ORDER BY rn) AS papers FROM r WHERE rn <= 5 GROUP BY 1""")
def top5_text(t: Tables) -> DataFrame:
    best = select.top_n(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return best.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), "、").alias("papers"))


@query("""SELECT doc_id, lang || '|' || source AS bundle_key, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY lang, source) AS items FROM documents""")
def evidence_bundle(t: Tables) -> DataFrame:
    by = Window.partitionBy("bundle_key")
    keyed = t.documents.select("doc_id", F.concat_ws("|", F.lower("lang"), F.lower("source")).alias("bundle_key"))
    return keyed.withColumn("pos", F.row_number().over(by.orderBy("doc_id"))).withColumn("items", F.count("*").over(by))


@query("""WITH a AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS name, p_size AS cited FROM part), f AS (SELECT 'ring economy' AS asked, * FROM a WHERE contains(lower(name), 'ring economy') UNION ALL SELECT 'economy ring', * FROM a WHERE contains(lower(name), 'economy') AND contains(lower(name), 'ring') UNION ALL SELECT 'nothing', * FROM a WHERE false),
r AS (SELECT asked, id, name, cited, row_number() OVER (PARTITION BY asked ORDER BY cited DESC, id) AS place FROM f) SELECT * FROM r WHERE place <= 8""")
def nested_search(t: Tables) -> DataFrame:
    """Author documents written as JSON and read again with their schema; those that hold a phrase, or else all its words, the most cited first."""
    folder = new_folder(t, "authors")
    nested = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("display_name"), F.struct(F.col("p_size").alias("cited_by_count")).alias("summary_stats"))
    nested.write.json(folder)
    authors = t.spark.read.schema(nested.schema).json(folder)
    found = [tables.search(authors, "display_name", asked, F.col("summary_stats.cited_by_count"), F.col("id"), 8).withColumn("asked", F.lit(asked)) for asked in ("ring economy", "economy ring", "nothing at all")]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("asked", "id", F.col("display_name").alias("name"), F.col("summary_stats.cited_by_count").alias("cited"), F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT d.doc_id, c.rn IS NOT NULL AND c.rn <= 25 AS queued FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""")
def check_queue(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("known")), "doc_id", "left").withColumn("row_id", F.col("doc_id"))
    return select.capped_queue(rows, F.col("known").isNull(), [F.desc("n_chars"), F.asc("doc_id")], 25).select("doc_id", "queued")
