"""Queries of clean-up, filters, scores and merges on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import names, rules, text
from rosterlake.operators import filters, merge, score, select

from .book import Tables, query

PRIORITY_BONUS = (("1-URGENT", 30), ("2-HIGH", 20))


def customer_metrics(t: Tables) -> DataFrame:
    """Customers as profiles: orders as index, their value as citations, line items as i10."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    urgent = F.max(score.title_bonus(["o_orderpriority"], PRIORITY_BONUS, generic="HIGH")["bonus"])
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("h"), F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).alias("citations"), F.coalesce(F.sum("lines"), F.lit(0)).alias("i10"), urgent.alias("bonus"))
    return t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("h", "citations", "i10", "bonus")])


METRICS_SQL = """lines AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1),
sums AS (SELECT o_custkey, count(*) AS h, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS citations, CAST(coalesce(sum(lines), 0) AS BIGINT) AS i10,
  max(CASE WHEN o_orderpriority LIKE '%1-URGENT%' THEN 30 WHEN o_orderpriority LIKE '%2-HIGH%' THEN 20 ELSE 0 END) AS bonus
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY 1),
metrics AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal, coalesce(h, 0) AS h, coalesce(citations, 0) AS citations, coalesce(i10, 0) AS i10, CAST(coalesce(bonus, 0) AS BIGINT) AS bonus
  FROM customer LEFT JOIN sums ON c_custkey = o_custkey)"""
SCORE_SQL = "round(h + CASE WHEN citations > 0 THEN log10(citations) * 15 ELSE 0 END + i10 * 0.2 + bonus, 2)"


@query(f"WITH {METRICS_SQL} SELECT c_custkey, h, citations, i10, bonus, {SCORE_SQL} AS score FROM metrics")
def score_rank(t: Tables) -> DataFrame:
    scored = customer_metrics(t).withColumn("score", F.round(score.total_score(F.col("h"), F.col("citations"), F.col("i10"), F.col("bonus")), 2))
    return scored.select("c_custkey", "h", "citations", "i10", "bonus", "score").orderBy(F.desc_nulls_last("score"), "c_custkey")


QUOTA_SQL = """seg AS (SELECT c_mktsegment AS grp, row_number() OVER (ORDER BY c_mktsegment) AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer)),
quota AS (SELECT grp, pos, 25 // (SELECT count(*) FROM seg) + CASE WHEN pos <= 25 % (SELECT count(*) FROM seg) THEN 1 ELSE 0 END AS quota FROM seg),
r AS (SELECT c.*, pos, quota, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer c JOIN quota ON grp = c_mktsegment),
o AS (SELECT *, r <= quota AS inside FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY NOT inside, CASE WHEN inside THEN pos END, CASE WHEN inside THEN r END, c_acctbal DESC, c_custkey) AS pick FROM o)"""


@query(f"WITH {QUOTA_SQL} SELECT c_custkey, c_mktsegment, c_acctbal, pick FROM p WHERE pick <= 25")
def balanced_quota(t: Tables) -> DataFrame:
    segments = t.customer.select(F.col("c_mktsegment").alias("grp")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("grp")))
    return select.balanced_quota(t.customer, "c_custkey", F.array("c_mktsegment"), segments, 25, [("c_acctbal", True), ("c_custkey", False)]).select("c_custkey", "c_mktsegment", "c_acctbal", "pick")


@query("""WITH f AS (SELECT *, md5(lower(trim(text))) AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS rn FROM f),
s AS (SELECT k, source, min(rn) AS first FROM r GROUP BY 1, 2)
SELECT g.k AS merge_key, g.n_rows, g.doc_id, g.n_chars, g.digest, s2.source FROM
(SELECT k, count(*) AS n_rows, arg_min(doc_id, rn) AS doc_id, max(n_chars) AS n_chars, md5(arg_max(text, (length(text), -rn))) AS digest FROM r GROUP BY 1) g
JOIN (SELECT k, string_agg(source, '；' ORDER BY first) AS source FROM s GROUP BY 1) s2 ON g.k = s2.k""")
def survivorship_merge(t: Tables) -> DataFrame:
    none = lambda c: F.trim(text.string(c)) == ""
    docs = t.documents.withColumn("first_id", F.col("doc_id").cast("string"))
    key = F.md5(F.lower(F.trim("text")))
    place = F.struct((-F.col("n_chars")).alias("less"), "doc_id")
    merged = merge.survivorship(docs, key, place, ["n_chars"], ["source"], ["text"], missing=none)
    return merged.select("merge_key", "n_rows", "first.doc_id", "n_chars", F.md5("text").alias("digest"), "source")


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN n_chars < 500 THEN 'text' END], lambda x: x IS NOT NULL), ',') AS missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def missing_fields(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select("doc_id", F.array_join(score.missing_fields(label_checks()), ",").alias("missing"))


def label_checks() -> dict:
    return {"quality": F.col("quality").isNull(), "toxic": F.col("toxic").isNull(), "text": F.col("n_chars") < 500}


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL THEN 4 ELSE 0 END + CASE WHEN toxic IS NULL THEN 3 ELSE 0 END + CASE WHEN n_chars < 500 THEN 1 ELSE 0 END AS gap
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def gap_score(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", score.gap_score(label_checks(), {"quality": 4, "toxic": 3}).alias("gap"))


POSITIVE, CONFLICTS = ("and the ", "tion "), (("heit ", "schaft"), ("ción", "mente "), ("eaux", "ment "))


@query("""WITH h AS (SELECT doc_id, array_to_string(list_slice(list_filter(['heit ', 'schaft', 'ción', 'mente ', 'eaux', 'ment '], lambda w: contains(lower(text), w)), 1, 4), '、') AS reasons,
contains(lower(text), 'and the ') OR contains(lower(text), 'tion ') AS ok FROM documents)
SELECT doc_id, CASE WHEN ok THEN '' ELSE reasons END AS reasons, ok OR reasons = '' AS kept FROM h""")
def domain_mismatch(t: Tables) -> DataFrame:
    kept, gone = filters.domain_mismatches(t.documents.select("doc_id", "text"), ["text"], POSITIVE, CONFLICTS)
    return kept.select("doc_id", F.lit("").alias("reasons"), F.lit(True).alias("kept")).unionByName(gone.select("doc_id", F.array_join("reasons", "、").alias("reasons"), F.lit(False).alias("kept")))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT (contains(n_name, 'NATION_1') OR contains(n_name, 'NATION_20'))")
def foreign_filter(t: Tables) -> DataFrame:
    joined = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    return joined.where(filters.foreign("n_name", ("nation_1", "NATION_20"))).select("s_suppkey", "n_name")


TRUST_SQL = """NOT ((h >= 20 AND oh > 0 AND oh < h * 0.65) OR (h >= 20 AND oc > 0 AND oc < greatest(100.0, h * 30)) OR (h >= 10 AND oh > 0 AND oh <= 5 AND oc < 500)
OR (citations >= 1000 AND oc > 0 AND oc < citations * 0.2) OR (h = 0 AND citations = 0 AND oh > 0 AND oh <= 2 AND oc < 100))"""


@query(f"""WITH {METRICS_SQL}, o AS (SELECT *, CAST(floor(c_acctbal / 300) AS BIGINT) AS oh, CAST(floor(c_acctbal * 100) AS BIGINT) AS oc FROM metrics)
SELECT c_custkey, {TRUST_SQL} AS trusted FROM o""")
def metric_trust(t: Tables) -> DataFrame:
    other = customer_metrics(t).withColumn("oh", F.floor(F.col("c_acctbal") / 300)).withColumn("oc", F.floor(F.col("c_acctbal") * 100))
    return other.select("c_custkey", filters.metric_trusted(F.col("h"), F.col("citations"), F.col("oh"), F.col("oc")).alias("trusted"))


@query("""SELECT c_custkey, TRY_CAST(regexp_extract(replace(c_name, ',', ''), '\\d+(?:\\.\\d+)?', 0) AS DOUBLE) AS number FROM customer""")
def number_parse(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.number_in("c_name").alias("number"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 180 THEN rtrim(left(x, 180)) || '...' ELSE x END AS clipped FROM c""")
def clip_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.clip("text", 180).alias("clipped"))


@query("""WITH w AS (SELECT p_partkey, u.i, u.x FROM (SELECT p_partkey, string_split(p_type, ' ') AS l FROM part), LATERAL (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) u WHERE u.x <> ''),
d AS (SELECT p_partkey, x, min(i) AS i FROM w GROUP BY 1, 2) SELECT p_partkey, string_agg(x, '；' ORDER BY i) AS parts FROM d GROUP BY 1""")
def multi_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.rendered(text.subdomain_list("p_type", separators=" +")).alias("parts"))


#: Frequent words and what stands in their place, so that every rule of the glossary has something to do.
SAID = (
    " the ", " and ", " to ", " of ", " in ", " for ", " with ", " is ", " on ", " that ", " it ", " das ", " und ", " nicht ", " de ", " la ", " le ", " et ", " un ", " que ",
    " en ", " el ", " ein ", " der ", " was ", " are ",
)
PHRASES = (
    "Associate Professor", "assistant professor", "Emeritus Professor", "Visiting Professor", "Professor", "Research Professor", "principal investigator", "Research Scientist", "Senior Scientist",
    "Chief Scientist", "Director", "chair", "Department of", "School of", "College of", "Institute of", "Research Center", "Research Centre", "University", "National Academy", "Fellow",
    "award", "Awards", "Research interest", "collaboration ; and", "co-author : coauthor",
)


#: Word characters and white space of all scripts, by which words end and white space is folded; this SQL's own classes are ASCII.
WORD_SQL, SPACE_SQL = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24b6}-\x{24e9}\x{200c}\x{200d}", r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def glossary_sql() -> str:
    said = "coalesce(text, '')"
    for old, new in zip(SAID, PHRASES, strict=True):
        said = f"replace({said}, '{old}', ' {new} ')"
    out = f"trim({said})"
    for pattern, new in rules.GLOSSARY:
        # a match takes the character on either side along, so of words with one character between them the second pass finds every other
        bare = pattern.removeprefix(r"\b").removesuffix(r"\b")
        for _ in range(2):
            out = f"regexp_replace({out}, '(?i)(^|[^{WORD_SQL}])(?:{bare})($|[^{WORD_SQL}])', '\\1{new}\\2', 'g')"
    for pattern, new in ((f"{SPACE_SQL}+", " "), (f"{SPACE_SQL}*;{SPACE_SQL}*", "；"), (f"{SPACE_SQL}*:{SPACE_SQL}*", "：")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"SELECT doc_id, md5(trim({out})) AS digest, length(trim({out})) AS n FROM documents"


@query(glossary_sql())
def glossary(t: Tables) -> DataFrame:
    """All 26 replacements of the glossary on whole texts."""
    said = F.col("text")
    for old, new in zip(SAID, PHRASES, strict=True):
        said = F.replace(said, F.lit(old), F.lit(f" {new} "))
    return t.documents.select("doc_id", text.glossary(said).alias("g")).select("doc_id", F.md5("g").alias("digest"), F.length("g").alias("n"))


@query("""SELECT event_id, 'GET http://a/x?api_key=***&mailto=***&q=' || event_type AS line FROM events""")
def hidden_parameters(t: Tables) -> DataFrame:
    line = F.concat(F.lit("GET http://a/x?api_key=k"), F.col("event_id").cast("string"), F.lit("&mailto=u"), F.col("user_id").cast("string"), F.lit("@x.org&q="), "event_type")
    return t.events.select("event_id", text.hide_parameters(line).alias("line"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '王' END AS name, array_to_string(list_slice(list_filter([p_name, '', p_type, p_brand, NULL, 'a', 'b'], lambda x: x <> ''), 1, 4), '、') AS topics FROM part""")
def preferred_names(t: Tables) -> DataFrame:
    """The search name of a cell with several names, and the first four topics."""
    cell = F.concat(F.lit("王；"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ann / "), "p_name")).otherwise("Ann"))
    topics = F.array(F.col("p_name"), F.lit(""), F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string"), F.lit("a"), F.lit("b"))
    return t.part.select("p_partkey", text.preferred_name(cell).alias("name"), text.first_names(topics).alias("topics"))


@query("""WITH b AS (SELECT doc_id, unnest([lang, '未命名文件']) AS source, unnest([1, 2]) AS i, text FROM documents), l AS (SELECT doc_id, source, i, unnest(string_split_regex(text, '\n+')) AS p FROM b)
SELECT doc_id, source, count(*) AS paragraphs, CAST(sum(length(trim(p))) AS BIGINT) AS chars FROM l WHERE trim(p) <> '' GROUP BY 1, 2""")
def document_blocks(t: Tables) -> DataFrame:
    """Texts under two source headers, cut into pieces; pieces longer than the text's longest line do not occur."""
    both = F.concat(F.lit("### 用户上传补充文件： "), "lang", F.lit("\n"), "text", F.lit("\n### 用户上传补充文件：\n"), "text")
    cut = t.documents.select("doc_id", F.explode(text.source_blocks(both, size=1 << 20)).alias("c"))
    return cut.groupBy("doc_id", F.col("c.source").alias("source")).agg(F.count("*").alias("paragraphs"), F.sum(F.length("c.chunk")).alias("chars"))


@query("""WITH r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE source END AS name, CASE WHEN toxic = 1 THEN 'reported deceased' ELSE '' END AS status, CASE WHEN quality = 1 THEN '未发现死亡证据' WHEN quality = 0 THEN '核验失败' ELSE '' END AS chk FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
q AS (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN status <> '' THEN 0 ELSE 1 END, doc_id) AS rn FROM r WHERE chk <> '未发现死亡证据' AND name <> '')
SELECT r.doc_id, coalesce(rn <= 25, false) AS queued, CASE WHEN chk <> '未发现死亡证据' AND name = '' THEN '缺少专家姓名' WHEN chk <> '未发现死亡证据' AND rn > 25 THEN '超过本批独立核验数量上限' END AS why_not FROM r LEFT JOIN q ON r.doc_id = q.doc_id""")
def survival_queue(t: Tables) -> DataFrame:
    """Who is checked next: the dead first, 25 in all; rows without a name take no place."""
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("name"), F.when(F.col("toxic") == 1, "reported deceased").alias("status"),
        F.when(F.col("quality") == 1, "未发现死亡证据").when(F.col("quality") == 0, "核验失败").alias("chk"),
    )
    return filters.survival_queue(rows, "doc_id", "name", "status", "chk", 25).select("doc_id", "queued", "why_not")


@query("""WITH j AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN quality IS NULL THEN 'None' ELSE CAST(quality AS VARCHAR) END AS q, text AS x FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, regexp_matches(q, '(?i)nan|none') AS pending, lower(trim(q)) IN ('none', 'nan', '') AS cell, x IS NULL OR trim(x) = '' OR regexp_matches(x, '(?i)nan|none') AS text_missing FROM j""")
def placeholder_flags(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "full").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("None")).alias("q"), F.col("text").alias("x"))
    return joined.select("doc_id", text.missing_pending("q").alias("pending"), text.cell_placeholder("q").alias("cell"), text.enrich_placeholder("x").alias("text_missing"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'NaN' ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""")
def person_filter(t: Tables) -> DataFrame:
    blanked = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 11 == 0, "NaN").otherwise(F.col("c_name")).alias("name"))
    return blanked.where(filters.is_person("name"))


@query("""WITH e AS (SELECT doc_id, regexp_extract(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}', 0) AS e FROM documents) SELECT doc_id, CASE WHEN e = '' THEN '暂无公开信息' ELSE e END AS contact FROM e""")
def contact_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.first_email("text").alias("contact"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE c_mktsegment END AS domain, CASE WHEN c_custkey % 10 = 0 THEN '暂无公开信息' ELSE c_name END AS subdomain FROM customer""")
def query_parts(t: Tables) -> DataFrame:
    said = F.concat("c_mktsegment", F.lit("领域下的"), "c_name", F.lit("方向顶级专家信息"))
    asked = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(said).alias("q"))
    return asked.select("c_custkey", text.query_parts("q").alias("p")).select("c_custkey", "p.domain", "p.subdomain")


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS l, p_name FROM part)
SELECT p_partkey, array_to_string(CASE WHEN len(list_filter(l, lambda x: length(x) > 1)) >= 2 THEN list_filter(l, lambda x: length(x) > 1) ELSE l END, ' ') AS dedupe,
array_to_string(list_filter(l, lambda x: length(x) > 1), ' ') AS simple, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS compact, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS spaced FROM w""")
def name_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.dedupe_key("p_name").alias("dedupe"), names.simple_name("p_name").alias("simple"), names.compact_name("p_name").alias("compact"), names.space_normal("p_name").alias("spaced"))


@query("""WITH j AS (SELECT d.doc_id, d.text, n_chars, coalesce(CASE WHEN toxic = 1 THEN '确认已故' WHEN toxic = 0 THEN '未发现死亡证据' END, '') AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, n_chars FROM j WHERE s <> '确认已故'""")
def deceased_filter(t: Tables) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "确认已故").when(F.col("toxic") == 0, "未发现死亡证据")
    return t.documents.join(t.labels, "doc_id", "left").withColumn("check", status).where(filters.not_deceased("check")).select("doc_id", "n_chars")


@query("""SELECT d.doc_id, (CASE WHEN quality IS NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NULL THEN 1 ELSE 0 END >= 2) OR (CASE WHEN n_chars < 300 THEN 1 ELSE 0 END + CASE WHEN source = 'src0' THEN 1 ELSE 0 END >= 2)
OR lang = 'es' OR (NOT coalesce(quality = 1, false) AND (quality IS NULL OR toxic IS NULL)) AS severe FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def severe_gaps(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    identity, details = [F.col("quality").isNull(), F.col("toxic").isNull()], [F.col("n_chars") < 300, F.col("source") == "src0"]
    return joined.select("doc_id", score.severe_gaps(identity, details, F.col("lang") == "es", F.coalesce(F.col("quality") == 1, F.lit(False))).alias("severe"))


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(quality = 0, false) AND NOT regexp_matches(text, '(?i)not relevant|idiot')""")
def low_confidence(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left").withColumn("why", F.when(F.col("quality") == 0, "suspected mismatch"))
    return joined.where(filters.confident("why", ["text"], "mismatch", "(?i)not relevant|idiot")).select("doc_id")


@query("""WITH w AS (SELECT p_partkey, p_brand, list_filter(string_split(lower(p_type), ' '), lambda x: length(x) >= 3 AND x NOT IN ('standard')) AS l FROM part),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_distinct(list_intersect(a.l, b.l)) AS s FROM w a JOIN w b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + 25)
SELECT a, b, len(s) >= 2 OR len(list_filter(s, lambda x: length(x) >= 5)) > 0 AS same FROM p""")
def institution_match(t: Tables) -> DataFrame:
    w = t.part.select("p_partkey", "p_brand", names.institution_tokens("p_type", ("standard",)).alias("l"))
    other = w.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("brand_b"), F.col("l").alias("lb"), (F.col("p_partkey") - 25).alias("a"))
    paired = w.withColumnRenamed("p_partkey", "a").join(other, "a").where(F.col("p_brand") == F.col("brand_b"))
    return paired.select("a", "b", names.institutions_match(F.col("l"), F.col("lb")).alias("same"))


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 1) AS l, p_name FROM part),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.l AS la, b.l AS lb FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, array_to_string(la, ' ') = array_to_string(lb, ' ') OR (len(list_distinct(list_intersect(la, lb))) >= 2 AND (len(list_filter(la, lambda x: NOT list_contains(lb, x))) = 0 OR len(list_filter(lb, lambda x: NOT list_contains(la, x))) = 0)) AS same,
contains(array_to_string(lb, ' '), la[1]) AND contains(array_to_string(lb, ' '), la[-1]) AS mentioned FROM p""")
def name_match(t: Tables) -> DataFrame:
    w = t.part.select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z ]", "").alias("n"))
    other = w.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("n").alias("m"))
    paired = w.withColumnRenamed("p_partkey", "a").join(other, "a")
    return paired.select("a", "b", names.same_person("n", "m").alias("same"), names.mentions(F.lower("m"), "n").alias("mentioned"))
