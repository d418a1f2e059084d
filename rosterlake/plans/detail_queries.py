"""Queries of evidence extraction, candidate matching and completion in detail.

Items are documents of a source, in which frequent words are replaced by words that evidence is known by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import names, rules, text, urls
from rosterlake.operators import complete, evidence, extract, match, report, select

from .book import Tables, new_folder, query

#: Frequent words of the texts and what stands in their place.
WORDS = (
    (" the ", " led "), (" and ", " joined "), (" to ", " received "), (" of ", " works on "), (" for ", " Research interests: "), (" with ", " Email: "),
    (" is ", " Career: "), (" on ", " China "), (" das ", " prize "), (" de ", " Education: "), (" la ", " Fellow of the Royal Society "), (" und ", " passed away "),
)
NAME = "That Thin"


def replaced_sql(c: str) -> str:
    for old, new in WORDS:
        c = f"replace({c}, '{old}', '{new}')"
    return c


ITEMS_SQL = f"""it AS (SELECT source AS k, doc_id AS pos, lang AS title, 'https://' || lang || CASE WHEN doc_id % 3 = 0 THEN '.edu' ELSE '.com' END || '/' || doc_id AS url, {replaced_sql("text")} AS content FROM documents)"""
#: Without look-ahead, which this SQL lacks, the word behind a span is taken along; the span is the same.
EMAIL_SQL = "(?:\\s+(?:Education|Email|Phone|Contact|Awards?)\\s*[:：-]|$)"


def items(t: Tables) -> DataFrame:
    content = F.col("text")
    for old, new in WORDS:
        content = F.replace(content, F.lit(old), F.lit(new))
    url = F.concat(F.lit("https://"), "lang", F.when(F.col("doc_id") % 3 == 0, ".edu").otherwise(".com"), F.lit("/"), F.col("doc_id").cast("string"))
    return t.documents.select(F.col("source").alias("k"), F.col("doc_id").alias("pos"), F.col("lang").alias("title"), url.alias("url"), content.alias("content"))


def strip_sql(c: str, marks: str = " 。；;") -> str:
    return f"regexp_replace({c}, '^[{marks}]+|[{marks}]+$', '', 'g')"


def parts_sql(c: str, part: tuple[int, str, int], least: int, most: int) -> str:
    pattern = "[^。；;\\n]{0,%d}(?:%s)[^。；;\\n]{0,%d}" % part
    cut = f"list_filter(list_transform(string_split(regexp_replace({c}, '([。；;.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    found = f"list_transform({cut}, lambda s: {strip_sql(f'''regexp_extract(s, '(?i){pattern}', 0)''', ' 。；;:-')})"
    nav = f"regexp_matches(lower(s), '{'|'.join(rules.NAVIGATION_TERMS)}') OR length(s) - length(replace(s, '|', '')) >= 2"
    return f"list_filter({found}, lambda s: length(s) BETWEEN {least} AND {most} AND NOT ({nav}))"


def label_sql(c: str, label: str) -> str:
    found = f"regexp_extract({c}, '(?i){label}', 1)"
    return f"CASE WHEN {found} <> '' THEN [{strip_sql(found)}] ELSE CAST([] AS VARCHAR[]) END"


def first_sql(candidates: str, n: int, where: str = "true", by: str = "。", name: str = "found") -> str:
    """The first n candidates of each key, by item and place, each once."""
    return f"""x_{name} AS (SELECT k, pos, regexp_replace(title || '{by}' || content, '\\s+', ' ', 'g') AS x, content, title FROM it WHERE {where}),
c_{name} AS (SELECT k, pos, list_slice({candidates}, 1, {n}) AS l FROM x_{name}),
u_{name} AS (SELECT k, pos, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM c_{name}),
n_{name} AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY pos, i) AS rn FROM u_{name}),
d_{name} AS (SELECT k, v, min(rn) AS rn FROM n_{name} WHERE rn <= {n} GROUP BY 1, 2),
{name} AS (SELECT k, string_agg(v, '；' ORDER BY rn) AS found FROM d_{name} GROUP BY 1)"""


def shown(found: DataFrame) -> DataFrame:
    return found.select("k", F.array_join("found", "；").alias("found"))


EDUCATION_SQL = rules.EDUCATION_LABEL.replace("(?=", "(?:")
EVERY_SQL = f"list_filter(list_transform(list_filter(string_split_regex(x, '[。；;\\n]'), lambda s: regexp_matches(s, '(?i){rules.EDUCATION_WORDS}')), lambda s: {strip_sql('s')}), lambda s: length(s) BETWEEN 10 AND 180)"


@query(f"""WITH {ITEMS_SQL}, {first_sql(f"list_concat({label_sql('x', EDUCATION_SQL)}, {EVERY_SQL})", 1)} SELECT * FROM found""")
def education_span(t: Tables) -> DataFrame:
    return shown(extract.education(items(t), "k", "pos", "title", "content"))


BARE_SQL = f"list_transform({parts_sql('x', rules.RESEARCH_PART, 8, 220)}, lambda s: trim(regexp_replace(s, '(?i){rules.RESEARCH_PREFIX}', '')))"


@query(f"""WITH {ITEMS_SQL.replace("source AS k", "CAST(doc_id AS VARCHAR) AS k")}, {first_sql(label_sql('x', rules.RESEARCH_LABEL.replace("(?=", "(?:")), 1, name="said")},
{first_sql(f"list_slice({BARE_SQL}, 1, 1)", 1, name="other")} SELECT coalesce(said.k, other.k) AS k, coalesce(said.found, other.found) AS found FROM said FULL JOIN other ON said.k = other.k""")
def interests_span(t: Tables) -> DataFrame:
    """By document, so that some have no label and fall back to a part of a sentence."""
    return shown(extract.interests(items(t).withColumn("k", F.col("pos").cast("string")), "k", "pos", "title", "content"))


@query(f"""WITH {ITEMS_SQL}, {first_sql(f'''list_concat({label_sql('x', rules.CAREER_LABEL.replace("(?=", "(?:"))}, list_slice({parts_sql('x', rules.CAREER_PART, 8, 240)}, 1, 1))''', 2)} SELECT * FROM found""")
def career_spans(t: Tables) -> DataFrame:
    return shown(extract.career(items(t), "k", "pos", "title", "content"))


MENTION_SQL = "contains(lower({0}), 'that') AND contains(lower({0}), 'thin')"


@query(f"""WITH {ITEMS_SQL}, {first_sql(parts_sql('x', rules.ACHIEVEMENT_PART, 12, 220), 2, MENTION_SQL.format("left(title || ' ' || content, 5000)"), " ")} SELECT * FROM found""")
def achievement_spans(t: Tables) -> DataFrame:
    rows = items(t).withColumn("name", F.lit(NAME))
    return shown(extract.achievements(rows, "k", "pos", "title", "content", "name"))


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT k, pos, lower(title || ' ' || content) AS x FROM it WHERE {MENTION_SQL.format("title || ' ' || content")}),
w AS (SELECT unnest({list(rules.TITLE_KEYWORDS)}) AS w, generate_subscripts({list(rules.TITLE_KEYWORDS)}, 1) AS i),
f AS (SELECT k, w, min((pos, i)) AS at_ FROM x JOIN w ON contains(x, lower(w)) GROUP BY 1, 2) SELECT k, string_agg(w, '、' ORDER BY at_) AS found FROM f GROUP BY 1""")
def title_mentions(t: Tables) -> DataFrame:
    found = extract.titles(items(t).withColumn("name", F.lit(NAME)), "k", "pos", "title", "content", "name")
    return found.select("k", F.array_join("found", "、").alias("found"))


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT k, pos, url, regexp_replace(title || ' ' || content, '\\s+', ' ', 'g') AS x FROM it),
h AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM x WHERE regexp_matches(lower(x), '{"|".join(w.lower() for w in rules.COLLABORATION_TERMS)}'))
SELECT k, '中国合作线索(合作依据: ' || trim(left(x, 120)) || '；来源: ' || url || ')' AS found FROM h WHERE rn = 1""")
def collaboration_snippet(t: Tables) -> DataFrame:
    return extract.collaboration(items(t), "k", "pos", "title", "content", "url")


#: What is said at the end of a text, by its number, and the sentences of it that say a death of the person (none: no death).
SAID = (
    (" That Kay Thin passed away in 2019.", "That Kay Thin passed away in 2019."), (" An obituary for Prof That Thin!", "An obituary for Prof That Thin!"),
    (" He met the late That B. Thin.", None), (" They read of the late That Beth Thin; later.", "They read of the late That Beth Thin;"),
    (" That Thin works. Others died.", None), ("", None), ("。王小明教授于2019年逝世。", "王小明教授于2019年逝世。"), ("。沉痛悼念 王小明 先生", "沉痛悼念 王小明 先生"), ("。王小明很好。某人去世", None),
)
HAN_FROM = 6
#: Words of the items that become the person and a death, so that the texts themselves say some.
DEATH_WORDS = ((" led ", " That le Thin "), (" joined ", " died "), (" prize ", " That le Thin "))


def death_items_sql(c: str) -> str:
    for old, new in DEATH_WORDS:
        c = f"replace({c}, '{old}', '{new}')"
    return c


PERSON = r"\bthat(?:\s+[a-z][a-z.-]*){0,3}\s+thin\b"
DEATH_SQL = "|".join([PERSON + rf".{{0,80}}\b(?:{'|'.join(rules.DEATH_AFTER)})\b", rf"\b(?:{'|'.join(rules.DEATH_BEFORE)})\b.{{0,40}}" + PERSON, r"\bthe late\b.{0,30}" + PERSON])
HAN_DEATH_SQL = f"王小明.{{0,40}}(?:{'|'.join(rules.DEATH_HAN_AFTER)})|(?:{'|'.join(rules.DEATH_HAN_BEFORE)}).{{0,40}}王小明"


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT pos, pos % {len(SAID)} >= {HAN_FROM} AS han, pos % 5 = 0 AS page, pos % 4 = 0 AS titled,
{death_items_sql("content")} || ' .' || {[x for x, _ in SAID]}[1 + pos % {len(SAID)}] AS c FROM it),
s AS (SELECT *, list_filter(string_split(regexp_replace(c, '([。！？.!?;；])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: CASE WHEN han THEN regexp_matches(regexp_replace(lower(s), '\\s+', '', 'g'), '{HAN_DEATH_SQL}') ELSE regexp_matches(lower(s), '{DEATH_SQL}') END) AS l FROM d),
f AS (SELECT *, left(trim(regexp_replace(l[1], '\\s+', ' ', 'g')), 320) AS body, CASE WHEN titled AND NOT han THEN 'In memoriam: That Thin' END AS head FROM s)
SELECT pos, coalesce(head, body) AS snippet, titled OR page AS strong FROM f WHERE coalesce(head, body) IS NOT NULL""")
def survival_items(t: Tables) -> DataFrame:
    """Sentences of whole texts that say a death: words behind and before the name, the late one, titles, Han names; some pages are strong by their address."""
    n = F.col("pos")
    said = F.element_at(F.array(*[F.lit(x) for x, _ in SAID]), (n % len(SAID) + 1).cast("int"))
    title = F.when(n % 4 == 0, "In memoriam: That Thin").otherwise("a page")
    name = F.when(n % len(SAID) >= HAN_FROM, "王小明").otherwise(NAME)
    url = F.concat(F.lit("https://x.com/"), F.when(n % 5 == 0, "obituary/").otherwise(""), n.cast("string"))
    content = F.col("content")
    for old, new in DEATH_WORDS:
        content = F.replace(content, F.lit(old), F.lit(new))
    rows = items(t).withColumns({"title": title, "content": F.concat(content, F.lit(" ."), said), "url": url, "name": name})
    return extract.survival_items(rows, "k", "pos", "title", "content", "url", "name").select("pos", "snippet", "strong")


@query(f"""SELECT doc_id, trim(source) = '' OR regexp_matches(source, '(?i){rules.PLACEHOLDER}') OR regexp_matches(c, '{"|".join(rules.UNPROVED_COLLABORATION)}') AS unproved
FROM (SELECT doc_id, source, source || CASE WHEN doc_id % 3 = 0 THEN {list(rules.UNPROVED_COLLABORATION)}[1 + doc_id % 11] ELSE ' Li Wei' END AS c FROM documents)""")
def unproved_collaboration(t: Tables) -> DataFrame:
    word = F.element_at(text.word_array(rules.UNPROVED_COLLABORATION), (F.col("doc_id") % 11 + 1).cast("int"))
    said = F.concat("source", F.when(F.col("doc_id") % 3 == 0, word).otherwise(" Li Wei"))
    return t.documents.select("doc_id", extract.unproved_collaboration(said).alias("unproved"))


TIER_SQL = "CASE WHEN regexp_matches(url, '\\.edu/') THEN 1 ELSE 3 END"


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT k, pos, url, title, {TIER_SQL} AS tier FROM it WHERE {MENTION_SQL.format("content")}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, pos) AS rn FROM a)
SELECT k, count(*) AS n, string_agg(url, ' | ' ORDER BY rn) AS sources, '[' || string_agg('{{"title":"' || title || '","url":"' || url || '","tier":"' || tier || '"}}', ',' ORDER BY rn) || ']' AS evidence FROM r WHERE rn <= 10 GROUP BY 1""")
def evidence_top_ten(t: Tables) -> DataFrame:
    """The ten best items of a source as JSON, by tier and place, each URL once."""
    rows = items(t).withColumn("name", F.lit(NAME))
    good = evidence.relevant_items(rows, "url", names.mentions("content", "name"), F.lit(True), F.lit(False))
    top = evidence.top_evidence(good, "k", "pos", "url", ["title", "url"], 10)
    return top.select("k", "n", F.array_join("urls", " | ").alias("sources"), "evidence")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT k, url, row_number() OVER (PARTITION BY k ORDER BY {TIER_SQL}, pos) AS rn FROM it) SELECT k, string_agg(url, ' | ' ORDER BY rn) AS sources FROM r WHERE rn <= 5 GROUP BY 1""")
def best_sources(t: Tables) -> DataFrame:
    """The five best URLs of each source of documents."""
    tiered = items(t).select("k", "pos", "url", urls.source_tier("url").alias("tier")).where("tier < 4")
    once = tiered.groupBy("k", "url").agg(F.min("pos").alias("pos"), F.min("tier").alias("tier"))
    best = select.top_n(once, ["k"], [F.asc("tier"), F.asc("pos")], 5)
    return best.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "url"))), lambda x: x["url"]), " | ").alias("sources"))


PAIR_SQL = """e AS (SELECT p_partkey AS row_id, p_name || ' ' || p_type AS n, p_type AS q FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_partkey AS author, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type ELSE 'dr ' || p_name || ' ' || p_type END AS o, p_type AS topics, CAST(p_size AS DOUBLE) AS h, p_retailprice * 100 AS c FROM part WHERE p_partkey % 2 = 1),
s AS (SELECT * FROM e CROSS JOIN r)"""


def pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts of even numbers as people, of odd ones as authors, whose names are shorter, equal or longer."""
    full = F.concat_ws(" ", "p_name", "p_type")
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, full).otherwise(F.concat(F.lit("dr "), full))
    left = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("row_id"), full.alias("n"), F.col("p_type").alias("q"))
    right = t.part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("author"), other.alias("o"), F.col("p_type").alias("topics"), F.col("p_size").cast("double").alias("h"), (F.col("p_retailprice") * 100).alias("c"))
    return left, right


@query(f"""WITH {PAIR_SQL}, v AS (SELECT row_id, author, CASE WHEN lower(n) = lower(o) THEN 1000 WHEN contains(lower(o), lower(n)) OR contains(lower(n), lower(o)) THEN 300 ELSE 0 END AS points, CASE WHEN contains(lower(topics), lower(q)) THEN 10 ELSE 0 END + h + least(c / 10000, 50.0) AS more FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY points + more DESC, author) AS rn FROM v WHERE points > 0) SELECT row_id, author, round(points + more, 4) AS score FROM w WHERE rn = 1""")
def author_match(t: Tables) -> DataFrame:
    """The best author of each name, by an index of name tokens; the SQL looks at all pairs."""
    left, right = pairs(t)
    n, o = F.col("n"), F.col("o")
    points = match.author_score(n, o, F.array(F.lower("q")), F.col("topics"), F.col("h"), F.col("c"))
    got = match.best_by_name(left, right, "row_id", "n", ["q"], "o", ["topics"], match.fame(F.col("h"), F.col("c")), F.col("author"), points, match.name_points(n, o) > 0)
    return got.select("row_id", "author", F.round("score", 4).alias("score"))


@query(f"""WITH {PAIR_SQL}, v AS (SELECT row_id, author, CASE WHEN lower(n) = lower(o) THEN 1000 WHEN contains(lower(o), lower(n)) THEN 250 ELSE 0 END + CASE WHEN author % 3 = 0 AND contains(lower(o) || ' ' || lower(o || ' ' || topics), lower(n)) THEN 200 ELSE 0 END AS points,
 CASE WHEN contains('http://' || lower(topics), lower(q)) THEN 5 ELSE 0 END + h + least(c / 10000, 50.0) AS more FROM s), w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY points + more DESC, author) AS rn FROM v WHERE points > 0) SELECT row_id, author, round(points + more, 4) AS score FROM w WHERE rn = 1""")
def second_author_match(t: Tables) -> DataFrame:
    """The same for the second source, whose short names have a longer one as alias."""
    left, right = pairs(t)
    n, o, aliases = F.col("n"), F.col("o"), F.col("aliases")
    right = right.withColumn("aliases", F.when(F.col("author") % 3 == 0, F.array(o, F.concat_ws(" ", "o", "topics"))))
    points = match.second_author_score(n, o, aliases, F.array(F.col("q")), F.concat(F.lit("http://"), "topics"), F.col("h"), F.col("c"))
    forms = F.concat(F.array(o), F.coalesce(aliases, F.array().cast("array<string>")))
    fits = match.second_name_points(n, o, aliases) > 0
    got = match.best_by_name(left, right, "row_id", "n", ["q"], "o", ["topics", "aliases"], match.fame(F.col("h"), F.col("c")), F.col("author"), points, fits, forms)
    return got.select("row_id", "author", F.round("score", 4).alias("score"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT) AS c, year(l_shipdate) AS y FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_linenumber, 'P' || l_partkey, y) AS rn FROM l)
SELECT l_orderkey, string_agg('P' || l_partkey || '(' || y || ', 未知来源, 引用' || c || ', u' || l_linenumber || ')', '；' ORDER BY rn) AS papers FROM r WHERE rn <= 5 GROUP BY 1""")
def top_papers(t: Tables) -> DataFrame:
    """The five most cited papers of an author as text."""
    paper = F.struct(
        F.col("l_linenumber").alias("at"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("title"), F.year("l_shipdate").alias("year"),
        F.floor("l_quantity").alias("citations"), F.lit(None).cast("string").alias("venue"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("url"),
    )
    listed = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(paper)).alias("p"))
    return listed.select("l_orderkey", match.top_papers(F.col("p")).alias("papers"))


@query("""WITH p AS (SELECT *, CAST(p_size AS BIGINT) * 10 AS own FROM part), v AS (SELECT p_partkey, own, p_name, unnest([p_name, p_name || ' ' || p_type, p_brand]) AS form, unnest([0, 1, 2]) AS at_ FROM p),
c AS (SELECT p_name AS form, p_name AS found, CAST(max(p_size) AS BIGINT) * 11 AS c FROM part GROUP BY 1 UNION ALL SELECT p_name || ' ' || p_type, p_name || ' x', CAST(max(p_size) AS BIGINT) * 12 FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, p_brand, 100000 FROM part GROUP BY 1),
m AS (SELECT p_partkey, own, found, c, row_number() OVER (PARTITION BY p_partkey ORDER BY c DESC, at_) AS rn FROM v JOIN c ON v.form = c.form WHERE contains(found, p_name))
SELECT p_partkey, greatest(own, c) AS citations, found AS matched FROM m WHERE rn = 1""")
def second_pass(t: Tables) -> DataFrame:
    """Parts matched over three forms of their names; the most cited of the same name counts if it is higher."""
    form = lambda c, n, k: t.part.groupBy(c.alias("form")).agg(F.min(n).alias("found"), k.alias("c"))
    long = F.concat_ws(" ", "p_name", "p_type")
    most = F.max("p_size").cast("bigint")
    candidates = form(F.col("p_name"), F.col("p_name"), most * 11).unionByName(form(long, F.concat("p_name", F.lit(" x")), most * 12)).unionByName(form(F.col("p_brand"), F.col("p_brand"), F.lit(100_000).cast("bigint")))
    rows = t.part.select("p_partkey", "p_name", "p_type", "p_brand", (F.col("p_size").cast("bigint") * 10).alias("citations"))
    asked = rows.withColumn("v", F.array(F.col("p_name"), long, F.col("p_brand")))
    best = match.second_pass(asked, candidates, "p_partkey", "p_name", F.col("v"), "form", "found", F.contains(F.col("found"), F.col("p_name")), "c")
    done = match.update_if_higher(rows, best, "p_partkey", {"citations": "c"}, {"matched": "found"}, F.lit(True))
    return done.select("p_partkey", "citations", "matched")


LOCK_SQL = """r AS (SELECT d.doc_id, source, CASE WHEN d.doc_id % 7 = 0 THEN 'Other Person' WHEN d.doc_id % 3 = 0 THEN '暂无' ELSE source END AS oa_name, CASE WHEN d.doc_id % 2 = 0 THEN 'A' || d.doc_id ELSE '' END AS oa_id,
 lang = 'en' AS fits, coalesce(quality = 1, false) AS page_ok, d.doc_id % 3 AS official, CAST(n_chars AS VARCHAR) AS h_raw FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT *, oa_name = 'Other Person' AS wrong, CASE WHEN oa_id = '' THEN 0 ELSE 1 END AS signals FROM r)"""


@query(f"""WITH {LOCK_SQL} SELECT doc_id, CASE WHEN wrong THEN '未通过' WHEN signals > 0 AND (fits OR (page_ok AND official > 0)) THEN '已锁定' ELSE '待复核' END AS lock,
CASE WHEN wrong THEN '数据库匹配姓名与原表不一致：' || oa_name ELSE '同名数据库信号 ' || signals || ' 个；OpenAlex机构' || CASE WHEN fits THEN '匹配' ELSE '未匹配' END || '；机构官方主页证据 ' || official || ' 个；主页' || CASE WHEN page_ok THEN '访问成功' ELSE '未完成有效访问' END END AS lock_why,
CASE WHEN official = 1 THEN '高可信来源优先' ELSE '普通公开来源待复核' END AS source_grade, CASE WHEN wrong THEN '' ELSE h_raw END AS h_raw, CASE WHEN wrong THEN '' ELSE oa_id END AS oa_id FROM k""")
def locked_evidence(t: Tables) -> DataFrame:
    """Whether the numbers of a match may be used; those of another person are emptied."""
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "source", F.when(F.col("doc_id") % 7 == 0, "Other Person").when(F.col("doc_id") % 3 == 0, "暂无").otherwise(F.col("source")).alias("oa_name"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A"), F.col("doc_id").cast("string"))).otherwise("").alias("oa_id"), F.col("n_chars").cast("string").alias("h_raw"), "lang", "quality",
    )
    official = F.col("doc_id") % 3
    got = complete.lock_evidence(rows, "source", ["oa_name"], ["oa_id"], F.col("lang") == "en", F.coalesce(F.col("quality") == 1, F.lit(False)), official, official, ["h_raw", "oa_id"])
    return got.select("doc_id", "lock", "lock_why", "source_grade", "h_raw", "oa_id")


CELLS_SQL = """c AS (SELECT doc_id, unnest(['interests', 'h_raw', 'gender']) AS col, unnest([CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END, CASE WHEN doc_id % 3 = 0 THEN '暂无' ELSE '5' END, '-']) AS value, doc_id % 2 = 0 AS locked FROM documents),
e AS (SELECT doc_id, unnest(['topics', 'page', 'h']) AS field, unnest([CASE WHEN doc_id % 5 = 0 THEN 'search results' ELSE 'topic ' || source END, 'page ' || lang, CAST(n_chars AS VARCHAR)]) AS v FROM documents),
p AS (SELECT c.doc_id, col, CASE WHEN col = 'interests' THEN CASE WHEN doc_id % 5 = 0 THEN 'page ' || lang ELSE 'topic ' || source END ELSE CAST(n_chars AS VARCHAR) END AS value
 FROM c JOIN documents d USING (doc_id) WHERE (value IN ('', '暂无', '-')) AND col IN ('interests', 'h_raw') AND locked AND (col = 'h_raw' OR doc_id % 6 <> 0))"""


def cells(t: Tables) -> DataFrame:
    three = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("interests"), F.when(F.col("doc_id") % 3 == 0, "暂无").otherwise("5").alias("h_raw"), F.lit("-").alias("gender")
    )
    return three.unpivot("doc_id", ["interests", "h_raw", "gender"], "column", "value")


def proposals(t: Tables) -> DataFrame:
    blank = cells(t).where(text.cell_placeholder("value")).select("doc_id", "column", F.col("column").alias("role"))
    topic = F.when(F.col("doc_id") % 5 == 0, "search results").otherwise(F.concat(F.lit("topic "), "source"))
    wide = t.documents.select("doc_id", topic.alias("topics"), F.concat(F.lit("page "), "lang").alias("page"), F.col("n_chars").cast("string").alias("h"))
    found = wide.unpivot("doc_id", ["topics", "page", "h"], "field", "value")
    roles = t.spark.createDataFrame([("interests", "topics", 1), ("interests", "page", 2), ("h_raw", "h", 1)], "role string, field string, prio int")
    none = F.array().cast("array<string>")
    pages = F.when(F.col("doc_id") % 6 == 0, none).otherwise(F.array(F.lit("https://a.edu/p")))
    state = t.documents.select("doc_id", (F.col("doc_id") % 2 == 0).alias("locked"), pages.alias("official"), none.alias("index_urls"))
    return complete.supported_proposals(blank, found, roles, state, "doc_id")


@query(f"WITH {CELLS_SQL} SELECT doc_id, col AS \"column\", value, CASE WHEN col = 'interests' THEN 'https://a.edu/p' END AS hints FROM p")
def supported_fill(t: Tables) -> DataFrame:
    """What evidence proposes for blank cells: good enough, with a lock, stories with a source."""
    return proposals(t).select("doc_id", "column", "value", F.array_join("hints", " | ").alias("hints"))


AUDIT_SQL = f"""{CELLS_SQL}, f AS (SELECT c.doc_id, c.col, p.value IS NOT NULL AS filled, p.value FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND c.col = p.col),
n AS (SELECT doc_id, count(CASE WHEN filled THEN 1 END) AS n FROM f GROUP BY 1)"""


@query(f"""WITH {AUDIT_SQL} SELECT n.doc_id, CASE WHEN n.doc_id % 3 = 0 THEN '未找到可写入的中高可信公开来源 URL' ELSE 'https://a.edu/' || source END AS sources,
'身份' || CASE WHEN n.doc_id % 2 = 0 THEN '已锁定' ELSE '待复核' END || '；字段级验证通过 ' || n || ' 项' AS status, '本次补全 ' || n || ' 个空白字段；生存状态：待核验；原有非空单元格未被覆盖。' AS remark FROM n JOIN documents USING (doc_id)""")
def completion_columns(t: Tables) -> DataFrame:
    new = proposals(t)
    filled = complete.write_back(cells(t), new, "doc_id")
    sources = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://a.edu/"), "source"))
    known = t.documents.select("doc_id", sources.alias("sources"), F.when(F.col("doc_id") % 2 == 0, "已锁定").alias("lock"), F.lit(None).cast("string").alias("life_status"))
    return complete.audit_columns(filled, known, new.select("doc_id", "column"), "doc_id")


@query(f"""WITH {AUDIT_SQL} SELECT doc_id, source AS name, col AS "column", value, '通过字段级证据闸门' AS verdict, CASE WHEN col = 'interests' THEN 'https://a.edu/p' ELSE '' END AS sources, CASE WHEN doc_id % 4 = 0 THEN '已锁定' ELSE '待复核' END AS lock FROM f JOIN documents USING (doc_id) WHERE filled""")
def completion_details(t: Tables) -> DataFrame:
    new = proposals(t)
    filled = complete.write_back(cells(t), new, "doc_id")
    known = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "已锁定").alias("lock"))
    return complete.detail_rows(filled, t.documents.select("doc_id", F.col("source").alias("name")), new.select("doc_id", "column", F.col("hints").alias("urls")), known, "doc_id")


@query(f"WITH {AUDIT_SQL} SELECT count(*) AS total_rows, count(CASE WHEN n > 0 THEN 1 END) AS completed_rows, CAST(sum(n) AS BIGINT) AS filled_cells FROM n")
def completion_totals(t: Tables) -> DataFrame:
    return complete.completion_totals(complete.write_back(cells(t), proposals(t), "doc_id"), "doc_id")


STAGES_SAID = ("done", "skipped: no nowhere", "skipped: UNRESOLVED_COLUMN.WITH_SUGGESTION", "failed: USER_RAISED_EXCEPTION", "done")


@query(f"""SELECT doc_id, lang || '+' AS a, CASE WHEN quality IS NULL THEN lang || '+' ELSE lang || '+' || quality END AS b, '{";".join(STAGES_SAID)}' AS said FROM documents LEFT JOIN labels USING (doc_id)""")
def stage_fall_through(t: Tables) -> DataFrame:
    """A chain of stages of which three cannot be used: one lacks a table, one a column, and one fails in a task, at a single row."""
    last = t.documents.agg(F.max("doc_id")).first()[0]
    broken = F.when(F.col("doc_id") == last, F.raise_error(F.lit("this row cannot be worked on"))).otherwise(F.lit("broken"))
    stages = [
        ("mark", lambda rows: rows.withColumn("a", F.concat("lang", F.lit("+"))), []),
        ("absent table", lambda rows, other: rows.join(other, "doc_id"), ["nowhere"]),
        ("absent column", lambda rows: rows.withColumn("a", F.col("no_such_column")), []),
        ("broken row", lambda rows: rows.withColumn("a", broken), []),
        ("labels", lambda rows, labels: rows.join(labels, "doc_id", "left").withColumn("b", F.concat("a", F.coalesce(F.col("quality").cast("string"), F.lit("")))), ["labels"]),
    ]
    rows, said = complete.run_stages(t.documents.select("doc_id", "lang"), stages, {"labels": t.labels}, new_folder(t, "stages"))
    return rows.select("doc_id", "a", "b", F.lit(";".join(said.values())).alias("said"))


BOTH_SQL = """b AS (SELECT doc_id, lang, source, regexp_replace(text, '[0-9_]', ' ', 'g') AS text FROM documents), u AS (SELECT doc_id, 'text' AS col, text AS v FROM b UNION ALL SELECT doc_id, 'source', regexp_replace(source, '[0-9]', ' ', 'g') || ' 大学 a university of note' FROM b),
w AS (SELECT doc_id, col, v, regexp_extract_all(regexp_replace(regexp_replace(v, 'https?://\\S+', ' ', 'g'), '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '[A-Za-z][A-Za-z-]{2,}') AS l FROM u),
x AS (SELECT *, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(v, '[^A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g')) AS meant FROM w)"""


@query(f"WITH {BOTH_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, col AS \"column\", len(l) AS n_words, array_to_string(list_slice(l, 1, 12), ' ') AS snippet FROM x WHERE len(l) >= 4 OR (len(l) >= 2 AND meant > 0 AND latin / meant >= 0.35)")
def residue_cells(t: Tables) -> DataFrame:
    """Cells of two columns that are in English, with their first words."""
    rows = t.documents.select("doc_id", F.regexp_replace("text", "[0-9_]", " ").alias("text"), F.concat(F.regexp_replace("source", "[0-9]", " "), F.lit(" 大学 a university of note")).alias("source"))
    return report.residue_audit(rows, "doc_id", ["text", "source"])


CITED_SQL = """c AS (SELECT doc_id, n_chars, replace(replace(text, ' the ', ' 1,234 citations '), ' de ', ' cited 77 ') AS x FROM documents),
m AS (SELECT *, list_concat(regexp_extract_all(x, '(?i)(\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:次)?\\s*(?:引用|被引|citations?|cited)', 1), regexp_extract_all(x, '(?i)(?:引用|被引|被引用|citations?|cited)\\s*(\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:次)?', 1)) AS l FROM c)"""


@query(f"""WITH {CITED_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND n_chars > 0 THEN CAST(n_chars AS DOUBLE) ELSE coalesce(list_max(list_transform(l, lambda v: TRY_CAST(regexp_extract(replace(v, ',', ''), '\\d+(?:\\.\\d+)?', 0) AS DOUBLE))), 0.0) END AS citations FROM m""")
def citation_estimate(t: Tables) -> DataFrame:
    """Citations from the first of six columns that has a number, else from what texts say."""
    from rosterlake.operators import score

    said = F.replace(F.replace("text", F.lit(" the "), F.lit(" 1,234 citations ")), F.lit(" de "), F.lit(" cited 77 "))
    none = F.lit(None).cast("string")
    six = {f"c{k}": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")) if k == 3 else none for k in range(6)}
    rows = t.documents.select("doc_id", said.alias("x"), *[c.alias(n) for n, c in six.items()])
    return rows.select("doc_id", score.citation_estimate(list(six), ["x"]).alias("citations"))


@query("""WITH r AS (SELECT lower(trim(lang)) || '|' || lower(trim(source)) AS bundle_key, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) SELECT bundle_key, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS found FROM r WHERE rn <= 8 GROUP BY 1""")
def person_bundles(t: Tables) -> DataFrame:
    """The first eight items of each pair of language and source."""
    got = evidence.bundles(t.documents, "lang", "source", "doc_id", ["doc_id", "lang"])
    return got.select("bundle_key", F.array_join(F.transform("items", lambda x: x["doc_id"].cast("string")), ",").alias("found"))


@query("""SELECT p_name AS name, min(p_partkey) AS place FROM part WHERE list_contains([p_type, p_brand], 'SMALL') AND trim(p_name) <> '' GROUP BY 1""")
def subdomain_names(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("groups"), "p_partkey")
    return match.group_members(rows, F.lit("SMALL"), "groups", "name", "p_partkey")


@query("""WITH r AS (SELECT p_partkey, p_name, i, '| ' || p_name || ' | ' || i || ' |' AS line FROM part, (SELECT unnest([1, 2]) AS i)) SELECT p_partkey, 1 AS row, 'name,n' AS cells FROM part UNION ALL SELECT p_partkey, i + 2, p_name || ',' || i FROM r""")
def markdown_block(t: Tables) -> DataFrame:
    """The first block of bars in a text that has a second one."""
    body = F.concat(F.lit("intro\n| name | n |\n| --- | :-: |\n| "), "p_name", F.lit(" | 1 |\n| "), "p_name", F.lit(" | 2 |\nend\n| other | table |"))
    from rosterlake.sources import tables

    return tables.first_block(t.part.select("p_partkey", body.alias("x")), "p_partkey", "x").select("p_partkey", "row", F.array_join("cells", ",").alias("cells"))


@query("""WITH d AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 3 <> 0),
p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'Fellow ' || source WHEN quality = 0 THEN source END AS post, CASE WHEN toxic IS NOT NULL THEN lang END AS field, doc_id % 5 = 0 AS poor FROM d),
s AS (SELECT *, CASE WHEN post IS NOT NULL AND NOT poor THEN ['https://p.edu/' || doc_id] ELSE CAST([] AS VARCHAR[]) END AS pu, CASE WHEN field IS NOT NULL THEN ['https://f.org/' || doc_id] ELSE CAST([] AS VARCHAR[]) END AS fu FROM p)
SELECT doc_id, 'why' AS "column", CASE WHEN post IS NOT NULL AND field IS NOT NULL THEN '现任' || post || '，研究聚焦' || field || '，具有明确的领域相关性与专业代表性。' WHEN post IS NOT NULL THEN '现任' || post || '，具有可核验的专业任职与领域代表性。' ELSE '长期研究' || field || '，与目标领域具有明确关联。' END AS value,
array_to_string(list_concat(pu, fu), ' | ') AS urls FROM s WHERE len(list_concat(pu, fu)) > 0 UNION ALL SELECT doc_id, 'mark', '是', array_to_string(pu, ' | ') FROM s WHERE post LIKE 'Fellow %' AND len(pu) > 0""")
def derived_reasons(t: Tables) -> DataFrame:
    """Reasons and top marks that follow from accepted posts and interests of locked rows."""
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("k", F.col("doc_id").cast("string"))
    post = F.when(F.col("quality") == 1, F.concat(F.lit("Fellow "), "source")).when(F.col("quality") == 0, F.col("source"))
    page = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://p.com/"), "k")).otherwise(F.concat(F.lit("https://p.edu/"), "k"))
    posts = rows.select("doc_id", F.lit("post").alias("column"), F.lit("position").alias("role"), post.alias("value"), F.array(page).alias("urls"))
    field = F.when(F.col("toxic").isNotNull(), F.col("lang"))
    fields = rows.select("doc_id", F.lit("field").alias("column"), F.lit("interests").alias("role"), field.alias("value"), F.array(F.concat(F.lit("https://f.org/"), "k")).alias("urls"))
    accepted = posts.unionByName(fields).where("value is not null")
    blank = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("why").alias("column"), F.lit("basis").alias("role")), F.struct(F.lit("mark").alias("column"), F.lit("top").alias("role")))).alias("b"))
    got = complete.derived_cells(accepted, blank.select("doc_id", "b.column", "b.role"), rows.where("doc_id % 3 <> 0"), "doc_id")
    return got.select("doc_id", "column", "value", F.array_join("urls", " | ").alias("urls"))
