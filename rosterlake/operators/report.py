"""Delivery projection, summaries and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.text import clean_text, english_words, has_english_residue, number_in, rendered, split_collaboration, string, subdomain_list
from rosterlake.functions.urls import url_list
from rosterlake.operators.filters import is_person


def selection_basis(explicit: Column | str, titles: Column, evidence: list[Column | str], h: Column, citations: Column, relevance: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Why a profile is listed: what is stated, titles, hits in the evidence, high numbers, relevance; the first that holds."""
    none = rules.NO_INFORMATION
    text = F.concat_ws("；", *[string(c) for c in evidence])
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in patterns])) if patterns else F.array().cast("array<string>")
    hits = F.array_distinct(F.slice(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^[ ；。]+|[ ；。]+$", "")), lambda x: x != ""), 1, 3))
    metrics = F.array_compact(F.array(F.when(h >= 30, F.concat(F.lit("H指数约"), h.cast("bigint").cast("string"))), F.when(citations >= 10_000, F.concat(F.lit("总被引次数约"), citations.cast("bigint").cast("string")))))
    stated, titled = clean_text(explicit), clean_text(titles)
    return (
        F.when(stated != none, stated)
        .when(~titled.isin(none, "无"), F.concat(F.lit("因具有可验证的权威头衔、奖项或行业组织身份入选："), titled))
        .when(F.size(hits) > 0, F.concat(F.lit("因公开证据显示其具有重要头衔、奖项、榜单或行业组织身份入选："), F.array_join(hits, "；")))
        .when(F.size(metrics) > 0, F.concat(F.lit("因学术影响力指标突出入选："), F.array_join(metrics, "；")))
        .when(relevance != none, F.concat(F.lit("因其代表成果与目标细分领域直接相关而入选："), relevance))
        .otherwise(none)
    )


#: Delivered column, in order; its source, and what stands there if the source is blank; no source: it is derived.
DELIVERED = (
    ("姓名", "name", None), ("国籍", "nationality", None), ("所在工作机构", "org", None), ("职位", "position", None),
    ("学科领域", None, None), ("细分领域", None, None), ("领域关联依据", None, None), ("工作经历", "career", None),
    ("主要成果", "achievements", None), ("联系方式", "contact", None), ("国内合作学者", None, None), ("国内合作单位", None, None),
    ("入选依据", None, None), ("个人主页", "homepage", None), ("研究兴趣", "interests", None), ("教育背景", "education", None),
    ("性别", "gender", None), ("语言", "languages", None), ("H指数", "h_raw", None), ("G指数", "g_raw", None),
    ("i10指数", "i10_raw", None), ("总被引次数", "citations_raw", None), ("评价_H指数", "h", None), ("评价_总被引次数", "citations", None),
    ("评价_顶级头衔标识", "top_titles", None), ("评价_i10指数", "i10", None), ("评价_TotalScore", "score", None),
    ("成功访问主页", "page_status", "未尝试"), ("主页访问方式", "page_method", "未尝试"), ("主页访问失败原因", "page_error", None),
    ("专家姓名验证", "name_check", "待复核"), ("姓名验证依据", "name_check_why", None), ("独立生存状态核验", "death_check", "未执行"),
    ("生存状态核验依据", "death_check_why", None), ("信息来源", None, None),
)


def delivery(experts: DataFrame, query_domain: str, query_subdomain: str, patterns: tuple[str, ...] = rules.BASIS_PATTERNS) -> DataFrame:
    """The 35 delivered columns, of rows that name a person; columns that a table lacks read as blank. patterns: what counts as a hit in post, achievements and career."""
    have = set(experts.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    subdomains = subdomain_list(clean_text(F.array_join("subdomains", "；") if "subdomains" in have else F.lit(None), query_subdomain))
    sources = url_list(F.concat_ws("；", col("sources")), col("homepage"))
    titles = F.array_join("titles", "、") if "titles" in have else F.lit(None)
    relevance = clean_text(col("relevance"), clean_text(col("achievements")))
    texts = [col("position"), col("achievements"), col("career")]
    sides = split_collaboration(col("collab"))
    derived = {
        "学科领域": clean_text(col("domain"), query_domain),
        "细分领域": rendered(subdomains),
        "领域关联依据": clean_text(col("relevance"), clean_text(col("interests"))),
        "国内合作学者": clean_text(col("scholars"), rendered(sides["scholars"])),
        "国内合作单位": clean_text(col("units"), rendered(sides["units"])),
        "入选依据": selection_basis(col("basis"), titles, texts, number_in(col("h_raw")), number_in(col("citations_raw")), relevance, patterns),
        "信息来源": rendered(sources, fallback="暂无可追溯网页来源"),
    }
    people = experts.where(is_person("name")) if "name" in have else experts
    return people.select(*[(derived[name] if source is None else clean_text(col(source), fallback or rules.NO_INFORMATION)).alias(name) for name, source, fallback in DELIVERED])


def run_summary(experts: DataFrame, items: tuple = rules.RUN_SUMMARY, residue: int | None = None) -> DataFrame:
    """(item, result, remark): the number of rows, and of those whose columns hold the counted values; one pass.

    residue: the number of cells with text in the wrong language, which makes an item of its own.
    """
    have = set(experts.columns)
    count = lambda c, v: F.count("*") if c is None else F.count_if(F.trim(string(c)) == v) if c in have else F.lit(0)
    one = experts.agg(*[count(c, v).cast("bigint").alias(name) for name, c, v, _ in items])
    remarks = F.create_map(*[F.lit(x) for name, _, _, remark in items for x in (name, remark)])
    out = one.unpivot([], [name for name, *_ in items], "item", "result").withColumn("remark", remarks[F.col("item")])
    if residue is None:
        return out
    more = out.sparkSession.range(1).select(F.lit("英文残留单元格").alias("item"), F.lit(residue).cast("bigint").alias("result"), F.lit("").alias("remark"))
    return out.unionByName(more)


def counts_before_after(before: DataFrame, after: DataFrame, field: str) -> DataFrame:
    """(field, before, after, improved) from two long tables of missing fields."""
    b, a = (t.groupBy(field).agg(F.count("*").alias(n)) for t, n in ((before, "before"), (after, "after")))
    joined = b.join(a, field, "full_outer").na.fill(0, ["before", "after"])
    return joined.withColumn("improved", F.col("before") - F.col("after"))


def residue_audit(rows: DataFrame, key: str, columns: list[str], most: int = 12) -> DataFrame:
    """(key, column, n_words, snippet) of cells in the wrong language; one row that says so if there are none.

    Whether there are none is known as soon as one cell is found.
    """
    long = rows.unpivot(key, columns, "column", "value").where(has_english_residue("value"))
    words = english_words("value")
    found = long.select(F.col(key).cast("string").alias(key), "column", F.size(words).alias("n_words"), F.array_join(F.slice(words, 1, most), " ").alias("snippet"))
    none = long.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    said = none.select(F.lit(None).cast("string").alias(key), F.lit("pass").alias("column"), F.lit(0).alias("n_words"), F.lit("").alias("snippet"))
    return found.unionByName(said)


def counters(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """(counter, field, n): the rows of each table by a column."""
    each = [t.groupBy(F.lit(name).alias("counter"), F.col(field).alias("field")).agg(F.count("*").alias("n")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, each)
