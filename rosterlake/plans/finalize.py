"""The merged-table pipeline: clean, filter, merge, enrich, verify, score, balance, deliver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.names import dedupe_key
from rosterlake.functions.text import first_email, homepage_or, subdomain_list
from rosterlake.operators import extract, filters, report, score
from rosterlake.operators.merge import survivorship
from rosterlake.operators.select import balanced_quota
from rosterlake.streaming import streams

from .book import Tables, new_folder, query, scratch
from .log_queries import error_text
from .profile_queries import METRICS_SQL, SCORE_SQL, customer_metrics

NUMERIC = ["h_raw", "i10_raw", "citations_raw"]
COMBINED = ["achievements", "collab", "basis", "relevance", "name_check_why", "death_check_why"]
EVIDENCE = ["interests", "org", "position", "career", "education", "achievements", "basis", "oa_topics", "s2_papers"]


def with_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns that a table lacks, as nulls."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in names if c not in rows.columns}) if any(c not in rows.columns for c in names) else rows


def merge_profiles(rows: DataFrame, key: Column) -> DataFrame:
    others = [c for c in rows.columns if c not in {*NUMERIC, *COMBINED, "row_id", "score", "citations"} and dict(rows.dtypes)[c] == "string"]
    scored = score.with_scores(rows).withColumn("_full", score.completeness(["homepage", "contact", "education", "collab", "oa_id", "s2_id"])).withColumn("row_text", F.col("row_id").cast("string"))
    falling = lambda c: [F.col(c).isNull().alias(f"no_{c}"), (-F.col(c)).alias(c)]
    place = F.struct(*falling("score"), *falling("citations"), (-F.col("_full")).alias("full"), "row_id")
    merged = survivorship(scored, key, place, [c for c in NUMERIC if c in rows.columns], [c for c in COMBINED if c in rows.columns], others)
    return merged.withColumn("row_id", F.col("first.row_id")).drop("first")


def targeted_fill(rows: DataFrame, stages: list[DataFrame], key: str) -> DataFrame:
    """Rows with any gap take what evidence tables (key, fields...) hold for their missing fields, stage by stage; others are left alone."""
    checks = {c: check for c, check in score.profile_checks().items() if any(c in stage.columns for stage in stages)}
    return extract.fill_missing(rows, key, stages, checks) if checks else rows


def finalize(
    rows: DataFrame, query_text: str = "", keep_chinese: bool = False, key: Column | None = None, stages: list[DataFrame] | None = None, stage_key: str = "merge_key", deaths: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """Profiles through the whole chain; stages whose input columns a table lacks see nulls.

    stages: tables of evidence (stage_key and fields of a profile), which fill what is missing after the merge.
    deaths: search results (row_id, pos, title, content, url), which give those a verdict whose check is still open;
    who is found dead goes then. folder: where the merged rows are written, so that later steps start from them.
    """
    text_columns = ["name", "homepage", "contact", "interests", "org", "position", "career", "education", "achievements", "collab", "basis", "relevance", "h_raw", "i10_raw", "g_raw", "citations_raw", "oa_name", "oa_id", "oa_topics", "s2_name", "s2_id", "s2_papers", "page_status", "page_method", "page_error", "death_check", "death_check_why", "life_status", "subdomains_raw", "name_check_why"]
    out = with_columns(rows, text_columns).where(filters.is_person("name"))
    out = out.withColumn("homepage", homepage_or("homepage")).withColumn("contact", first_email("contact")).where(filters.not_deceased("death_check"))
    profile = filters.profile_of(query_text)
    if profile:
        out, _ = filters.domain_mismatches(out, EVIDENCE, profile[2], profile[3])
    if not keep_chinese:
        out = out.where(filters.foreign("org", rules.GREATER_CHINA_MARKERS))
    out = merge_profiles(out, dedupe_key("name") if key is None else key)
    if folder:
        out.write.mode("overwrite").parquet(f"{folder}/merged")
        out = out.sparkSession.read.schema(out.schema).parquet(f"{folder}/merged")
    if stages:
        out = targeted_fill(out, stages, stage_key)
    status = filters.homepage_status("homepage", "page_method", "page_error", "page_status")
    out = out.withColumn("_s", status).withColumns({"page_status": F.col("_s.status"), "page_method": F.col("_s.method")}).drop("_s")
    if deaths is not None:
        out = extract.verify_survival(out, "row_id", "name", deaths).where(filters.not_deceased("death_check"))
    out = filters.with_name_check(out, "name", [("OpenAlex", "oa_name", "oa_id"), ("Semantic Scholar", "s2_name", "s2_id")], "page_status")
    # a mismatch is what the check's text would say; the flag keeps the filter short where it is pushed down
    out = out.where(~F.col("name_mismatch") & filters.confident("relevance", ["org", "position", "relevance", "achievements"])).drop("name_mismatch")
    return score.with_scores(out).withColumn("subdomains", subdomain_list("subdomains_raw"))


NAMED_SQL = "'Ann ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') || 'x'"


@query(f"""WITH c AS (SELECT c_custkey, {NAMED_SQL} AS name, CASE WHEN c_custkey % 3 = 0 THEN 'found' ELSE '暂无公开信息' END AS org, c_custkey % 7 AS said, c_custkey % 11 AS known FROM customer WHERE c_custkey % 13 <> 0 OR c_custkey % 11 = 1)
SELECT name AS "姓名", CASE WHEN c_custkey % 3 = 0 THEN 'found' ELSE '暂无公开信息' END AS "所在工作机构",
CASE WHEN known = 1 THEN '未发现死亡证据' WHEN said = 2 THEN '疑似已故待复核' ELSE '未发现死亡证据' END AS "独立生存状态核验",
CASE WHEN known = 1 THEN 'checked' WHEN said = 2 THEN '单一弱证据待人工核验：' || name || ' died. | https://a.com/p；单一弱证据待人工核验：' || name || ' died. | https://a.com/q' ELSE '独立网页检索未发现同时匹配专家姓名与明确死亡表述的证据' END AS "生存状态核验依据",
CASE WHEN c_custkey % 5 = 0 THEN '因公开证据显示其具有重要头衔、奖项、榜单或行业组织身份入选：He is; a Nobel of note' ELSE '暂无公开信息' END AS "入选依据"
FROM c WHERE known = 1 OR said NOT IN (0, 1)""")
def finalize_delivery(t: Tables) -> DataFrame:
    """The whole chain to delivered columns: filled from evidence, checked for deaths, of which some are sure by title or by two domains and go."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Ann "), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit("x"))
    checked = F.when(k % 11 == 1, "未发现死亡证据").when(k % 13 == 0, "确认已故")
    rows = t.customer.select(k.alias("row_id"), name.alias("name"), checked.alias("death_check"), F.when(k % 11 == 1, "checked").alias("death_check_why"), F.when(k % 5 == 0, "He is; a Nobel of note；more").alias("career"))
    found = t.customer.where("c_custkey % 3 = 0").select(dedupe_key(name).alias("merge_key"), F.lit("found").alias("org"))
    item = lambda pos, title, content, url: F.struct(F.lit(pos).alias("pos"), title.alias("title"), content.alias("content"), F.lit(url).alias("url"))
    plain, died = F.lit("page"), F.concat(name, F.lit(" died."))
    by_title = F.array(item(1, F.concat(F.lit("In memoriam: "), name), plain, "https://a.com/p"))
    two = F.array(item(1, plain, died, "https://a.com/p"), item(2, plain, died, "https://b.com/p"))
    one = F.array(item(1, plain, died, "https://a.com/p"), item(2, plain, died, "https://a.com/q"), item(3, plain, F.lit("Bob died."), "https://b.com/p"))
    said = t.customer.select(k.alias("row_id"), F.explode(F.when(k % 7 == 0, by_title).when(k % 7 == 1, two).when(k % 7 == 2, one)).alias("i")).select("row_id", "i.*")
    done = finalize(rows, stages=[found], deaths=said, folder=new_folder(t, "merged"))
    named = report.delivery(done, "x", "y")
    return named.select("姓名", "所在工作机构", "独立生存状态核验", "生存状态核验依据", "入选依据")


@query(f"""WITH {METRICS_SQL}, r AS (SELECT *, {SCORE_SQL} AS score, c_mktsegment || '|' || (c_custkey // 4) AS k FROM metrics WHERE c_custkey % 10 <> 3),
m AS (SELECT k, arg_min(c_custkey, (-score, c_custkey)) AS c_custkey, c_mktsegment, max(h) AS h, max(citations) AS citations, max(i10) AS i10, count(*) AS n_rows FROM (SELECT *, -score AS s FROM r) GROUP BY k, c_mktsegment),
x AS (SELECT *, round(h + CASE WHEN citations > 0 THEN log10(citations) * 15 ELSE 0 END + i10 * 0.2, 2) AS total FROM m),
seg AS (SELECT c_mktsegment AS grp, row_number() OVER (ORDER BY c_mktsegment) AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer)),
quota AS (SELECT grp, pos, 31 // (SELECT count(*) FROM seg) + CASE WHEN pos <= 31 % (SELECT count(*) FROM seg) THEN 1 ELSE 0 END AS quota FROM seg),
o AS (SELECT x.*, pos, quota, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, k) AS rn FROM x JOIN quota ON grp = c_mktsegment),
p AS (SELECT *, row_number() OVER (ORDER BY rn > quota, CASE WHEN rn <= quota THEN pos END, CASE WHEN rn <= quota THEN rn END, total DESC, k) AS pick FROM o) SELECT k AS name, n_rows, total AS score, pick FROM p WHERE pick <= 31""")
def finalize_pipeline(t: Tables) -> DataFrame:
    """Customers through the whole chain: four neighbours of a segment are one person, every tenth is reported dead."""
    m = customer_metrics(t)
    digits = lambda c: F.col(c).cast("string")
    rows = m.select(
        F.col("c_custkey").alias("row_id"), F.concat_ws("|", "c_mktsegment", F.floor(F.col("c_custkey") / 4).cast("string")).alias("name"), digits("h").alias("h_raw"), digits("citations").alias("citations_raw"), digits("i10").alias("i10_raw"),
        F.col("c_mktsegment").alias("subdomains_raw"), F.when(F.col("c_custkey") % 10 == 3, "确认已故").alias("death_check"), F.lit("MIT").alias("org"),
    )
    done = finalize(rows, key=F.col("name"), folder=new_folder(t, "merged"))
    segments = t.customer.select(F.col("c_mktsegment").alias("grp")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("grp")))
    picked = balanced_quota(done.select("name", "n_rows", "score", "subdomains"), "name", F.col("subdomains"), segments, 31, [("score", True), ("name", False)])
    return picked.select("name", "n_rows", "score", "pick")


@query("SELECT user_id, event_type, min(event_id % 2) AS batch, arg_min(event_id, (event_id % 2, event_id)) AS event_id FROM events GROUP BY 1, 2")
def stream_new_keys(t: Tables) -> DataFrame:
    """Keys of event files in three runs of a stream: even events, then odd ones too, then nothing new."""
    place = new_folder(t, "stream")
    for rest in (0, 1, None):
        if rest is not None:
            t.events.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(f"{place}/in")
        logged = streams.batches(t.spark, f"{place}/in", t.events.schema)
        streams.add_new_keys(logged, ["user_id", "event_type"], [F.asc("event_id")], f"{place}/out", f"{place}/state")
    return t.spark.read.parquet(f"{place}/out").select("user_id", "event_type", F.col("batch").cast("long").alias("batch"), "event_id")


@query("""SELECT CASE WHEN event_type = 'error' THEN 'Tavily 搜索服务' ELSE 'OpenAlex 数据库' END AS error_source, count(*) AS n FROM events GROUP BY 1""")
def stream_errors(t: Tables) -> DataFrame:
    from uuid import uuid4

    place = f"{scratch(t)}/stream-{uuid4().hex}"
    logged = streams.batches(t.spark, t.folder, t.events.schema, pattern="events.parquet")
    streams.run_available(streams.classified(logged, error_text()).select("event_id", "error_source"), f"{place}/out", f"{place}/state")
    return t.spark.read.parquet(f"{place}/out").groupBy("error_source").agg(F.count("*").alias("n"))


