"""Table completion in long form: blank cells, proposals, gates, derived fields, write-back and audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.names import same_person
from rosterlake.functions.text import HAN, cell_placeholder, clip, string
from rosterlake.functions.urls import domain, official_profile, source_tier
from rosterlake.operators.joins import small

#: Roles whose values tell a story.
NARRATIVE = ("org", "position", "interests", "career", "education", "achievements", "collab", "basis", "relevance")
# Degrees alone, words of schools, signs of a broken text.
DEGREE_ONLY = r"(?i)^(?:博士|硕士|学士|医学博士|哲学博士|博士学位|硕士学位|学士学位|ph\.?d\.?|m\.?d\.?)$"
SCHOOL = r"(?i)大学|学院|学校|研究所|医学院|医院|培训|博士后|university|college|school|institute|academy|hospital|medical center|postdoc"
BROKEN = r"(?i)(?:\.\.\.|…)$|error sending|connection error|operation timed out|search results?"


def low_quality(role: Column, value: Column | str, narrative: Sequence[str] = NARRATIVE) -> Column:
    """Placeholders, cut or failed texts, degrees without a school, thin reasons, stories mostly in Latin letters."""
    text = F.trim(F.regexp_replace(string(value), r"\s+", " "))
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    thin = (han < 18) | text.rlike(r"(?i)(?:National Academy|Academy|Fellow|award|prize)\s*$")
    return (
        cell_placeholder(text) | text.rlike(BROKEN)
        | ((role == "education") & (text.rlike(DEGREE_ONLY) | ~text.rlike(SCHOOL)))
        | ((role == "basis") & thin)
        | (role.isin(*narrative) & (latin >= 30) & (han < 6))
    )


def cited(urls: Column, known: Column, below: int = 4, most: int = 3) -> Column:
    """Trusted URLs in order, each once, cut to the first few, and only then to those known for the row."""
    trusted = F.array_distinct(F.filter(urls, lambda u: source_tier(u) < below))
    return F.filter(F.slice(trusted, 1, most), lambda u: F.array_contains(known, u))


def gate(rows: DataFrame, high_risk: Sequence[str] = ("h_raw", "basis", "life_status"), titled: Sequence[str] = ("basis", "life_status"), sensitive: Sequence[str] = ("gender",), narrative: Sequence[str] = NARRATIVE) -> DataFrame:
    """Adds ``urls`` (those that count) and ``reason`` (null where a proposal passes).

    rows: (role, value, source_urls, known_urls, locked, homepage, homepage_ok, stated), one for each
    proposed cell; ``stated``: the source says a sensitive value outright.
    """
    counted = rows.withColumn("urls", cited(F.col("source_urls"), F.col("known_urls")))
    some_good = F.exists("urls", lambda u: source_tier(u) <= 2)
    all_good = F.forall("urls", lambda u: source_tier(u) <= 2)
    host = domain("homepage")
    own_page = F.col("homepage_ok") & F.exists("urls", lambda u: (domain(u) == host) & (host != ""))
    role = F.col("role")
    reason = (
        F.when(low_quality(role, "value", narrative), "low quality")
        .when(F.size("urls") == 0, "no source that counts")
        .when(role.isin(*high_risk) & ~F.col("locked"), "identity is not locked")
        .when(role.isin(*narrative) & ~F.col("locked") & ~some_good & ~own_page, "narrative without an authority or verified page")
        .when(role.isin(*sensitive) & ~all_good, "sensitive value without authorities")
        .when(role.isin(*sensitive) & ~F.col("stated"), "sensitive value is not stated")
        .when(role.isin(*titled) & ~some_good, "title without an authority")
    )
    return counted.withColumn("reason", reason)


def stated_in_cited(items: str, urls: str, pattern: Column) -> Column:
    """Whether one of the cited items matches. items: array<struct<url, text>>."""
    return F.exists(items, lambda i: F.array_contains(F.col(urls), i["url"]) & F.regexp_like(F.lower(i["text"]), pattern))


def identity_lock(name_fits: Column, ids: Column, institution_fits: Column, page_ok: Column, official_page: Column) -> Column:
    """Mismatching names fail; an id with a fitting institution or a verified official page locks."""
    return F.when(~name_fits, "未通过").when((ids > 0) & (institution_fits | (page_ok & official_page)), "已锁定").otherwise("待复核")


def lock_evidence(
    rows: DataFrame, source_name: str, matched: list[str], ids: list[str], institution_fits: Column, page_ok: Column, official_pages: Column, best_tier: Column, blanked: list[str]
) -> DataFrame:
    """Adds ``lock``, ``lock_why`` and ``source_grade``; where a matched name is not the row's, the ``blanked`` columns are emptied.

    matched: names that databases gave; ids: their author ids; official_pages: number of official profile URLs;
    best_tier: the best trust tier of the row's sources.
    """
    wrong = F.array_compact(F.array(*[F.when(~cell_placeholder(c) & ~same_person(source_name, c), string(c)) for c in matched]))
    signals = reduce(lambda a, c: a + F.when(cell_placeholder(c), 0).otherwise(1), ids, F.lit(0))
    failed = F.size("_wrong") > 0
    lock = identity_lock(~failed, F.col("_signals"), institution_fits, page_ok, official_pages > 0)
    said = F.concat(
        F.lit("同名数据库信号 "), F.col("_signals").cast("string"), F.lit(" 个；OpenAlex机构"), F.when(institution_fits, "匹配").otherwise("未匹配"), F.lit("；机构官方主页证据 "),
        official_pages.cast("string"), F.lit(" 个；主页"), F.when(page_ok, "访问成功").otherwise("未完成有效访问"),
    )
    out = rows.withColumn("_wrong", wrong).withColumn("_signals", signals)
    out = out.withColumn("lock", lock).withColumn("lock_why", F.when(failed, F.concat(F.lit("数据库匹配姓名与原表不一致："), F.array_join("_wrong", "、"))).otherwise(said))
    out = out.withColumn("source_grade", F.when(best_tier == 1, "高可信来源优先").otherwise("普通公开来源待复核"))
    return out.withColumns({c: F.when(failed, F.lit("")).otherwise(F.col(c)) for c in blanked}).drop("_wrong", "_signals")


def claim_kept(claim: Column, locked: Column, institution_fits: Column, official_domains: Column, dated: Column) -> Column:
    """A claim of death stays only with a lock, the institution, two official domains and a date."""
    return claim & locked & institution_fits & (F.size(F.array_distinct(official_domains)) >= 2) & dated


def settle_claim(rows: DataFrame, check: str, said: str, status: str, locked: Column, institution_fits: Column, confirmed: str = "确认已故", date: str = rules.DEATH_DATE) -> DataFrame:
    """Rows whose claim of a death is not upheld have the check open again, no status, and what was said marked as refused.

    A claim needs a lock, the institution, a date or an age in what is said, and two official domains there.
    """
    urls = F.transform(F.regexp_extract_all(string(said), F.lit(r"https?://[^\s；;,，)）|]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.。:：!?！？)）]+$", ""))
    official = F.transform(F.filter(urls, official_profile), domain)
    kept = claim_kept(F.trim(string(check)) == confirmed, locked, institution_fits, official, string(said).rlike(f"(?i){date}"))
    refused = (F.trim(string(check)) == confirmed) & ~F.coalesce(kept, F.lit(False))
    new = {check: F.lit(rules.CLAIM_OPEN), status: F.lit(""), said: F.concat(F.lit(rules.CLAIM_REFUSED), string(said))}
    return rows.withColumn("_refused", refused).withColumns({c: F.when(F.col("_refused"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_refused")


def missing_groups(cells: DataFrame, key: str, groups: dict[str, str]) -> DataFrame:
    """(key, one flag for each group): whether a blank cell's header is of the group."""
    blank = cells.where(cell_placeholder("value"))
    return blank.groupBy(key).agg(*[F.bool_or(F.col("header").rlike(p)).alias(g) for g, p in groups.items()])


def direct_proposals(blank: DataFrame, evidence: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """(key, column, value): the first evidence field, by priority, with a value for a blank cell.

    blank: (key, column); roles: (column, field, prio), few rows; evidence: (key, field, value).
    """
    wanted = blank.join(small(roles), "column")
    found = wanted.join(evidence.where(~cell_placeholder("value")).hint("merge"), [key, "field"])
    return found.groupBy(key, "column").agg(F.min_by("value", "prio").alias("value"))


def supported_proposals(
    blank: DataFrame,
    evidence: DataFrame,
    roles: DataFrame,
    state: DataFrame,
    key: str,
    needs_lock: Sequence[str] = ("h_raw",),
    indexed: Sequence[str] = ("interests", "relevance", "achievements", "basis"),
    narrative: Sequence[str] = NARRATIVE,
    size: int = 1800,
) -> DataFrame:
    """(key, column, value, hints): direct proposals that hold up: good enough, locked where that is needed, stories with a source.

    blank: (key, column, role); roles: (role, field, prio), few rows; state: (key, locked, official, index_urls), the
    official profile URLs and those of publication indexes in order. Stories carry up to three sources as hints.
    """
    role = F.col("role")
    wanted = blank.join(small(roles), "role")
    found = wanted.join(evidence.hint("merge"), [key, "field"]).join(state.hint("merge"), key)
    hints = F.slice(F.array_distinct(F.when(role.isin(*indexed), F.concat("official", "index_urls")).otherwise(F.col("official"))), 1, 3)
    story = role.isin(*narrative)
    good = ~cell_placeholder("value") & ~low_quality(role, "value", narrative) & (~role.isin(*needs_lock) | F.col("locked")) & (~story | (F.col("locked") & (F.size("hints") > 0)))
    kept = found.withColumn("hints", hints).where(good)
    best = F.min_by(F.struct(clip("value", size).alias("value"), F.when(story, F.col("hints")).alias("hints")), "prio").alias("_b")
    return kept.groupBy(key, "column").agg(best).select(key, "column", "_b.value", "_b.hints")


def merge_proposals(key: str, *rounds: DataFrame) -> DataFrame:
    """(key, column, value, prio): of several rounds, the first listed counts for a cell."""
    tagged = [r.select(key, "column", "value", F.lit(n).alias("prio")) for n, r in enumerate(rounds)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "column").orderBy("prio", "value"))).where("_rn = 1").drop("_rn")


def valid_proposals(proposals: DataFrame, blank: DataFrame, key: str) -> DataFrame:
    """Proposals for cells that are blank, with a value that is good enough (of a ``role``, if they have one); clipped."""
    role = F.col("role") if "role" in proposals.columns else F.lit("")
    good = proposals.where(~cell_placeholder("value") & ~low_quality(role, "value")).withColumn("value", F.left(F.trim(F.col("value")), F.lit(2000)))
    return good.join(blank.select(key, "column").distinct(), [key, "column"], "left_semi")


def correct(accepted: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Accepted cells with the corrected value where there is one that is good enough (for their ``role``, if they have one)."""
    role = F.col("role") if "role" in accepted.columns else F.lit("")
    new = corrections.select(key, "column", F.col("value").alias("_new"))
    joined = accepted.join(new.hint("merge"), [key, "column"], "left")
    good = ~cell_placeholder("_new") & ~low_quality(role, "_new")
    return joined.withColumn("value", F.when(good, F.col("_new")).otherwise(F.col("value"))).drop("_new")


def write_back(cells: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """Cells with ``filled``: only blank ones take a new value."""
    joined = cells.join(final.select(key, "column", F.col("value").alias("_new")).hint("merge"), [key, "column"], "left")
    fill = cell_placeholder("value") & ~cell_placeholder("_new")
    return joined.withColumn("filled", fill).withColumn("value", F.when(fill, F.col("_new")).otherwise(F.col("value"))).drop("_new")


def audit(filled: DataFrame, key: str) -> DataFrame:
    """(key, n_filled, columns, note) for each row."""
    some = F.count_if("filled")
    listed = F.array_join(F.sort_array(F.collect_list(F.when(F.col("filled"), F.col("column")))), "、")
    return filled.groupBy(key).agg(some.alias("n_filled"), listed.alias("columns"), F.when(some > 0, "completed").otherwise("unchanged").alias("note"))


def audit_columns(filled: DataFrame, evidence: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """(key, sources, status, remark): the three audit columns of each row.

    evidence: (key, sources, lock, life_status); accepted: (key, column), the cells that passed the gates.
    """
    counts = filled.groupBy(key).agg(F.count_if("filled").alias("n_filled"))
    passed = accepted.groupBy(key).agg(F.count("*").alias("n_passed"))
    joined = counts.join(evidence, key, "left").join(passed, key, "left")
    text = lambda c, other: F.when(string(c) == "", F.lit(other)).otherwise(string(c))
    n = F.coalesce("n_passed", F.lit(0)).cast("string")
    status = F.concat(F.lit("身份"), text("lock", "待复核"), F.lit("；字段级验证通过 "), n, F.lit(" 项"))
    remark = F.concat(F.lit("本次补全 "), F.col("n_filled").cast("string"), F.lit(" 个空白字段；生存状态："), text("life_status", "待核验"), F.lit("；原有非空单元格未被覆盖。"))
    return joined.select(key, text("sources", "未找到可写入的中高可信公开来源 URL").alias("sources"), status.alias("status"), remark.alias("remark"))


def detail_rows(filled: DataFrame, names: DataFrame, cited: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, name, column, value, verdict, sources, lock) of every filled cell. cited: (key, column, urls)."""
    rows = filled.where("filled").join(names, key, "left").join(cited, [key, "column"], "left").join(evidence.select(key, "lock"), key, "left")
    urls = F.array_join(F.slice(F.coalesce("urls", F.array().cast("array<string>")), 1, 3), " | ")
    lock = F.when(string("lock") == "", "待复核").otherwise(F.col("lock"))
    return rows.select(key, "name", "column", "value", F.lit("通过字段级证据闸门").alias("verdict"), urls.alias("sources"), lock.alias("lock"))


def completion_totals(filled: DataFrame, key: str) -> DataFrame:
    """(total_rows, completed_rows, filled_cells)."""
    rows = filled.groupBy(key).agg(F.count_if("filled").alias("n"))
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(F.col("n") > 0).alias("completed_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("filled_cells"))


def completed_tables(cells: DataFrame, final: DataFrame, names: DataFrame, evidence: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables that a completion delivers: all cells, three audit columns of each row, every filled cell, and totals.

    final: (key, column, value, urls), what passed the gates; names: (key, name); evidence: (key, sources, lock, life_status).
    """
    filled = write_back(cells, final, key)
    return {
        "completed": filled.drop("filled"),
        "audit": audit_columns(filled, evidence, final.select(key, "column"), key),
        "details": detail_rows(filled, names, final.select(key, "column", "urls"), evidence, key),
        "totals": completion_totals(filled, key),
    }


def run_stages(
    rows: DataFrame, stages: Sequence[tuple[str, Callable[..., DataFrame], Sequence[str]]], tables: dict[str, DataFrame], folder: str
) -> tuple[DataFrame, dict[str, str]]:
    """Stages ``(name, function, names of its tables)`` one behind the other, each written to ``folder`` and read again.

    A stage whose tables or columns are missing, or that fails while it runs, leaves the rows as the stage before
    wrote them; what a broken stage has written is not read. Returns the rows and what became of each stage:
    ``done``, ``skipped: ...`` or ``failed: ...``.
    """
    spark, said = rows.sparkSession, {}
    for n, (name, stage, needed) in enumerate(stages):
        missing = [t for t in needed if t not in tables]
        if missing:
            said[name] = f"skipped: no {', '.join(missing)}"
            continue
        path = f"{folder.rstrip('/')}/{n:02d}"
        try:
            found = stage(rows, *[tables[t] for t in needed])
            found.write.mode("overwrite").parquet(path)
            rows, said[name] = spark.read.schema(found.schema).parquet(path), "done"
        except AnalysisException as e:  # a column is missing
            said[name] = f"skipped: {e.getCondition()}"
        except (PySparkException, Py4JJavaError) as e:  # a task failed as often as it may
            said[name] = f"failed: {getattr(e, 'getCondition', lambda: None)() or type(e).__name__}"
    return rows, said


def derived_sentences(accepted: DataFrame, key: str, template: str, roles: list[str]) -> DataFrame:
    """(key, value): a sentence from accepted fields, for rows that have them all."""
    wide = accepted.groupBy(key).agg(*[F.max(F.when(F.col("column") == r, F.col("value"))).alias(r) for r in roles])
    return wide.dropna(subset=roles).select(key, F.format_string(template, *[F.col(r) for r in roles]).alias("value"))


#: Words of the highest honours, and the sentences that follow from a post and from interests.
HONOURS = r"(?i)院士|国家科学院|国家医学院|诺贝尔|图灵奖|Gruber|National Academy|Nobel|Turing|\bFellow\b|\bPrize\b|\bMedal\b"
REASONS = ("现任%s，研究聚焦%s，具有明确的领域相关性与专业代表性。", "现任%s，具有可核验的专业任职与领域代表性。", "长期研究%s，与目标领域具有明确关联。")


def derived_cells(accepted: DataFrame, blank: DataFrame, locked: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, column, value, urls): reasons and top marks that follow from accepted cells, for blank cells of locked rows.

    accepted: (key, column, role, value, urls); blank: (key, column, role), roles ``basis`` and ``top``; locked: (key).
    A reason follows from an accepted post or interests, a mark from another mark or from the words of an honour;
    both need a source of tier 2 or better, and carry up to three.
    """
    good = F.filter("urls", lambda u: source_tier(u) <= 2)
    of = lambda role: F.col("role") == role
    marked = of("top") & (F.trim("value") == "是") & (F.size("urls") > 0)
    ordered = lambda when, urls: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("column", urls.alias("u"))))), lambda x: x["u"])))
    wide = accepted.join(locked.select(key).distinct().hint("merge"), key, "left_semi").groupBy(key).agg(
        F.max(F.when(of("position"), F.col("value"))).alias("post"), F.max(F.when(of("interests"), F.col("value"))).alias("field"),
        F.max(F.when(of("position"), good)).alias("post_urls"), F.max(F.when(of("interests"), good)).alias("field_urls"),
        F.slice(F.min_by(F.when(marked, F.col("urls")), F.when(marked, F.col("column"))), 1, most).alias("mark_urls"),
        F.slice(ordered(F.col("value").rlike(HONOURS), good), 1, most).alias("honour_urls"),
    )
    none = F.array().cast("array<string>")
    support = F.slice(F.array_distinct(F.concat(F.coalesce("post_urls", none), F.coalesce("field_urls", none))), 1, most)
    both, post, field = (F.format_string(r, *[F.col(c) for c in names]) for r, names in zip(REASONS, (("post", "field"), ("post",), ("field",)), strict=True))
    reason = clip(F.when(F.col("post").isNotNull() & F.col("field").isNotNull(), both).when(F.col("post").isNotNull(), post).when(F.col("field").isNotNull(), field), 420)
    top = F.when(F.size("mark_urls") > 0, F.col("mark_urls")).otherwise(F.col("honour_urls"))
    known = wide.select(key, F.when(F.col("post").isNotNull() | F.col("field").isNotNull(), reason).alias("reason"), support.alias("support"), top.alias("top_urls"))
    open_ = blank.where(F.col("role").isin("basis", "top")).join(accepted.select(key, "column").hint("merge"), [key, "column"], "left_anti").join(known.hint("merge"), key)
    is_basis = F.col("role") == "basis"
    value, urls = F.when(is_basis, F.col("reason")).otherwise("是"), F.when(is_basis, F.col("support")).otherwise(F.col("top_urls"))
    return open_.select(key, "column", value.alias("value"), urls.alias("urls")).where(F.col("value").isNotNull() & (F.size("urls") > 0))


def payload(columns: dict[str, int]) -> Column:
    """A map of the fields that hold something, each clipped to its size."""
    entries = F.array_compact(F.array(*[F.when(~cell_placeholder(c), F.struct(F.lit(c).alias("k"), clip(c, n).alias("v"))) for c, n in columns.items()]))
    return F.map_from_entries(entries)


def coverage(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, side): what is missing from either side."""
    missing = expected.select(key).distinct().join(done, key, "left_anti").select(key, F.lit("missing").alias("side"))
    extra = done.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("extra").alias("side"))
    return missing.unionByName(extra)
