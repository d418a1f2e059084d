"""Row filters and verdicts on profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.names import same_person
from rosterlake.functions.text import EMAIL, any_contains, hits, missing_pending, number_in, public_value, string


def is_person(name: str, footer: str = "总数据来源：", headers: tuple[str, ...] = ("nan", "none", "专家姓名", "姓名")) -> Column:
    text = F.trim(string(name))
    return (text != "") & ~text.startswith(footer) & ~F.lower(text).isin(*headers)


def foreign(org: str, markers: tuple[str, ...] = rules.GREATER_CHINA_MARKERS) -> Column:
    """Blank workplaces are kept."""
    return (F.trim(string(org)) == "") | ~any_contains(org, markers)


def not_deceased(check: str, confirmed: str = "确认已故") -> Column:
    return F.trim(string(check)) != confirmed


def profile_of(query: str, profiles: tuple = rules.DOMAIN_PROFILES) -> tuple | None:
    """The first profile one of whose aliases the query names."""
    low = query.lower()
    return next((p for p in profiles if any(a.lower() in low for a in p[1])), None)


def domain_conflicts(evidence: list[str], positive: tuple[str, ...], conflicts: tuple[tuple[str, ...], ...]) -> Column:
    """The words that speak against the domain, empty where any word speaks for it."""
    text = F.concat_ws(" ", *[string(c) for c in evidence])
    against = hits(text, [w for group in conflicts for w in group])
    return F.when(any_contains(text, positive), F.array().cast("array<string>")).otherwise(against)


def domain_mismatches(rows: DataFrame, evidence: list[str], positive: tuple[str, ...], conflicts: tuple[tuple[str, ...], ...]) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and rows that go with up to four reasons."""
    marked = rows.withColumn("_against", domain_conflicts(evidence, positive, conflicts))
    return marked.where(F.size("_against") == 0).drop("_against"), marked.where(F.size("_against") > 0).withColumn("reasons", F.slice("_against", 1, 4)).drop("_against")


def metric_trusted(h: Column, citations: Column, other_h: Column, other_citations: Column) -> Column:
    """Whether another source's numbers fit a profile's: five rules reject."""
    return ~(
        ((h >= 20) & (other_h > 0) & (other_h < h * 0.65))
        | ((h >= 20) & (other_citations > 0) & (other_citations < F.greatest(F.lit(100.0), h * 30)))
        | ((h >= 10) & (other_h > 0) & (other_h <= 5) & (other_citations < 500))
        | ((citations >= 1000) & (other_citations > 0) & (other_citations < citations * 0.2))
        | ((h == 0) & (citations == 0) & (other_h > 0) & (other_h <= 2) & (other_citations < 100))
    )


def suspicious_reasons(keys: list[str], urls: list[str], homepage: str, contact: str, h: str, texts: list[str], risky: str) -> Column:
    """Why a row should be looked at again."""
    pages = F.concat_ws(" ", *[string(c) for c in urls])
    checks = {
        "key fields missing": reduce(lambda a, c: a & missing_pending(c), keys, F.lit(True)),
        "no source": ~pages.rlike("https?://"),
        "bad homepage": ~missing_pending(homepage) & ~F.trim(string(homepage)).rlike("^https?://"),
        "bad e-mail": string(contact).contains("@") & ~string(contact).rlike(EMAIL),
        "high index": number_in(h) > 300,
        "risky wording": F.concat_ws(" ", *[string(c) for c in texts]).rlike(f"(?i){risky}"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))


def homepage_status(homepage: str, method: str, failure: str, status: str) -> Column:
    """Struct (status, method) that agrees with how the page was reached."""
    m, failed = F.trim(string(method)), ~missing_pending(failure)
    no_page = ~F.trim(string(homepage)).rlike("^https?://")
    s = F.trim(string(status))
    new = F.when(m.isin("HTTP", "OpenCLI") & ~failed, "是").when(m.contains("失败") | failed, "否").when(no_page, "未尝试").otherwise(F.when(s == "", "未尝试").otherwise(s))
    reached = (m.isin("HTTP", "OpenCLI") & ~failed) | m.contains("失败") | failed
    kept = F.when(~reached & no_page, "未尝试").when(m == "", "未尝试").otherwise(m)
    return F.struct(new.alias("status"), kept.alias("method"))


def with_name_check(rows: DataFrame, name: str, sources: list[tuple[str, str, str]], page_status: str) -> DataFrame:
    """Adds ``name_check`` and ``name_check_why``. sources: (label, name column, id column); names that fit, ids and a page that was reached count."""
    out = rows
    for k, (_, other, key) in enumerate(sources):
        out = out.withColumns({f"_n{k}": public_value(other), f"_i{k}": public_value(key)})
    out = out.withColumns({f"_f{k}": (F.col(f"_n{k}") == "") | same_person(name, f"_n{k}") for k in range(len(sources))})
    good, bad = [], []
    for k, (label, _, _) in enumerate(sources):
        n = F.col(f"_n{k}")
        there = (n != "") | (F.col(f"_i{k}") != "")
        shown = F.when(n == "", F.lit("")).otherwise(F.concat(F.lit("("), n, F.lit(")")))
        good.append(F.when(there & F.col(f"_f{k}"), F.concat(F.lit(f"{label}作者记录"), shown)))
        bad.append(F.when(there & ~F.col(f"_f{k}"), F.concat(F.lit(f"{label}疑似错配"), shown)))
    good.append(F.when(F.trim(string(page_status)) == "是", F.lit("专家个人主页访问成功")))
    out = out.withColumns({"_g": F.array_compact(F.array(*good)), "_b": F.array_compact(F.array(*bad))})
    g, b = F.col("_g"), F.col("_b")
    verdict = F.when((F.size(b) == 0) & (F.size(g) >= 2), "已验证").otherwise("待复核")
    why = F.when(F.size(b) > 0, F.array_join(F.concat(b, g), "；")).when(F.size(g) >= 2, F.array_join(g, "；"))
    why = why.when(F.size(g) == 1, F.concat(F.lit("当前仅有单一验证来源："), F.array_join(g, "；"))).otherwise("未在 OpenAlex、Semantic Scholar 或可访问个人主页中完成姓名验证")
    drop = [f"_{c}{k}" for k in range(len(sources)) for c in "nif"]
    return out.withColumns({"name_check": verdict, "name_check_why": why, "name_mismatch": F.size(b) > 0}).drop("_g", "_b", *drop)


# Wording of a wrong match, and of relevance that is not shown.
WRONG_MATCH = "疑似错配|姓名不一致|身份错配"
NOT_RELEVANT = "直接关联证据不足|领域关联不足|与.+关联证据不足"


def confident(why: str, texts: list[str], wrong: str = WRONG_MATCH, irrelevant: str = NOT_RELEVANT) -> Column:
    """Neither a wrong match nor missing relevance is stated; what is only incomplete stays."""
    return ~string(why).rlike(wrong) & ~F.concat_ws(" ", *[string(c) for c in texts]).rlike(irrelevant)


# What is said of the dead, states that are checked again, and reasons why a row is not checked.
DEAD = r"(?i)已故|去世|逝世|deceased|died|passed away|obituary"
UNCHECKED = ("", "未执行", "核验失败")
NO_NAME, OVER_CAP, NOT_RUN = "缺少专家姓名", "超过本批独立核验数量上限", "未执行"


def survival_queue(rows: DataFrame, row_id: str, name: str, status: str, check: str, cap: int | None) -> DataFrame:
    """Adds ``queued`` and ``why_not``: unchecked rows, those said to be dead first, up to ``cap`` (all without one); rows without a name take no place.

    What comes before the last place is a limit, so the queue is never ordered as a whole.
    """
    open_ = F.trim(string(check)).isin(*UNCHECKED)
    named = F.trim(string(name)) != ""
    if cap is None:
        return rows.withColumn("queued", open_ & named).withColumn("why_not", F.when(open_ & ~named, NO_NAME))
    later = F.when(string(status).rlike(DEAD), 0).otherwise(1)
    first = rows.where(open_ & named).select(row_id, later.alias("_later")).orderBy("_later", row_id).limit(cap).select(row_id, F.lit(True).alias("_q"))
    joined = rows.join(first.hint("merge"), row_id, "left")
    queued = F.coalesce("_q", F.lit(False))
    why = F.when(open_ & ~named, NO_NAME).when(open_ & ~queued, OVER_CAP)
    return joined.withColumn("queued", queued).withColumn("why_not", why).drop("_q")
