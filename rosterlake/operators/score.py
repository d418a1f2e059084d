"""Composite scores, title bonuses, estimates and gap scores."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.text import completeness_missing, hits, missing_pending, number_in, string


def first_positive(*columns: Column) -> Column:
    """The first number above zero, else null."""
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def citation_estimate(explicit: list[str], evidence: list[str]) -> Column:
    """The first positive number of the explicit columns, else the largest number next to a citation word."""
    text = F.concat_ws(" ", *[string(c) for c in evidence])
    number = r"(\d[\d,]*(?:\.\d+)?)"
    before = F.regexp_extract_all(text, F.lit(rf"(?i){number}\s*(?:次)?\s*(?:引用|被引|citations?|cited)"), F.lit(1))
    after = F.regexp_extract_all(text, F.lit(rf"(?i)(?:引用|被引|被引用|citations?|cited)\s*{number}\s*(?:次)?"), F.lit(1))
    most = F.array_max(F.transform(F.concat(before, after), number_in))
    return F.coalesce(first_positive(*[number_in(c) for c in explicit]), most, F.lit(0.0))


def i10_estimate(explicit: list[str], proxy: str) -> Column:
    return F.coalesce(first_positive(*[number_in(c) for c in explicit]), number_in(proxy))


def title_bonus(evidence: list[str], bonuses: tuple[tuple[str, int], ...] = rules.TITLE_BONUSES, generic: str = "Fellow") -> Column:
    """Struct (bonus, titles): the highest bonus, and the titles found without the generic one where a special one is."""
    text = F.concat_ws(" ", *[string(c) for c in evidence])
    found = hits(text, [k for k, _ in bonuses])
    worth = F.from_json(F.lit(json.dumps(dict(bonuses), ensure_ascii=False)), "map<string, int>")
    best = F.coalesce(F.array_max(F.transform(found, lambda t: F.element_at(worth, t))), F.lit(0))
    special = F.exists(found, lambda t: t.endswith(generic) & (t != generic))
    return F.struct(best.alias("bonus"), F.filter(found, lambda t: ~special | (t != generic)).alias("titles"))


def total_score(h: Column, citations: Column, i10: Column, bonus: Column) -> Column:
    """H + 15 log10(citations) + 0.2 i10 + bonus; no citations count 0."""
    return h + F.when(citations > 0, F.log10(citations) * 15).otherwise(0.0) + i10 * 0.2 + bonus


def with_scores(experts: DataFrame) -> DataFrame:
    """Adds ``h, citations, i10, titles, score`` to a table of profiles."""
    bonus = title_bonus(["position", "achievements", "education", "org", "basis"])
    out = experts.withColumn("_h", number_in("h_raw")).withColumn("_c", citation_estimate(["citations_raw"], ["achievements", "interests", "position", "education"]))
    out = out.withColumn("_i", i10_estimate(["i10_raw"], "g_raw")).withColumn("_b", bonus)
    out = out.withColumns({"h": F.round("_h", 2), "citations": F.col("_c").cast("bigint"), "i10": F.round("_i", 2), "titles": F.col("_b.titles"), "score": F.round(total_score(F.col("_h"), F.col("_c"), F.col("_i"), F.col("_b.bonus")), 2)})
    return out.drop("_h", "_c", "_i", "_b")


def completeness(columns: list[str]) -> Column:
    return reduce(lambda a, c: a + F.when(completeness_missing(c), 0).otherwise(1), columns, F.lit(0))


def missing_fields(checks: dict[str, Column]) -> Column:
    """The names of the fields whose check holds, in order."""
    return F.array_compact(F.array(*[F.when(check, F.lit(name)) for name, check in checks.items()]))


def profile_checks() -> dict[str, Column]:
    """When each field of a profile is missing."""
    numbers = {c: number_in(c) <= 0 for c in ("h_raw", "i10_raw", "citations_raw")}
    from rosterlake.functions.text import EMAIL

    first = {"homepage": ~F.trim(string("homepage")).rlike("^https?://"), "contact": ~string("contact").rlike(EMAIL)}
    return first | {c: missing_pending(c) for c in ("interests", "org", "position", "career", "education", "achievements", "collab", "basis")} | numbers


def gap_score(checks: dict[str, Column], weights: dict[str, int] | None = None) -> Column:
    weights = rules.GAP_WEIGHTS if weights is None else weights
    return reduce(lambda a, x: a + F.when(x[1], weights.get(x[0], 1)).otherwise(0), checks.items(), F.lit(0))


def severe_gaps(identity: list[Column], details: list[Column], no_source: Column, verified: Column) -> Column:
    """Two identity or detail gaps, no source, or one identity gap of an unverified profile."""
    count = lambda checks: reduce(lambda a, c: a + c.cast("int"), checks, F.lit(0))
    return (count(identity) >= 2) | (count(details) >= 2) | no_source | (~verified & (count(identity) >= 1))
