"""Facts of a person from evidence items: education, interests, career, achievements, collaboration, deaths.

Items are rows (key, pos, title, content, url); results are one row for each key, by item order. Candidates are
found inside each item, and only the first few of a key meet in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.names import mentions, simple_name
from rosterlake.functions.text import HAN, any_contains, around, one_of, segments, string
from rosterlake.functions.urls import netloc
from rosterlake.operators.evidence import is_navigation


def joined_text(title: Column | str, content: Column | str, by: str = "。") -> Column:
    return F.regexp_replace(F.concat(string(title), F.lit(by), string(content)), r"\s+", " ")


def stripped(c: Column, marks: str = " 。；;") -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def labelled(text: Column, label: str) -> Column:
    """What stands behind a label, as an array of one value or none."""
    found = F.regexp_extract(text, f"(?i){label}", 1)
    return F.when(found != "", F.array(stripped(found))).otherwise(F.array().cast("array<string>"))


def parts(text: Column, part: tuple[int, str, int], least: int, most: int, n: int) -> Column:
    """The first match in each sentence, without navigation and what is too short or long; sentences behind ``n`` finds are not looked at."""

    def step(found: Column, sentence: Column) -> Column:
        new = stripped(around(F.trim(sentence), part), " 。；;:-")
        fits = F.length(new).between(least, most) & ~is_navigation(new, rules.NAVIGATION_TERMS)
        return F.when(F.size(found) >= n, found).when(fits, F.concat(found, F.array(new))).otherwise(found)

    return F.aggregate(segments(text), F.array().cast("array<string>"), step)


def first_candidates(items: DataFrame, key: str, pos: str, candidates: Column, n: int = 1) -> DataFrame:
    """(key, found): the first ``n`` candidates of a key, by item and place, each once."""
    each = items.select(key, pos, F.posexplode(F.slice(candidates, 1, n)).alias("_k", "_c"))
    first = each.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(pos, "_k"))).where(F.col("_rn") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rn", "_c")))
    return first.groupBy(key).agg(F.array_distinct(F.transform(listed, lambda x: x["_c"])).alias("found"))


def education(items: DataFrame, key: str, pos: str, title: str, content: str) -> DataFrame:
    """(key, found): the first labelled span, or part that speaks of a degree."""
    text = joined_text(title, content)
    every = F.transform(F.filter(F.split(text, r"[。；;\n]"), lambda s: s.rlike(f"(?i){rules.EDUCATION_WORDS}")), lambda s: stripped(s))
    return first_candidates(items, key, pos, F.concat(labelled(text, rules.EDUCATION_LABEL), F.filter(every, lambda x: F.length(x).between(10, 180))))


def interests(items: DataFrame, key: str, pos: str, title: str, content: str) -> DataFrame:
    """(key, found): the first labelled span of any item, else the first part that speaks of research, without its label."""
    text = joined_text(title, content)
    bare = F.transform(parts(text, rules.RESEARCH_PART, 8, 220, 1), lambda x: F.trim(F.regexp_replace(x, f"(?i){rules.RESEARCH_PREFIX}", "")))
    said = first_candidates(items, key, pos, labelled(text, rules.RESEARCH_LABEL))
    other = first_candidates(items, key, pos, bare).withColumnRenamed("found", "_other")
    return said.join(other.hint("merge"), key, "full_outer").select(key, F.coalesce("found", "_other").alias("found"))


def first_part(items: DataFrame, key: str, pos: str, title: str, content: str, part: tuple[int, str, int], most: int = 150) -> DataFrame:
    """(key, found): the first part of a sentence with one of the words, of 8 characters or more: a post, an institution."""
    return first_candidates(items, key, pos, parts(joined_text(title, content), part, 8, most, 1))


def posts(items: DataFrame, key: str, pos: str, title: str, content: str) -> DataFrame:
    return first_part(items, key, pos, title, content, rules.POSITION_PART)


def institutions(items: DataFrame, key: str, pos: str, title: str, content: str) -> DataFrame:
    return first_part(items, key, pos, title, content, rules.INSTITUTION_PART)


def with_label(current: Column, label: str, found: Column) -> Column:
    """A text with what was found behind a label at its end, unless it is there already; placeholders give way."""
    from rosterlake.functions.text import enrich_placeholder

    new = F.concat(F.lit(label), found)
    return F.when((string(found) == "") | F.contains(string(current), string(found)), current).when(enrich_placeholder(current), new).otherwise(F.concat(F.trim(current), F.lit("；"), new))


def career(items: DataFrame, key: str, pos: str, title: str, content: str) -> DataFrame:
    """(key, found): the first two of labelled spans and parts that speak of posts, each once."""
    text = joined_text(title, content)
    return first_candidates(items, key, pos, F.concat(labelled(text, rules.CAREER_LABEL), parts(text, rules.CAREER_PART, 8, 240, 1)), 2)


def achievements(items: DataFrame, key: str, pos: str, title: str, content: str, name: str, within: int = 5000) -> DataFrame:
    """(key, found): the first two parts that speak of achievements, of items that name the person early on."""
    named = items.where(mentions(F.left(F.concat_ws(" ", title, content), F.lit(within)), name))
    return first_candidates(named, key, pos, parts(joined_text(title, content, " "), rules.ACHIEVEMENT_PART, 12, 220, 2), 2)


def titles(items: DataFrame, key: str, pos: str, title: str, content: str, name: str, words: tuple[str, ...] = rules.TITLE_KEYWORDS) -> DataFrame:
    """(key, found): the titles in items that name the person, in order, each once."""
    from rosterlake.operators.evidence import keyword_evidence

    whole = items.withColumn("_text", F.concat_ws(" ", title, content))
    return keyword_evidence(whole.where(mentions("_text", name)), key, pos, "_text", words)


def collaboration(items: DataFrame, key: str, pos: str, title: str, content: str, url: str, words: tuple[str, ...] = rules.COLLABORATION_TERMS) -> DataFrame:
    """(key, found): the first item that speaks of work with partners: 120 characters and where they stand."""
    text = joined_text(title, content, " ")
    source = F.when(string(url) != "", string(url)).otherwise(string(title))
    line = F.concat(F.lit("中国合作线索(合作依据: "), F.trim(F.left(text, F.lit(120))), F.lit("；来源: "), source, F.lit(")"))
    return items.where(any_contains(text, words)).groupBy(key).agg(F.min_by(line, pos).alias("found"))


def unproved_collaboration(c: Column | str, words: tuple[str, ...] = rules.UNPROVED_COLLABORATION) -> Column:
    """Whether a collaboration text is missing or says nothing definite."""
    from rosterlake.functions.text import enrich_placeholder

    return enrich_placeholder(c) | string(c).rlike(one_of(words))


def says_death(text: Column | str, name: Column | str, is_title: bool = False) -> Column:
    """Whether a sentence says that the person died: words before or behind the name, in a title also its own words."""
    key, low = simple_name(name), F.lower(string(text))
    escaped = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    first, last = escaped(F.element_at(F.split(key, " "), 1)), escaped(F.element_at(F.split(key, " "), -1))
    person = F.concat(F.lit(r"\b"), first, F.lit(r"(?:\s+[a-z][a-z.-]*){0,3}\s+"), last, F.lit(r"\b"))
    any_ = lambda words: rf"\b(?:{'|'.join(words)})\b"
    forms = [
        F.concat(person, F.lit(".{0,80}" + any_(rules.DEATH_AFTER))),
        F.concat(F.lit(any_(rules.DEATH_BEFORE) + ".{0,40}"), person),
        F.concat(F.lit(r"\bthe late\b.{0,30}"), person),
    ]
    if is_title:
        forms += [F.concat(F.lit(any_(rules.DEATH_TITLE) + ".{0,50}"), person), F.concat(person, F.lit(".{0,50}" + any_(rules.DEATH_TITLE)))]
    latin = F.concat(F.lit("(?:"), F.concat_ws("|", *forms), F.lit(")"))
    one = escaped(F.replace(key, F.lit(" "), F.lit("")))
    after, before = "|".join(rules.DEATH_HAN_AFTER), "|".join(rules.DEATH_HAN_BEFORE)
    han = F.concat(F.lit("(?:"), one, F.lit(f".{{0,40}}(?:{after})|(?:{before}).{{0,40}}"), one, F.lit(")"))
    said = F.when(key.rlike(f"[{HAN}]"), F.regexp_like(F.regexp_replace(low, r"\s+", ""), han)).otherwise(F.regexp_like(low, latin))
    return (key != "") & mentions(text, name) & said  # the cheap test first


def death_segments(text: Column | str, name: Column | str, is_title: bool = False) -> Column:
    """The sentences of a text that say that the person died, cut to 320 characters."""
    cut = F.split(string(text), r"(?<=[。！？.!?;；])\s*")
    said = F.filter(cut, lambda s: says_death(s, name, is_title))
    return F.transform(said, lambda s: F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(320)))


def survival_items(items: DataFrame, key: str, pos: str, title: str, content: str, url: str, name: str, hints: tuple[str, ...] = rules.STRONG_SOURCE_HINTS) -> DataFrame:
    """(key, pos, url, snippet, strong) of items that say a death; a title, or a source of a known kind, is strong."""
    marked = items.withColumn("_t", death_segments(title, name, True)).withColumn("_b", death_segments(content, name))
    strong = (F.size("_t") > 0) | any_contains(F.concat_ws(" ", title, url), hints)
    return marked.where(F.size(F.concat("_t", "_b")) > 0).select(key, pos, url, F.concat("_t", "_b")[0].alias("snippet"), strong.alias("strong"))


# Verdicts, and what is said for one weak item and for none.
CONFIRMED, SUSPECTED, NO_DEATH = "确认已故", "疑似已故待复核", "未发现死亡证据"
ONE_WEAK, NO_ITEM = "单一弱证据待人工核验：", "独立网页检索未发现同时匹配专家姓名与明确死亡表述的证据"


def death_verdicts(found: DataFrame, key: str, most: int = 2) -> DataFrame:
    """(key, verdict, why) from items that say a death: a strong one or two domains confirm. found: (key, pos, url, snippet, strong)."""
    host = F.coalesce(F.nullif(netloc("url"), F.lit("")), F.col("url"))
    sums = found.groupBy(key).agg(F.bool_or("strong").alias("_s"), F.count_distinct(host).alias("_n"))
    # strong items are named alone where there are any
    best = found.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("strong"), "pos"))).where(F.col("_rn") <= most)
    item = F.struct("_rn", "strong", F.concat("snippet", F.lit(" | "), F.col("url")).alias("text"))
    listed = best.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    joined = sums.join(listed.hint("merge"), F.col(key) == F.col("_key"))
    confirmed = F.col("_s") | (F.col("_n") >= 2)
    chosen = F.filter("_l", lambda x: x["strong"] | ~F.col("_s"))
    text = F.array_join(F.transform(chosen, lambda x: F.when(confirmed, x["text"]).otherwise(F.concat(F.lit(ONE_WEAK), x["text"]))), "；")
    return joined.select(key, F.when(confirmed, CONFIRMED).otherwise(SUSPECTED).alias("verdict"), text.alias("why"))


def verify_survival(rows: DataFrame, row_id: str, name: str, items: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows whose check is open take the verdict of their items: check, reason and status; those beyond the cap say so.

    items: (row_id, pos, title, content, url). Columns death_check, death_check_why and life_status are set.
    """
    from rosterlake.operators.filters import NOT_RUN, survival_queue

    queued = survival_queue(rows, row_id, name, "life_status", "death_check", cap)
    asked = queued.where("queued").select(row_id, F.col(name).alias("_name"))
    met = items.join(asked.hint("merge"), row_id)
    found = death_verdicts(survival_items(met, row_id, "pos", "title", "content", "url", "_name"), row_id)
    joined = queued.join(found.hint("merge"), row_id, "left")
    verdict, q = F.coalesce("verdict", F.lit(NO_DEATH)), F.col("queued")
    status = F.when(q & (verdict == CONFIRMED), "已故").when(q & (verdict == NO_DEATH) & (F.trim(string("life_status")) == "已故"), "待核验").otherwise(F.col("life_status"))
    check = F.when(q, verdict).when(F.col("why_not").isNotNull(), NOT_RUN).otherwise(F.col("death_check"))
    why = F.when(q, F.coalesce("why", F.lit(NO_ITEM))).otherwise(F.coalesce("why_not", F.col("death_check_why")))
    return joined.withColumns({"life_status": status, "death_check": check, "death_check_why": why}).drop("queued", "why_not", "verdict", "why")


def fill_missing(rows: DataFrame, key: str, stages: list[DataFrame], missing: dict[str, Column]) -> DataFrame:
    """Columns filled where their check says that they are missing, from tables (key, column, ...) in stage order; one row for each key."""
    return reduce(lambda out, stage: fill_once(out, key, stage, missing), stages, rows)


def fill_once(rows: DataFrame, key: str, found: DataFrame, missing: dict[str, Column]) -> DataFrame:
    fields = [c for c in missing if c in found.columns]
    joined = rows.join(found.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields]).hint("merge"), key, "left")
    new = {c: F.when(missing[c] & (string(f"_new_{c}") != ""), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(new).drop(*[f"_new_{c}" for c in fields])
