"""Evidence from search results and pages: first hits, verdicts, chosen homepages, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.text import any_contains, around, hits, pieces, segments, string
from rosterlake.functions.urls import netloc, normal_url, source_tier
from rosterlake.operators.joins import running_budget, small

NAVIGATION = rules.NAVIGATION_TERMS


def is_navigation(c: Column | str, words: tuple[str, ...] = NAVIGATION) -> Column:
    """One of the words, or two bars and more."""
    text = string(c)
    return any_contains(text, words) | (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 2)


def first_hit(items: DataFrame, key: str, pos: str, text: str, pattern: str | tuple[int, str, int], least: int = 8, most: int = 150, split: str = "。；;.!?", stops: str = ".;\n") -> DataFrame:
    """(key, hit): the first sentence part that fits, by item and place, which is no navigation text.

    pattern: an expression, or words with numbers of characters between stops before and behind them, which is much quicker
    than the expression of the same meaning. Of each item the sentences up to its first hit are looked at.
    """
    known = pattern if isinstance(pattern, str) else f"(?i){pattern[1]}"
    hit = lambda part: F.trim(F.regexp_extract(part, pattern, 0) if isinstance(pattern, str) else around(part, pattern, stops))

    def step(found: Column, part: Column) -> Column:
        met = F.when(part.rlike(known), hit(part))  # most parts hold no word, which one cheap test says
        return F.when(found.isNotNull() | ~part.rlike(known), found).when(F.length(met).between(least, most) & ~is_navigation(met), met)

    first = items.select(key, pos, F.aggregate(segments(text, split), F.lit(None).cast("string"), step).alias("hit")).where("hit is not null")
    return first.groupBy(key).agg(F.min_by("hit", pos).alias("hit"))


def label_span(text: Column | str, label: str, stops: str = "。；;\n") -> Column:
    """What stands behind a label, up to the next stop or label."""
    return F.trim(F.regexp_extract(string(text), rf"(?i){label}\s*[:：]?\s*([^{stops}]+?)(?=[{stops}]|$)", 1))


def first_value(items: DataFrame, key: str, pos: str, value: Column) -> DataFrame:
    """(key, value): the first value that is not empty, in item order."""
    return items.withColumn("_v", value).where(F.col("_v") != "").groupBy(key).agg(F.min_by("_v", pos).alias("value"))


def keyword_evidence(items: DataFrame, key: str, pos: str, text: str, words: tuple[str, ...]) -> DataFrame:
    """(key, found): the words in the items of a key, in order of items, then words; each once."""
    found = items.select(key, pos, F.posexplode(hits(text, words)).alias("_k", "word"))
    first = found.groupBy(key, "word").agg(F.min(F.struct(pos, "_k")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("found"))


def two_domain_verdict(items: DataFrame, key: str, pos: str, url: str, said: Column, strong: Column, confirmed: str = "确认已故", suspected: str = "疑似已故待复核", none: str = "未发现死亡证据") -> DataFrame:
    """(key, verdict, n_items, n_domains, first_items): a strong item or two domains confirm; one item is suspected."""
    host = F.coalesce(F.nullif(netloc(url), F.lit("")), F.col(url))
    marked = items.withColumn("_said", said).withColumn("_strong", strong & said).withColumn("_host", F.when(said, host))
    got = marked.groupBy(key).agg(
        F.bool_or("_strong").alias("s"), F.count_if("_said").alias("n_items"), F.count_distinct("_host").alias("n_domains"),
    )
    first = marked.where("_said").withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_strong"), pos))).where("_rn <= 2")
    listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(pos).alias("pos")))), lambda x: x["pos"]).alias("first"))
    got = got.join(listed.withColumnRenamed(key, "_key").hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left")
    verdict = F.when(F.col("s") | (F.col("n_domains") >= 2), confirmed).when(F.col("n_items") > 0, suspected).otherwise(none)
    return got.select(key, verdict.alias("verdict"), "n_items", "n_domains", F.coalesce("first", F.array().cast(listed.schema["first"].dataType)).alias("first_items"))


def homepage_score(url: Column | str, text_names: Column, name_in_url: Column, org_in_text: Column) -> Column:
    u = F.lower(string(url))
    hint = lambda words: reduce(lambda a, w: a | F.contains(u, F.lit(w)), words, F.lit(False))
    of = lambda c, n: F.when(c, n).otherwise(0)
    official = u.rlike(r"\.(?:edu|org|gov)(?:[./:]|$)")
    return of(text_names, 8) + of(name_in_url, 4) + of(org_in_text, 2) + of(hint(rules.PROFILE_HINTS), 3) - of(hint(rules.WEAK_HINTS), 2) + of(official, 1) - of(u.rlike(r"\.(?:pdf|docx?|pptx?|xlsx?)(?:$|[?#])"), 6)


def best_url(candidates: DataFrame, key: str, url: str, score: Column, order: list[Column], least: int = 2) -> DataFrame:
    """(key, url, score): the best URL of each key, the first on ties; URLs that differ in case or end slashes are one."""
    scored = candidates.withColumn("score", score).withColumn("_n", normal_url(url))
    one = scored.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_n").orderBy(*order))).where("_rn = 1")
    best = one.where(F.col("score") >= least).withColumn("_rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *order)))
    return best.where("_rk = 1").select(key, url, "score")


def identity_context(text: Column | str, *tokens: Column) -> Column:
    """Whether a text holds a token of any of the arrays (of institutions, of queries)."""
    low = F.lower(string(text))
    return reduce(lambda a, t: a | F.exists(t, lambda w: F.contains(low, F.lower(w))), tokens, F.lit(False))


def relevant_items(items: DataFrame, url: str, names_person: Column, context: Column, official: Column) -> DataFrame:
    """Items of trusted sources that name the person and share a token, or stand on an official page."""
    return items.withColumn("tier", source_tier(url)).where((F.col("tier") < 4) & names_person & (context | official))


def top_evidence(items: DataFrame, key: str, pos: str, url: str, fields: list[str], n: int = 10) -> DataFrame:
    """(key, n, urls, evidence): the first ``n`` items of each key by tier and place, each URL once, as a JSON array. items hold ``tier``."""
    one = items.groupBy(key, url).agg(F.min_by(F.struct(*[c for c in items.columns if c not in (key, url)]), F.struct("tier", pos)).alias("_i"))
    ranked = one.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("_i.tier", f"_i.{pos}"))).where(F.col("_rn") <= n)
    item = F.struct(*[(F.col(c) if c == url else F.col(f"_i.{c}")).alias(c) for c in fields], F.col("_i.tier").cast("string").alias("tier"))
    listed = F.array_sort(F.collect_list(F.struct("_rn", item.alias("item"), F.col(url).alias("url"))))
    got = ranked.groupBy(key).agg(F.count("*").alias("n"), listed.alias("_l"))
    return got.select(key, "n", F.transform("_l", lambda x: x["url"]).alias("urls"), F.to_json(F.transform("_l", lambda x: x["item"])).alias("evidence"))


def bundles(items: DataFrame, name: str, org: str, pos: str, fields: list[str], n: int = 8) -> DataFrame:
    """(bundle_key, items): the first ``n`` results of each person and workplace, in order; every later step shares them."""
    key = F.concat(F.lower(F.trim(string(name))), F.lit("|"), F.lower(F.trim(string(org))))
    first = items.withColumn("bundle_key", key).withColumn("_rn", F.row_number().over(Window.partitionBy("bundle_key").orderBy(pos))).where(F.col("_rn") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rn", F.struct(*fields).alias("item"))))
    return first.groupBy("bundle_key").agg(F.transform(listed, lambda x: x["item"]).alias("items"))


def chunks(docs: DataFrame, source: str, key: str, text: str, size: int = 900) -> DataFrame:
    """(source, key, chunk_no, chunk)."""
    return docs.select(source, key, F.posexplode(pieces(text, size)).alias("chunk_no", "chunk"))


def chunks_within_budget(chunked: DataFrame, query: list[str], source: str, key: str, terms: tuple[str, ...], markers: tuple[str, ...], budget: int) -> DataFrame:
    """Chunks by relevance under a character budget: the best chunk of each source first, then the rest by score."""
    low = F.lower("chunk")
    count = lambda words: reduce(lambda a, w: a + F.contains(low, F.lit(w)).cast("int"), words, F.lit(0))
    names = list(dict.fromkeys([*query, source]))
    same = lambda columns: reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])
    # ranked by numbers alone; equal chunks are told by their digests, and texts are read again for what fits
    seen = chunked.select(*names, key, "chunk_no", F.md5("chunk").alias("_h"), F.length("chunk").alias("_length"), (4 * count(terms) + F.least(F.lit(6), count(markers))).alias("score"))
    once = seen.groupBy(*names, "_h", "_length", "score").agg(F.min(F.struct(key, "chunk_no")).alias("_p"))
    scored = once.select(*names, f"_p.{key}", "_p.chunk_no", "_h", "_length", "score").localCheckpoint()
    hit = scored.where(F.col("score") > 0)
    some = hit.unionByName(scored.where(F.col("score") <= 0).alias("l").join(small(hit.select(*query).distinct()).alias("r"), same(query), "left_anti"))
    place = F.struct((-F.col("score")).alias("less"), F.col(key).alias("_key"), F.col("chunk_no").alias("_no"))
    rest = [c for c in some.columns if c not in (*query, source)]
    best = some.groupBy(*names).agg(F.min_by(F.struct(*rest), place).alias("_b")).select(*names, *[f"_b.{c}" for c in rest])
    order = [F.desc("score"), F.asc(source), F.asc(key), F.asc("chunk_no")]
    # what comes behind the best chunks of all sources is cut to the budget first, part by part
    others = running_budget(some, query, order, F.col("_length") + 2, budget, F.xxhash64("_h")).drop("_left")
    ids = [*names, key, "chunk_no", "_h"]
    both = best.withColumn("_rank", F.lit(0)).unionByName(others.alias("l").join(small(best.select(*ids)).alias("r"), same(ids), "left_anti").withColumn("_rank", F.lit(1)))
    left = running_budget(both, query, [F.asc("_rank"), *order], F.col("_length") + 2, budget, F.xxhash64("_h"))
    kept = left.select(*ids, "score", "_left").localCheckpoint()
    met = chunked.withColumn("_h", F.md5("chunk")).alias("l").join(small(kept).alias("r"), same(ids))
    chunk = F.expr("rtrim(left(l.chunk, r._left))").alias("chunk")
    return met.select(*[f"l.{c}" for c in names], chunk, f"l.{key}", "l.chunk_no", "r.score").distinct()  # of equal rows one
