"""Operators on profile-shaped rows."""

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.operators import complete, evidence, extract, filters, joblog, match, merge, report, score, select
from rosterlake.plans.finalize import finalize
from rosterlake.sources import tables

PROFILE = "row_id long, name string, org string, position string, achievements string, interests string, education string, basis string, h_raw string, i10_raw string, g_raw string, citations_raw string, contact string, homepage string, collab string, subdomains_raw string"


def profile(row_id, **values):
    fields = [f.split()[0] for f in PROFILE.split(", ")]
    return tuple(row_id if f == "row_id" else values.get(f) for f in fields)


def test_scores(spark):
    rows = [profile(1, name="A", h_raw="50", citations_raw="10,000", i10_raw="100", position="IEEE Fellow"), profile(2, name="B", h_raw="约10"), profile(3, name="C", achievements="论文被引用 1,200 次；2,500 citations", g_raw="7")]
    out = {r.name: r for r in score.with_scores(spark.createDataFrame(rows, PROFILE)).collect()}
    assert (out["A"].score, out["A"].titles) == (160.0, ["IEEE Fellow"])
    assert (out["B"].score, out["B"].titles, out["B"].citations) == (10.0, [], 0)
    assert out["C"].citations == 2500 and out["C"].i10 == 7


def test_survivorship(spark):
    rows = [profile(1, name="Ada Lovelace", position="教授", achievements="A成果；B成果", h_raw="12", interests="待核验"), profile(2, name="Prof. Ada Lovelace", position="讲席教授", achievements="B成果；C成果", h_raw="30", interests="待核验"), profile(3, name="Ada M. Lovelace", position="待核验", h_raw="30", achievements="未知"), profile(4, name="Bo Li", achievements="X；X")]
    from rosterlake.functions.names import dedupe_key

    df = spark.createDataFrame(rows, PROFILE)
    out = {r.merge_key: r for r in merge.survivorship(df, dedupe_key("name"), F.struct("row_id"), ["h_raw"], ["achievements"], ["name", "position", "interests"]).collect()}
    ada = out["ada lovelace"]
    assert (ada.n_rows, ada.position, ada.achievements, ada.h_raw, ada.interests) == (3, "讲席教授", "A成果；B成果；C成果", "30", "待核验")
    assert ada.name == "Prof. Ada Lovelace" and out["bo li"].achievements == "X；X"  # a single value is left as it is
    again = merge.survivorship(df.where("row_id = 4"), dedupe_key("name"), F.struct("row_id"), ["h_raw"], ["achievements"], ["name"]).first()
    assert again.achievements == "X；X"


def test_balanced_quota(spark):
    rows = [(k, ["a", "b", "c"][k % 3] if k < 9 else "z", float(100 - k)) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, g string, s double")
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "grp string, pos int")
    got = select.balanced_quota(df, "id", F.array("g"), wanted, 7, [("s", True), ("id", False)]).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 5, 6] and len({r.pick for r in got}) == 7
    many = select.balanced_quota(df, "id", F.array("g"), wanted, 50, [("s", True), ("id", False)])
    assert many.count() == 10


def test_filters(spark):
    df = spark.createDataFrame([("", 1), ("Tsinghua University(CN)", 2), ("MIT(US)", 3), (None, 4)], "org string, k int")
    assert sorted(r.k for r in df.where(filters.foreign("org")).collect()) == [1, 3, 4]
    people = spark.createDataFrame([("总数据来源：x",), ("姓名",), (" ",), ("Ada",), ("NaN",), (None,)], "name string")
    assert [r.name for r in people.where(filters.is_person("name")).collect()] == ["Ada"]
    p = filters.profile_of("农业领域下的现代农业信息技术方向顶级专家信息")
    rows = spark.createDataFrame([("精神分裂症、临床精神卫生 schizophrenia psychosis", 1), ("作物遗传育种与种质资源", 2), ("计算机视觉、作物病害 schizophrenia", 3), ("音乐", 4)], "interests string, k int")
    kept, gone = filters.domain_mismatches(rows, ["interests"], p[2], p[3])
    assert sorted(r.k for r in kept.collect()) == [2, 3, 4] and gone.first().reasons[:2] == ["精神卫生", "精神分裂"]
    assert filters.profile_of("新兴交叉领域") is None
    trust = spark.createDataFrame([(30, 0, 10, 5000), (30, 0, 25, 5000), (0, 0, 1, 5), (0, 5000, 9, 100), (12, 0, 3, 100)], "h int, c int, oh int, oc int")
    assert [r[0] for r in trust.select(filters.metric_trusted(F.col("h"), F.col("c"), F.col("oh"), F.col("oc"))).collect()] == [False, True, False, False, False]


def test_verify_name(spark):
    df = spark.createDataFrame([("Ada Lovelace", "Ada Lovelace", "1", "Ada M. Lovelace", "2", ""), ("Ada Lovelace", "Bob King", "1", None, "2", "是"), ("Ada Lovelace", None, None, None, None, "")], "n string, a string, ai string, b string, bi string, page string")
    got = filters.with_name_check(df, "n", [("OpenAlex", "a", "ai"), ("Semantic Scholar", "b", "bi")], "page").collect()
    assert [g.name_check for g in got] == ["已验证", "待复核", "待复核"]
    assert got[1].name_check_why == "OpenAlex疑似错配(Bob King)；Semantic Scholar作者记录；专家个人主页访问成功"


def test_joblog(spark):
    errors = spark.createDataFrame([("研究员节点", "Connection error."), ("", "Tavily HTTP 429"), ("HTTP 主页", "HTTP 403 Forbidden"), ("", "TAVILY_API_KEY is not configured"), ("", "???")], "stage string, m string")
    got = [r[0] for r in errors.select(joblog.diagnose("m", "stage")).collect()]
    assert [g.source for g in got] == ["LLM 中转服务", "Tavily 搜索服务", "专家主页网站", "Tavily 搜索服务", "系统或网络环境"]
    assert "稳定连接" in got[0].cause and "调用频率" in got[1].cause and "反爬虫" in got[2].cause and "缺少" in got[3].cause
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "grp string, pos int")
    assert [(r.target, r.rounds) for r in joblog.workload(wanted, 31, 10).orderBy("pos").collect()] == [(11, 2), (10, 1), (10, 1)]
    with pytest.raises(Exception, match="below the number"):
        joblog.workload(wanted, 2, 10).collect()
    log = spark.createDataFrame([("j", k, ok) for k, ok in enumerate([True, False, False, False, True, False])], "job string, seq int, ok boolean")
    assert [r.streak for r in joblog.failure_streaks(log, "job", ["seq"], F.col("ok")).orderBy("seq").collect()] == [0, 1, 2, 3, 0, 1]
    calls = spark.createDataFrame([("j", 1, True, None), ("j", 2, False, None), ("j", 3, True, 5.0)], "job string, seq int, ok boolean, actual double")
    assert joblog.spend(calls, "job", F.col("ok"), F.lit(2.0), F.col("actual"), 20.0).first()[1:] == (9.0, 3, 11.0)
    states = spark.createDataFrame([("a", "running", 1), ("b", "completed", 2)], "job string, status string, at int")
    assert joblog.recoverable(states, [F.desc("at")]).count() == 0 and joblog.recoverable(states.where("at = 1"), [F.desc("at")]).count() == 1
    prev = spark.createDataFrame([("a", "失败", 0), ("b", "部分成功", 3)], "k string, status string, actual int")
    cur = spark.createDataFrame([("a", "成功", 15)], "k string, status string, actual int")
    got = {r.k: (r.status, r.actual) for r in joblog.merge_statuses(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), prev, cur, "k").collect()}
    assert got == {"a": ("成功", 15), "b": ("部分成功", 3), "c": ("待重试", 0)}


def test_evidence(spark):
    items = spark.createDataFrame([(1, 1, "Obituary: Ada Lovelace passed away", "http://a.com/obituary"), (2, 1, "Ada Lovelace, who died in May", "http://a.com/1"), (3, 1, "Ada Lovelace works", "http://a.com"), (4, 1, "Ada Lovelace died", "http://a.com"), (4, 2, "Ada K. Lovelace died", "http://b.com")], "k int, pos int, content string, url string").withColumn("name", F.lit("Ada Lovelace"))
    said = extract.says_death("content", "name")
    strong = F.exists(F.array(*[F.lit(h) for h in rules.STRONG_SOURCE_HINTS]), lambda h: F.contains(F.lower("url"), h))
    got = {r.k: r.verdict for r in evidence.two_domain_verdict(items, "k", "pos", "url", said, strong).collect()}
    assert got == {1: "确认已故", 2: "疑似已故待复核", 3: "未发现死亡证据", 4: "确认已故"}
    hits = evidence.first_hit(items.select("k", "pos", "content"), "k", "pos", "content", "(?i)ada.*")
    assert {r.k for r in hits.collect()} == {1, 2, 3, 4}
    docs = spark.createDataFrame([("s1", 1, "alpha beta\ngamma delta"), ("s2", 2, "zeta"), ("s1", 3, "alpha beta")], "source string, k int, text string").withColumn("q", F.lit(1))
    cut = evidence.chunks(docs, "source", "k", "text").withColumn("q", F.lit(1))
    best = evidence.chunks_within_budget(cut, ["q"], "source", "k", ("alpha",), (), 100).collect()
    assert [r.chunk for r in best] == ["alpha beta"]
    short = evidence.chunks_within_budget(cut, ["q"], "source", "k", ("nothing",), (), 14).collect()
    assert sum(len(r.chunk) for r in short) <= 14


def test_completion(spark):
    cells = spark.createDataFrame([(1, "a", "x"), (1, "b", ""), (1, "c", "暂无"), (2, "a", None)], "row_id int, column string, value string")
    final = spark.createDataFrame([(1, "a", "new"), (1, "b", "B"), (1, "c", "-"), (2, "a", "A")], "row_id int, column string, value string")
    out = {(r.row_id, r.column): (r.value, r.filled) for r in complete.write_back(cells, final, "row_id").collect()}
    assert out == {(1, "a"): ("x", False), (1, "b"): ("B", True), (1, "c"): ("暂无", False), (2, "a"): ("A", True)}
    low = spark.createDataFrame([("education", "博士学位"), ("education", "Jaimie Henderson, MD"), ("education", "清华大学博士"), ("basis", "National Academy"), ("career", "a long english story without any han letters"), ("org", "截断..."), ("org", "麻省理工")], "role string, v string")
    assert [r[0] for r in low.select(complete.low_quality(F.col("role"), "v")).collect()] == [True, True, False, True, True, True, False]
    urls = spark.createDataFrame([(["http://en.wikipedia.org/a", "http://a.edu", "http://b.com", "http://c.com", "http://d.com"], ["http://a.edu", "http://d.com"])], "u array<string>, k array<string>")
    assert urls.select(complete.cited(F.col("u"), F.col("k"))).first()[0] == ["http://a.edu"]
    base = spark.createDataFrame([("org", "麻省理工", ["http://c.com/x"], ["http://c.com/x"], False, "http://www.c.com", True, False), ("org", "麻省理工", ["http://c.com/x"], ["http://c.com/x"], False, "http://d.com", True, False), ("h_raw", "30", ["http://a.edu"], ["http://a.edu"], False, "", False, False)], "role string, value string, source_urls array<string>, known_urls array<string>, locked boolean, homepage string, homepage_ok boolean, stated boolean")
    assert [r.reason for r in complete.gate(base).collect()] == [None, "narrative without an authority or verified page", "identity is not locked"]


def test_sources(spark):
    said = "Intro\n```\n| 姓名 | b | c |\n|---|:-:|---|\n| Ada | 1 | 2 |\n| short |\n| Bob | 3 | 4 |\nend\n| Eve | 5 | 6 |"
    rows = tables.markdown_rows(spark.createDataFrame([(1, said), (2, None)], "k int, t string"), "k", "t", "姓名", least_cells=3).collect()
    assert [r.cells for r in rows] == [["Ada", "1", "2"], ["Bob", "3", "4"]]
    cells = spark.createDataFrame([("f", "推荐表", 2, 1, "标题"), ("f", "推荐表", 4, 1, "姓名\n（中英文）"), ("f", "推荐表", 4, 2, "单位"), ("f", "推荐表", 5, 1, "Bin He"), ("f", "推荐表", 5, 2, "卡内基梅隆大学"), ("g", "x", 1, 1, "other")], "file string, sheet string, row int, col int, value string")
    layout = tables.detect_header(cells, ("姓名（中英文）",), ("姓名（中英文）", "单位"))
    assert [(r.file, r.row) for r in layout.collect()] == [("f", 4)]
    roles = spark.createDataFrame([("姓名（中英文）", "name"), ("单位", "org")], "alias string, role string")
    assert {(r.row, r.role, r.value) for r in tables.canonical_rows(cells, layout, roles).collect()} == {(5, "name", "Bin He"), (5, "raw_name", "Bin He"), (5, "org", "卡内基梅隆大学"), (5, "institution", "卡内基梅隆大学")}


def test_collaboration(spark):
    def entry(author, place, country):
        return (author, author.upper(), place, [("x", country)])

    works = spark.createDataFrame([(1, 10, [entry("a", "first", "US"), entry("b", "last", "CN")]), (2, 300, [entry("a", "middle", "US"), entry("b", "middle", "CN"), entry("c", "middle", "CN")]), (3, 100, [entry("a", "middle", "US"), entry("b", "middle", "CN")]), (4, 5, [entry("a", "middle", "US"), entry("b", "middle", "CN")])], "id int, cited_by_count int, authorships array<struct<author_id: string, name: string, position: string, institutions: array<struct<name: string, country: string>>>>")
    works = works.withColumn("title", F.when(F.col("id") == 1, F.lit("A study"))).withColumn("year", F.when(F.col("id") == 1, 2001))
    found = match.collaborations(works).where("author_id = 'a'")
    got = {r.id: r.strength for r in found.collect()}
    assert match.collaboration_texts(found, 2).first().collab == "强合作：B（x(CN)）、C（x(CN)）；合作依据：《未知论文》（未知年份，OpenAlex，引用300次）；中合作：B（x(CN)）；合作依据：《未知论文》（未知年份，OpenAlex，引用100次）"
    assert "《A study》（2001，OpenAlex，引用10次）" in {r.id: r.line for r in found.collect()}[1]
    assert got == {1: "强合作", 2: "强合作", 3: "中合作", 4: "弱合作"}
    assert [r.author_id for r in match.first_authors(works, [F.desc("cited_by_count")]).collect()] == ["a"]


def test_delivery_and_finalize(spark):
    rows = [profile(1, name="Ada Lovelace", org="MIT", h_raw="50", contact="x ada@mit.edu", homepage="http://a.edu", subdomains_raw="甲方向；乙"), profile(2, name="Prof Ada Lovelace", org="MIT Lab", h_raw="60"), profile(3, name="Li Ming", org="Tsinghua University"), profile(4, name="nan")]
    done = finalize(spark.createDataFrame(rows, PROFILE), "农业领域下的种质方向顶级专家信息")
    one = done.collect()
    assert len(one) == 1 and one[0].h == 60 and one[0].contact == "ada@mit.edu" and one[0].subdomains == ["甲", "乙"]
    out = report.delivery(done, "农业", "种质").first().asDict()
    assert out["姓名"] == "Prof Ada Lovelace" and out["细分领域"] == "甲；乙" and out["学科领域"] == "农业" and "H指数约60" in out["入选依据"]
    assert report.delivery(done.limit(0), "a", "b").columns == report.delivery(done, "a", "b").columns


def test_name_pairs_equal_all_pairs(spark):
    import random

    from rosterlake.operators import match

    rng = random.Random(2)
    word = lambda: rng.choice(("li", "wei", "wang")) if rng.random() < 0.5 else "".join(rng.choice("abel") for _ in range(rng.randint(1, 4)))
    left = sorted({" ".join(word() for _ in range(rng.randint(2, 3))) for _ in range(150)} | {"王 伟", "x" * 300 + " y", "!!", "Anna B. Lee"})
    right = sorted({" ".join(word() for _ in range(rng.randint(2, 4))) for _ in range(150)} | {"dr 王 伟", "x" * 300 + " y z", "anna lee", "wang"})
    frames = [spark.createDataFrame([(n,) for n in names], f"{c} string") for c, names in (("n", left), ("o", right))]
    simple = lambda n: " ".join(w for w in __import__("re").findall("[a-z\u4e00-\u9fff]+", n.lower()) if len(w) > 1)
    expected = {(n, o) for n in left for o in right if n.lower() in o.lower() or (o.lower() in n.lower() and " " in o) or (simple(n) and simple(n) == simple(o))}
    expected = {(n, o) for n, o in expected if n != "!!"}
    for common in (256, 5):
        got = {(r.a, r.b) for r in match.name_pairs(*frames, "n", "o", common).collect()}
        fits = {(n, o) for n, o in got if n.lower() in o.lower() or (o.lower() in n.lower() and " " in o) or (simple(n) and simple(n) == simple(o))}
        assert fits == expected and ("Anna B. Lee", "anna lee") in got
    assert len(expected) > 20


def test_pairs_of_names_grow_with_the_names(spark):
    import random

    from rosterlake.operators import match

    counts = []
    for size in (400, 1600):
        rng = random.Random(size)
        names = [f"{rng.choice(('wei', 'li', 'anna'))} " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(size)]
        rows = spark.createDataFrame([(n,) for n in names], "n string")
        counts.append(match.name_pairs(rows, rows.withColumnRenamed("n", "o"), "n", "o", common=50).count())
    assert counts[1] < 6 * counts[0]


def test_survivorship_of_a_million_copies(spark):
    from rosterlake.operators import merge

    rows = spark.range(1_000_000).select(F.col("id"), F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, "x；y").otherwise("y; z").alias("listed"), F.lit("w " * 20).alias("text"), (F.col("id") % 7).cast("string").alias("n"))
    more = spark.createDataFrame([(5, None, "only", "t", "1"), (4, None, "only", "t", "2"), (6, "b", None, None, None)], "id long, k string, listed string, text string, n string")
    got = {r.merge_key: r for r in merge.survivorship(rows.unionByName(more), F.col("k"), F.struct((-F.col("id")).alias("less"), "id"), ["n"], ["listed"], ["text"]).collect()}
    assert got["a"].listed == "y；z；x" and got["a"].n_rows == 1_000_000 and got["a"].first.id == 999_999 and got["a"].n == "6"
    assert got[None].listed == "only" and got[None].n_rows == 2 and got[None].n == "2"
    assert got["b"].listed is None and got["b"].text is None
