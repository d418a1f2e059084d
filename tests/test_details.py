"""Evidence extraction, matching and default rules on sentences and names as they occur."""

import re

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import rules, text, urls
from rosterlake.operators import complete, extract, filters, joblog, match, report, score

ITEMS = [
    ("ada", 1, "Ada Lovelace", "Education: PhD, University of London, 1840 Email: ada@x.org. Ada Lovelace was awarded the Turing Award in 1842. She led the engine project for years.", "https://a.edu/1"),
    ("ada", 2, "News", "She joined the Academy in 1835. Lovelace, Ada published notes on engines. 与中国科学院合作。", "https://b.org/2"),
    ("ada", 3, "Page", "Career: professor at London from 1836 to 1840 Email: x. research interests: analytical engines and numbers Contact: none", "https://c.com/3"),
    ("bob", 1, "Bob", "menu login search. He received the bachelor degree from Leeds College in 1901.", "https://d.com/4"),
    ("bob", 2, "Obituary: Bob Stone", "Bob Stone passed away on Monday. The late Bob Stone was kind.", "https://e.org/5"),
]


@pytest.fixture(scope="module")
def items(spark):
    name = F.when(F.col("k") == "ada", "Ada Lovelace").otherwise("Bob Stone")
    return spark.createDataFrame(ITEMS, "k string, pos int, title string, content string, url string").withColumn("name", name)


def found(df):
    return {r.k: r.found for r in df.collect()}


def test_spans(items):
    got = found(extract.education(items, "k", "pos", "title", "content"))
    assert got["ada"] == ["PhD, University of London, 1840"] and got["bob"][0].startswith("menu login search")
    assert found(extract.interests(items, "k", "pos", "title", "content"))["ada"] == ["analytical engines and numbers"]
    assert found(extract.career(items, "k", "pos", "title", "content"))["ada"] == ["She joined the Academy in 1835.", "professor at London from 1836 to 1840"]
    got = found(extract.achievements(items, "k", "pos", "title", "content", "name"))
    assert len(got["ada"]) == 2 and "Turing Award" in got["ada"][0] and "led the engine" in got["ada"][1]
    assert found(extract.titles(items, "k", "pos", "title", "content", "name"))["ada"] == ["Turing Award"]
    assert found(extract.collaboration(items, "k", "pos", "title", "content", "url"))["ada"] == (
        "中国合作线索(合作依据: " + re.sub(r"\s+", " ", f"{ITEMS[1][2]} {ITEMS[1][3]}")[:120].strip() + "；来源: https://b.org/2)"
    )


def test_deaths(items, spark):
    said = {(r.k, r.pos): (r.snippet, r.strong) for r in extract.survival_items(items, "k", "pos", "title", "content", "url", "name").collect()}
    assert set(said) == {("bob", 2)} and said["bob", 2][1]
    rows = [
        ("Ada Lovelace", "Ada King Lovelace died in London", True), ("Ada Lovelace", "obituary for Ada Lovelace", True), ("Ada Lovelace", "the late countess Ada Lovelace", True),
        ("Ada Lovelace", "Ada was well, Lovelace died", False), ("Ada Lovelace", "in memoriam Ada Lovelace", False), ("李明", "李 明教授于昨日逝世", True), ("李明", "悼念李明先生", True), ("李明", "李明出席", False),
    ]
    df = spark.createDataFrame(rows, "name string, said string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", extract.says_death("said", "name")).collect())
    assert df.where("said like 'in mem%'").select(extract.says_death("said", "name", True)).first()[0]


def test_every_error_rule(spark):
    rows = [(n, word.upper()) for n, (words, *_) in enumerate(rules.ERROR_RULES) for word in words]
    got = spark.createDataFrame(rows, "n int, m string").withColumn("d", joblog.diagnose("m")).collect()
    low = [[w for w in words] for words, *_ in rules.ERROR_RULES]
    for r in got:
        first = next(k for k, words in enumerate(low) if any(w in r.m.lower() for w in words))
        _, cause, action = rules.ERROR_RULES[first]
        assert r.d.cause == (cause if isinstance(cause, str) else cause[1]) and r.d.action == (action if isinstance(action, str) else action[1])
    df = spark.createDataFrame([("403 forbidden", "个人主页"), ("", ""), ("fine", "worker")], "m string, s string").withColumn("d", joblog.diagnose("m", "s"))
    home, blank, other = df.select("d.*", joblog.one_line(F.col("d")).alias("line")).collect()
    assert (home.cause, home.action) == (rules.ERROR_RULES[4][1][0], rules.ERROR_RULES[4][2][0]) and home.source == "专家主页网站"
    assert blank.detail == "未知错误" and other.action == rules.ERROR_ACTION_OTHER and other.line == f"来源：后台任务进程｜原因：{rules.ERROR_CAUSE_OTHER}｜建议：{rules.ERROR_ACTION_OTHER}｜技术详情：fine"
    assert len(rules.ERROR_RULES) == 20


def test_default_lists(spark):
    df = spark.createDataFrame([(f"a {m} b",) for m in rules.GREATER_CHINA_MARKERS] + [("MIT(US)",), ("",)], "org string")
    assert [r.org for r in df.where(filters.foreign("org", rules.GREATER_CHINA_MARKERS)).collect()] == ["MIT(US)", ""]
    df = spark.createDataFrame([(t,) for t, _ in rules.TITLE_BONUSES], "t string").select("t", score.title_bonus(["t"]).alias("b"))
    assert all(r.b.bonus == max(n for t, n in rules.TITLE_BONUSES if t.lower() in r.t.lower()) for r in df.collect())
    plain = lambda s: re.sub(r"\s+", " ", __import__("functools").reduce(lambda t, r: re.sub(r[0], r[1], t, flags=re.I), rules.GLOSSARY, s)).strip()
    said = ["Associate Professor", "Emeritus professor and Director", "Institute of Physics", "awards and award", "co-author", "Research Centre", "Research Professor", "National Academy Fellow"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r.g for r in df.select(text.glossary("s").alias("g")).collect()] == [plain(s) for s in said]


def test_public_addresses(spark):
    given = {
        "http://a.org": True, "http://[::1]/x": False, "http://[fe80::1]/": False, "http://[fd00::5]/": False, "http://[2001:db9::1]/": True, "http://[::ffff:10.0.0.1]/": False,
        "http://127.0.0.1": False, "http://8.8.8.8/": True, "ftp://a.org": False, "http://localhost": False,
    }
    df = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.public_url("u").alias("ok"))
    assert {r.u: r.ok for r in df.collect()} == given


def test_second_source(spark):
    rows = spark.createDataFrame([("Ada Lovelace", "Ada Lovelace", ["x"], 3.0, 20_000.0, "http://engines.org"), ("Ada", "Ada King", ["Ada"], None, None, None), ("Bob", "Eve", None, 900.0, 1e9, "")], "n string, o string, al array<string>, h double, c double, hp string")
    points = match.second_author_score(F.col("n"), F.col("o"), F.col("al"), F.array(F.lit("engines")), F.col("hp"), F.col("h"), F.col("c"))
    assert [r[0] for r in rows.select(points).collect()] == [1000 + 5 + 3 + 2, 250 + 200, 950]
    papers = "array<struct<title string, year int, citations int, venue string, url string>>"
    df = spark.createDataFrame([([("A", 2000, 5, "V", "u1"), (None, None, None, None, None), ("B", 2001, 9, None, "u2")],)], f"p {papers}")
    assert df.select(match.top_papers(F.col("p"))).first()[0] == "B(2001, 未知来源, 引用9, u2)；A(2000, V, 引用5, u1)；未知论文(未知年份, 未知来源, 引用0, )"


def test_fill_summary_and_stages(spark, tmp_path):
    rows = spark.createDataFrame([("1", "", "x"), ("2", "kept", ""), ("3", "", "")], "k string, org string, position string")
    first = spark.createDataFrame([("1", "MIT", "y"), ("2", "no", "prof")], "k string, org string, position string")
    second = spark.createDataFrame([("1", "ETH"), ("3", "ETH")], "k string, org string")
    checks = {c: F.trim(text.string(c)) == "" for c in ("org", "position")}
    got = {r.k: (r.org, r.position) for r in extract.fill_missing(rows, "k", [first, second], checks).collect()}
    assert got == {"1": ("MIT", "x"), "2": ("kept", "prof"), "3": ("ETH", "")}
    people = spark.createDataFrame([("是", "已验证"), ("否", "待复核"), (" 是 ", "")], "page_status string, name_check string")
    counts = {r.item: r.result for r in report.run_summary(people, residue=4).collect()}
    assert counts["最终输出专家数"] == 3 and counts["成功访问主页"] == 2 and counts["姓名已验证"] == 1 and counts["主页未尝试"] == 0 and counts["英文残留单元格"] == 4 and len(counts) == 11
    out, said = complete.run_stages(rows, [("a", lambda r: r.select("nothing"), []), ("b", lambda r, t: r.join(t, "k"), ["gone"]), ("c", lambda r: r.limit(1), []), ("d", lambda r: r.withColumn("k", F.raise_error(F.lit("no"))), [])], {}, str(tmp_path))
    assert out.count() == 1 and said["a"].startswith("skipped") and said["b"] == "skipped: no gone" and said["c"] == "done" and said["d"] == "failed: USER_RAISED_EXCEPTION"


def test_first_rule_is_found_in_one_pass(spark):
    import random

    from rosterlake.operators.joblog import first_rule

    rng = random.Random(1)
    groups = [("ab", "bca", "x.y"), ("abc", "b"), ("ca", "(c"), ("aab",)]
    texts = ["".join(rng.choice("abc(x.y") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", first_rule(F.col("t"), groups).alias("n")).collect()
    assert [r.n for r in got] == [next((n for n, words in enumerate(groups, 1) if any(w in r.t for w in words)), 5) for r in got]
    every = [words for words, *_ in rules.ERROR_RULES]
    said = [f"<{a} {b}>" for words in every for a in words for b in ("dns", "json", "x")]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", first_rule(F.col("t"), every).alias("n")).collect()
    assert [r.n for r in got] == [next(n for n, words in enumerate(every, 1) if any(w in r.t for w in words)) for r in got]


def test_incremental_keys(spark, tmp_path):
    import os

    from rosterlake.streaming import streams

    def run(rows, checkpoint):
        if rows:
            spark.createDataFrame(rows, "k string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.add_new_keys(streams.batches(spark, f"{tmp_path}/in", schema), ["k"], [F.asc("n")], f"{tmp_path}/out", f"{tmp_path}/{checkpoint}")
        return sorted((str(r.k), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    schema = spark.createDataFrame([], "k string, n int").schema
    assert run([("a", 2), ("a", 1), (None, 3), (None, 4)], "one") == [("None", 3), ("a", 1)]
    second = run([("a", 0), ("b", 9), (None, 1)], "one")
    assert second == [("None", 3), ("a", 1), ("b", 9)] == run([], "one")
    assert not os.path.exists(f"{tmp_path}/one/state")
    os.remove(f"{tmp_path}/one/commits/1")  # the second batch is done again, as after a failure
    for name in os.listdir(f"{tmp_path}/one/commits"):
        if name.startswith(".1"):
            os.remove(f"{tmp_path}/one/commits/{name}")
    assert run([], "one") == second
    assert run([], "another") == second  # a stream without a checkpoint finds what is stored


def test_targeted_fill_in_the_whole_chain(spark):
    from rosterlake.plans.finalize import finalize

    rows = spark.createDataFrame([(1, "Ada Lovelace", "", "professor"), (2, "Bob Stone", "MIT", "")], "row_id long, name string, org string, position string")
    facts = spark.createDataFrame([("ada lovelace", "ETH Zurich", "other"), ("bob stone", "no", "engineer")], "merge_key string, org string, position string")
    got = {r.name: (r.org, r.position) for r in finalize(rows, stages=[facts]).collect()}
    assert got == {"Ada Lovelace": ("ETH Zurich", "professor"), "Bob Stone": ("MIT", "engineer")}


def test_residue(spark):
    rows = spark.createDataFrame([(1, "中文内容", "four English words here"), (2, "short one", "纯中文")], "k int, a string, b string")
    got = sorted((r.k, r.column, r.n_words, r.snippet) for r in report.residue_audit(rows, "k", ["a", "b"]).collect())
    assert got == [("1", "b", 4, "four English words here"), ("2", "a", 2, "short one")]
    assert [tuple(r) for r in report.residue_audit(rows.where("k = 3"), "k", ["a", "b"]).collect()] == [(None, "pass", 0, "")]
