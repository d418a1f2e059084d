"""Column helpers on profile texts."""

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import names, text, urls


@pytest.fixture(scope="module")
def one(spark):
    return lambda values, ddl="v string": spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], ddl)


def got(df, column):
    return [r[0] for r in df.select(column.alias("x")).collect()]


def test_numbers(one):
    assert got(one(["约85", "50,000", "暂无公开信息", None, "1.5 of 2"]), text.number_in("v")) == [85, 50000, 0, 0, 1.5]


def test_missing_predicates_differ(one):
    df = one(["", None, "Nanotechnology", "待核验", "MIT", "未公开", "不详", "None"])
    assert got(df, text.missing_pending("v")) == [True, True, True, True, False, False, False, True]
    assert got(df, text.missing_pending("v", token_match=True)) == [True, True, False, True, False, False, False, True]
    assert got(df, text.public_value("v")) == ["", "", "", "待核验", "MIT", "", "不详", ""]
    assert got(df, text.cell_placeholder("v")) == [True, True, False, False, False, False, True, True]
    assert got(df, text.enrich_placeholder("v")) == [True, True, True, False, False, False, False, True]
    assert got(df, text.clean_text("v", "-")) == ["-", "-", "Nanotechnology", "待核验", "MIT", "未公开", "不详", "-"]


def test_name_keys(one):
    df = one(["Prof. Ada M. Lovelace", "X. Y", "李 明", "", None])
    assert got(df, names.dedupe_key("v")) == ["ada lovelace", "x y", "李 明", "", ""]
    assert got(df, names.simple_name("v")) == ["prof ada lovelace", "", "", "", ""]
    assert got(df, names.compact_name("v")) == ["profadamlovelace", "xy", "李明", "", ""]


def test_same_person(one):
    df = one([("Ada Lovelace", "Ada M. Lovelace"), ("Ada Lovelace", "Ada King"), ("李明", "李 明"), ("李明", "李明明"), ("", ""), ("Ada", "Ada")], "a string, b string")
    assert got(df, names.same_person("a", "b")) == [True, False, True, False, False, True]


def test_mentions(one):
    df = one([("Ada Lovelace", "lovelace, ada: notes"), ("Ada Lovelace", "Ada Byron"), ("李明", "教授李 明"), ("", "x")], "a string, b string")
    assert got(df, names.mentions("b", "a")) == [True, False, True, False]


def test_query_parts_and_subdomains(one):
    assert [tuple(x) for x in got(one(["农业领域下的种质方向顶级专家信息", "其他", ""]), text.query_parts("v"))] == [("农业", "种质"), ("其他", "暂无公开信息"), ("暂无公开信息", "暂无公开信息")]
    assert got(one(["细分领域：甲方向；乙领域、甲|甲", "暂无", None]), text.rendered(text.subdomain_list("v"))) == ["甲；乙", "暂无公开信息", "暂无公开信息"]


def test_contact(one):
    assert got(one(["电话 1, jürgen@x.de", "none"]), text.first_email("v")) == ["jürgen@x.de", "暂无公开信息"]
    assert got(one(["http://a", "某大学官方主页", None]), text.homepage_or("v")) == ["http://a", "暂无公开信息", "暂无公开信息"]


def test_glossary_order(one):
    assert got(one(["Research Professor; Institute of X : Y", "associate professor"]), text.glossary("v")) == ["Research 教授；研究所 X：Y", "副教授"]


def test_redaction(one):
    df = one(["Authorization: Bearer abc.def, api_key=K1 token: T2 sk-abcdefgh1 end"])
    assert got(df, text.redact("v")) == ["Authorization: Bearer ***, api_key=*** token: *** sk-*** end"]


def test_html(one):
    page = "<html><script>var t='</p>';</script><style>p{}</style><p>A &amp; B</p><div>C&nbsp;D<br>E</div></html>"
    assert got(one([page, None]), text.html_text("v")) == ["A & B\nC D\nE", ""]


def test_pieces_and_segments(one):
    assert got(one(["ab\n\ncdefg", ""]), text.pieces("v", 3)) == [["ab", "cde", "fg"], []]
    assert got(one(["One. Two! 三。 Four"]), text.segments("v")) == [["One.", "Two!", "三。", "Four"]]


def test_split_collaboration(one):
    df = one(["强合作：张三（清华大学，物理组）；李四(北京大学(CN))，来源：http://x；中国科学院", "暂无公开信息"])
    out = [tuple(map(tuple, x)) for x in got(df, text.split_collaboration("v"))]
    assert out == [(("张三", "李四"), ("清华大学", "北京大学", "中国科学院")), ((), ())]


def test_urls(one):
    df = one(["https://www.Cs.MIT.edu:80/x", "http://en.wikipedia.org/a", "https://a.org", "http://b.com/c d|e", "nothing", None])
    assert got(df, urls.domain("v")) == ["cs.mit.edu", "en.wikipedia.org", "a.org", "b.com", "", ""]
    assert got(df, urls.source_tier("v")) == [1, 4, 2, 3, 4, 4]
    local = one(["http://127.0.0.1/", "http://10.1.2.3", "https://8.8.8.8/a", "http://localhost:8", "ftp://a.b", "http://a.local", "http://172.20.0.1"])
    assert got(local, urls.public_url("v")) == [False, False, True, False, False, False, False]
    ranked = urls.ranked_sources(F.array(F.lit("http://en.wikipedia.org/a"), F.lit("http://c.com"), F.lit("http://a.edu"), F.lit("https://youtube.com")))
    assert got(one(["x"]), ranked) == [["http://a.edu", "http://c.com"]]
    assert got(one(["a http://x.y/1。 b https://z；http://x.y/1."]), urls.url_list("v")) == [["http://x.y/1", "https://z"]]


def test_institutions(one):
    df = one([("Carnegie Institution for Science", "Carnegie University"), ("MIT Lab", "MIT"), ("卡内基梅隆大学", "卡内基梅隆大学")], "a string, b string")
    assert got(df, names.institutions_match(names.institution_tokens("a"), names.institution_tokens("b"))) == [True, False, True]


def test_english_residue(one):
    df = one(["研究 machine learning methods today", "研究方向", "see https://a.b/c only", "作物 crop seed"])
    assert got(df, text.has_english_residue("v")) == [True, False, True, True]
