"""Column helpers for profile text: missing values, numbers, clean-up, splitting. All built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s；;,，)）]+"
HAN = r"\x{4e00}-\x{9fff}"


def string(c: Column | str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def containing(c: Column | str, alternatives: str, token_match: bool = False) -> Column:
    """Blank, or holding one of the alternatives in any case (with ``token_match`` only as a word)."""
    text = F.trim(string(c))
    pattern = rf"(?i)(?<![A-Za-z])(?:{alternatives})(?![A-Za-z])" if token_match else f"(?i){alternatives}"
    return (text == "") | text.rlike(pattern)


def missing_pending(c: Column | str, token_match: bool = False) -> Column:
    return containing(c, rules.PENDING, token_match)


def enrich_placeholder(c: Column | str) -> Column:
    return containing(c, rules.PLACEHOLDER)


def completeness_missing(c: Column | str) -> Column:
    return (string(c) == "") | string(c).rlike(f"(?i){rules.PLACEHOLDER}")


def public_value(c: Column | str) -> Column:
    """The trimmed text, or the empty text where it says that nothing is public."""
    text = F.trim(string(c))
    return F.when(text.rlike(f"(?i){rules.NOT_PUBLIC}"), F.lit("")).otherwise(text)


def cell_placeholder(c: Column | str, tokens: tuple[str, ...] = rules.CELL_PLACEHOLDERS) -> Column:
    return F.lower(F.trim(string(c))).isin(*tokens)


def clean_text(c: Column | str, fallback: Column | str = rules.NO_INFORMATION) -> Column:
    """The trimmed text, or the fallback where it is blank, ``nan`` or ``none``."""
    text = F.trim(string(c))
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when((text == "") | F.lower(text).isin("nan", "none"), other).otherwise(text)


def number_in(c: Column | str) -> Column:
    """The first number in a text, thousands commas removed, else 0."""
    found = F.regexp_extract(F.replace(string(c), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def clip(c: Column | str, size: int) -> Column:
    """White space collapsed; longer texts cut and marked with dots."""
    text = F.trim(F.regexp_replace(string(c), r"\s+", " "))
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.left(text, F.lit(size))), F.lit("..."))).otherwise(text)


def first_email(c: Column | str, fallback: str = rules.NO_INFORMATION) -> Column:
    found = F.regexp_extract(string(c), EMAIL, 0)
    return F.when(found == "", F.lit(fallback)).otherwise(found)


def homepage_or(c: Column | str, fallback: str = rules.NO_INFORMATION) -> Column:
    return F.when(string(c).rlike("https?://|暂无公开信息"), F.col(c) if isinstance(c, str) else c).otherwise(F.lit(fallback))


def query_parts(c: Column | str, pattern: str = "(.+?)领域下的(.+?)方向顶级专家信息") -> Column:
    """Struct (domain, subdomain) of a query in the template, else (the query, no information)."""
    text = F.trim(string(c))
    fits = text.rlike(pattern)
    domain = F.when(fits, F.trim(F.regexp_extract(text, pattern, 1))).when(text == "", F.lit(rules.NO_INFORMATION)).otherwise(text)
    return F.struct(domain.alias("domain"), F.when(fits, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(F.lit(rules.NO_INFORMATION)).alias("subdomain"))


def subdomain_list(c: Column | str, separators: str = r"[；;、|/\n]+", prefix: str = r"^(?:细分领域|所属细分领域)\s*[:：]\s*", suffix: str = r"\s*(?:方向|领域)$") -> Column:
    """The distinct parts of a multi-valued text in order, labels and missing parts dropped."""
    parts = F.transform(F.split(string(c), separators), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), prefix, ""), suffix, "")))
    return F.when(missing_pending(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda x: ~missing_pending(x))))


def rendered(c: Column, separator: str = "；", fallback: str = rules.NO_INFORMATION) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, separator)).otherwise(F.lit(fallback))


def glossary(c: Column | str, replacements: tuple[tuple[str, str], ...] = rules.GLOSSARY) -> Column:
    """Ordered replacements in any case, then white space and punctuation folded."""
    text = reduce(lambda t, r: F.regexp_replace(t, f"(?iU){r[0]}", r[1]), replacements, F.trim(string(c)))
    for pattern, new in ((r"(?U)\s+", " "), (r"(?U)\s*;\s*", "；"), (r"(?U)\s*:\s*", "：")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def redact(c: Column | str, limit: int = 600) -> Column:
    """White space collapsed, secrets replaced by stars, cut."""
    text = F.trim(F.regexp_replace(string(c), r"\s+", " "))
    text = F.regexp_replace(text, r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+", "$1***")
    text = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token)\s*[:=]\s*)[^\s,;]+", "$1***")
    text = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_-]{8,}\b", "sk-***")
    return F.left(text, F.lit(limit))


def hide_parameters(c: Column | str, names: tuple[str, ...] = ("api_key", "mailto")) -> Column:
    """The values of some URL parameters replaced by stars."""
    return reduce(lambda t, n: F.regexp_replace(t, rf"([?&]{n}=)[^&\s)]+", "$1***"), names, string(c))


def institution_label(name: Column | str, country: Column | str, fallback: str = rules.NO_INFORMATION) -> Column:
    """``name(country)``, without brackets where there is no country."""
    shown = F.when(string(name) == "", F.lit(fallback)).otherwise(string(name))
    return F.when(string(country) == "", shown).otherwise(F.concat(shown, F.lit("("), string(country), F.lit(")")))


def first_names(names: Column, most: int = 4, fallback: str = rules.NO_INFORMATION) -> Column:
    """The first few names of an array that are not blank, as text."""
    return rendered(F.slice(F.filter(names, lambda n: n.isNotNull() & (n != "")), 1, most), "、", fallback)


def preferred_name(c: Column | str) -> Column:
    """Of the parts of a name cell the last with two Latin words, else the first."""
    parts = F.filter(F.transform(F.split(F.trim(string(c)), r"[\n/；;]+"), lambda p: F.trim(p)), lambda p: p != "")
    latin = F.filter(parts, lambda p: F.size(F.regexp_extract_all(p, F.lit("[A-Za-z]+"), F.lit(0))) >= 2)
    return F.when(F.size(latin) > 0, F.element_at(latin, -1)).when(F.size(parts) > 0, F.element_at(parts, 1)).otherwise(F.lit(""))


def source_blocks(c: Column | str, header: str = "### 用户上传补充文件：", unnamed: str = "未命名文件", size: int = 900) -> Column:
    """array<struct<source, chunk>>: a text cut before its source headers, then into pieces, in order."""
    blocks = F.filter(F.transform(F.split(string(c), f"(?m)(?=^\\Q{header}\\E)"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")

    def cut(block: Column) -> Column:
        first = F.regexp_extract(block, r"^[^\n]*", 0)
        bare = F.trim(F.when(first.startswith(header), F.substring(first, len(header) + 1, 1_000_000)).otherwise(first))
        name = F.when(bare == "", F.lit(unnamed)).otherwise(bare)
        return F.transform(pieces(F.regexp_replace(block, r"^[^\n]*\n?", ""), size), lambda p: F.struct(name.alias("source"), p.alias("chunk")))

    return F.flatten(F.transform(blocks, cut))


#: The named entities that are replaced, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text(c: Column | str) -> Column:
    """Text of a page: scripts and styles dropped, breaking tags as line ends, other tags as blanks."""
    text = F.regexp_replace(string(c), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|br|li|tr|h[1-6]|section|article)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def segments(c: Column | str, ends: str = "。；;.!?") -> Column:
    """Split behind sentence ends that white space follows."""
    return F.split(string(c), rf"(?<=[{ends}])\s+")


#: Longest word that a part of a sentence is known by.
WORD_SIZE = 40


def around(sentence: Column, part: tuple[int, str, int], stops: str = "。；;\n") -> Column:
    """The first part of a sentence that holds one of the words, between stops: so many characters before and behind; else empty.

    The same as a search for ``[^stops]{0,before}(?:words)[^stops]{0,behind}``, but that tries every place and every
    number of characters before it. Here the first word is found by one alternation, which gives the place where
    such a part begins, and the whole pattern is tried there only, on a few hundred characters.
    """
    before, words, behind = part
    # a mark in front tells a word at the beginning from none
    front = F.regexp_extract(F.concat(F.lit("\x01"), sentence), f"(?is)^(.*?)(?:{words})", 1)
    bare = F.substring_index(F.translate(front, f"\x01{stops}", "\x01" * (len(stops) + 1)), "\x01", -1)
    begin = F.length(front) - F.least(F.length(bare), F.lit(before))
    window = F.substring(sentence, begin, F.lit(before + WORD_SIZE + behind))
    found = F.regexp_extract(window, f"(?i)^[^{stops}]{{0,{before}}}(?:{words})[^{stops}]{{0,{behind}}}", 0)
    return F.when(front != "", found).otherwise("")


def json_array(c: Column | str, schema: str) -> Column:
    """The JSON array between the first ``[`` and the last ``]`` of a chatty text."""
    return F.from_json(F.regexp_extract(string(c), r"(?s)\[.*\]", 0), schema)


def pieces(c: Column | str, size: int = 900) -> Column:
    """A text cut at line ends, then into fixed pieces, in order; blank pieces dropped."""
    lines = F.filter(F.transform(F.split(string(c), r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda k: F.substring(x, k * size + 1, F.lit(size))))
    return F.flatten(cut)


def english_words(c: Column | str) -> Column:
    """Words of three letters and more outside URLs and addresses."""
    text = F.regexp_replace(F.regexp_replace(string(c), r"https?://\S+", " "), EMAIL, " ")
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z-]{2,})(?![A-Za-z0-9_])"), F.lit(1))


def has_english_residue(c: Column | str) -> Column:
    words = F.size(english_words(c))
    latin = F.length(F.regexp_replace(string(c), "[^A-Za-z]", ""))
    meant = F.length(F.regexp_replace(string(c), f"[^A-Za-z{HAN}]", ""))
    return (words >= 4) | ((words >= 2) & (F.when(meant > 0, latin / meant).otherwise(0.0) >= 0.35))


def one_of(words: tuple[str, ...] | list[str]) -> str:
    """A pattern for any of the words, taken literally."""
    return "|".join(f"\\Q{w}\\E" for w in words) or "(?!)"


def word_array(words: tuple[str, ...] | list[str]) -> Column:
    """A constant array of words."""
    return F.split(F.lit("\x01".join(words)), "\x01")


def any_contains(c: Column | str, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a text holds one of the words, in any case."""
    return F.lower(string(c)).rlike(one_of([w.lower() for w in words]))


def hits(c: Column | str, words: tuple[str, ...] | list[str]) -> Column:
    """The words that a text holds, in the order of the list."""
    low = F.lower(string(c))
    return F.filter(word_array(list(dict.fromkeys(words))), lambda w: F.contains(low, F.lower(w)))


#: Words that institutions are known by.
INSTITUTION = "(?i)大学|学院|研究所|科学院|实验室|中心|公司|University|Institute|Academy"


def split_collaboration(c: Column | str) -> Column:
    """Struct (scholars, units) of a collaboration text: ``label: name (units)`` parts, labels and sources dropped."""
    parts = F.filter(F.transform(F.split(string(c), r"[；;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.trim(F.element_at(F.split(F.regexp_replace(p, r"^(?:强合作|中合作|弱合作|合作线索|合作学者)\s*[:：]\s*", ""), r"[，,]\s*(?:合作依据|来源|证据)\s*[:：]"), 1)))
    plain = F.transform(bare, lambda p: F.regexp_replace(p, r"(?i)\((?:CN|CHN|HK|HKG|MO|MAC|TW|TWN)\)", ""))
    pair = r"([^，,、；;（）()：:]{2,80})[（(]([^）)]+)[）)]"
    names = F.flatten(F.transform(plain, lambda p: F.regexp_extract_all(p, F.lit(pair), F.lit(1))))
    inside = F.flatten(F.transform(plain, lambda p: F.flatten(F.transform(F.regexp_extract_all(p, F.lit(pair), F.lit(2)), lambda x: F.split(x, r"[，,、]\s*")))))
    alone = F.filter(bare, lambda p: ~p.rlike(r"[（(]") & p.rlike(INSTITUTION))
    scholars = F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"^[ ，,、]+|[ ，,、]+$", "")), lambda n: (n != "") & ~n.rlike(INSTITUTION))
    units = F.concat(F.filter(F.transform(inside, lambda u: F.trim(u)), lambda u: u.rlike(INSTITUTION)), alone)
    missing = clean_text(c) == rules.NO_INFORMATION
    none = F.array().cast("array<string>")
    return F.struct(F.when(missing, none).otherwise(F.array_distinct(scholars)).alias("scholars"), F.when(missing, none).otherwise(F.array_distinct(units)).alias("units"))
