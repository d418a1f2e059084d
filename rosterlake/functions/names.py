"""Column helpers for personal and institution names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, string

#: Words of institution names that say nothing about which one it is.
INSTITUTION_STOP = ("university", "institute", "college", "school", "department", "center", "centre", "laboratory", "hospital", "the", "and", "for", "of")


def words(c: Column | str, letters: str = f"[a-z{HAN}]+") -> Column:
    return F.regexp_extract_all(F.lower(string(c)), F.lit(letters), F.lit(0))


def dedupe_key(c: Column | str) -> Column:
    """Name key: titles dropped, single letters dropped where two words remain."""
    text = F.regexp_replace(F.lower(string(c)), r"\b(?:sir|prof|professor|dr|phd|md)\b", " ")
    every = words(text)
    meant = F.filter(every, lambda w: F.length(w) > 1)
    return F.array_join(F.when(F.size(meant) >= 2, meant).otherwise(every), " ")


def simple_name(c: Column | str) -> Column:
    return F.array_join(F.filter(words(c), lambda w: F.length(w) > 1), " ")


def compact_name(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(string(c)), f"[^a-z0-9{HAN}]", "")


def space_normal(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(string(c)), r"\s+", " "))


def name_variants(name: Column | str, org: Column | str, query: Column | str) -> Column:
    """Distinct search forms: name, simple name, name with the first word of the workplace, with four query words."""
    n, o = F.trim(string(name)), F.trim(string(org))
    first = F.regexp_extract(o, r"^\S+", 0)
    four = F.array_join(F.slice(F.filter(F.split(string(query), r"\s+"), lambda w: w != ""), 1, 4), " ")
    forms = F.array(n, simple_name(name), F.when(first != "", F.concat(n, F.lit(" "), first)).otherwise(n), F.when(four != "", F.concat(n, F.lit(" "), four)).otherwise(n))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def mentions(text: Column | str, name: Column | str) -> Column:
    """Whether a text names a person: Han names as a whole, others by first and last word."""
    key, low = simple_name(name), F.lower(string(text))
    parts = F.split(key, " ")
    han = F.contains(F.replace(low, F.lit(" "), F.lit("")), F.replace(key, F.lit(" "), F.lit("")))
    return (key != "") & F.when(key.rlike(f"[{HAN}]"), han).otherwise(F.contains(low, F.element_at(parts, 1)) & F.contains(low, F.element_at(parts, -1)))


def same_person(a: Column | str, b: Column | str) -> Column:
    """Equal keys, or for names without Han letters two shared words, one name holding all of the other's."""
    x, y = dedupe_key(a), dedupe_key(b)
    s, t = F.split(x, " "), F.split(y, " ")
    within = (F.size(F.array_except(s, t)) == 0) | (F.size(F.array_except(t, s)) == 0)
    han = F.concat(x, y).rlike(f"[{HAN}]")
    compact = F.replace(x, F.lit(" "), F.lit("")) == F.replace(y, F.lit(" "), F.lit(""))
    return (x != "") & (y != "") & ((x == y) | F.when(han, compact).otherwise((F.size(F.array_intersect(s, t)) >= 2) & within))


def same_author(a: Column | str, b: Column | str) -> Column:
    """The loose form: one simple name is part of the other."""
    x, y = simple_name(a), simple_name(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def institution_tokens(c: Column | str, stop: tuple[str, ...] = INSTITUTION_STOP) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(string(c)), F.lit(f"[a-z]{{3,}}|[{HAN}]{{2,}}"), F.lit(0))), F.array(*[F.lit(s) for s in stop]))


def institutions_match(a: Column, b: Column) -> Column:
    """Two shared tokens, or one of five letters and more. a, b: token arrays."""
    shared = F.array_intersect(a, b)
    return (F.size(shared) >= 2) | F.exists(shared, lambda w: F.length(w) >= 5)


def query_terms(c: Column | str, boilerplate: str = "领域下的|方向顶级专家信息|顶级专家|专家信息") -> Column:
    """Latin words of three letters and more, then Han runs of 2 to 12, of a query without its boilerplate."""
    text = F.lower(F.regexp_replace(string(c), boilerplate, " "))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)), F.regexp_extract_all(text, F.lit(f"[{HAN}]{{2,12}}"), F.lit(0))))
