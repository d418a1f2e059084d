"""Column helpers for URLs: domains, trust tiers, lists, public addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import URL, string


def netloc(c: Column | str) -> Column:
    return F.regexp_extract(F.lower(string(c)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def domain(c: Column | str) -> Column:
    """Lower-case host without port and ``www.``."""
    return F.regexp_replace(F.regexp_replace(netloc(c), r":\d+$", ""), r"^www\.", "")


def in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    return reduce(lambda a, d: a | (host == d) | host.endswith(f".{d}"), domains, F.lit(False))


def source_tier(c: Column | str, authority: tuple[str, ...] = rules.AUTHORITY_DOMAINS, low: tuple[str, ...] = rules.LOW_TRUST_DOMAINS) -> Column:
    """1: academic, official or listed authority; 2: organisations; 3: others; 4: not trusted or no URL."""
    host = domain(c)
    official = host.rlike(r"(?:\.edu|\.gov|\.mil)$|\.(?:edu|ac|gov)\.[a-z]{2}$") | in_domains(host, authority)
    return F.when((host == "") | in_domains(host, low), 4).when(official, 1).when(host.endswith(".org"), 2).otherwise(3)


def official_profile(c: Column | str) -> Column:
    """Whether a trusted URL is of a university or a government."""
    host = domain(c)
    ends = reduce(lambda a, e: a | host.endswith(e), (".edu", ".gov", ".gov.cn", ".ac.cn", ".ac.uk"), F.contains(host, F.lit(".edu.")))
    return (source_tier(c) < 4) & ends


def normal_url(c: Column | str) -> Column:
    """The key by which URLs are the same: lower case, no slash at the end."""
    return F.regexp_replace(F.lower(F.trim(string(c))), r"/+$", "")


def url_list(*columns: Column | str) -> Column:
    """The distinct URLs of several texts in order, end punctuation trimmed."""
    found = F.concat(*[F.transform(F.regexp_extract_all(string(c), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[。.]+$", "")) for c in columns])
    return F.array_distinct(found)


def append_url(urls: Column, url: Column) -> Column:
    """A URL list with one more at its end, if it is a web address and new."""
    return F.when(F.trim(url).rlike("^https?://"), F.array_distinct(F.array_append(urls, F.trim(url)))).otherwise(urls)


def valid_homepage(c: Column | str, index_domains: tuple[str, ...] = rules.INDEX_DOMAINS) -> Column:
    text = F.lower(F.trim(string(c)))
    return text.rlike("^https?://") & ~reduce(lambda a, d: a | F.contains(text, F.lit(d)), index_domains, F.lit(False))


def public_url(c: Column | str) -> Column:
    """Web address with a public host: no local names, no private, loopback or reserved address."""
    host = F.regexp_replace(netloc(c), r":\d+$", "")
    ip = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    a, b = (F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})", k).try_cast("int") for k in (1, 2))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    local = host.isin("", "localhost") | host.rlike(r"\.(?:local|localhost|internal)$") | ~host.contains(".")
    # fixed values: unspecified and loopback, private, link-local and multicast, mapped private addresses of IPv6
    six = F.regexp_extract(netloc(c), r"^\[([0-9a-f:.]+)\]", 1)
    closed = six.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:(?:10|127|192\.168|169\.254|0)\..*)$")
    local = F.when(six != "", closed).otherwise(local)
    return string(c).rlike("(?i)^https?://") & ~local & ~F.coalesce(ip & private, F.lit(False))


def ranked_sources(urls: Column, most: int = 5, below: int = 4) -> Column:
    """The best URLs of a list by tier, then place."""
    tiered = F.transform(urls, lambda u, k: F.struct(source_tier(u).alias("tier"), k.alias("pos"), u.alias("url")))
    return F.transform(F.slice(F.array_sort(F.filter(tiered, lambda t: t["tier"] < below)), 1, most), lambda t: t["url"])
