"""Homepages of people: pages joined by URL, accepted where their text names the person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.names import mentions
from rosterlake.functions.text import html_text, string
from rosterlake.functions.urls import normal_url, valid_homepage
from rosterlake.operators.joins import small

# How a page was reached, and why not.
NO_URL, NO_PAGE, WRONG_TYPE, NO_TEXT, NO_NAME = "缺少有效个人主页 URL", "HTTP访问失败: ", "HTTP返回不支持的内容类型: ", "HTTP页面未提取到有效正文", "HTTP页面正文未匹配专家姓名"
UNTRIED, BOTH_FAILED, RENDERED, PLAIN = "未尝试", "HTTP失败，OpenCLI未成功", "OpenCLI", "HTTP"
NO_RENDERED_TEXT, NO_RENDERED_NAME = "OpenCLI未提取到有效正文", "OpenCLI页面正文未匹配专家姓名"
#: People of one page that meet in one task.
SHARED = 10_000


def first_pages(pages: DataFrame, url: str, asked: DataFrame, order: str) -> DataFrame:
    """The first page of each URL that someone asks for, under ``_url``."""
    keyed = pages.withColumn("_url", normal_url(url)).join(asked.select("_url").distinct().hint("merge"), "_url", "left_semi")
    return keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_url").orderBy(order))).where("_rn = 1").drop("_rn")


def homepages(people: DataFrame, key: str, name: str, homepage: str, pages: DataFrame, rendered: DataFrame, shared: int = SHARED) -> DataFrame:
    """(key, method, failure, content): the text of a homepage that names the person early on, from a plain page or else a rendered one.

    pages: (url, at, html, status, content_type), rendered: (url, at, text, error); the first page of URLs that
    differ in case and end slashes counts. Texts are made once a page, and cut before they meet people; the people
    of a page that very many share are dealt over several tasks.
    """
    asked = people.select(key, F.trim(string(name)).alias("_name"), homepage, F.when(valid_homepage(homepage), normal_url(homepage)).alias("_url"))
    of_url = asked.where("_url is not null").groupBy("_url").agg(F.ceil(F.count("*") / shared).cast("int").alias("_n"))
    hot = small(of_url.where("_n > 1"))
    plain = first_pages(pages, "url", of_url, "at").select("_url", string("status").alias("_status"), F.lower(string("content_type")).alias("_type"), F.left(html_text("html"), F.lit(10_000)).alias("_plain"))
    other = first_pages(rendered, "url", of_url, "at").select("_url", F.left(F.trim(F.regexp_replace(string("text"), r"\s+", " ")), F.lit(16_000)).alias("_rendered"), string("error").alias("_error"), F.lit(True).alias("_tried"))
    texts = plain.join(other.hint("merge"), "_url", "full_outer").join(hot, "_url", "left")
    copies = texts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    dealt = asked.join(hot, "_url", "left").withColumn("_salt", F.pmod(F.xxhash64(key), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    met = dealt.join(copies.hint("merge"), ["_url", "_salt"], "left")
    typed = F.contains("_type", F.lit("html")) | F.contains("_type", F.lit("text"))
    why = (
        F.when(F.col("_plain").isNull() | ~F.col("_status").rlike("^2"), F.concat(F.lit(NO_PAGE), F.coalesce("_status", F.lit(""))))
        .when(~typed, F.concat(F.lit(WRONG_TYPE), F.when(F.col("_type") == "", "未知").otherwise(F.col("_type"))))
        .when(F.col("_plain") == "", NO_TEXT)
        .when(~mentions(F.left("_plain", F.lit(4_000)), "_name"), NO_NAME)
        .otherwise("")
    )
    said = met.withColumn("_why", why)
    untried, fine = F.col("_url").isNull(), F.col("_why") == ""
    failed = F.coalesce("_error", F.lit("")) != ""
    named = mentions(F.left("_rendered", F.lit(6_000)), "_name")
    method = F.when(untried, UNTRIED).when(fine, PLAIN).when(F.col("_tried").isNull() | failed, BOTH_FAILED).otherwise(RENDERED)
    failure = F.when(untried, NO_URL).when(fine, "").when(F.col("_tried").isNull(), F.col("_why")).when(failed, F.col("_error")).when(F.col("_rendered") == "", NO_RENDERED_TEXT).when(~named, NO_RENDERED_NAME).otherwise("")
    content = F.when(~untried & fine, F.col("_plain")).when(~untried & F.col("_tried") & ~failed & named, F.col("_rendered"))
    return said.select(key, method.alias("method"), failure.alias("failure"), content.alias("content"))
