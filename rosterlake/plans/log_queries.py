"""Queries of job, error and call logs: events stand for calls and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules, text
from rosterlake.operators import joblog, merge, report, select

from .book import Tables, query


@query("""WITH s AS (SELECT c_mktsegment AS grp, row_number() OVER (ORDER BY c_mktsegment) AS pos, count(*) OVER () AS k FROM (SELECT DISTINCT c_mktsegment FROM customer)),
t AS (SELECT grp, pos, CAST(31 // k + CASE WHEN pos <= 31 % k THEN 1 ELSE 0 END AS INT) AS target FROM s) SELECT grp, pos, target, CAST(ceil(target / 10) AS INT) AS rounds FROM t""")
def workload_split(t: Tables) -> DataFrame:
    wanted = t.customer.select(F.col("c_mktsegment").alias("grp")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("grp")))
    return joblog.workload(wanted, 31, 10)


def said(words: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sided(value: str | tuple[str, str]) -> str:
    return f"'{value}'" if isinstance(value, str) else f"CASE WHEN source = '{rules.ERROR_SOURCE_HOMEPAGE}' THEN '{value[0]}' ELSE '{value[1]}' END"


def chosen(texts: tuple, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {said(words, 'low')} THEN {sided(text)}" for (words, *_), text in zip(rules.ERROR_RULES, texts, strict=True)) + f" ELSE '{other}' END"


#: Messages of every kind, by event; ids after the secret's mark are redacted before the words are looked for.
MESSAGES = [words[0] for words, *_ in rules.ERROR_RULES] + ["all is well"]
STAGES = [words[0] for words, _ in rules.ERROR_SOURCES] + ["nothing"]
DIAGNOSED_SQL = f"""m AS (SELECT event_id, user_id, ts, event_type, {MESSAGES}[1 + event_id % {len(MESSAGES)}] || '  in ' || event_type || ' token=abc' || event_id AS msg, {STAGES}[1 + user_id % {len(STAGES)}] AS stage FROM events),
d AS (SELECT *, regexp_replace(regexp_replace(trim(msg), '\\s+', ' ', 'g'), 'token=.*', 'token=***') AS detail FROM m),
s AS (SELECT *, lower(detail) AS low, CASE {" ".join(f"WHEN {said(words, 'lower(stage || chr(32) || detail)')} THEN '{name}'" for words, name in rules.ERROR_SOURCES)} ELSE '{rules.ERROR_SOURCE_OTHER}' END AS source FROM d),
g AS (SELECT *, {chosen(tuple(c for _, c, _ in rules.ERROR_RULES), rules.ERROR_CAUSE_OTHER)} AS cause, {chosen(tuple(a for *_, a in rules.ERROR_RULES), rules.ERROR_ACTION_OTHER)} AS action FROM s)"""


def diagnosed(t: Tables) -> DataFrame:
    message = F.element_at(text.word_array(MESSAGES), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    stage = F.element_at(text.word_array(STAGES), (F.col("user_id") % len(STAGES) + 1).cast("int"))
    whole = F.concat(message, F.lit("  in "), "event_type", F.lit(" token=abc"), F.col("event_id").cast("string"))
    return t.events.select("event_id", "user_id", "ts", "event_type", joblog.diagnose(whole, stage).alias("d"))


@query(f"WITH {DIAGNOSED_SQL} SELECT event_id, source, cause, action, detail, source || '：' || cause AS summary FROM g")
def error_classify(t: Tables) -> DataFrame:
    return diagnosed(t).select("event_id", "d.source", "d.cause", "d.action", "d.detail", "d.summary")


@query(f"WITH {DIAGNOSED_SQL} SELECT event_id, '来源：' || source || '｜原因：' || cause || '｜建议：' || action || '｜技术详情：' || detail AS line, source || '：' || cause AS last_error, action AS error_action FROM g")
def diagnostic_text(t: Tables) -> DataFrame:
    d = diagnosed(t)
    flat = d.select("event_id", joblog.one_line(F.col("d")).alias("line"), *joblog.flat_diagnosis(F.col("d")))
    return flat.select("event_id", "line", "last_error", "error_action")


@query(f"""WITH {DIAGNOSED_SQL}, r AS (SELECT user_id, cause, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM g WHERE event_type = 'error'),
f AS (SELECT user_id, cause, min(rn) AS rn FROM r WHERE rn <= 3 GROUP BY 1, 2) SELECT user_id, string_agg(cause, '；' ORDER BY rn) AS causes FROM f GROUP BY 1""")
def last_error_causes(t: Tables) -> DataFrame:
    """The distinct causes of the last three errors of each user."""
    errors = diagnosed(t).where("event_type = 'error'")
    last = joblog.last_causes(errors, "user_id", [F.desc("ts"), F.desc("event_id")], F.col("d.cause"))
    return last.select("user_id", F.array_join("causes", "；").alias("causes"))


def error_text():
    """Messages of two services, as a stream holds them."""
    code = F.concat(F.lit("HTTP "), (F.floor("value") % 110 + 400).cast("string"), F.lit(" Tavily token=abc"), F.col("event_id").cast("string"))
    return F.when(F.col("event_type") == "error", code).otherwise(F.concat("event_type", F.lit(" timeout from OpenAlex")))


@query("""WITH r AS (SELECT *, left(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type)), 12) AS request_key, event_type <> 'error' AND value > 20 AS ok FROM events)
SELECT event_id, request_key, CASE WHEN ok AND row_number() OVER (PARTITION BY request_key, ok ORDER BY event_id) = 1 THEN 2 ELSE 0 END AS charged FROM r""")
def request_credits(t: Tables) -> DataFrame:
    key = [F.col("user_id").cast("string"), F.lower("event_type")]
    paid = joblog.credits_once(t.events, key, ["event_id"], (F.col("event_type") != "error") & (F.col("value") > 20), F.lit(2))
    return paid.select("event_id", "request_key", "charged")


@query("""WITH o AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER w AS nth, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM o)
SELECT user_id, count(*) AS attempts, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS gained,
coalesce(string_agg(CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY nth), '') AS names, min(CASE WHEN streak >= 2 THEN nth END) AS opened_at FROM s GROUP BY 1""")
def attempt_breaker(t: Tables) -> DataFrame:
    gained = (F.col("event_type") == "purchase").cast("int")
    got = joblog.attempt_breaker(t.events, "user_id", ["ts", "event_id"], F.col("event_type") != "error", gained, F.col("event_id").cast("string"), 2)
    return got.select("user_id", "attempts", "gained", F.array_join("names", ",").alias("names"), "opened_at")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id % 3 <> 0)
SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(n.status, s.status) AS status, s.n_events, n.value FROM
(SELECT user_id, 'queued' AS status, count(*) AS n_events FROM events WHERE user_id % 2 = 0 GROUP BY 1) s FULL JOIN (SELECT user_id, event_type AS status, value FROM r WHERE rn = 1) n ON s.user_id = n.user_id""")
def job_upsert(t: Tables) -> DataFrame:
    """Queued jobs updated by the newest event of each, new jobs added."""
    state = t.events.where("user_id % 2 = 0").groupBy("user_id").agg(F.lit("queued").alias("status"), F.count("*").alias("n_events"))
    new = joblog.current_state(t.events.where("user_id % 3 <> 0"), "user_id", [F.desc("ts"), F.desc("event_id")])
    return joblog.upserted(state, new.select("user_id", F.col("event_type").alias("status"), "value"), "user_id")


@query("""SELECT event_id, event_id % 3 = 0 AND event_id % 5 < 2 AS failed FROM events""")
def conn_flag(t: Tables) -> DataFrame:
    """Failed connections to the model service: words of both lists."""
    k = F.col("event_id")
    what = F.when(k % 3 == 0, "ReadTimeout: 连接超时").when(k % 3 == 1, "HTTP 404").otherwise("")
    where = F.when(k % 5 == 0, " LLM/API").when(k % 5 == 1, " 验证节点").otherwise(" OpenAlex")
    return t.events.select("event_id", joblog.connection_failure(F.concat(what, where)).alias("failed"))


@query("""WITH o AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM o) SELECT event_id, streak, streak >= 2 AS open FROM s""")
def failure_streak(t: Tables) -> DataFrame:
    return joblog.failure_streaks(t.events, "user_id", ["ts", "event_id"], F.col("event_type") != "error", 2).select("event_id", "streak", "open")


@query("""SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN coalesce(nullif(CAST(floor(value) AS BIGINT), 0), 2) ELSE 2 END) AS used, count(*) AS requests,
greatest(1000 - sum(CASE WHEN event_type <> 'error' THEN coalesce(nullif(CAST(floor(value) AS BIGINT), 0), 2) ELSE 2 END), 0) AS remaining FROM events GROUP BY 1""")
def spend_ledger(t: Tables) -> DataFrame:
    return joblog.spend(t.events, "user_id", F.col("event_type") != "error", F.lit(2), F.floor("value"), 1000)


@query("""WITH r AS (SELECT event_id, left(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR))), 12) AS request_key FROM events)
SELECT event_id, request_key, row_number() OVER (PARTITION BY request_key ORDER BY event_id) = 1 AS first FROM r""")
def request_dedupe(t: Tables) -> DataFrame:
    key = [F.col("user_id").cast("string"), F.lower("event_type"), F.floor(F.col("value") / 10).cast("string")]
    return joblog.served_once(t.events, key, ["event_id"]).select("event_id", "request_key", "first")


@query("""WITH g AS (SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS ok, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY 1),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error'),
l AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS last FROM e WHERE rn <= 3 GROUP BY 1)
SELECT g.user_id, ok, failed, CASE WHEN ok >= 3 THEN '成功' WHEN ok > 0 THEN '部分成功' ELSE '失败' END AS status, coalesce(last, '') AS last FROM g LEFT JOIN l ON g.user_id = l.user_id""")
def subdomain_status(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"))
    last = select.top_n(t.events.where("event_type = 'error'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    listed = last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("last"))
    joined = counts.join(listed, "user_id", "left")
    return joined.select("user_id", "ok", "failed", joblog.subdomain_status(F.col("ok"), F.lit(3)).alias("status"), F.coalesce("last", F.lit("")).alias("last"))


STATUS_SQL = """p AS (SELECT o_custkey AS k, CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0 THEN '成功' ELSE '部分成功' END AS status, count(*) AS actual FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
c AS (SELECT o_custkey AS k, CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0 THEN '成功' ELSE '失败' END AS status, count(*) AS actual FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 200000 GROUP BY 1),
m AS (SELECT c_custkey AS k, coalesce(c.status, p.status, '待重试') AS status, CASE WHEN c.k IS NOT NULL THEN c.actual WHEN p.k IS NOT NULL THEN p.actual ELSE 0 END AS actual FROM customer LEFT JOIN c ON c_custkey = c.k LEFT JOIN p ON c_custkey = p.k)"""


def order_statuses(t: Tables) -> DataFrame:
    def half(rows: DataFrame, other: str) -> DataFrame:
        return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, "成功").otherwise(other).alias("status"), F.count("*").alias("actual"))

    previous = half(t.orders.where("o_orderkey % 2 = 0"), "部分成功")
    current = half(t.orders.where("o_orderkey % 2 = 1 and o_totalprice > 200000"), "失败")
    return joblog.merge_statuses(t.customer.select(F.col("c_custkey").alias("k")), previous, current, "k")


@query(f"WITH {STATUS_SQL} SELECT * FROM m")
def status_merge(t: Tables) -> DataFrame:
    return order_statuses(t)


@query(f"WITH {STATUS_SQL} SELECT * FROM m WHERE status IN ('失败', '部分成功', '待重试')")
def retry_list(t: Tables) -> DataFrame:
    return joblog.to_retry(order_statuses(t))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type AS status, value FROM r WHERE rn = 1""")
def job_latest(t: Tables) -> DataFrame:
    return joblog.current_state(t.events, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.col("event_type").alias("status"), "value")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events),
r AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM f)
SELECT event_id, total, greatest(4 - total, 0) AS remaining, round(least(total / 4, 1.0), 4) AS progress FROM r""")
def attempt_rollup(t: Tables) -> DataFrame:
    seen = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) == 1
    return joblog.attempt_progress(t.events.withColumn("fresh", seen.cast("int")), "user_id", ["ts", "event_id"], F.col("fresh"), 4).select("event_id", "total", "remaining", "progress")


def summary_sql() -> str:
    marks = {"name_check": "CASE event_type WHEN 'purchase' THEN '已验证' ELSE '待复核' END", "page_status": "CASE WHEN value < 30 THEN '否' WHEN value < 60 THEN ' 是 ' ELSE '未尝试' END"}
    marks |= {"page_method": "CASE WHEN user_id % 4 = 0 THEN 'OpenCLI' END", "death_check": "CASE event_type WHEN 'error' THEN '疑似已故待复核' WHEN 'view' THEN '未发现死亡证据' ELSE '未执行' END"}
    rows = [f"SELECT '{name}' AS item, count({'*' if c is None else f'CASE WHEN trim({marks[c]}) = {chr(39)}{v}{chr(39)} THEN 1 END'}) AS result, '{remark}' AS remark FROM events" for name, c, v, remark in rules.RUN_SUMMARY]
    return " UNION ALL ".join(rows)


@query(summary_sql())
def run_summary(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    rows = t.events.select(
        F.when(kind == "purchase", "已验证").otherwise("待复核").alias("name_check"), F.when(value < 30, "否").when(value < 60, " 是 ").otherwise("未尝试").alias("page_status"),
        F.when(F.col("user_id") % 4 == 0, "OpenCLI").alias("page_method"), F.when(kind == "error", "疑似已故待复核").when(kind == "view", "未发现死亡证据").otherwise("未执行").alias("death_check"),
    )
    return report.run_summary(rows)


@query("""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)(authorization\\s*[:=]\\s*bearer\\s+)[^\\s,;]+', '\\1***', 'g'), '(?i)((?:api[_-]?key|token)\\s*[:=]\\s*)[^\\s,;]+', '\\1***', 'g'), '\\bsk-[A-Za-z0-9_-]{8,}\\b', 'sk-***', 'g'), 600) AS clean FROM documents""")
def redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.redact("text").alias("clean"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1""")
def first_seen(t: Tables) -> DataFrame:
    return merge.first_seen(t.events, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH u AS (SELECT *, md5(lower(trim(text))) AS k FROM conversations WHERE role = 'user'), k AS (SELECT DISTINCT k FROM u WHERE conv_id % 3 = 0),
n AS (SELECT conv_id, turn, k, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) AS rn FROM u WHERE conv_id % 3 <> 0)
SELECT conv_id, turn, k FROM n WHERE rn = 1 AND k NOT IN (SELECT k FROM k)""")
def new_names_anti(t: Tables) -> DataFrame:
    """Turns whose whole text, in any case, is new."""
    asked = t.conversations.where("role = 'user'").withColumn("k", F.md5(F.lower(F.trim("text"))))
    return merge.new_rows(asked.where("conv_id % 3 <> 0"), asked.where("conv_id % 3 = 0"), "k", [F.asc("conv_id"), F.asc("turn")]).select("conv_id", "turn", "k")


@query("""SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NOT NULL THEN n.b ELSE c.c_acctbal END AS c_acctbal FROM customer c FULL JOIN (SELECT c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1000000 ELSE 0 END AS k, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 3 = 0) n ON c.c_custkey = n.k""")
def priority_merge(t: Tables) -> DataFrame:
    third = t.customer.where("c_custkey % 3 = 0")
    new = third.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 6 == 0, 1000000).otherwise(0)).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merge.priority_merge(t.customer.select("c_custkey", "c_acctbal"), new, "c_custkey", ["c_acctbal"], replace=True)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0 THEN '教授；' || lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def translation_overlay(t: Tables) -> DataFrame:
    """Translated cells laid over the table, blank ones not, with the glossary's words put right again."""
    said = F.concat(F.lit(" Professor ;  "), F.lower("c_mktsegment"))
    changes = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(said).alias("new"))
    return merge.translated(t.customer.select("c_custkey", "c_mktsegment"), changes, ["c_custkey"], "c_mktsegment", "new")
