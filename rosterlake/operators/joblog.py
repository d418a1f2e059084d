"""Job, error and call logs: causes of errors, streaks, spend, states, workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.text import one_of, redact, string


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(one_of(words))


def first_rule(text: Column, words: list[tuple[str, ...]]) -> Column:
    """The number of the first of several rules, from 1, one of whose words a text holds; one more than there are if none does.

    One pass over the text finds a word at each place where one begins, by first letters; a word stands for the
    first rule that it, or a word it begins with, belongs to.
    """
    every = {w: n for n, listed in reversed(list(enumerate(words, 1))) for w in listed}
    rule = {w: min(n for other, n in every.items() if w.startswith(other)) for w in every}
    by: dict[str, list[str]] = {}
    for w in sorted(rule, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    tree = "|".join(f"\\Q{letter}\\E(?:{one_of(rest)})" for letter, rest in by.items())
    found = F.regexp_extract_all(text, F.lit(f"(?=({tree}))"), F.lit(1))
    number = F.create_map(*[F.lit(x) for w, n in rule.items() for x in (w, n)])
    return F.coalesce(F.array_min(F.transform(found, lambda w: number[w])), F.lit(len(words) + 1))


def error_source(message: Column | str, stage: Column | str | None = None, sources: tuple = rules.ERROR_SOURCES, other: str = rules.ERROR_SOURCE_OTHER) -> Column:
    text = F.lower(F.concat_ws(" ", F.lit("") if stage is None else string(stage), string(message)))
    return F.element_at(F.array(*[F.lit(name) for _, name in sources], F.lit(other)), first_rule(text, [words for words, _ in sources]))


def by_source(source: Column, said: tuple[str | tuple[str, str], ...], at: Column) -> Column:
    """The text at a place of a list, in which a pair of texts stands for (homepages, other sources)."""
    home, other = ([t if isinstance(t, str) else t[side] for t in said] for side in (0, 1))
    pick = lambda listed: F.element_at(F.array(*[F.lit(t) for t in listed]), at)
    return F.when(source == rules.ERROR_SOURCE_HOMEPAGE, pick(home)).otherwise(pick(other))


def diagnose(
    message: Column | str,
    stage: Column | str | None = None,
    sources: tuple = rules.ERROR_SOURCES,
    told: tuple = rules.ERROR_RULES,
    other: str = rules.ERROR_CAUSE_OTHER,
    other_action: str = rules.ERROR_ACTION_OTHER,
    other_source: str = rules.ERROR_SOURCE_OTHER,
) -> Column:
    """Struct (source, cause, action, detail, summary) of an error message; the first rule that fits counts."""
    detail = redact(F.when(F.trim(string(message)) == "", F.lit("未知错误")).otherwise(string(message)))
    first = F.struct(error_source(detail, stage, sources, other_source).alias("source"), first_rule(F.lower(detail), [words for words, *_ in told]).alias("rule"), detail.alias("detail"))

    def whole(x: Column) -> Column:
        cause = by_source(x["source"], (*(c for _, c, _ in told), other), x["rule"])
        action = by_source(x["source"], (*(a for _, _, a in told), other_action), x["rule"])
        return F.struct(x["source"].alias("source"), cause.alias("cause"), action.alias("action"), x["detail"].alias("detail"), F.concat(x["source"], F.lit("："), cause).alias("summary"))

    return F.transform(F.array(first), whole)[0]  # so that nothing is worked out twice


def one_line(d: Column) -> Column:
    """A diagnosis as one line for the user."""
    return F.concat(F.lit("来源："), d["source"], F.lit("｜原因："), d["cause"], F.lit("｜建议："), d["action"], F.lit("｜技术详情："), d["detail"])


def flat_diagnosis(d: Column) -> list[Column]:
    """A diagnosis as the columns of a job's state."""
    names = {"last_error": "summary", "error_source": "source", "error_reason": "cause", "error_action": "action", "error_detail": "detail"}
    return [d[field].alias(name) for name, field in names.items()]


def connection_failure(message: Column | str, connection: tuple[str, ...] = rules.CONNECTION_WORDS, model: tuple[str, ...] = rules.MODEL_WORDS) -> Column:
    """Words of both lists."""
    low = F.lower(string(message))
    return _any(low, connection) & _any(low, model)


def failure_streaks(log: DataFrame, job: str, order: list[str], ok: Column, flag_at: int = 3) -> DataFrame:
    """Adds ``streak``, the failures since the last success, and ``open`` where it reaches ``flag_at``."""
    by = Window.partitionBy(job).orderBy(*order)
    islands = log.withColumn("_ok", ok.cast("int")).withColumn("_island", F.sum("_ok").over(by))
    inside = Window.partitionBy(job, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum(1 - F.col("_ok")).over(inside)).withColumn("open", F.col("streak") >= flag_at).drop("_ok", "_island")


def spend(log: DataFrame, job: str, ok: Column, estimated: Column, actual: Column, limit: float) -> DataFrame:
    """Used, remaining and requests of each job: estimates stand for failed calls and calls without an amount."""
    charged = F.when(ok, F.coalesce(F.nullif(actual, F.lit(0)), estimated)).otherwise(estimated)
    return log.groupBy(job).agg(F.sum(charged).alias("used"), F.count("*").alias("requests")).withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def served_once(log: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """Calls of the same normalised key: the first is served, later ones come from it."""
    return log.withColumn("request_key", F.left(F.sha2(F.concat_ws("|", *key), 256), F.lit(12))).withColumn("first", F.row_number().over(Window.partitionBy("request_key").orderBy(*order)) == 1)


def credits_once(log: DataFrame, key: list[Column], order: list[str], ok: Column, credits: Column) -> DataFrame:
    """Adds ``request_key`` and ``charged``: of the calls of one normalised key only the first success is paid."""
    keyed = log.withColumn("request_key", F.left(F.sha2(F.concat_ws("|", *key), 256), F.lit(12))).withColumn("_ok", ok)
    nth = F.row_number().over(Window.partitionBy("request_key", "_ok").orderBy(*order))
    return keyed.withColumn("charged", F.when(F.col("_ok") & (nth == 1), credits).otherwise(0)).drop("_ok")


def last_causes(errors: DataFrame, job: str, order: list[Column], cause: Column, n: int = 3) -> DataFrame:
    """(job, causes): the distinct causes of the last ``n`` errors of each job, the newest first."""
    last = errors.withColumn("_rn", F.row_number().over(Window.partitionBy(job).orderBy(*order))).where(F.col("_rn") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rn", cause.alias("cause"))))
    return last.groupBy(job).agg(F.array_distinct(F.transform(listed, lambda x: x["cause"])).alias("causes"))


def upserted(state: DataFrame, changes: DataFrame, job: str) -> DataFrame:
    """The state of each job with the fields that a change gives; a job that is new is added. changes: one row for each job."""
    given = [c for c in changes.columns if c != job]
    fresh = changes.select(job, *[F.col(c).alias(f"_new_{c}") for c in given])
    kept = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in state.columns if c != job]
    more = [F.col(f"_new_{c}").alias(c) for c in given if c not in state.columns]
    return state.join(fresh, job, "full_outer").select(job, *kept, *more)


def subdomain_status(actual: Column, target: Column) -> Column:
    return F.when(actual >= target, "成功").when(actual > 0, "部分成功").otherwise("失败")


def merge_statuses(wanted: DataFrame, previous: DataFrame, current: DataFrame, key: str, absent: str = "待重试") -> DataFrame:
    """Each wanted key with its current status, else its previous one. Both tables: (key, status, actual)."""
    c = current.select(key, F.struct("status", "actual").alias("_c"))
    p = previous.select(key, F.struct("status", "actual").alias("_p"))
    joined = wanted.join(c, key, "left").join(p, key, "left").withColumn("_s", F.coalesce("_c", "_p"))
    return joined.select(key, F.coalesce("_s.status", F.lit(absent)).alias("status"), F.coalesce("_s.actual", F.lit(0)).alias("actual"))


def to_retry(statuses: DataFrame, retryable: tuple[str, ...] = ("失败", "部分成功", "待重试")) -> DataFrame:
    return statuses.where(F.col("status").isin(*retryable))


def workload(wanted: DataFrame, total: int, per_round: int) -> DataFrame:
    """(grp, pos): target and rounds of each group; a total below the number of groups is an error."""
    counted = wanted.join(F.broadcast(wanted.agg(F.count("*").alias("k"))))  # one row
    checked = F.when(F.lit(total) < F.col("k"), F.raise_error(F.lit("the total is below the number of groups"))).otherwise(F.lit(total))
    target = (F.floor(checked / F.col("k")) + (F.col("pos") <= checked % F.col("k")).cast("int")).cast("int")
    return counted.select("grp", "pos", target.alias("target")).withColumn("rounds", F.ceil(F.col("target") / per_round).cast("int"))


def current_state(events: DataFrame, job: str, order: list[Column]) -> DataFrame:
    """The newest event of each job of an append-only log."""
    return events.withColumn("_rn", F.row_number().over(Window.partitionBy(job).orderBy(*order))).where("_rn = 1").drop("_rn")


def recoverable(state: DataFrame, order: list[Column], statuses: tuple[str, ...] = ("queued", "running", "interrupted", "partial", "failed")) -> DataFrame:
    """The newest job if its status can be resumed; older jobs are not searched."""
    return state.orderBy(*order).limit(1).where(F.col("status").isin(*statuses))


def attempt_breaker(attempts: DataFrame, job: str, order: list[str], ok: Column, gained: Column, names: Column, flag_at: int = 3) -> DataFrame:
    """(job, attempts, gained, names, opened_at): names gained in order, and the attempt at which ``flag_at`` failures in a row open the breaker."""
    marked = failure_streaks(attempts.withColumn("_gained", gained).withColumn("_name", names), job, order, ok, flag_at)
    at = F.row_number().over(Window.partitionBy(job).orderBy(*order))
    numbered = marked.withColumn("_at", at)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_gained") > 0, F.struct("_at", "_name")))), lambda x: x["_name"])
    opened = F.min(F.when(F.col("open"), F.col("_at"))).alias("opened_at")
    return numbered.groupBy(job).agg(F.count("*").alias("attempts"), F.sum("_gained").alias("gained"), listed.alias("names"), opened)


def attempt_progress(attempts: DataFrame, job: str, order: list[str], gained: Column, target: int) -> DataFrame:
    """Running gain, what remains and the fraction done after each attempt."""
    by = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = attempts.withColumn("total", F.sum(gained).over(by)).withColumn("remaining", F.greatest(F.lit(target) - F.col("total"), F.lit(0)))
    return out.withColumn("progress", F.round(F.least(F.col("total") / target, F.lit(1.0)), 4))
