"""Mixing sources to target weights: iterative proportional fitting on token weights, in DataFrame functions only.

Documents fall into cells of source, language and topic. Each cell starts with its tokens as weight; sweeps
rake the weights to the target marginals of each dimension in turn, in tokens of the budget, and hold a cell
at what it has. A document's probability is its cell's weight over its cell's tokens. A document is drawn if
a hash of its id, a number in [0, 1), is below that. ``marginals`` compares what was drawn with the targets.

A target gives shares to values of a dimension; values without a share take what is left, ``rest`` of the whole
at least, in proportion to a power of their tokens (under 1, so that small ones gain). Shares are then made to
add up to one over the values that occur. Where cells have too few tokens for their share, they are taken whole
and the mixture holds fewer tokens than the budget; ``report`` shows by how much.

The cells are aggregated before anything else, so a hot source is a few partial sums. Up to ``ONE_TASK``
cells are raked in one task without a shuffle; more are raked by the same windows, dealt by dimension.

Defined results: null sources, languages and texts are categories or texts of their own ("" each); texts
without words weigh one token; rows with the same id share their fate; rows without an id are drawn by a
hash of their text; an empty table gives an empty result; values with a share of 0 are left out, and so is
all if nothing else occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

DIMENSIONS = ("source", "lang", "topic")
#: A document's topic is the list of which it holds most words, the first on ties; without any it is ``OTHER``.
TOPICS = {
    "law": ("license", "licence", "licensed", "copyright", "warranty", "warranties", "liability", "liable", "permission", "permissions", "reserved"),
    "contact": ("email", "mail", "phone", "telephone", "telefon", "teléfono", "téléphone", "address", "contact"),
    "code": ("return", "import", "function", "null", "token", "api"),
}
OTHER = "prose"
#: Shares of the mixture. Sources, and languages that are not listed, follow their tempered tokens.
TARGETS = {"lang": {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": {"prose": 0.7, "law": 0.1, "contact": 0.1, "code": 0.1}}
TEMPER, SWEEPS, BUDGET, ONE_TASK, SWEEPS_A_PLAN, REST = 0.5, 12, 0.6, 100_000, 3, 0.05
#: What parts words besides blanks.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r"


def topic_words(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """The words of a text, in any case, that are in a list."""
    words = F.split(F.translate(F.lower(text), MARKS, " " * len(MARKS)), " ")
    listed = [w for some in topics.values() for w in some]
    return F.filter(words, lambda w: w.isin(*listed))


def topic_of(found: Column, topics: dict[str, tuple[str, ...]] = TOPICS, other: str = OTHER) -> Column:
    """The topic of a text from its ``topic_words``, which are a stored column so that texts are read once."""

    def count(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*words)))

    counts = F.array(*[count(words) for words in topics.values()])
    names = F.array(*[F.lit(t) for t in topics])
    return F.when(F.array_max(counts) > 0, F.element_at(names, F.array_position(counts, F.array_max(counts)).cast("int"))).otherwise(F.lit(other))


def tokens_of(text: Column) -> Column:
    """Words separated by blanks, tabs or line ends; at least one."""
    clean = F.regexp_replace(text, "[^ \t\n\r]+", "x")
    return F.greatest(F.length(F.regexp_replace(clean, "[ \t\n\r]+", "")), F.lit(1)).cast("long")


def in_cells(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """``(row, draw, source, lang, topic, tokens)``: all columns of a document, the number it is drawn by and its cell."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), text))
    first = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        draw(key).alias("draw"),
        F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"),
        topic_words(text).alias("found"),
        tokens_of(text).alias("tokens"),
    )
    return first.select("row", "draw", "source", "lang", topic_of(F.col("found")).alias("topic"), "tokens")


def with_target(cells: DataFrame, dimension: str, listed: dict[str, float], temper: float, budget: float, rest: float = REST) -> DataFrame:
    """Adds ``_<dimension>``: the tokens that the mixture is to hold of a cell's value."""
    by, every = Window.partitionBy(dimension), Window.partitionBy(F.lit(0))
    known = reduce(lambda to, item: to.when(F.col(dimension) == item[0], F.lit(float(item[1]))), listed.items(), F.when(F.lit(False), 0.0))
    left = F.lit(max(float(rest), 1.0 - sum(listed.values())))
    # a value's part is spread over its cells, so that sums over cells are sums over values
    cells = cells.withColumn("_n", F.sum("tokens").over(by).cast("double"))
    cells = cells.withColumn("_part", F.col("tokens") / F.col("_n")).withColumn("_known", known).withColumn("_free", F.pow("_n", F.lit(temper)))
    cells = cells.withColumn("_rest", F.sum(F.when(F.col("_known").isNull(), F.col("_part") * F.col("_free"))).over(every))
    cells = cells.withColumn("_s", F.coalesce("_known", left * F.col("_free") / F.col("_rest")))
    share = F.coalesce(F.col("_s") / F.nullif(F.sum(F.col("_part") * F.col("_s")).over(every), F.lit(0.0)), F.lit(0.0))
    cells = cells.withColumn(f"_{dimension}", share * F.sum("tokens").over(every) * budget)
    return cells.drop("_n", "_part", "_known", "_free", "_rest", "_s")


def rake(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS, budget: float = BUDGET, one_task: int = ONE_TASK
) -> DataFrame:
    """Cells ``(source, lang, topic, tokens)`` with ``weight`` (tokens to draw), ``probability`` and ``target_<dimension>`` (tokens of the cell's value)."""
    targets = TARGETS if targets is None else targets
    if cells.count() <= one_task:
        cells = cells.coalesce(1)  # no window below needs a shuffle then
    cells = cells.select(*DIMENSIONS, "tokens")
    for d in DIMENSIONS:
        cells = with_target(cells, d, targets.get(d, {}), temper, budget)
    cells = keep(cells.withColumn("weight", F.col("tokens").cast("double")))
    for sweep in range(sweeps):
        for d in DIMENSIONS:
            cells = cells.withColumn("_sum", F.sum("weight").over(Window.partitionBy(d)))
            cells = cells.withColumn("weight", F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum") * F.col(f"_{d}")).otherwise(0.0)).drop("_sum")
        cells = cells.withColumn("weight", F.least("weight", F.col("tokens").cast("double")))
        if sweep % SWEEPS_A_PLAN == SWEEPS_A_PLAN - 1:
            cells = keep(cells)  # short plans
    return cells.where("weight > 0").select(*DIMENSIONS, "tokens", "weight", F.round(F.col("weight") / F.col("tokens"), 9).alias("probability"), *[F.col(f"_{d}").alias(f"target_{d}") for d in DIMENSIONS])


def draw(key: Column) -> Column:
    """A number in [0, 1) from a string, the same everywhere."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def drawn(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """``(row, source, lang, topic, tokens, probability)`` of the documents drawn; ``row`` holds all columns of ``docs``."""
    rows = in_cells(docs, id_col, text_col, source_col, lang_col)
    cells = keep(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    fitted = keep(rake(cells, targets, budget=budget)).select(*DIMENSIONS, "probability")
    small = fitted.count() <= ONE_TASK  # rows of a few short strings: a few MB at most
    joined = rows.join(F.broadcast(fitted) if small else fitted.hint("merge"), list(DIMENSIONS))
    return joined.where(F.col("draw") < F.col("probability")).select("row", *DIMENSIONS, "tokens", "probability")


def chosen(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, **columns: str) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are."""
    return drawn(docs, targets, budget, **columns).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``(id, source, lang, topic, tokens, probability)`` of the documents drawn."""
    return drawn(docs, targets, budget, id_col, **columns).select(F.col(f"row.`{id_col}`").alias("id"), *DIMENSIONS, "tokens", "probability")


def report(cells: DataFrame) -> DataFrame:
    """``(dimension, value, target, weight, short)`` of raked cells: tokens that a value is to have, that it gets, and what is missing."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"target_{d}").alias("target")) for d in DIMENSIONS])
    sums = cells.select(F.explode(each).alias("x"), "weight").groupBy("x.dimension", "x.value").agg(F.max("x.target").alias("target"), F.sum("weight").alias("weight"))
    return sums.withColumn("short", F.greatest(F.col("target") - F.col("weight"), F.lit(0.0)))


def marginals(mixed: DataFrame, dimension: str) -> DataFrame:
    """``(value, share)``: the tokens that were drawn, by value of a dimension."""
    every = mixed.agg(F.sum("tokens")).first()[0]
    return mixed.groupBy(F.col(dimension).alias("value")).agg((F.sum("tokens") / F.lit(every)).alias("share"))
