"""Quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is fitted on trusted texts, but for every fourth (by a hash of the id), which set the thresholds.
Each task counts the distinct n-grams of its texts before the shuffle; counts of all orders, continuation
counts, discounts and back-off weights follow by aggregations and joins on distinct n-grams, and give every
n-gram that occurs in any text its interpolated log-probability. No join is on a constant: the lowest
order's history is one row, and those of higher orders have at most as many n-grams as there are characters.

Documents meet the probabilities by sharded count joins. Texts are stored in blocks of a few million
characters. A block asks each shard of the table for the distinct n-grams that it holds, as one compressed
list; the shard answers with their log-probabilities, and the block adds up its documents' occurrences. Answers
of some blocks lie in one file, of which a block reads its own part.
A text that is longer than a block is several pieces whose sums meet by row. Neither n-grams nor texts
pass through the driver, and nothing depends on how many shards there are.

A document is kept if its perplexity for each character is at most its language's quantile of the trusted
texts that were kept apart. N-grams are whole code points; line starts stand in front of a text. Defined
results: null and empty texts have no perplexity and are kept; a null language is a language of its own; a
language without such texts takes the quantile of all of them; without any, everything is kept; repeated
rows are counted and scored each, rows without an id too; repeated labels of one id are trusted if any is;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, file_system, keep, kept_table, shared_dir
from .suffix_dedup import _MIX, mix

ORDER, QUANTILE = 5, 0.99
#: Characters of a block, n-grams of a shard, and n-grams that one task answers.
BLOCK, SHARD, ANSWERS = 8_000_000, 1_000_000, 20_000_000
#: Blocks whose answers lie together, and groups of them at most; bytes of a part of a file that is read for a block.
GROUPED, GROUPS, READ = 8, 20_000, 1 << 20
#: Up to so many trusted ids (of at most a few dozen bytes) are sent to every task; more are joined by a shuffle.
SENT_IDS = 1_000_000
SENT_LANGUAGES = 100_000


def points_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


class Grams:
    """The n-grams of some texts: ``distinct`` (n-gram by code point, in order) and ``occurring``, a number for each window."""

    def __init__(self, texts: list[str], order: int):
        points = points_of(texts)
        there = np.zeros(0x110000, bool)
        there[points] = True
        alphabet = np.flatnonzero(there).astype("<u4")
        rank = np.zeros(0x110000, np.int32)
        rank[alphabet] = np.arange(len(alphabet))
        local = rank[points]
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        windows = np.ones(len(points), bool)  # those that start in a text's last order - 1 characters are none
        for k in range(1, order):
            windows[ends - k] = False
        self.starts = np.flatnonzero(windows)
        self.sizes = lengths - (order - 1)
        code, top = local[self.starts].astype(np.int64), len(alphabet)
        for k in range(1, order):
            if top * len(alphabet) >= 1 << 62:  # many characters: number what is there so far
                names, code = np.unique(code, return_inverse=True)
                top = len(names)
            code *= len(alphabet)
            code += local[self.starts + k]
            top *= len(alphabet)
        self.codes = code
        self.names = np.unique(code)
        first = np.zeros(len(self.names), np.int64)
        self.index = pd.Index(self.names)
        first[self.occurring()] = self.starts
        self.distinct = points[first[:, None] + np.arange(order)]

    def occurring(self) -> np.ndarray:
        """The number, among the distinct n-grams, of each window."""
        return self.index.get_indexer(self.codes)


def gram_keys(grams: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each n-gram."""
    out = np.full(len(grams), seed, np.uint64)
    for k in range(grams.shape[1]):
        out = mix(out * _MIX + grams[:, k].astype(np.uint64) + np.uint64(1))
    return out


def gram_texts(grams: np.ndarray) -> list[str]:
    order, joined = grams.shape[1], np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[at : at + order] for at in range(0, len(joined), order)]


def press(grams: np.ndarray) -> bytes:
    """Sorted n-grams, compressed column by column."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(grams.T).tobytes())


def unpress(raw: bytes, order: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").reshape(order, -1).T


def spread(texts: DataFrame) -> DataFrame:
    """Texts compressed, to be moved."""
    schema = T.StructType([f for f in texts.schema.fields if f.name != "text"] + [T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(raw, pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def marked(texts: DataFrame, trusted: DataFrame, sent: int = SENT_IDS) -> DataFrame:
    """Texts (id, lang, text) with ``kind``: 1 to fit on, 2 trusted and kept apart, 0 others; trusted: (id) once each, stored."""
    fourth = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) == 2
    flags = trusted.withColumn("kind", F.when(fourth, 2).otherwise(1))
    kind = F.coalesce("kind", F.lit(0)).alias("kind")
    if trusted.count() <= sent:
        return texts.join(F.broadcast(flags), "id", "left").select("id", "lang", "text", kind)
    moved = spread(texts.where("id is not null")).join(flags.hint("merge"), "id", "left").select("id", "lang", "raw", kind)
    return moved.unionByName(spread(texts.where("id is null")).select("id", "lang", "raw", F.lit(0).alias("kind")))


#: What is known of each piece of a block.
LISTS = ("row", "id", "lang", "kind", "n")


def stored_blocks(texts: DataFrame, order: int, block: int) -> DataFrame:
    """Rows ``(block, row, id, lang, kind, n, raw)`` of some pieces of texts: n characters behind order - 1 others, compressed together."""
    has_text = "text" in texts.columns
    types = {"row": T.LongType(), "id": texts.schema["id"].dataType, "lang": T.StringType(), "kind": T.IntegerType(), "n": T.LongType()}
    lists = [T.StructField(c, T.ArrayType(types[c])) for c in LISTS]
    schema = T.StructType([T.StructField("block", T.LongType()), *lists, T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack, to = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor(), arrow_schema(schema)
        number = row = TaskContext.get().partitionId() << 33
        filled, step, held, pieces, size = 0, max(1, block // 2), [], [], 0

        def settle() -> pa.RecordBatch:
            nonlocal held, pieces, size
            raw = pack.compress("".join(pieces).encode("utf-8", "surrogatepass"))
            columns = [[number], *([list(c)] for c in zip(*held, strict=True)), [raw]]
            held, pieces, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to, strict=True)], names=schema.names)

        for batch in batches:
            for doc, lang, kind, got in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                text = "\n" * (order - 1) + (got if has_text else unpack.decompress(got).decode("utf-8", "surrogatepass"))
                for begin in range(0, max(1, len(text) - order + 1), step):
                    piece = text[begin : begin + step + order - 1]
                    held.append((row, doc, lang, kind, len(piece) - order + 1))
                    pieces.append(piece)
                    size, filled = size + len(piece), filled + len(piece)
                    if size >= 1 << 18 or filled >= step:
                        yield settle()
                    if filled >= step:
                        number, filled = number + 1, 0
                row += 1
        if held:
            yield settle()

    return texts.select("id", "lang", "kind", "text" if has_text else "raw").mapInArrow(run, schema)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, which follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and b > a and held[0].column("block")[0].as_py() != numbers[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(part: pa.Table, column: str) -> pa.Array:
    return part.column(column).combine_chunks().flatten()


def texts_of(part: pa.Table, order: int) -> list[str]:
    unpack, out = zstandard.ZstdDecompressor(), []
    for raw, sizes in zip(part.column("raw").to_pylist(), part.column("n").to_pylist(), strict=True):
        text, at = unpack.decompress(raw).decode("utf-8", "surrogatepass"), 0
        for n in sizes:
            out.append(text[at : at + n + order - 1])
            at += n + order - 1
    return out


def counted(stored: DataFrame, order: int) -> DataFrame:
    """``(g, n)``: each n-gram that a text holds, with its count in texts to fit on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_block(batches):
            grams = Grams(texts_of(part, order), order)
            if not len(grams.names):
                continue
            fit = np.repeat(flat(part, "kind").to_numpy() == 1, grams.sizes)
            n = np.bincount(grams.index.get_indexer(grams.codes[fit]), minlength=len(grams.names))
            yield pa.RecordBatch.from_arrays([pa.array(gram_texts(grams.distinct), pa.string()), pa.array(n.astype(np.int64))], names=["g", "n"])

    return stored.select("block", "kind", "n", "raw").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def log_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """``(g, logp)`` for every n-gram of a stored table (g, n): interpolated modified Kneser-Ney, down to a uniform start."""

    def tail(k: int) -> Column:
        return F.substring("g", 2, k)  # without the first of k + 1 characters

    # a lower order counts what stands in front; n-grams that no text to fit on holds go along with a count of 0
    levels = {order: grams.select("g", "n")}
    for k in range(order - 1, 0, -1):
        levels[k] = kept_table(levels[k + 1].groupBy(tail(k).alias("g")).agg(F.count_if(F.col("n") > 0).alias("n")))
    lower = None
    for k in range(1, order + 1):
        counts = {r["n"]: r["count"] for r in levels[k].where("n between 1 and 4").groupBy("n").count().collect()}  # four numbers
        n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d1, d2, d3 = (min(i, max(0.0, i - (i + 1) * y * b / a)) if a else 0.5 * y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("n") == 1, F.lit(d1)).when(F.col("n") == 2, F.lit(d2)).otherwise(F.lit(d3))
        if k == 1:  # one history
            start = levels[1].agg(F.sum("n").alias("total"), F.sum(discount).alias("mass"), F.count("*").alias("size")).first()
            out = levels[1].withColumn("total", F.lit(start["total"] or 0)).withColumn("mass", F.lit(start["mass"] or 0.0)).withColumn("p", F.lit(1.0 / max(1, start["size"])))
        else:  # a history, and a lower n-gram, has at most as many n-grams as there are characters
            same = Window.partitionBy("h")
            out = levels[k].withColumn("h", F.substring("g", 1, k - 1)).withColumn("total", F.sum("n").over(same)).withColumn("mass", F.sum(discount).over(same))
            out = out.withColumn("t", tail(k - 1)).join(lower.select(F.col("g").alias("t"), "p").hint("merge"), "t")
        p = F.when(F.col("total") == 0, F.col("p")).otherwise((F.col("n") - discount) / F.col("total") + F.col("mass") / F.col("total") * F.col("p"))
        lower = kept_table(out.select("g", p.alias("p")))
    return lower.select("g", F.log("p").alias("logp"))


ASK = "shard int, part int, block long, grams binary, logp binary"


def asked(stored: DataFrame, order: int, shards: int, parts: int) -> DataFrame:
    """What each block asks each shard: its distinct n-grams there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_block(batches):
            grams, number = Grams(texts_of(part, order), order).distinct, part.column("block")[0].as_py()
            own = (gram_keys(grams, 1) % np.uint64(shards)).astype(np.int64)
            rows = [(s, number % parts, number, press(grams[own == s]), None) for s in np.unique(own).tolist()]
            if rows:
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "part", "block", "grams", "logp"])

    return stored.select("block", "n", "raw").mapInArrow(run, ASK)


def dealt(table: DataFrame, order: int, shards: int, parts: int) -> DataFrame:
    """The table (g, logp) by shard, once for each part, in rows of many n-grams without a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = points_of(batch.column("g").to_pylist()).reshape(-1, order)
            logp = batch.column("logp").to_numpy().astype("<f4")
            own = (gram_keys(grams, 1) % np.uint64(shards)).astype(np.int64)
            for s in np.unique(own).tolist():
                at = np.flatnonzero(own == s)
                row = (press(grams[at]), zstandard.compress(logp[at].tobytes()))
                columns = [pa.array([s] * parts, pa.int32()), pa.array(range(parts), pa.int32()), pa.nulls(parts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x] * parts, pa.binary()) for x in row)], names=["shard", "part", "block", "grams", "logp"])

    return table.select("g", "logp").mapInArrow(run, ASK)


def answered(rows: DataFrame, order: int) -> DataFrame:
    """``(block, shard, logp)`` for rows that lie sorted by shard and part, the table's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        at, found, grams, logp = None, None, [], []
        for batch in batches:
            for shard, part, block, raw, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, part) != at:
                    at, found, grams, logp = (shard, part), None, [], []
                if block is None:
                    grams.append(unpress(raw, order))
                    logp.append(np.frombuffer(inflate(values), "<f4"))
                    continue
                if found is None:
                    known, value, seed = np.concatenate(grams), np.concatenate(logp), 2
                    while not (found := pd.Index(gram_keys(known, seed))).is_unique:
                        seed += 1
                mine = unpress(raw, order)
                place = found.get_indexer(gram_keys(mine, seed))
                if (known[place] != mine).any():
                    raise RuntimeError("an n-gram is not in the table")
                reply = zstandard.compress(value[place].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([reply], pa.binary())], names=["block", "shard", "logp"])

    return rows.select("shard", "part", "block", "grams", "logp").mapInArrow(run, "block long, shard int, logp binary")


def added_up(stored: DataFrame, folder: str, order: int, shards: int) -> DataFrame:
    """``(row, id, lang, kind, n, logp)`` of each piece; a block reads the answers that are its own."""
    schema = T.StructType([T.StructField(c, stored.schema[c].dataType.elementType) for c in LISTS] + [T.StructField("logp", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, place = file_system(folder)
        inflate = zstandard.ZstdDecompressor().decompress
        for part in by_block(batches):
            grams = Grams(texts_of(part, order), order)
            sums = np.zeros(len(grams.sizes))
            if len(grams.names):
                number, group = part.column("block")[0].as_py(), part.column("grp")[0].as_py()
                answer = pq.read_table(f"{place}/grp={group}", filesystem=system, partitioning=None, filters=[("block", "=", number)])
                own = (gram_keys(grams.distinct, 1) % np.uint64(shards)).astype(np.int64)
                logp = np.zeros(len(own))
                for s, raw in zip(answer.column("shard").to_pylist(), answer.column("logp").to_pylist(), strict=True):
                    logp[own == s] = np.frombuffer(inflate(raw), "<f4")
                rows = np.repeat(np.arange(len(sums)), grams.sizes)
                sums = np.bincount(rows, logp[grams.occurring()], len(sums))
            yield pa.RecordBatch.from_arrays([*(flat(part, c) for c in LISTS), pa.array(sums)], names=schema.names)

    return stored.select("block", "grp", "raw", *LISTS).mapInArrow(run, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    order: int = ORDER,
    block: int = BLOCK,
    shard: int = SHARD,
    sent: int = SENT_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """``(id, lang, n_chars, perplexity, threshold, kept)`` of every row."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    good = labels.where((F.col(f"`{label_col}`") > 0) & F.col(f"`{id_col}`").isNotNull())
    trusted = keep(good.select(F.col(f"`{id_col}`").cast(id_type).alias("id")).distinct())
    texts = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    stored = keep(stored_blocks(marked(texts, trusted, sent), order, block))
    table = log_probabilities(kept_table(counted(stored, order)), order)
    size = table.count()
    chars = stored.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    parts = max(1, int(chars // (20 * shards * ANSWERS)))  # a block holds at most about a twentieth of its characters as distinct n-grams
    rows = asked(stored, order, shards, parts).unionByName(dealt(table, order, shards, parts))
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("block").asc_nulls_first())
    folder = f"{shared_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    groups = max(1, min(GROUPS, stored.select("block").distinct().count() // GROUPED))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("grp")
    told = answered(rows, order).select("block", "shard", "logp", group).repartition(groups, "grp").sortWithinPartitions("grp", "block")
    told.write.option("parquet.block.size", READ).option("compression", "uncompressed").partitionBy("grp").parquet(folder)
    pieces = added_up(stored.select("*", group), folder, order, shards)
    same = [F.first(c).alias(c) for c in ("id", "lang", "kind")]
    scored = keep(pieces.groupBy("row").agg(*same, F.sum("n").alias("n"), F.sum("logp").alias("logp")))
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))))
    known = scored.where("perplexity is not null and kind = 2")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    whole = known.agg(at).first()[0]  # one number
    limits = keep(known.groupBy("lang").agg(at.alias("threshold")))
    limits = F.broadcast(limits) if limits.count() <= SENT_LANGUAGES else limits.hint("merge")
    joined = scored.join(limits, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(whole).cast("double")))
    return joined.select("id", "lang", F.col("n").alias("n_chars"), "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
