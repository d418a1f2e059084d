"""Repeated passages by sparse suffix arrays.

A passage is a run of at least ``length`` words that occurs more than once, in one text or several.
Of all suffixes only those at minimiser positions are retained: positions whose ``gram``-word hash is
the smallest, leftmost on ties, of ``window`` consecutive ones. The choice depends on the words alone,
so equal passages retain suffixes at equal places. Every run of ``length`` words selects one suffix
among its first ``window`` positions, and goes with it. Suffixes are sorted by their first
``length - window + 1`` words, then by id, text and position; neighbours that agree there are extended to the left and
right over the runs that select them. Each run that an earlier place (by id, then position) holds too
is repeated, and repeated runs that touch are joined, which gives the same words as comparing all runs
of ``length`` words in the corpus.

Work is linear in the words, whatever the size of a group of copies: no pairs are formed. A prefix
that very many suffixes share (as a sample of texts shows, which decides on the dealing only) is dealt
over several tasks by text; each finds what repeats in its part, and the first places of the runs, one
for each run and part, are compared in a second, small aggregation. The ``SPLIT_KEYS`` most frequent
prefixes are dealt so; any other one holds less than that part of all suffixes.

Words are split at white space. Two runs are equal if the 64-bit hashes of their prefix and of the whole
run are, so copies of a template that differ in one word stay apart. Defined results: null and empty
texts, and texts shorter than ``length`` words, repeat nothing; of copies the one with the smallest id
counts as first; ``firsts`` lists texts that hold a run at an earlier place; rows with the same id and
text are one text, rows with the same id and another text are texts of their own; a null id repeats
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, release_all, text_rows

LENGTH, WINDOW, GRAM, HOT, PARTS, SAMPLE, SPLIT_KEYS = 50, 20, 8, 50_000, 64, 32, 10_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixing of unsigned 64-bit values, wrapping."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when it is full, which costs time only."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return got


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n values, by doubling."""
    out, have, done = None, 0, h
    size = 1
    while n:
        if n & 1:
            if out is None:
                out, have = done, size
            else:
                m = len(done) - have
                out = mix(out[:m] * _MIX + done[have : have + m])
                have += size
        n >>= 1
        if n:
            m = max(0, len(done) - size)
            done = mix(done[:m] * _MIX + done[size : size + m])
            size *= 2
    return out


def leftmost_least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the smallest of every n values in a row stands, the leftmost on ties, by doubling."""
    at, size = np.arange(len(x), dtype=np.int32), 1
    while size < n:
        step = min(size, n - size)
        a, b = at[:-step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        size += step
    return at


def suffixes(texts: DataFrame, length: int, window: int, gram: int, keys_only: bool = False, hot: list[int] | None = None) -> DataFrame:
    """The retained suffixes of ``(id, h, text)``: prefix hash, part of a hot prefix, id, digest of the text, and the
    place of the first of the runs that select the suffix, with 8 bytes of hash for each run."""
    prefix = length - window + 1
    schema = "key long" if keys_only else "key long, part int, id long, h long, low int, held binary"
    busy = np.sort(np.array(hot or [], np.int64))

    def rows(ids: np.ndarray, digests: np.ndarray, words: list[list[str]], hashes: WordHashes) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words])
        h = np.fromiter((hashes[w] for listed in words for w in listed), np.uint64, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths
        left = np.repeat(begins + lengths, lengths) - np.arange(len(h))  # words from here to the end of the text
        places = np.flatnonzero(left >= length)  # of all runs
        chosen = leftmost_least(runs(h, gram), window)[places]
        new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (left[places[1:]] > left[places[:-1]])])
        at = chosen[new]
        key = runs(h, prefix)[at].view(np.int64)
        if keys_only:
            return pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
        own = np.searchsorted(begins, at, side="right") - 1
        part = np.zeros(len(at), np.int32)
        if len(busy):
            dealt = mix(ids[own].view(np.uint64)) % np.uint64(PARTS) + np.uint64(1)
            part = np.where(np.isin(key, busy), dealt, np.uint64(0)).astype(np.int32)
        offsets = (np.r_[new, len(places)] * 8).astype(np.int32)
        whole = np.ascontiguousarray(runs(h, length)[places])
        held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])
        low = (places[new] - begins[own]).astype(np.int32)
        columns = [pa.array(key), pa.array(part), pa.array(ids[own]), pa.array(digests[own]), pa.array(low), held]
        return pa.RecordBatch.from_arrays(columns, names=["key", "part", "id", "h", "low", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_all()
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                split = list(map(str.split, batch.column("text").to_pylist()))
                long = [k for k, (doc, w) in enumerate(zip(batch.column("id").to_pylist(), split, strict=True)) if doc is not None and len(w) >= length]
                if long:
                    ids, digests = (batch.column(c).take(pa.array(long)).to_numpy() for c in ("id", "h"))
                    yield rows(ids, digests, [split[k] for k in long], hashes)

    return texts.select("id", "h", "text").mapInArrow(run, schema)


#: Runs of a text that start at words low to high (both included) and are repeated; first: a text that holds one of
#: them earlier. With a run: the first place of that run in one part of a hot prefix, to be compared with other parts.
RUN = "id long, h long, low int, high int, first long, run long"


def _row_batch(ids: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, run: np.ndarray | None) -> pa.RecordBatch:
    marks = pa.nulls(len(ids), pa.int64()) if run is None else pa.array(run.view(np.int64))
    columns = [pa.array(ids), pa.array(h), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(first), marks]
    return pa.RecordBatch.from_arrays(columns, names=["id", "h", "low", "high", "first", "run"])


def _compare(grouped: DataFrame) -> DataFrame:
    """Repeated runs of suffixes that lie sorted by key, id, text and place: neighbours that share the prefix are extended."""

    def find(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
        same = key[1:] == key[:-1]
        rows = np.flatnonzero(np.r_[False, same] | np.r_[same, False] | (part > 0))
        if not len(rows):
            return
        held = t.column("held").take(pa.array(rows)).to_pylist()
        sizes = np.array([len(x) for x in held]) // 8
        of = np.repeat(rows, sizes)  # the suffix of each run
        low = t.column("low").to_numpy()[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        run = mix(key[of].view(np.uint64) * _MIX + np.frombuffer(b"".join(held), np.uint64))
        ids, h = t.column("id").to_numpy()[of], t.column("h").to_numpy()[of]
        order = np.argsort(run, kind="stable")  # earlier places stay first
        new = np.r_[True, run[order][1:] != run[order][:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = ~new & ((ids[order] != ids[head]) | (h[order] != h[head]) | (low[order] != low[head]))
        first, repeated = np.zeros(len(of), np.int64), np.zeros(len(of), bool)
        first[order], repeated[order] = ids[head], again
        # runs side by side in one suffix are one stretch
        border = np.r_[True, of[1:] != of[:-1]]
        begin = np.flatnonzero(repeated & (border | ~np.r_[False, repeated[:-1]]))
        end = np.flatnonzero(repeated & (np.r_[border[1:], True] | ~np.r_[repeated[1:], False]))
        yield _row_batch(ids[begin], h[begin], low[begin], low[end], first[begin], None)
        lead = order[new]
        lead = lead[part[of[lead]] > 0]
        if len(lead):
            yield _row_batch(ids[lead], h[lead], low[lead], low[lead], ids[lead], run[lead])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 60_000:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from find(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from find(pa.Table.from_batches(held))

    return grouped.select("key", "part", "id", "h", "low", "held").mapInArrow(run, RUN)


def repeated_passages(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row ``(id, text_hash, start_word, end_word, firsts)`` for each maximal repeated stretch of each text.

    ``text_hash`` is Spark's xxhash64 of the text, which tells rows with the same id apart; ``firsts`` lists the
    ids of texts where its runs occur before. Ids are integers.
    """
    if not (window >= 2 and length - window + 1 >= gram and window + gram - 1 <= length):
        raise ValueError("gram + window - 1 words must fit into length, and the prefix must hold a gram")
    texts = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    sampled = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    counts = suffixes(sampled, length, window, gram, keys_only=True).groupBy("key").agg(F.count("*").alias("n"))
    counts = keep(counts.where(F.col("n") > max(1, hot // SAMPLE)))
    busy = [r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(SPLIT_KEYS).collect()]
    found = suffixes(texts, length, window, gram, hot=busy)
    compared = keep(_compare(found.repartition("key", "part").sortWithinPartitions("key", "id", "h", "low")))
    hits = compared.where("run is null").drop("run")
    if busy:
        leads = compared.where("run is not null")
        earliest = leads.groupBy("run").agg(F.min(F.struct("id", "h", "low")).alias("f"), F.count("*").alias("n")).where("n > 1")
        others = leads.join(earliest.select("run", "f").hint("merge"), "run").where("struct(id, h, low) > f")
        hits = hits.unionByName(others.select("id", "h", "low", "high", F.col("f.id").alias("first")))
    order = Window.partitionBy("id", "h").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = hits.withColumn("new", F.when(F.col("low") <= reach + length, 0).otherwise(1))
    groups = groups.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = [F.min("low").alias("start_word"), (F.max("high") + length).alias("end_word"), F.sort_array(F.collect_set("first")).alias("firsts")]
    return groups.groupBy("id", F.col("h").alias("text_hash"), "g").agg(*stretch).drop("g")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end, in code points, of each word."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def without_spans(text: str, parts: list) -> str:
    """A text without the stretches ``(first word, word behind the last)``, which are sorted and apart."""
    words, kept, at = word_spans(text), [], 0
    for begin, end in parts:
        if begin > at:
            kept.append(text[(0 if at == 0 else words[at][0]) : words[begin - 1][1]])
        at = end
    if at < len(words):
        kept.append(text[words[at][0] :])
    return " ".join(kept)


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the repeated stretches cut out of their texts, other columns as they are; white space around a cut becomes one blank.

    Stretches are found by id and text, so rows that share an id keep what is theirs. Texts travel compressed.
    drop_emptied: rows of whose texts the cuts leave nothing go; texts that were empty before stay.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_"))
    text = F.col(f"`{text_col}`")
    rows = docs.select(others.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    pieces = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("raw", T.BinaryType())])

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=pieces.names)

    cuts = spans.groupBy("id", F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    joined = rows.mapInArrow(press, pieces).join(cuts.hint("merge"), ["id", "h"], "left").select("row", "raw", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out, emptied = whole.slice(at, 512), [], []
                for raw, parts in zip(batch.column("raw").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                    got = None if raw is None else unpack.decompress(raw).decode("utf-8", "surrogatepass")
                    out.append(without_spans(got, [(p["start_word"], p["end_word"]) for p in parts]) if parts and got else got)
                    emptied.append(bool(parts and got and not out[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(emptied)], names=["row", "text", "emptied"])

    clean = joined.mapInArrow(cut, T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("emptied", T.BooleanType())]))
    if drop_emptied:
        clean = clean.where(~F.col("emptied"))
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
