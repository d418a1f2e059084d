"""Near-duplicates by SimHash: candidates from SimHash tables, confirmed by the Jaccard similarity of word shingles.

The SimHash of a text's shingle set has ``TABLES`` times ``BITS`` bits. Texts with equal ones are one class, so copies are
never expanded. A similarity of 0.8 is a cosine of 0.889 at least, so a bit differs with probability 0.151. That is
about ten of 64 bits, which no tables of such short codes find without comparing most pairs; the wide SimHash is cut
into ``TABLES`` segments of ``BITS`` bits, and a pair of similarity 0.8 has at least one segment in common with
probability 0.9997. Rows of a table entry are near when ``NEAR`` of the first 256 bits differ at most (at 0.8 or more
that fails for one in 150,000; texts without a common shingle differ in 128). What the tables find is confirmed by the
Jaccard similarity of the whole shingle sets of the classes' representatives.

Sets of four to seven shingles may differ in more bits, up to 0.188 of them, so they enter a second family of segments as well, with
limits of their own. Smaller sets reach 0.8 with none but equal ones.

A table entry does not give all pairs of a group, but a link from its lowest class to each of what is near there, and
the links of a class are replaced by those of its lowest neighbour, so a group has few more than classes. What these
links connect is compared as a whole: every pair whose SimHashes differ in few enough bits, as long as it is still apart.
So each class's shingle set moves once. Groups of more than ``LARGE`` classes are dealt in blocks, and each
pair of blocks is compared in a task of its own.

Defined results: null and empty texts are one class and link with nothing else; a text shorter than a
shingle is one shingle; rows that share an id are told apart by their text, and each may stand for a group;
rows without an id stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, first_rows, keep, pressed, release_all, text_hash, text_rows
from .simhash import shingle_hashes
from .suffix_dedup import _MIX, mix

TABLES, BITS, LARGE = 64, 13, 2000
SIMILARITY = 0.8
LEAST, SHORT = 4, 8  # sets of fewer shingles: are similar to none but equal ones; differ in more bits
FIRST, NEAR, NEAR_SHORT = 24, 66, 78  # of 64 and of 256 bits, in table entries
FAR, FAR_SHORT = 178, 208  # of all bits, before shingle sets are compared
DENSE = 8
_WORDS = TABLES * BITS // 64
_STEPS = np.arange(_WORDS, dtype=np.uint64) * _MIX
_NUMBERS = ["key", "fp", "w0", "w1", "w2", "w3"]


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """SimHash, as 64-bit words, of a set of shingle hashes."""
    ones = np.zeros(TABLES * BITS, np.int64)
    for at in range(0, len(hashes), 255):
        words = mix(hashes[at : at + 255, None] + _STEPS)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def table_keys(wide: np.ndarray, family: int = 0) -> np.ndarray:
    """One key for each segment of each SimHash; the second family's segments lie across the first one's."""
    bits = np.roll(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), family * (BITS // 2), axis=1)
    values = bits.reshape(-1, TABLES, BITS).astype(np.float32) @ (1 << np.arange(BITS)).astype(np.float32)
    return values.astype(np.int64) + (np.arange(TABLES) + family * TABLES << BITS)


def signed(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, fp, wide, size)``: the text's hash, the number of its class, its SimHash and how many shingles it has."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("size", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_all()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
                wide = [wide_simhash(x).tobytes() for x in sets]
                fp = np.array([xxhash.xxh64_intdigest(w) for w in wide], np.uint64).view(np.int64)
                columns = [pa.array(fp), pa.array(wide, pa.binary()), pa.array([len(x) for x in sets], pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=schema.names)

    return text_rows(docs, id_col, text_col).withColumn("h", text_hash("text")).mapInArrow(run, schema)


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _WORDS)


def entries(classes: DataFrame) -> DataFrame:
    """``(key, fp, w0 to w3)``: each class (fp, wide, size) once in every table, with the first 256 bits of its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                fp, size, wide = batch.column("fp").to_numpy(), batch.column("size").to_numpy(), _words(batch.column("wide"))
                for family, enters in enumerate((size >= LEAST, (size >= LEAST) & (size < SHORT))):
                    if enters.any():
                        one = [fp[enters], *wide[enters, :4].view(np.int64).T]
                        columns = [table_keys(wide[enters], family).ravel(), *(np.repeat(c, TABLES) for c in one)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NUMBERS)

    return classes.select("fp", "wide", "size").mapInArrow(run, ", ".join(f"{n} long" for n in _NUMBERS))


def _nearest_lowest(words: np.ndarray, limit: int) -> np.ndarray:
    """The lowest row that near ones connect each row of one table entry with.

    Rows of the largest component need not be looked at: a link between two components has an end outside it.
    """
    label, done = np.arange(words.shape[1]), np.zeros(words.shape[1], bool)
    while True:
        names, sizes = np.unique(label, return_counts=True)
        rest = np.flatnonzero(~done & (label != names[sizes.argmax()]))
        if not len(rest):
            return label
        i = int(rest[0])
        near = np.bitwise_count(words ^ words[:, i : i + 1]).sum(axis=0) <= limit
        roots = np.unique(label[near])
        label[np.isin(label, roots)] = roots[0]
        done[i] = True


def near_rows(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the lowest row to each of what near rows connect in whole table entries. key: sorted; words: by column.

    Each row is compared with the next one, the next but one and so on of its entry, for all entries together.
    Entries with more than ``DENSE`` times as many near pairs as rows are gone through component by component.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    entry = np.repeat(np.arange(len(starts)), sizes)
    after = (starts + sizes)[entry] - np.arange(len(key)) - 1
    limit = np.where(key >> BITS < TABLES, NEAR, NEAR_SHORT)
    found, dense = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(len(key)), 1
    while True:
        if step & (step - 1) == 0:  # entries that are through are left out now and then
            at = at[((sizes > step) & ~dense)[entry[at]]]
            head, rest = words[0, at], after[at]
        if step >= len(at):
            break
        near = np.flatnonzero((np.bitwise_count(head[:-step] ^ head[step:]) <= FIRST) & (rest[:-step] >= step))
        i, j = at[near], at[near + step]
        fits = np.bitwise_count(words[:, i] ^ words[:, j]).sum(axis=0) <= limit[i]
        if fits.any():
            a.append(i[fits])
            b.append(j[fits])
            found += np.bincount(entry[i[fits]], minlength=len(starts))
            dense |= found > DENSE * sizes
        step += 1
    left, right = np.concatenate(a), np.concatenate(b)
    few = ~dense[entry[left]]
    left, right, label = left[few], right[few], np.arange(len(key))
    while (label[left] != label[right]).any():
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        label = label[label]
    for k in np.flatnonzero(dense).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        label[part] = starts[k] + _nearest_lowest(words[:, part], int(limit[starts[k]]))
    rows = np.flatnonzero(label != np.arange(len(key)))
    return label[rows], rows


def candidates(classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of class numbers, of classes (fp, wide, size), that connect what may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size = np.empty((len(_NUMBERS), 0), np.int64), [], 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, size
            rows = np.concatenate([rows, *held], axis=1)
            held, size = [], 0
            cut = rows.shape[1] if last else int(np.searchsorted(rows[0], rows[0, -1]))
            if cut:
                a, b = near_rows(rows[0, :cut], rows[2:, :cut].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(rows[1, a]), pa.array(rows[1, b])], names=["a", "b"])
                rows = rows[:, cut:]

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in _NUMBERS]))
            size += batch.num_rows
            if size >= 50_000:
                yield from settle(False)
        if held or rows.shape[1]:
            yield from settle(True)

    links = entries(classes).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")
    stars = links.groupBy("b").agg(F.collect_set("a").alias("to"))  # one of each table at most
    least = F.array_min("to")
    joined = F.transform("to", lambda a: F.struct(least.alias("a"), F.when(a == least, F.col("b")).otherwise(a).alias("b")))
    return stars.select(F.explode(joined).alias("link")).select("link.*").distinct()


def held_sets(docs: DataFrame, needed: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(fp, held)``: the shingle set of each needed class (fp, id, h), from the text of the row that stands for it."""
    rows = pressed(text_rows(docs, id_col, text_col).withColumn("h", text_hash("text")), "text")
    moved = rows.join(needed.hint("merge"), ["id", "h"]).groupBy("fp").agg(F.min("text").alias("text"))  # copies of the row

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                held = [np.unique(shingle_hashes(unpack.decompress(raw).decode("utf-8", "surrogatepass"), shingle)).tobytes() for raw in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(held, pa.binary())], names=["fp", "held"])

    return moved.mapInArrow(sets, "fp long, held binary")


def similar_links(sets: list[np.ndarray], wide: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of left and of right that connect what is similar; nearest SimHashes are tried first."""
    label, links = np.arange(len(sets)), []
    sizes = np.array([len(x) for x in sets])
    for i in left.tolist():
        apart, least = np.bitwise_count(wide[right] ^ wide[i]).sum(axis=1), np.minimum(sizes[right], sizes[i])
        fits = (apart <= np.where(least < SHORT, FAR_SHORT, FAR)) & (least >= similarity * np.maximum(sizes[right], sizes[i]))
        for j in right[fits][np.argsort(apart[fits], kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common < similarity * (sizes[i] + sizes[j] - common):
                continue
            links.append((i, j))
            label[label == label[j]] = label[i]
    return links


def confirmed(members: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of what is similar. members: (component, n, fp, wide, held)."""
    blocks = F.ceil(F.col("n") / LARGE).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    dealt = members.select("component", own.alias("own"), F.explode(every).alias("at"), "fp", "wide", "held")
    dealt = dealt.select("component", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own", "fp", "wide", "held")

    def compare(t: pa.Table) -> pa.RecordBatch:
        fp, own = t.column("fp").to_numpy(), t.column("own").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("held").to_pylist()]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        links = similar_links(sets, _words(t.column("wide")), np.flatnonzero(own == i), np.flatnonzero(own == j), similarity)
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")), strict=True))
            begin = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != (keys[begin] if k > begin else keys[k]):
                    if held and keys[begin] != at:
                        yield compare(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(begin, k - begin))
                    at, begin = keys[begin], k
        if held:
            yield compare(pa.Table.from_batches(held))

    place = ["component", "i", "j"]
    return dealt.repartition(*place).sortWithinPartitions(*place, "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, group, component_id)`` of every row with an id: its text's hash, the number of its group and the smallest id there."""
    if similarity < SIMILARITY:
        raise ValueError(f"the tables find similarities of {SIMILARITY} and more")
    marked = keep(signed(docs.where(F.col(f"`{id_col}`").isNotNull()), shingle, id_col, text_col))
    one = F.min_by(F.struct("id", "h", "wide", "size"), F.struct("id", "h")).alias("s")
    first = keep(marked.groupBy("fp").agg(one).select("fp", "s.id", "s.h", "s.wide", "s.size"))
    groups = keep(components(candidates(first)).withColumnRenamed("id", "fp"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = first.join(groups.hint("merge"), "fp")
    held = held_sets(docs, members.select("fp", "id", "h"), shingle, id_col, text_col)
    full = members.select("fp", "wide", "component").join(sizes.hint("merge"), "component").join(held.hint("merge"), "fp")
    found = components(confirmed(full, similarity)).withColumnRenamed("id", "fp")
    joined = first.select("fp", "id").join(found.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = joined.join(least.hint("merge"), "component").select("fp", F.col("component").alias("group"), "component_id")
    return marked.select("id", "h", "fp").join(named.hint("merge"), "fp").select("id", "h", "group", "component_id")


def one_of_similar(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, one with its smallest id. Rows without an id stay."""
    return first_rows(docs, near_duplicates(docs, shingle, similarity, id_col, text_col), id_col, text_col)
