"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

``token_pieces`` cuts documents into pieces of at most ``capacity`` tokens; ``pack`` puts pieces into
sequences. Pieces of full length are sequences by themselves. The others are dealt at random into
shards of a few thousand pieces, whatever their source or length, so a shard is bounded and a hot
source is spread. Each shard is evolved on several islands with populations of their own; after every
epoch an island's elite moves to the next island of its shard. A chromosome is a grouping: the
sequence number of every piece. Populations start from pieces in random order, each put where it fits
best. Crossover injects whole well-filled sequences of another parent, removes the sequences that hold
duplicates of the injected pieces, and best-fits the displaced ones, longest first; children replace the
worst. In the last epoch the grouping by best-fit decreasing joins, so that none is worse than it. An
island stops at the least number of sequences that the tokens allow.

Defined results: a null text is empty and is one piece of one token; repeated rows are packed as often
as they occur; an empty table gives an empty result; ties between equal lengths are broken by order of
the stored rows. Pieces of equal length are interchangeable, so sequence numbers carry no meaning.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import holding, keep, map_batches, text_rows

CAPACITY, SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN = 2048, 4096, 2, 3, 8, 16
#: Characters that are tokenized together, which bounds a task's memory.
TEXT_BLOCK = 3 << 20

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def blocks(texts: list[str], size: int = TEXT_BLOCK) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield texts[begin : k + 1]
            begin, held = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    with_ids: bool = False,
    cache: int = 250_000,
) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the ids themselves. cache: pre-tokens that a worker remembers."""

    def cut(batch: pa.RecordBatch) -> list:
        from .wordbpe import word_ids

        holding("word ids", word_ids.cache_clear)
        coder = word_ids(tokenizer, cache)
        end, take, rows, ids = np.array([end_id], "<u4").tobytes(), [], [], []
        encoded = (raw for block in blocks(batch.column(1).to_pylist()) for raw in coder.batch(block))
        for row, raw in enumerate(encoded):
            raw += end
            for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                take.append(row)
                rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype("i4"))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        return [batch.column(0).take(pa.array(take, pa.int64())), *columns] + [ids] * with_ids

    schema = T.StructType([*PIECES.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return map_batches(text_rows(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")), cut, schema, rows=4096)


class Grouping:
    """Groupings of one shard's pieces, which are sorted by length, longest first."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lengths, self.capacity, self.rng = lengths, capacity, rng

    def best_fit(self, order, where: np.ndarray, rooms: list[tuple[int, int]], bins: int) -> np.ndarray:
        """Put pieces into the fullest sequence with room, else into a new one. rooms: sorted (room, sequence)."""
        lengths = self.lengths
        for i in order:
            need = int(lengths[i])
            k = bisect_left(rooms, (need, -1))
            if k < len(rooms):
                room, to = rooms.pop(k)
            else:
                room, to, bins = self.capacity, bins, bins + 1
            where[i] = to
            if room > need:
                insort(rooms, (room - need, to))
        return where

    def fresh(self) -> np.ndarray:
        """Pieces in random order, each put where it fits best."""
        return self.best_fit(self.rng.permutation(len(self.lengths)).tolist(), np.full(len(self.lengths), -1), [], 0)

    def decreasing(self) -> np.ndarray:
        """Best-fit decreasing."""
        return self.best_fit(range(len(self.lengths)), np.full(len(self.lengths), -1), [], 0)

    def fill(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, self.lengths).astype(np.int64)

    def fitness(self, where: np.ndarray) -> float:
        """Fewer sequences first, then uneven filling, which leaves room to empty one more."""
        fill = self.fill(where)
        return -len(fill) + float(np.mean((fill / self.capacity) ** 2))

    def child(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inject well-filled sequences of ``b`` into ``a``."""
        fill_b = self.fill(b)
        good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.6))
        chosen = np.zeros(len(fill_b), bool)
        chosen[good[self.rng.random(len(good)) < 0.5]] = True
        injected = chosen[b]
        fill_a = self.fill(a)
        lost = np.zeros(len(fill_a), bool)
        lost[a[injected]] = True  # they hold duplicates
        lost |= (fill_a < np.quantile(fill_a, 0.02)) | (self.rng.random(len(fill_a)) < 0.01)  # mutation: empty the worst and a few more
        stay, renumber = ~lost[a] & ~injected, np.cumsum(~lost) - 1
        where = np.full(len(a), -1)
        where[stay] = renumber[a[stay]]
        kept = int((~lost).sum())
        where[injected] = kept + (np.cumsum(chosen) - 1)[b[injected]]
        bins = kept + int(chosen.sum())
        room = self.capacity - np.bincount(where[where >= 0], self.lengths[where >= 0], bins).astype(np.int64)
        rooms = sorted((int(room[k]), k) for k in np.flatnonzero(room > 0).tolist())
        return self.best_fit(np.flatnonzero(where < 0).tolist(), where, rooms, bins)

    def evolve(self, elites: list[np.ndarray], population: int, children: int, last: bool = True) -> tuple[np.ndarray, int]:
        """The best grouping after at most ``children`` children, and how many there were."""
        people = [*elites, *(self.fresh() for _ in range(population - len(elites)))]
        people += [self.decreasing()] if last else []
        people = sorted(people, key=self.fitness, reverse=True)[:population]
        bound, born = -(-int(self.lengths.sum()) // self.capacity), 0
        while born < children and people[0].max(initial=-1) + 1 > bound:
            i, j = self.rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
            people.append(self.child(people[i], people[j]))
            people = sorted(people, key=self.fitness, reverse=True)[:population]
            born += 1
        return people[0], born


ISLAND = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("island", T.IntegerType()),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("elite", T.ArrayType(T.IntegerType())),
        T.StructField("fitness", T.DoubleType()),
        T.StructField("born", T.IntegerType()),
    ]
)


def _epoch(islands: DataFrame, epoch: int, last: bool, capacity: int, population: int, children: int) -> DataFrame:
    """Evolve every island by one epoch: rows (shard, island, lengths, elites) give rows of ``ISLAND``."""
    ints = pa.list_(pa.int32())
    types = [pa.int64(), pa.int32(), ints, ints, pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, island, lengths, elites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Grouping(np.array(lengths), capacity, np.random.default_rng([shard, island, epoch]))
                best, born = own.evolve([np.array(e) for e in elites or []], population, children, last)
                row = (shard, island, lengths, best.astype("i4"), own.fitness(best), born)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=ISLAND.names)

    return islands.select("shard", "island", "lengths", "elites").mapInArrow(run, ISLAND)


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    shard_size: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    children: int = CHILDREN,
    length_col: str = "length",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are between 1 and ``capacity``."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]  # these are given anew
    columns = [F.col(f"_.`{c}`").alias(c) for c in names]
    stored = keep(pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_"), F.monotonically_increasing_id().alias("row")))
    length = F.col(f"_.`{length_col}`")
    full = length >= capacity
    whole = stored.where(full).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = stored.where(~full)
    shards = max(1, -(-rest.count() // shard_size))
    # a shard holds about shard_size pieces, however many there are in all
    item = F.struct((-length).cast("int").alias("l"), F.col("row").alias("r"))
    dealt = rest.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), item.alias("item"))
    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4, 10_000))
    sorted_shards = keep(dealt.groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items")).repartition(tasks))
    lengths = F.transform("items", lambda x: -x["l"])
    every = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    none = F.lit(None).cast("array<array<int>>")
    state = sorted_shards.select("shard", lengths.alias("lengths"), every.alias("island")).withColumn("elites", none)
    for epoch in range(epochs):
        last = epoch == epochs - 1
        evolved = keep(_epoch(state, epoch, last, capacity, population, children))
        if not last:  # an island keeps its elite and gets that of the island before
            to = F.explode(F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))))
            met = evolved.select("shard", to.alias("to"), "lengths", F.struct("fitness", "elite").alias("e"))
            met = met.groupBy("shard", F.col("to").alias("island")).agg(F.first("lengths").alias("lengths"), F.collect_list("e").alias("e"))
            state = met.select("shard", "island", "lengths", F.transform(F.sort_array("e"), lambda x: x["elite"]).alias("elites"))
    best = evolved.groupBy("shard").agg(F.max_by("elite", F.struct("fitness", "island")).alias("elite"))
    zipped = F.explode(F.arrays_zip(F.col("items"), F.col("elite"))).alias("z")
    placed = sorted_shards.join(best.hint("merge"), "shard").select("shard", zipped)
    placed = placed.select(F.col("z.items.r").alias("row"), (F.col("shard") * F.lit(1 << 24) + F.col("z.elite")).alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    packed = rest.join(placed.hint("merge"), "row").withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))
    return whole.unionByName(packed.select(*columns, "sequence_id", "offset"))
