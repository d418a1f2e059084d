"""Nearest neighbours by largest inner product, from balanced posting lists.

Inner products become distances first: with M the greatest length of a vector, a vector x gets one more
component, sqrt(M * M - |x| * |x|), and a query, scaled to length M, gets 0 there; the nearest are then those
with the largest inner product. Equal vectors are one class, with the smallest ids only.

Lists: a sample of about ``sample`` classes (all, if fewer) is cut by k-means whose clusters pay for their
size, again and again, until about ``size`` vectors of the table belong to a leaf; the leaves' means are the
centroids, their number bounded by the sample and by ``MODEL_BYTES``. Each centroid has links to near ones
that no other link leads to, and a few entry points lead into that graph, which every task holds in memory.

Entries: every vector is searched in the graph and enters the list of its nearest centroid, and further lists
up to ``replicate`` farther (of the ``NEAR`` nearest) whose centroids are not nearer to one that holds it: boundary
vectors stand in several lists.

Search: a query goes along the graph over all centroids up to ``prune`` farther than the nearest, and asks
those lists: few where the nearest centroid is close, many where all are alike, but the ``ASKED`` nearest at least,
so that a query amid a tight group finds enough. No greatest number of lists is fixed.
Neighbouring lists are shards; vectors and queries of a shard meet in blocks of bounded size, however large it
is. Products in double precision, computed alike in all blocks, give each query's best there, and those of
all shards the result.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or are so long that
their square is no number take no part; nor do rows without an id, and vectors not as long as most of the
sample. Rows with one id and unlike vectors are rows of their own; repeated rows count once. Fewer candidates
give shorter results; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep
from .itq import usable

SAMPLE, SIZE, REPLICATE, PRUNE, NEAR, ASKED = 200_000, 128, 0.1, 0.25, 32, 8
#: Bytes of the centroids at most; links of a centroid; vectors of a shard; vectors and queries of a block.
MODEL_BYTES, LINKS, SHARD, BLOCK_VECTORS, BLOCK_QUERIES = 64_000_000, 24, 8_192, 16_384, 4_096


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1))


def balanced_leaves(x: np.ndarray, size: float, branches: int = 8, turns: int = 8, seed: int = 0) -> np.ndarray:
    """Means of balanced clusters of about ``size`` rows; neighbours in the order are near each other."""
    rng, out, stack = np.random.default_rng(seed), [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        k = min(branches, round(len(rows) / size))
        if k < 2:
            out.append(x[rows].mean(axis=0))
            continue
        part = x[rows]
        centers, held = part[rng.choice(len(rows), k, replace=False)].copy(), np.zeros(k)
        for turn in range(turns):
            far = squares(part, centers)
            cost = far + (held * k / len(rows) - 1) * (0.3 * far.mean() * (turn > 0))
            of = cost.argmin(axis=1)
            held = np.bincount(of, minlength=k).astype(float)
            for j in np.flatnonzero(held):
                centers[j] = part[of == j].mean(axis=0)
        if held.max() > 0.7 * len(rows):  # alike: cut along a line
            of = np.empty(len(rows), np.int64)
            of[np.argsort(part @ rng.normal(size=x.shape[1]), kind="stable")] = np.arange(len(rows)) * k // len(rows)
        line = np.argsort(centers @ (centers[-1] - centers[0]))
        stack += [rows[of == j] for j in line if (of == j).any()]
    return np.array(out)


class Graph:
    """Centroids, the links between them and where a search begins."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray, entries: np.ndarray):
        self.c, self.links, self.entries = centroids, links, entries
        self.norms = (centroids * centroids).sum(axis=1)

    @classmethod
    def over(cls, centroids: np.ndarray, links: int = LINKS, seed: int = 0) -> Graph:
        n = len(centroids)
        near = min(n - 1, 2 * links)
        out = np.full((n, links), -1, np.int32)
        for at in range(0, n, 512):
            own = np.arange(at, min(n, at + 512))
            far = squares(centroids[own], centroids)
            far[np.arange(len(own)), own] = np.inf
            close = np.argpartition(far, near - 1, axis=1)[:, :near] if near else np.zeros((len(own), 0), int)
            close = np.take_along_axis(close, np.argsort(np.take_along_axis(far, close, 1), axis=1), 1)
            for row, listed in zip(own.tolist(), close, strict=True):
                # first those that no nearer link leads to, then the nearest of the others
                between, to = squares(centroids[listed], centroids[listed]), far[row - at, listed]
                taken: list[int] = []
                for k in range(len(listed)):
                    if not taken or (between[k, taken] >= to[k]).all():
                        taken.append(k)
                rest = [k for k in range(len(listed)) if k not in set(taken)]
                chosen = listed[(taken + rest)[:links]]
                out[row, : len(chosen)] = chosen
        entries = np.random.default_rng(seed).choice(n, min(n, 8 + int(2 * n**0.5)), replace=False)
        return cls(centroids, out, entries)

    def within(self, x: np.ndarray, more: float, least: int = 1) -> np.ndarray:
        """Distances from the rows of x to the centroids up to ``more`` farther than the nearest found, or among the ``least`` nearest (others: infinite)."""
        least = min(least, len(self.c))
        far = np.full((len(x), len(self.c)), np.inf, np.float32)
        norms = (x * x).sum(axis=1)
        far[:, self.entries] = np.sqrt(squares(x, self.c[self.entries]))
        seen = np.zeros(far.shape, bool)
        while True:
            limit = np.maximum(far.min(axis=1, keepdims=True) * np.float32(1 + more), np.partition(far, least - 1, axis=1)[:, least - 1 : least])
            rows, at = np.nonzero((far <= limit) & ~seen)
            if not len(rows):
                break
            seen[rows, at] = True
            next_ = self.links[at]
            pairs = np.stack([np.repeat(rows, next_.shape[1]), next_.ravel()])[:, next_.ravel() >= 0]
            pairs = pairs[:, np.isinf(far[pairs[0], pairs[1]])]
            met = np.unique(pairs[0] * len(self.c) + pairs[1])
            for part in np.array_split(met, len(met) // 200_000 + 1):
                r, k = part // len(self.c), part % len(self.c)
                far[r, k] = np.sqrt(np.maximum(0, norms[r] - 2 * np.einsum("ij,ij->i", x[r], self.c[k]) + self.norms[k]))
        far[far > limit] = np.inf
        return far

    def holders(self, far: np.ndarray, near: int = NEAR) -> list[list[int]]:
        """The lists that a vector enters, from its distances: the nearest, and others that no holder is nearer to."""
        near = min(near, far.shape[1])
        close = np.argpartition(far, near - 1, axis=1)[:, :near]
        to = np.take_along_axis(far, close, 1)
        order = np.argsort(to, axis=1)
        close, to = np.take_along_axis(close, order, 1), np.take_along_axis(to, order, 1)
        held = np.zeros(close.shape, bool)
        held[:, 0] = True
        for k in range(1, near):
            open_ = np.flatnonzero(np.isfinite(to[:, k]))
            if not len(open_):
                break
            free = np.ones(len(open_), bool)
            for j in range(k):
                both = np.flatnonzero(held[open_, j] & free)
                a, b = self.c[close[open_[both], k]], self.c[close[open_[both], j]]
                free[both] = np.sqrt(((a - b) ** 2).sum(axis=1)) >= to[open_[both], k]
            held[open_[free], k] = True
        return [row[h].tolist() for row, h in zip(close, held, strict=True)]


def widened(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with the component that turns inner products into distances."""
    sizes = np.linalg.norm(v, axis=1)
    if query:
        return np.hstack([v * (longest / sizes)[:, None], np.zeros((len(v), 1))]).astype(np.float32)
    return np.hstack([v, np.sqrt(np.maximum(0, longest**2 - sizes**2))[:, None]]).astype(np.float32)


ROUTED = T.StructType([T.StructField("k", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("shard", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))])


class Index:
    """The fitted model: what a task needs to route vectors and queries."""

    def __init__(self, dim: int, longest: float, per_shard: int, graph: Graph):
        self.dim, self.longest, self.per_shard, self.graph = dim, longest, per_shard, graph

    def routed(self, rows: DataFrame, query: bool, more: float) -> DataFrame:
        """A row (k, rep, v, shard, lists) for each shard that a class enters, or asks."""
        sent = rows.sparkSession.sparkContext.broadcast((self.graph.c, self.graph.links, self.graph.entries))
        dim, longest, per = self.dim, self.longest, self.per_shard

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = Graph(*sent.value)
            step = max(16, min(512, 4_000_000 // len(graph.c)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    same = np.flatnonzero(batch.column("v").value_lengths().to_numpy() == dim)
                    if not len(same):
                        continue
                    batch = batch.take(pa.array(same))
                    x = widened(batch.column("v").flatten().to_numpy().reshape(-1, dim), longest, query)
                    far = graph.within(x, more, ASKED if query else 1)
                    lists = [np.flatnonzero(f).tolist() for f in np.isfinite(far)] if query else [sorted(h) for h in graph.holders(far)]
                    row, shard, entered = [], [], []
                    for r, listed in enumerate(lists):
                        by: dict[int, list[int]] = {}
                        for k in listed:
                            by.setdefault(k // per, []).append(k)
                        row += [r] * len(by)
                        shard += by.keys()
                        entered += by.values()
                    to = batch.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(to.column(c) for c in ("k", "rep", "v")), pa.array(shard, pa.int32()), pa.array(entered, pa.list_(pa.int32()))], names=ROUTED.names)

        return rows.select("k", "rep", "v").mapInArrow(run, ROUTED)


def fit(classes: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> Index | None:
    """The index over a sample of classes (k, v); None if there is none."""
    n, longest = classes.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))).first()
    if not n:
        return None
    drawn = classes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0 * sample / n)).cast("long")).select("v")

    def learn(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["v"].map(len)
        dim = int(sizes.mode().iloc[0])
        x = widened(np.stack(pdf["v"][sizes == dim].to_list()).astype(float), longest, False)
        x = x[np.lexsort(x.T[::-1])]  # whatever order they come in
        least = max(4.0, len(x) * x.itemsize * x.shape[1] / MODEL_BYTES)
        graph = Graph.over(balanced_leaves(x, max(size * len(x) / n, least) if len(x) < n else size))
        return pd.DataFrame({"dim": [dim], "c": [graph.c.tobytes()], "links": [graph.links.tobytes()], "entries": [graph.entries.astype(np.int64).tobytes()]})

    model = drawn.groupBy(F.lit(0).alias("_all")).applyInPandas(learn, "dim int, c binary, links binary, entries binary").first()
    if model is None:
        return None
    dim = model["dim"]
    centroids = np.frombuffer(bytes(model["c"]), np.float32).reshape(-1, dim + 1)
    links = np.frombuffer(bytes(model["links"]), np.int32).reshape(len(centroids), -1)
    per_shard = max(1, int(SHARD * len(centroids) / n))
    return Index(dim, longest, per_shard, Graph(centroids, links, np.frombuffer(bytes(model["entries"]), np.int64)))


def classes_of(vectors: DataFrame, ids: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, v)`` that take part, each once, and their distinct vectors ``(k, v, rep, ids)`` with the smallest ids."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c) < float("inf")
    good = rows.where(F.col("id").isNotNull() & usable("v")).where(finite).distinct()
    # few rows of a vector leave each task, however many copies it has
    first = good.withColumn("_rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_rn") <= ids)
    listed = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return good, keep(listed.select(F.monotonically_increasing_id().alias("k"), "v", F.col("ids")[0].alias("rep"), "ids"))


FOUND = "q long, k long, rep long, score double"


def blocks_of(entries: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks: every query of a shard meets every vector of it in one."""
    shards = entries.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("vectors"))
    asked = probes.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("queries"))
    both = keep(shards.join(asked.hint("merge"), "shard"))

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        met = rows.join(both.hint("merge"), "shard")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)
        return met.select("shard", F.pmod(F.xxhash64("k"), F.col(own)).cast("int").alias(mine), "k", "rep", "v", "lists", every)

    return dealt(entries, "vectors", "queries", "vb", "qb"), dealt(probes, "queries", "vectors", "qb", "vb")


def best_in_blocks(entries: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """``(q, k, rep, score)``: the ``n`` best classes of each query and block, of lists that it asks."""
    held, asking = blocks_of(entries, probes)

    def lists_of(t: pa.Table, number: dict[int, int]) -> np.ndarray:
        column = t.column("lists").combine_chunks()
        row = np.repeat(np.arange(t.num_rows), column.value_lengths().to_numpy())
        out = np.zeros((t.num_rows, len(number)), np.float32)
        out[row, [number[k] for k in column.flatten().to_pylist()]] = 1
        return out

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            x, y = matrix(vectors), matrix(queries)
            every = {k for t in (vectors, queries) for k in t.column("lists").combine_chunks().flatten().to_pylist()}
            number = {k: i for i, k in enumerate(sorted(every))}
            in_, asks = lists_of(vectors, number), lists_of(queries, number)
            k, rep, q = vectors.column("k").to_numpy(), vectors.column("rep").to_numpy(), queries.column("k").to_numpy()
            step = max(1, 4_000_000 // len(x))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                about = np.where(asks[at : at + step] @ in_.T > 0, part @ x.T, -np.inf)
                if len(x) > n:  # all that may be among the best, whatever the last digits
                    least = np.partition(about, -n, axis=1)[:, -n]
                    least = least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                    row, column = np.nonzero((about >= least[:, None]) & (about > -np.inf))
                else:
                    row, column = np.nonzero(about > -np.inf)
                score = np.einsum("ij,ij->i", part[row], x[column])
                order = np.lexsort((rep[column], -score, row))
                row, column, score = row[order], column[order], score[order]
                first = np.searchsorted(row, row)
                top = np.arange(len(row)) - first < n
                for to, values in zip(found, (q[at + row[top]], k[column[top]], rep[column[top]], score[top]), strict=True):
                    to.append(values)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, types, strict=True)], names=["q", "k", "rep", "score"])

    return held.groupBy("shard", "vb", "qb").cogroup(asking.groupBy("shard", "vb", "qb")).applyInArrow(meet, FOUND)


def nearest(
    vectors: DataFrame, is_query: Column, n: int = 20, sample: int = SAMPLE, size: int = SIZE, replicate: float = REPLICATE, prune: float = PRUNE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``n`` found with the largest inner product for rows whose ``id`` fits ``is_query``, without the row itself."""
    spark = vectors.sparkSession
    good, classes = classes_of(vectors, n + 1, id_col, vector_col)
    index = fit(classes, sample, size)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = keep(good.where(is_query).join(classes.select("k", "v").hint("merge"), "v").select("id", "k"))
    asked = classes.join(queries.select("k").distinct().hint("merge"), "k", "left_semi")
    entries, probes = keep(index.routed(classes, False, replicate)), keep(index.routed(asked, True, prune))
    found = best_in_blocks(entries, probes, n + 1)
    # a class may stand in several shards
    once = found.groupBy("q", "k", "rep").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("rep")]
    top = once.withColumn("_rn", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("_rn") <= n + 1)
    each = top.join(classes.select("k", "ids").hint("merge"), "k").select("q", "k", "score", F.explode("ids").alias("vec_id"))
    best = each.withColumn("_rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "k"))).where(F.col("_rn") <= n + 1)
    listed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_rn", "k", "vec_id", "score"))).alias("all"))
    met = queries.withColumnRenamed("k", "q").join(listed.hint("merge"), "q")
    others = F.slice(F.filter("all", lambda x: (x["vec_id"] != F.col("id")) | (x["k"] != F.col("q"))), 1, n)
    return met.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_at", "one")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")
