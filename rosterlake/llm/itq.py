"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated vectors are balanced codes
that lose little (alternating between codes and an orthogonal Procrustes fit), on a sample of at most
``sample`` vectors drawn by a hash of the id. Two codes of ``bits`` bits come from rotations with starts
of their own; vectors of fewer dimensions take as many rotations as fill a code. Every vector is entered
in one table for each 16-bit segment of both codes; it looks up the Hamming ball of radius one around its
own segment in each. A pair found in several tables is taken from the first. Pairs whose codes differ in
more than ``max_bits`` bits on average are left; the others are reranked by the cosine of the original
vectors in double precision. Codes find a pair with high probability, not always; the tests measure the recall.

In a table entry of at most ``HOT`` classes pairs are rows. A larger one is cut into blocks of about ``SQUARE``
entries and of as many probes; each pair of blocks is one small matrix product, which gives how many links
every class has there and only as many links as connect what is linked. So a group of near copies is compared
over many tasks, and neither its pairs nor its vectors meet in one.

Equal vectors of a label are one class, so copies are never expanded. Defined results: rows whose label,
id or vector is null, or whose vector is empty, zero or holds null or non-finite components, link with
nothing; repeated rows are vectors of their own with one id; vectors of unlike lengths are unlike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, keep

COSINE, BITS, MAX_BITS, SAMPLE, TURNS = 0.93, 64, 16, 20_000, 40
SEGMENT, CODES = 16, 2
HOT, SQUARE = 64, 256


def learn_rotation(x: np.ndarray, bits: int = BITS, turns: int = TURNS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension by ``bits``) of unit vectors ``x``."""
    mean = x.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    main = axes[:, np.argsort(-values)[: min(bits, x.shape[1])]]
    v = (x - mean) @ main
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(main.shape[1], main.shape[1])))
    for _ in range(turns):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(codes.T @ v)
        rotation = (u @ w).T
    return mean, main @ rotation


def learn_codes(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projections (dimension by ``CODES * bits``), each code filled by rotations with starts of their own."""
    per = -(-bits // min(bits, x.shape[1]))
    turned = [learn_rotation(x, bits, seed=seed) for seed in range(CODES * per)]
    return turned[0][0], np.hstack([np.hstack([p for _, p in turned[c * per : (c + 1) * per]])[:, :bits] for c in range(CODES)])


def usable(vector: str) -> F.Column:
    """Whether a vector can be compared."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(label, v, rep, n)``: the distinct usable vectors of each label."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    good = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & usable("v"))
    return good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def encode(classes: DataFrame, sample: int, bits: int) -> DataFrame:
    """Adds the codes ``code0`` and on of each class; vectors that are not as long as most of the sample get code 0."""
    drawn = classes.orderBy(F.xxhash64("rep"), "label").limit(sample).select("v")

    def fit(_, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["v"].map(len)
        dim = int(sizes.mode().iloc[0])
        x = np.stack(pdf["v"][sizes == dim].to_list()).astype(float)
        mean, projection = learn_codes(x / np.linalg.norm(x, axis=1)[:, None], bits)
        return pd.DataFrame({"dim": [dim], "mean": [mean.tobytes()], "projection": [projection.tobytes()]})

    model = drawn.groupBy(F.lit(0).alias("_all")).applyInPandas(fit, "dim int, mean binary, projection binary").first()
    if model is None:
        return classes.select("*", *[F.lit(0).cast("long").alias(f"code{c}") for c in range(CODES)])
    dim, mean, projection = model["dim"], np.frombuffer(bytes(model["mean"])), np.frombuffer(bytes(model["projection"])).reshape(model["dim"], -1)
    schema = T.StructType([*classes.schema.fields, *[T.StructField(f"code{c}", T.LongType()) for c in range(CODES)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            codes = np.zeros((len(v), CODES, 64), bool)
            same = np.flatnonzero(np.diff(v.offsets.to_numpy()) == dim)
            if len(same):
                x = v.take(pa.array(same)).flatten().to_numpy().reshape(-1, dim)
                codes[same, :, :bits] = ((x / np.linalg.norm(x, axis=1)[:, None] - mean) @ projection >= 0).reshape(len(x), CODES, bits)
            packed = np.packbits(codes.reshape(len(v), CODES * 64), axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(packed[:, c].copy()) for c in range(CODES))], names=schema.names)

    return classes.mapInArrow(run, schema)


def segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, s * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))


#: Code and segment of each table.
TABLES = [(c, s) for c in range(CODES) for s in range(64 // SEGMENT)]


def lookups(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (label, key, b, cb0...) and probes (label, key, a, ca0...) of all tables; a key holds its table above the segment."""
    codes = [F.col(f"code{c}") for c in range(CODES)]
    keys = [(n << SEGMENT, segment(codes[c], s)) for n, (c, s) in enumerate(TABLES)]
    own = [codes[c].alias(f"cb{c}") for c in range(CODES)]
    entry = coded.select("label", F.col("k").alias("b"), *own, F.explode(F.array(*[value + tag for tag, value in keys])).alias("key"))
    balls = [value.bitwiseXOR(F.lit(flip)) + tag for tag, value in keys for flip in (0, *(1 << j for j in range(SEGMENT)))]
    asked = [codes[c].alias(f"ca{c}") for c in range(CODES)]
    return entry, coded.select("label", F.col("k").alias("a"), *asked, F.explode(F.array(*balls)).alias("key"))


def candidates(entry: DataFrame, probe: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``(a, b)`` of class numbers, a < b, each once."""
    differ = [F.col(f"ca{c}").bitwiseXOR(F.col(f"cb{c}")) for c in range(CODES)]
    first = F.lit(len(TABLES))
    for n, (c, s) in reversed(list(enumerate(TABLES))):
        first = F.when(F.bit_count(segment(differ[c], s)) <= 1, F.lit(n)).otherwise(first)
    apart = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    met = probe.hint("merge").join(entry, ["label", "key"]).where((F.col("a") < F.col("b")) & (apart <= CODES * max_bits) & (F.shiftright("key", SEGMENT) == first))
    return met.select("a", "b")


def first_tables(differ: np.ndarray) -> np.ndarray:
    """The first table that holds a pair together. differ: the codes' differing bits, by code."""
    out = np.full(differ.shape[1:], len(TABLES))
    for n, (c, s) in reversed(list(enumerate(TABLES))):
        part = (differ[c] >> np.uint64(s * SEGMENT)) & np.uint64((1 << SEGMENT) - 1)
        out[np.bitwise_count(part) <= 1] = n
    return out


def cosines(x: list[np.ndarray], y: list[np.ndarray], cosine: float) -> np.ndarray:
    """Which of all pairs of two lists of vectors reach a cosine, vectors of unlike lengths being unlike."""
    out = np.zeros((len(x), len(y)), bool)
    sizes, others = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    for dim in np.intersect1d(sizes, others).tolist():
        i, j = np.flatnonzero(sizes == dim), np.flatnonzero(others == dim)
        u, v = np.stack([x[k] for k in i]), np.stack([y[k] for k in j])
        got = u @ v.T / (np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1))
        good = got >= cosine
        for r, c in np.argwhere(np.abs(got - cosine) < 1e-9).tolist():  # on the border: as pairs that are rows are computed
            good[r, c] = np.einsum("ij,ij->i", u[r : r + 1], v[c : c + 1])[0] / (np.linalg.norm(u[r]) * np.linalg.norm(v[c])) >= cosine
        out[np.ix_(i, j)] = good
    return out


def spanning(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As many links as connect what is linked."""
    label, out = np.arange(len(a) + len(b)), []  # rows, then columns
    for i in range(len(a)):
        near = np.flatnonzero(linked[i])
        roots, first = np.unique(label[len(a) + near], return_index=True)
        new = roots != label[i]
        out += [(int(a[i]), int(b[near[k]])) for k in first[new].tolist()]
        label[np.isin(label, roots)] = label[i]
    return out


FOUND = "a long, b long, links long"


def hot_links(entry: DataFrame, probe: DataFrame, hot: DataFrame, classes: DataFrame, cosine: float, max_bits: int) -> DataFrame:
    """Links of large table entries: rows (a, b, null) connect what is linked, rows (a, null, links) count the links of a class."""
    at = ["label", "key"]
    vectors = classes.select("k", "v", "n")
    asking = probe.join(hot.select(*at, F.ceil(F.col("n") / SQUARE).cast("int").alias("eblocks")).hint("merge"), at)
    asking = asking.join(probe.join(hot.select(*at).hint("merge"), at, "left_semi").groupBy(*at).agg(F.ceil(F.count("*") / SQUARE).cast("int").alias("pblocks")).hint("merge"), at)
    blocks = keep(asking.select(*at, "eblocks", "pblocks").distinct())
    codes = lambda side: F.array(*[F.col(f"c{side}{c}") for c in range(CODES)]).alias("codes")

    def dealt(rows: DataFrame, number: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64(number), F.col(own)).cast("int").alias(mine)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)
        return rows.select(*at, F.col(number).alias("k"), codes(number), F.lit(number == "a").alias("asks"), block, every)

    members = entry.join(blocks.hint("merge"), at)
    both = dealt(members, "b", "eblocks", "pblocks", "eb", "pb").unionByName(dealt(asking, "a", "pblocks", "eblocks", "pb", "eb"))
    full = both.join(vectors.hint("merge"), "k")

    def square(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        rows, columns = np.flatnonzero(asks), np.flatnonzero(~asks)
        k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
        codes = np.array(t.column("codes").to_pylist(), np.int64).reshape(-1, CODES).view(np.uint64).T
        vectors = [np.array(v, float) for v in t.column("v").to_pylist()]
        differ = codes[:, rows][:, :, None] ^ codes[:, columns][:, None, :]
        table = t.column("key")[0].as_py() >> SEGMENT if t.num_rows else 0
        linked = (k[rows][:, None] < k[columns]) & (np.bitwise_count(differ).sum(axis=0) <= CODES * max_bits) & (first_tables(differ) == table)
        if linked.any():
            linked &= cosines([vectors[i] for i in rows], [vectors[j] for j in columns], cosine)
        found = [(a, b, None) for a, b in spanning(linked, k[rows], k[columns])]
        counts = np.zeros(len(k), np.int64)
        counts[rows], counts[columns] = linked @ n[columns], n[rows] @ linked
        found += [(int(k[i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
        types = [pa.int64()] * 3
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*found, strict=True)) or [()] * 3, types, strict=True)], names=["a", "b", "links"])

    return full.groupBy(*at, "eb", "pb").applyInArrow(square, FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, bits: int = BITS, max_bits: int = MAX_BITS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id)`` for every row of ``vectors``."""
    # equal vectors of different labels may share a smallest id, so classes get numbers of their own
    classes = keep(classes_of(vectors, id_col, vector_col, label_col).withColumn("k", F.monotonically_increasing_id()))
    coded = keep(encode(classes, sample, bits).select("label", "k", *[f"code{c}" for c in range(CODES)]))
    vector = classes.select("k", "v")
    entry, probe = lookups(coded)
    hot = keep(entry.groupBy("label", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    pairs = candidates(entry.join(hot.select("label", "key").hint("merge"), ["label", "key"], "left_anti"), probe, max_bits)
    paired = pairs.join(vector.select(F.col("k").alias("a"), F.col("v").alias("va")).hint("merge"), "a").join(vector.select(F.col("k").alias("b"), F.col("v").alias("vb")).hint("merge"), "b").select("a", "b", "va", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column("va"), batch.column("vb")
            sizes, others = np.diff(va.offsets.to_numpy()), np.diff(vb.offsets.to_numpy())
            close = np.zeros(len(sizes), bool)
            for dim in np.unique(sizes[sizes == others]).tolist():
                rows = np.flatnonzero((sizes == dim) & (others == dim))
                x, y = (c.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim) for c in (va, vb))
                close[rows] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            at = pa.array(np.flatnonzero(close))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    linked = keep(paired.mapInArrow(rerank, "a long, b long"))
    large = keep(hot_links(entry, probe, hot, classes, cosine, max_bits))
    size = classes.select("k", "n")
    both = linked.select(F.col("a").alias("k"), F.col("b").alias("o")).unionByName(linked.select(F.col("b").alias("k"), F.col("a").alias("o")))
    counts = both.join(size.select(F.col("k").alias("o"), F.col("n").alias("m")).hint("merge"), "o").select("k", F.col("m").alias("links"))
    counts = counts.unionByName(large.where("links is not null").select(F.col("a").alias("k"), "links"))
    counted = counts.groupBy("k").agg(F.sum("links").alias("links"))
    found = components(linked.unionByName(large.where("links is null").select("a", "b"))).withColumnRenamed("id", "k")
    full = classes.join(counted.hint("merge"), "k", "left").join(found.hint("merge"), "k", "left").withColumn("c", F.coalesce("component", "k"))
    least = full.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = full.join(least.hint("merge"), "c").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    label = F.when(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{label_col}`"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), label.alias("label"))
    joined = rows.join(named.hint("merge"), ["label", "v"], "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
