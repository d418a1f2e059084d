"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints are one class, so copies are
never expanded. The fingerprint is cut into three segments; two fingerprints that differ in at most
five bits differ in at most one bit of some segment, so each fingerprint is entered once in the table
of each segment and looks up the Hamming ball of radius one around its own segment there. Whole
distances are verified in the tasks that hold the table's entries. A task emits links that connect
what is linked, at most one for each fingerprint of a table entry, not all pairs of it.

Defined results: a null or empty text has fingerprint zero, which links like any other; repeated rows
keep their rows and share a class; an empty table gives an empty result; a null id never names a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, first_rows, keep, map_batches, text_hash, text_rows

#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of ``width`` words of an ASCII-lower-cased text."""
    joined = b" ".join(text.encode("utf-8", "replace").lower().split())
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) + 1 <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) + 1 - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def simhash(text: str, width: int) -> int:
    """Signed 64-bit SimHash over shingles of ``width`` words of an ASCII-lower-cased text."""
    return simhash_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, fp)``; ``h`` is the text's hash."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])
    rows = text_rows(docs, id_col, text_col).withColumn("h", text_hash("text"))
    return map_batches(rows, lambda b: [b.column(0), b.column(2), [simhash(t, shingle) for t in b.column(1).to_pylist()]], schema)


def _close(fp: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``radius`` in one table entry; ``table`` marks the entry's own rows."""
    own = np.flatnonzero(table)
    label, links = np.arange(len(fp)), []
    for i in own.tolist():
        near = np.flatnonzero(np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= radius)
        roots, first = np.unique(label[near], return_index=True)
        new = roots != label[i]
        if new.any():
            links += [(int(fp[i]), int(fp[near[k]])) for k in first[new].tolist()]
            label[np.isin(label, roots)] = label[i]
    return links


def _verify(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole table entries. key: sorted, the lowest bit is 1 for an entry's own rows."""
    entry = key >> 1
    starts = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    sizes = np.diff(np.r_[starts, len(entry)])
    own = np.add.reduceat(key & 1, starts)
    pairs = own * sizes
    a, b = [], []
    some = (own > 0) & (sizes > 1)
    few = some & (pairs <= 64)
    for size in np.unique(sizes[few]).tolist():  # entries of one size together
        at = starts[few & (sizes == size)][:, None] + np.arange(size)
        f, t = fp[at], (key[at] & 1).astype(bool)
        for i in range(size):
            near = t[:, i : i + 1] & (np.bitwise_count((f ^ f[:, i : i + 1]).view(np.uint64)) <= radius) & (f != f[:, i : i + 1])
            rows, cols = np.nonzero(near)
            a.append(f[rows, i])
            b.append(f[rows, cols])
    for k in np.flatnonzero(some & ~few).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        links = np.array(_close(fp[part], (key[part] & 1).astype(bool), radius), np.int64).reshape(-1, 2)
        a.append(links[:, 0])
        b.append(links[:, 1])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``radius`` (at most 5) bits."""
    if not 0 <= radius <= 5:
        raise ValueError("three segments with balls of radius one find at most five differing bits")
    entries = []
    for n, (low, width) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(n << 24)
        entries += [((value.bitwiseXOR(F.lit(flip)) + tag) * 2 + int(flip == 0)).alias(f"k{n}_{flip}") for flip in (0, *(1 << k for k in range(width)))]
    spread = classes.select("fp", F.explode(F.array(*entries)).alias("key"))
    by_entry = spread.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fp):
            a, b = _verify(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys, fps = np.r_[keys, batch.column("key").to_numpy()], np.r_[fps, batch.column("fp").to_numpy()]
            if len(keys) >= 100_000 and keys[-1] >> 1 != keys[0] >> 1:
                cut = int(np.searchsorted(keys, (keys[-1] >> 1) << 1))
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)

    return by_entry.select("key", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, fp, group, component_id)``: the smallest id that can be reached over links; groups of rows that share an id have numbers of their own."""
    marked = keep(fingerprints(docs, shingle, id_col, text_col))
    classes = keep(marked.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(classes, radius)).withColumnRenamed("id", "fp")
    joined = classes.join(found.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(first.hint("merge"), "component").select("fp", F.col("component").alias("group"), "component_id")
    return marked.join(named.hint("merge"), "fp").select("id", "h", "fp", "group", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, one with its smallest id. Rows without an id stay."""
    return first_rows(docs, near_duplicates(docs.where(F.col(f"`{id_col}`").isNotNull()), shingle, radius, id_col, text_col), id_col, text_col)
