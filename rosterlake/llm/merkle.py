"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.

Paragraphs are lines. Consecutive paragraphs make a section, which a blank line or a paragraph whose
digest is divisible by ``section`` ends, so an edit moves no border elsewhere. Paragraphs are cut
into clauses, so that an edit inside a long one is located. Leaves are digests of clauses; a paragraph's
digest covers its clauses', a section's its paragraphs', the root the sections'.

A fingerprint is the tree as text: the root, and for each section ``;``, its digest and its paragraphs, for
each paragraph ``,``, its digest and its leaves, each behind a ``.``. Digests are 8 hexadecimal digits, but
for the root's 32; a leaf's last digit is the order of magnitude of its size. Equal roots mean equal texts.
Two trees are compared from the root down: equal sections count as a whole, inside the others equal
paragraphs, inside the rest equal clauses, so what remains at the bottom is what was edited.

Defined results: a null text is empty; empty texts have one fingerprint, and their likeness is 1;
repeated rows and ties in the order are kept, in an order by text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, text_rows

def clause_ends(every: int, spaced: int) -> re.Pattern:
    """Clauses end behind sentence marks of any script, behind words that end in a letter whose code point is divisible
    by ``every``, and in scripts without spaces behind characters divisible by ``spaced``; so no leaf is long."""
    last = "".join(chr(c) for c in range(0x41, 0x2E80) if c % every == 0 and chr(c).isalpha())
    alone = "".join(chr(c) for c in range(0x2E80, 0xD7A4) if c % spaced == 0)
    return re.compile(rf".+?(?:[.!?|。！？；]+\s*|[{last}]\s+|[{alone}]|$)")


CLAUSE = clause_ends(9, 16)
SECTION = 8
#: How a tree is written: what stands before a section, a paragraph and a leaf.
MARKS = (";", ",", ".")


def fingerprint(text: str, section: int = SECTION) -> str:
    """The tree of a text, as text."""
    sha, out, tops, inside, digests = hashlib.sha256, [], [], [], []

    def close() -> None:
        if inside:
            top = sha(b"s" + b"".join(digests)).digest()
            out.append(MARKS[0] + top.hex()[:8] + "".join(inside))
            tops.append(top)
            inside.clear()
            digests.clear()

    for line in text.split("\n") if text else []:
        parts = [x.encode("utf-8", "surrogatepass") for x in CLAUSE.findall(line) or [""]]
        leaves = [sha(x).digest() for x in parts]
        top = sha(b"p" + b"".join(leaves)).digest()
        written = "".join([f".{x[:4].hex()[:7]}{min(15, len(part).bit_length()):x}" for x, part in zip(leaves, parts, strict=True)])
        inside.append(MARKS[1] + top.hex()[:8] + written)
        digests.append(top)
        if not line.strip() or top[0] % section == 0:
            close()
    close()
    return sha(b"r" + b"".join(tops)).hexdigest()[:32] + "".join(out)


def branches(written: str, level: int) -> list[tuple[str, str]]:
    """The branches of one level as (digest, what is below)."""
    return [(part[:8], part[8:]) for part in written.split(MARKS[level])[1:]]


def weight(written: str) -> int:
    """The size of what is below a branch, in orders of magnitude of its leaves."""
    return sum(1 << int(leaf[7], 16) for leaf in re.findall(r"\.([0-9a-f]{8})", written))


def apart(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The branches of either side that have no equal on the other, each used once."""
    common = Counter(d for d, _ in a) & Counter(d for d, _ in b)

    def rest(side: list[tuple[str, str]]) -> list[tuple[str, str]]:
        left, out = common.copy(), []
        for branch in side:
            if left[branch[0]]:
                left[branch[0]] -= 1
            else:
                out.append(branch)
        return out

    return rest(a), rest(b)


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the share of the larger text, by size of clauses, that the trees have in common from the root down."""
    if a[:32] == b[:32]:
        return 1.0
    whole = max(weight(a), weight(b))
    x, y = branches(a[32:], 0), branches(b[32:], 0)
    for level in (1, 2):
        x, y = apart(x, y)
        x, y = ([branch for _, below in side for branch in branches(below, level)] for side in (x, y))
    x, y = apart(x, y)
    lost = max(sum(1 << int(d[7], 16) for d, _ in side) for side in (x, y))
    return max(0.0, 1 - lost / max(whole, 1))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` that no paragraph of ``b`` equals; only sections that differ are looked into."""
    other = branches(b[32:], 0)
    there = Counter(d for d, _ in other)
    known = {d for digest, below in other for d, _ in branches(below, 1)}
    out = []
    for s, (digest, below) in enumerate(branches(a[32:], 0)):
        if not there[digest]:
            out += [(s, p) for p, (d, _) in enumerate(branches(below, 1)) if d not in known]
    return out


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third] if third else text


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def compare(text: str, other: str, tree: str, other_tree: str) -> tuple:
    new = edited(text, other)
    new_tree = tree if new == text else fingerprint(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), tree, new_tree, likeness(tree, new_tree), likeness(tree, other_tree)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return map_batches(text_rows(docs, id_col, text_col), lambda b: [b.column(0), [fingerprint(t) for t in b.column(1).to_pylist()]], schema)


LAST = -(1 << 63)
#: Characters that one task compares.
TASK_CHARS = 64 << 20


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare every text with its edited form and the next text, by descending id; the last with the first.

    Texts are dealt by ranges of ids, compressed, in one shuffle. Inside a range each text meets the next
    one as it streams by in order; the first text of a range is sent to the range before it as well.
    """
    texts = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    spark = docs.sparkSession
    ids = texts.select(F.coalesce("id", F.lit(LAST)).alias("id"))
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // TASK_CHARS)
    ranges = min(4 * tasks, 10_000)  # several ranges a task, so that tasks are of one size
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []))  # a number for each range

    def range_of(values: np.ndarray) -> np.ndarray:
        return len(cuts) - np.searchsorted(cuts, values)  # the first range has the largest ids

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            values = batch.column(0).to_numpy()
            own = range_of(values)
            for r in np.unique(own).tolist():
                most[r] = max(most.get(r, LAST), int(values[own == r].max()))
        if most:
            yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())], names=["range", "head"])

    first = {r["range"]: r["head"] for r in ids.mapInArrow(heads, "range int, head long").groupBy("range").agg(F.max("head").alias("head")).collect()}  # a row for each range
    order = sorted(first)
    before = {r: order[k - 1] for k, r in enumerate(order)}  # the first range's head goes to the last range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                values = part.column("id").fill_null(LAST).to_numpy()
                own, rows = range_of(values), []
                for doc, value, r, h, text in zip(part.column("id").to_pylist(), values.tolist(), own.tolist(), part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = pack.compress(text.encode("utf-8", "surrogatepass"))
                    rows.append((r, False, doc, value, h, raw))
                    if value == first[r]:
                        rows.append((before[r], True, doc, value, h, raw))
                types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["range", "guest", "id", "rank", "h", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), None  # held: range, id, text and tree of the row before
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part, rows = whole.slice(at, 256), []
                for r, guest, doc, raw in zip(*(part.column(c).to_pylist() for c in ("range", "guest", "id", "raw")), strict=True):
                    if held is not None and held[0] != r:
                        held = None
                    if guest and held is None:
                        continue  # only the first guest of a range counts
                    text = unpack.decompress(raw).decode("utf-8", "surrogatepass")
                    tree = fingerprint(text)
                    if held is not None:
                        rows.append((held[1], *compare(held[2], text, held[3], tree)))
                    held = None if guest else (r, doc, text, tree)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCHEMA.names)

    dealt = texts.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(deal, "range int, guest boolean, id long, rank long, h long, raw binary")
    sorted_ranges = dealt.repartition(min(tasks, ranges), "range").sortWithinPartitions("range", "guest", F.desc("rank"), "h", "raw")
    return sorted_ranges.select("range", "guest", "id", "raw").mapInArrow(run, SCHEMA)
