"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Tokenizer A is a byte-level file of the ``tokenizers`` library, B a sentencepiece model that puts a blank
before each text, so A encodes blank + text. Places where tokens of both end cut a text into groups; an A and
a B token are linked where their bytes overlap. The counts of linked id pairs over the corpus say which A id
goes best with a B id.

Texts are deduplicated first: a shuffle by the whole text leaves each distinct one once, with the number of
its rows, so copies are tokenised once and weigh as often as they occur. A task joins the texts it gets to
blocks of some million links, which are written: the distinct pairs of a block with their counts, as rows,
and the pairs of each text as places among those. Pair rows are summed over the corpus and looked up again
by pair; a block then meets the counts of its pairs, which are as few as its links, and gives the measures
of its texts. These join the rows of the table by the digest of the text, where copies may be many: the
other side is one row a text, so Spark can split them.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte for byte, have no
tokens; repeated rows, rows of one id and rows without an id have a result each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, holding, keep, shared_dir, text_rows

#: Links of a block, and bytes of texts that are encoded together.
BLOCK_LINKS, AT_ONCE = 2_000_000, 2_000_000
#: Blanks in a row that the fast encoder is not given.
BLANKS = re.compile(r"\s{4096}")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE file.

    Where the file's merges stand in the order of their ids and its words are cut by the usual pattern, the
    faster encoder of the same method is used; the tests compare both, over all code points too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        letters = byte_letters()
        self.tokens = [b""] * self.whole.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        for piece, k in file["model"]["vocab"].items():
            self.tokens[k] = bytes(letters[c] for c in piece)
        self.fast = self.faster(file)

    def faster(self, file: dict):
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file.get("normalizer")
        special = all(t.get("special") for t in file.get("added_tokens", []))
        ids = [vocab.get("".join(m), -1) for m in merges]
        if not (plain and usual and special and ids == sorted(set(ids)) and ids[:1] >= [256] and len(vocab) == 256 + len(ids)):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        return tiktoken.Encoding("rows", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(self.tokens) if t}, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.whole.encode(t, add_special_tokens=False).ids if BLANKS.search(t) else self.fast.encode_ordinary(t) for t in texts]


class PieceTokens:
    """Ids of a sentencepiece model, which puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        text = lambda k: self.model.id_to_piece(k)
        self.tokens = [bytes([int(text(k)[1:-1], 16)]) if self.model.is_byte(k) else text(k).replace("▁", " ").encode() for k in range(n)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Aligned tokens of lists of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.base = len(self.b.tokens)
        self.bytes_a, self.bytes_b = pa.array(self.a.tokens, pa.binary()), pa.array(self.b.tokens, pa.binary())
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side.tokens]) for side in (self.a, self.b))
        # what is written behind an id: another of its side, the other side, the next group
        self.said_a = pa.array([f"{k}{mark}" for k in range(len(self.a.tokens)) for mark in ",|"], pa.large_binary())
        self.said_b = pa.array([f"{k}{mark}" for k in range(self.base) for mark in ",;"], pa.large_binary())

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """``good`` (numbers of the texts that have tokens) and for those ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``sha``; for every link ``pair`` and ``text``."""
        spaced = [" " + t for t in texts]
        listed_a, listed_b = self.a(spaced), self.b(texts)
        whole = [t.encode("utf-8", "surrogatepass") for t in spaced]
        good = [k for k, t in enumerate(texts) if t and listed_b[k] and self.gives_back(listed_a[k], self.bytes_a, whole[k]) and self.gives_back(listed_b[k], self.bytes_b, whole[k])]
        n_a, n_b = (np.array([len(listed[k]) for k in good], np.int64) for listed in (listed_a, listed_b))
        a, b = (np.fromiter(chain.from_iterable(listed[k] for k in good), np.int64, int(n.sum())) for listed, n in ((listed_a, n_a), (listed_b, n_b)))
        text_ends = np.cumsum(np.array([len(whole[k]) for k in good], np.int64))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        # both sides have the same bytes, so each end of either closes the part that one A and one B token share
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        text = np.searchsorted(text_ends, ends)
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        groups = np.searchsorted(text_ends, ends_a[last_a])
        count = lambda of: np.bincount(of, minlength=len(good))
        sha = self.digests(a, b, last_a, last_b, n_a, n_b)
        return {"good": good, "n_a": n_a, "n_b": n_b, "n_groups": count(groups), "n_links": count(text), "sha": sha, "pair": a[at_a] * self.base + b[at_b], "text": text}

    @staticmethod
    def gives_back(ids: list[int], tokens: pa.Array, text: bytes) -> bool:
        taken = tokens.take(pa.array(ids, pa.int64()))
        size = np.frombuffer(taken.buffers()[1], np.int32)[len(taken)]
        return size == len(text) and memoryview(taken.buffers()[2]).cast("B")[:size] == text

    def digests(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """SHA-256 of each text's groups: A ids, a bar, B ids; groups part at semicolons."""
        if not len(n_a):
            return []
        cut_a, cut_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        first_b, behind_a = np.concatenate([[0], cut_b[:-1] + 1]), cut_a + 1
        place_a = np.arange(len(a)) + first_b[np.cumsum(last_a) - last_a]
        place_b = np.arange(len(b)) + behind_a[np.cumsum(last_b) - last_b]
        said = pa.concat_arrays([self.said_a.take(pa.array(2 * a + last_a)), self.said_b.take(pa.array(2 * b + last_b))])
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = np.arange(len(a)), len(a) + np.arange(len(b))
        line = said.take(pa.array(order))
        offsets, data = np.frombuffer(line.buffers()[1], np.int64)[: len(line) + 1], memoryview(line.buffers()[2])
        stops = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [hashlib.sha256(data[s : e - 1]).digest() for s, e in zip(stops[:-1], stops[1:], strict=True)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    holding("alignment", _ALIGNERS.clear)
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


MEASURES = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("pair", T.LongType()), T.StructField("n", T.LongType()), T.StructField("texts", T.BinaryType())])
RESULT = T.StructType([T.StructField("digest", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in (*MEASURES, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])


def packed(**arrays: np.ndarray) -> bytes:
    to = io.BytesIO()
    np.savez(to, **arrays)
    return zstandard.ZstdCompressor(level=3).compress(to.getvalue())


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw))))


class Block:
    """Links of texts, gathered until they are written."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.links = self.texts = 0

    def add(self, digests: list[bytes], weights: np.ndarray, found: dict) -> None:
        good = found["good"]
        self.parts.append(([digests[k] for k in good], weights[good], np.stack([found[c] for c in MEASURES]), found["sha"], found["pair"], found["text"] + self.texts))
        self.links += len(found["pair"])
        self.texts += len(good)

    def rows(self, block: int) -> pa.RecordBatch:
        """A row for each distinct pair, and one with the pairs of every text as places among them."""
        digests, weights, measures, shas, pairs, texts = zip(*self.parts, strict=True)
        pair, place = np.unique(np.concatenate(pairs), return_inverse=True)
        weight = np.concatenate(weights)
        key, times = np.unique(np.concatenate(texts) * len(pair) + place, return_counts=True)
        text, place = key // len(pair), key % len(pair)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, place, times * weight[text])
        sizes = np.bincount(text, minlength=self.texts)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
        step = np.diff(place, prepend=0)
        step[first] = place[first]
        joined = lambda parts: np.frombuffer(b"".join(chain.from_iterable(parts)), np.uint8)
        data = packed(digests=joined(digests), shas=joined(shas), measures=np.concatenate(measures, axis=1).astype(np.uint32), sizes=sizes.astype(np.uint32), step=step.astype(np.uint32), times=times.astype(np.uint32))
        empty = len(pair)
        columns = [pa.array(np.full(empty + 1, block)), pa.array([*pair.tolist(), None], pa.int64()), pa.array([*n.tolist(), None], pa.int64()), pa.array([None] * empty + [data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=BLOCKS.names)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", links: int = BLOCK_LINKS) -> DataFrame:
    """The written blocks ``(block, pair, n, texts)``: rows of pairs with their counts, and a row with the block's texts."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, number, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :][: batch.num_rows + 1])
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                part = batch.slice(at, to - at)
                at = to
                block.add([bytes(d) for d in part.column("digest").to_pylist()], part.column("n").to_numpy(), align(part.column("text").to_pylist()))
                if block.links >= links:
                    yield block.rows(number)
                    number, block = number + 1, Block()
        if block.texts:
            yield block.rows(number)

    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "n", "text").mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(BLOCKS).parquet(folder)


def pair_counts(blocks: DataFrame, base: int) -> DataFrame:
    """``(pair, count, best)`` of all linked pairs; best: no other A id is linked more often with the B id."""
    counts = keep(blocks.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count")))
    most = counts.groupBy((F.col("pair") % base).alias("b")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("b", F.col("pair") % base).join(most.hint("merge"), "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def text_measures(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``(digest, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every distinct text."""
    told = blocks.where("pair is not null").select(F.col("block").alias("of_block"), "pair").join(counts.hint("merge"), "pair")
    whole = blocks.where("texts is not null").select("block", "texts")

    def measure(rows: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(counted.column("pair").to_numpy())
        count, best = counted.column("count").to_numpy()[order], counted.column("best").to_numpy()[order].astype(np.int64)
        for raw in rows.column("texts").to_pylist():
            d = unpacked(raw)
            sizes = d["sizes"].astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            place = np.cumsum(d["step"].astype(np.int64))
            begin = np.cumsum(sizes) - sizes
            before = np.where(begin > 0, place[begin - 1], 0) if len(place) else begin
            place -= before[text]
            times = d["times"].astype(np.int64)
            sums = np.zeros((2, len(sizes)), np.int64)
            np.add.at(sums[0], text, times * best[place])
            np.add.at(sums[1], text, times * count[place])
            digests, shas = d["digests"].tobytes(), d["shas"].tobytes()
            cut = lambda b: [b[k : k + 32] for k in range(0, len(b), 32)]
            columns = [pa.array(cut(digests), pa.binary()), *(pa.array(m.astype(np.int64)) for m in d["measures"]), pa.array(sums[0]), pa.array(sums[1]), pa.array([s.hex() for s in cut(shas)], pa.string())]
            out.append(pa.Table.from_arrays(columns, names=RESULT.names))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], schema=arrow_schema(RESULT))

    return whole.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(measure, RESULT)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row, and ``(a, b, count, best)`` of every linked pair of ids."""
    base = len(PieceTokens(b_path).tokens)
    blocks = aligned_blocks(docs, a_path, b_path, text_col, links)
    counts = keep(pair_counts(blocks, base))
    found = text_measures(blocks, counts)
    rows = text_rows(docs, id_col, text_col).select("id", F.unhex(F.sha2("text", 256)).alias("digest"))
    joined = rows.join(found.hint("merge"), "digest", "left")
    measures = joined.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*MEASURES, "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return measures, counts.select(F.floor(F.col("pair") / base).alias("a"), (F.col("pair") % base).alias("b"), "count", "best")
