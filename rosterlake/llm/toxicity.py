"""Toxicity: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with borders), hashed into a fixed number of rows;
a window of words is the average of its words' vectors, and a linear softmax over it gives two classes.
Unseen spellings share n-gram vectors with known ones. Training takes whole texts first, then windows: those
of a toxic text that count as toxic are chosen by the model of the round before. A text is described by
the softmax's log-odds of its most toxic windows, of its most toxic words and of the whole, so length does
not dilute a remark; a logistic calibration of these, on texts kept apart from training, gives the
probability. The fit uses a sample of labelled texts of at most ``sample`` rows of either class and
``SAMPLE_CHARS`` characters in all, drawn by a hash of the id; scoring covers every whole text. The model,
``rows * dim`` floats, is a few MB whatever the data.

Defined results: null and empty texts get the score of a text whose words all score 0; repeated labels of
one id count as toxic if any is; of the texts of one id the one with the smallest digest is learned from;
without labels of both classes every score is 0; without both classes among the texts kept apart the
log-odds of the most toxic window are taken as they are; repeated rows are scored each; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, release_all, text_rows

ROWS, DIM, WINDOW, SAMPLE, SAMPLE_CHARS, STEPS, ROUNDS, WINDOWS = 1 << 16, 8, 3, 2000, 64 << 20, 60, 3, 8
THRESHOLD = 0.3


def grams(word: str, rows: int) -> list[int]:
    """Hashed n-grams of a word."""
    w = f"<{word}>"
    crc = zlib.crc32
    return [crc(w[i : i + n].encode("utf-8", "replace")) % rows for n in (3, 4, 5) for i in range(len(w) - n + 1)] or [crc(w.encode("utf-8", "replace")) % rows]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Trainer:
    """Joint training of n-gram vectors and softmax by gradient steps with momentum on whole batches."""

    def __init__(self, texts: list[str], toxic: np.ndarray, rows: int, dim: int, window: int, seed: int = 0):
        self.rng, self.rows, self.dim, self.window, self.toxic = np.random.default_rng(seed), rows, dim, window, toxic.astype(bool)
        index: dict[str, int] = {}
        self.texts = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), np.int64) for t in texts]
        flat, sizes = array("i"), array("i")  # word by word, so that no lists of numbers pile up
        for w in index:
            bag = grams(w, rows)
            flat.extend(bag)
            sizes.append(len(bag))
        self.flat, self.sizes = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.emb = self.rng.normal(0, 0.1, (rows, dim))
        self.out, self.bias = self.rng.normal(0, 0.1, (dim, 2)), np.zeros(2)

    def word_scores(self) -> np.ndarray:
        """Log-odds that each known word contributes."""
        gram = self.emb @ (self.out[:, 1] - self.out[:, 0])
        return np.add.reduceat(gram[self.flat], self.starts) / self.sizes

    def best_windows(self) -> tuple[np.ndarray, list[int]]:
        """The log-odds and start of each text's most toxic window."""
        score, b = self.word_scores(), self.bias[1] - self.bias[0]
        got = [best_window(score[t], self.window) for t in self.texts]
        return np.array([g[0] for g in got]) + b, [g[1] for g in got]

    def fit(self, windows: list[np.ndarray], labels: np.ndarray, steps: int, rate: float = 0.3) -> None:
        sizes = np.array([len(w) for w in windows])
        flat, own = np.concatenate(windows), np.repeat(np.arange(len(windows)), sizes)
        used, flat = np.unique(flat, return_inverse=True)
        bag_sizes = self.sizes[used]
        starts = np.cumsum(bag_sizes) - bag_sizes
        held = np.zeros(len(self.sizes), bool)
        held[used] = True
        grams_used = self.flat[np.repeat(held, self.sizes)]
        there = np.zeros(self.rows, bool)
        there[grams_used] = True
        seen = np.flatnonzero(there)
        ids = (np.cumsum(there) - 1)[grams_used]
        word = np.repeat(np.arange(len(used)), bag_sizes)
        del grams_used
        weight = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum()))
        params = [self.emb[seen], self.out, self.bias]
        moments = [[np.zeros_like(p), np.zeros(1)] for p in params]
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        for step in range(1, steps + 1):
            emb, out, bias = params
            vec = np.stack([np.add.reduceat(emb[:, k][ids], starts) for k in range(self.dim)], axis=1) / bag_sizes[:, None]
            hidden = np.add.reduceat(vec[flat], first) / sizes[:, None]
            logit = hidden @ out + bias
            p = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -50, 50)))
            d = (p - labels) * weight
            grad = np.stack([-d, d], axis=1)
            back = grad @ out.T / sizes[:, None]
            grads = [np.empty_like(emb), hidden.T @ grad, grad.sum(axis=0)]
            for k in range(self.dim):
                by_word = np.bincount(flat, back[own, k], len(used)) / bag_sizes
                grads[0][:, k] = np.bincount(ids, by_word[word], len(seen))
            for n, (g, (m, v)) in enumerate(zip(grads, moments, strict=True)):
                # one scale for a whole array: what many windows share moves further than what few hold
                m += 0.1 * (g - m)
                v += 0.1 * (np.max(np.abs(g)) - v)
                params[n] = params[n] - rate * (m / (1 - 0.9**step)) / (v / (1 - 0.9**step) + 1e-12)
        self.emb[seen], self.out, self.bias = params

    def train(self, steps: int, rounds: int, per_text: int, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, float]:
        """n-gram log-odds, and slopes and intercept of the last fit, which uses every fourth text and only those.

        weights: how many labelled texts stand behind one clean and one toxic text of the sample.
        """
        apart = np.arange(len(self.texts)) % 4 == 3
        full = [k for k, t in enumerate(self.texts) if len(t) and not apart[k]]
        self.fit([np.unique(self.texts[k]) for k in full], self.toxic[full], steps)  # whole texts, each word once
        for _ in range(rounds):
            tops, windows, labels = self.best_windows()[1], [], []
            for k in full:
                t, at = self.texts[k], [tops[k]]
                if not self.toxic[k]:
                    count = -(-len(t) // self.window)
                    at += (self.rng.choice(count, min(count, per_text), replace=False) * self.window).tolist()
                windows += [np.unique(t[s : s + self.window]) for s in at]
                labels += [self.toxic[k]] * len(at)
            self.fit(windows, np.array(labels, bool), steps)
        score = self.word_scores()
        slopes, shift = np.eye(len(SPANS) + 2)[0], float(self.bias[1] - self.bias[0])
        if self.toxic[apart].any() and not self.toxic[apart].all():
            seen = np.array([features(score[t]) for t, a in zip(self.texts, apart, strict=True) if a])
            slopes, shift = logistic(seen, self.toxic[apart], np.where(self.toxic[apart], weights[1], weights[0]))
        return self.emb @ (self.out[:, 1] - self.out[:, 0]), slopes, shift


def best_window(scores: np.ndarray, window: int) -> tuple[float, int]:
    """The highest mean of ``window`` scores in a row (of all, if there are fewer) and where it starts."""
    n = len(scores)
    if n <= window:
        return (float(scores.mean()) if n else 0.0), 0
    sums = np.cumsum(scores)
    means = (sums[window - 1 :] - np.r_[0.0, sums[: n - window]]) / window
    at = int(means.argmax())
    return float(means[at]), at


#: A text is described by the log-odds of its best windows of these lengths, of its best words and of all words.
SPANS, BEST_WORDS = (3, 12, 48), 6


def features(scores: np.ndarray) -> list[float]:
    if not len(scores):
        return [0.0] * (len(SPANS) + 2)
    top = np.partition(scores, max(0, len(scores) - BEST_WORDS))[-BEST_WORDS:]
    return [*(best_window(scores, n)[0] for n in SPANS), float(top.sum()) / BEST_WORDS, float(scores.mean())]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and intercept by weighted, regularised Newton steps."""
    scale = np.maximum(1e-9, x.std(axis=0))
    z, w = np.c_[x / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.1] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1])


MODEL = T.StructType([T.StructField("grams", T.BinaryType()), T.StructField("slopes", T.ArrayType(T.DoubleType())), T.StructField("shift", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS, dim: int = DIM, window: int = WINDOW):
    """The model as a row of ``MODEL``, or None without labels of both classes. The fit runs in one task on the bounded sample."""
    marked = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.max(F.col(f"`{label_col}`").cast("int")) > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two numbers
    clean, bad = counts.get(False, 0), counts.get(True, 0)
    order = F.xxhash64("id")
    chosen = [marked.where(F.col("toxic") == c).withColumn("drawn", order).orderBy("drawn", "id").limit(sample) for c in (True, False)]
    picked = keep(chosen[0].unionByName(chosen[1]))  # at most 2 * sample ids
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "drawn", "toxic")).alias("t")
    texts = keep(text_rows(docs, id_col, text_col).join(F.broadcast(picked), "id").groupBy("id").agg(least).select("id", "t.text", "t.drawn", "t.toxic"))
    before = Window.partitionBy("toxic").orderBy("drawn", "id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) < SAMPLE_CHARS // 2  # over at most 2 * sample rows
    texts = texts.withColumn("room", room).where("room").select("text", "drawn", "toxic")

    def fit(_, pdf: pd.DataFrame) -> pd.DataFrame:
        release_all()
        pdf = pdf.sort_values("drawn")
        toxic = pdf["toxic"].to_numpy(bool)
        if not toxic.any() or toxic.all():
            return pd.DataFrame({"grams": pd.Series(dtype=object), "slopes": pd.Series(dtype=object), "shift": pd.Series(dtype=float)})
        gram, slopes, shift = Trainer(pdf["text"].tolist(), toxic, rows, dim, window).train(STEPS, ROUNDS, WINDOWS, (clean / (~toxic).sum(), bad / toxic.sum()))
        return pd.DataFrame({"grams": [gram.astype("<f4").tobytes()], "slopes": [slopes.tolist()], "shift": [shift]})

    return texts.groupBy(F.lit(0).alias("_all")).applyInPandas(fit, MODEL).first()


class Scorer:
    def __init__(self, model, limit: int = 400_000):
        self.gram = np.frombuffer(model["grams"], "<f4")
        self.slopes, self.shift, self.limit = np.array(model["slopes"]), model["shift"], limit
        self.words: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > self.limit:
            self.words.clear()
        rows = len(self.gram)
        listed = list(words)
        bags = [grams(w, rows) for w in listed]
        sizes = np.array([len(b) for b in bags])
        flat = self.gram[np.fromiter((g for b in bags for g in b), np.int64)].astype(float)
        got = np.add.reduceat(flat, np.r_[0, np.cumsum(sizes)[:-1]]) / sizes
        self.words.update(zip(listed, got.tolist(), strict=True))

    def batch(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        words = set().union(*split)
        if new := words.difference(self.words):
            self.learn(new)
            if not self.words.keys() >= words:
                self.learn(words)
        find = self.words.__getitem__
        seen = np.array([features(np.fromiter(map(find, t), float, len(t))) for t in split])
        return 1 / (1 + np.exp(-np.clip(seen @ self.slopes + self.shift, -50, 50)))


def scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    texts = text_rows(docs, id_col, text_col)
    if model is None:
        return texts.select("id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast({k: bytes(v) if k == "grams" else v for k, v in model.asDict().items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_all()
        own = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.batch(part.column(1).to_pylist()))], names=["id", "score"])

    return texts.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores below the threshold, all columns as they are; one pass, no shuffle."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast({k: bytes(v) if k == "grams" else v for k, v in model.asDict().items()})
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_all()
        own = Scorer(shared.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                part = whole.slice(begin, 512)
                yield part.filter(pa.array(own.batch([t or "" for t in part.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
