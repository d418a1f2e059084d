"""Periodic runs, cross-tokenizer alignment and nearest neighbours against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, `a b` int, runs int, id int, digest int, n int, block int"
TAIL = (None,) * 5
ODD = [
    (1, "The cat sat on the mat. " * 30, "en", "s1", 1, None, 1, *TAIL),
    (2, "The cat sat on the mat. " * 30, "en", "s1", 1, "x", None, *TAIL),
    (3, None, None, None, None, None, None, *TAIL),
    (4, "", "en", "s1", 0, None, None, *TAIL),
    (5, "word " * 30_000, "en", "s2", 1, None, None, 1, 1, 1, 1, 1),
    (6, "日本語 テキスト 😀 ÀÉÎ İstanbul\x1cx　y <|endoftext|> </s> <0x41>", "xx", "s3", 1, None, None, *TAIL),
    (7, "one", "de", "s1", 3, None, None, *TAIL),
    (7, "one", "de", "s1", 3, None, None, *TAIL),
    (7, "two words", "de", "s1", 3, None, None, *TAIL),
    (None, "a b a b a b a b c", "de", "s1", 3, None, None, *TAIL),
    (8, "".join(random.Random(5).choice("abcdef \n.") for _ in range(4000)), "fr", "s4", 1, None, None, *TAIL),
    (9, " \t\n\v\f\r ", "fr", "s4", 1, None, None, *TAIL),
    (-10, "x\x85y\xa0z ▁ " * 9, "fr", "s4", 1, None, None, *TAIL),
    (11, "b c" * 3 + " a a a a a a" + " q w e" * 4 + " q", "fr", "s4", 1, None, None, *TAIL),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The odd rows, and an empty table, as tables of the queries."""
    out = {}
    for name, rows in (("odd", ODD), ("empty", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, DOCS).write.parquet(f"{out[name]}/documents.parquet")
    return out | {"small": SMALL}


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def plain_periodic(doc, text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words) if n < 3000 else None
    if runs is None:
        return None
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_periodic_runs(spark, folder, table):
    from rosterlake.llm.registry import op11_periodic_runs

    got = op11_periodic_runs(spark, folder[table]).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder[table]}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    expected = [plain_periodic(*d) for d in docs]
    long_ = {d[0] for d, e in zip(docs, expected, strict=True) if e is None}
    assert Counter(tuple(r)[:8] for r in got if r.doc_id not in long_) == Counter(e for e in expected if e)
    if table == "odd":
        one = next(r for r in got if r.doc_id == 5)
        assert (one.n_runs, one.start, one.length, one.period, one.collapsed_sha256) == (1, 0, 30_000, 1, hashlib.sha256(b"word").hexdigest())
    if table == "small":
        assert sum(r.n_runs > 0 for r in got) > 5


def test_runs_of_random_sequences():
    from rosterlake.llm.runs import runs_of, text_runs

    rng = random.Random(1)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 40])
        ids = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            ids = [x if i < a else ids[a + (i - a) % p] for i, x in enumerate(ids)]
        x = np.array(ids, np.int64)
        expected = [list(r) for r in plain_runs(ids)]
        assert runs_of(x).tolist() == expected and text_runs(x).tolist() == expected


def test_common_extensions_and_stretches():
    from rosterlake.llm.runs import Tour, stretches

    rng = np.random.default_rng(0)
    for size, kinds in ((50, 2), (300, 3)):
        s = [*(rng.integers(1, kinds + 1, size)).tolist(), 0]
        tour = Tour(s, kinds + 1)
        assert sorted(range(size + 1), key=lambda k: s[k:]) == np.argsort(tour.rank).tolist()
        i, j = rng.integers(0, size, 500), rng.integers(0, size, 500)
        i, j = i[i != j], j[i != j]
        plain = [next(k for k in range(size + 1) if s[a + k] != s[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert tour.common(i, j).tolist() == plain
    assert stretches(np.arange(1000)) == []
    x = np.concatenate([np.arange(100), np.tile(np.arange(200, 220), 5), np.arange(300, 400)])
    ((b, e),) = stretches(x)
    assert b <= 100 and e >= 200 and e - b < 150


def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, token by token."""
    import bisect

    a_model, b_model = tokenizers()
    letters = {}
    spare = 0
    for byte in range(256):
        if chr(byte).isprintable() and byte not in (0x20, 0xA0, 0xAD):
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + spare)] = byte
            spare += 1
    links, out = [], []
    for text in texts:
        links.append([])
        out.append((0, 0, 0, 0, 0, 0, ""))
        if not text:
            continue
        raw = (" " + text).encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        bytes_a = [bytes(letters[c] for c in a_model.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
        begins_a = [0, *ends_a[:-1]]
        for k, (s, e) in enumerate(zip([0, *ends_b[:-1]], ends_b, strict=True)):
            i = bisect.bisect_right(ends_a, s)
            while i < len(a) and begins_a[i] < e:
                links[-1].append((a[i], b[k]))
                i += 1
        said, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = bisect.bisect_right(ends_a, cut), bisect.bisect_right(ends_b, cut)
            said.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        out[-1] = (len(a), len(b), len(said), len(links[-1]), 0, 0, hashlib.sha256(";".join(said).encode()).hexdigest())
    counts = Counter(link for each in links for link in each)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(*o[:4], sum(counts[x] == most[x[1]] for x in each), sum(counts[x] for x in each), o[6]) for o, each in zip(out, links, strict=True)], counts, most


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_token_alignment(spark, folder, table):
    from rosterlake.llm.registry import op12_token_alignment

    got = op12_token_alignment(spark, folder[table]).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder[table]}/documents.parquet").select("doc_id", "text").collect()]
    expected, _, _ = plain_alignment([t for _, t in docs])
    assert Counter(tuple(r) for r in got) == Counter((d, *e) for (d, _), e in zip(docs, expected, strict=True))
    if table == "small":
        assert len({t for _, t in docs}) < len(docs) and max(r.count_sum for r in got) > 0


def test_pair_counts_in_small_blocks(spark):
    import public_tokenizers

    from rosterlake.llm.alignment import align

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    texts = [r.text for r in docs.collect()]
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found, pairs = align(docs, *paths, links=5_000)
    expected, counts, most = plain_alignment(texts)
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {x: (n, n == most[x[1]]) for x, n in counts.items()}
    assert Counter(tuple(r)[1:] for r in found.collect()) == Counter(expected)


def test_fast_encoder_gives_the_ids_of_the_file():
    import public_tokenizers

    from rosterlake.llm.alignment import ByteTokens

    a, _ = tokenizers()
    b = ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert b.fast is not None
    rng = random.Random(3)
    texts = [" " + "".join(rng.choice(w) for _ in range(rng.randint(1, 24))) for w in ("abcdeinorst", "ab", "thein", "0189", "=-_*", "éèü", "日本語", "'sdtl ", " \t\n　\xa0x") for _ in range(2000)]
    texts += [" a%sb %s%s1 %s" % ((chr(c),) * 4) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" <|endoftext|>", "x" + " " * 20_000 + "y", " " * 5000]
    assert b(texts) == [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]


def plain_nearest(rows, n=20):
    """Rows (query_id, rank, vec_id, score) by brute force."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    x = np.array([v for _, v in good])
    out = []
    for k, (i, v) in enumerate(good):
        if i % 20 == 0:
            score = np.einsum("ij,ij->i", np.repeat(x[k : k + 1], len(x), 0), x)
            order = [j for j in np.lexsort(([g[0] for g in good], -score)).tolist() if j != k][:n]
            out += [(i, r + 1, good[j][0], float(score[j])) for r, j in enumerate(order)]
    return out


def recall(got, expected):
    want = {(q, v) for q, _, v, _ in expected}
    return len(want & {(q, v) for q, _, v, _ in got}) / len(want)


def neighbours(spark, rows, tmp_path, more="label int"):
    from rosterlake.llm.registry import op13_nearest_neighbours

    spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<double>, {more}").write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in op13_nearest_neighbours(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_nearest_neighbours(spark, name):
    from rosterlake.llm.registry import op13_nearest_neighbours

    folder = f"/root/testdata/{name}"
    got = [tuple(r) for r in op13_nearest_neighbours(spark, folder).collect()]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = plain_nearest(rows)
    score = {(q, v): s for q, _, v, s in got}
    assert recall(got, expected) >= 0.95 and len(got) == len(expected)
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in expected)
    assert all(score.get((q, v), s) == s for q, _, v, s in expected)
    by = defaultdict(list)
    for q, r, v, s in sorted(got):
        by[q].append((-s, v))
    assert all(sorted(x) == x and all(v != q for _, v in x) for q, x in by.items())


def test_nearest_neighbours_of_odd_vectors(spark, tmp_path):
    rows = [(k, [1.0, 2.0]) for k in range(0, 60)] + [(60, [1.0, 2.0]), (60, [1.0, 2.0]), (80, [-3.0, 1.0]), (81, None), (100, [0.0, 0.0]), (101, [float("nan"), 1.0]), (102, [None, 1.0]), (103, [float("inf"), 1.0])]
    rows += [(None, [5.0, 5.0]), (104, []), (-20, [0.5, 1.0]), (40, [9.0, 9.0]), (105, [1e200, 1.0])]
    got = neighbours(spark, rows, tmp_path, "k int")
    assert sorted(got) == sorted(plain_nearest([r for r in rows if r[0] != 105]))
    assert {q for q, *_ in got} == {0, 20, 40, 60, 80, -20}


def test_nearest_neighbours_of_few_or_no_vectors(spark, tmp_path):
    assert neighbours(spark, [(1, None)], tmp_path / "a") == [] and neighbours(spark, [], tmp_path / "b") == []
    assert neighbours(spark, [(20, [1.0])], tmp_path / "c") == []
    assert neighbours(spark, [(20, [1.0]), (3, [2.0])], tmp_path / "d") == [(20, 1, 3, 2.0)]


def test_nearest_neighbours_in_many_lists_and_blocks(spark, tmp_path, monkeypatch):
    from rosterlake.llm import postings

    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 24))
    x = centers[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 24))
    x *= rng.uniform(0.7, 1.3, size=(3000, 1))  # unlike lengths
    x[1000:1900] = x[1000] + 0.01 * rng.normal(size=(900, 24))  # near copies
    x[2000:2300] = x[2000]  # copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    for name, value in (("SIZE", 32), ("SHARD", 256), ("BLOCK_VECTORS", 300), ("BLOCK_QUERIES", 20)):
        monkeypatch.setattr(postings, name, value)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    from pyspark.sql import functions as F

    got = [tuple(r) for r in postings.nearest(vectors, F.pmod("id", F.lit(20)) == 0, size=32).collect()]
    assert recall(got, plain_nearest(rows)) >= 0.95
    _, classes = postings.classes_of(vectors, 21, "vec_id", "embedding")
    assert classes.count() == 2701 and classes.agg(F.max(F.size("ids"))).first()[0] == 21
    index = postings.fit(classes, size=32)
    assert 60 <= len(index.graph.c) <= 140
    entries = index.routed(classes, False, 0.1)
    assert entries.select("k").distinct().count() == 2701
    lists = entries.select(F.explode("lists").alias("l")).groupBy("l").count()
    assert lists.agg(F.max("count")).first()[0] < 8 * 32
    y = postings.widened(x[:200], index.longest, True)
    far = index.graph.within(y, 0.25)
    plain = np.sqrt(postings.squares(y, index.graph.c))
    near = plain <= 1.25 * plain.min(axis=1, keepdims=True)
    assert (np.isfinite(far) & near).sum() >= 0.97 * near.sum()
