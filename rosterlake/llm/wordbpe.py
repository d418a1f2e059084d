"""Exact ids of a word-level BPE tokenizer, with a bounded cache of word encodings.

The tokenizer lower-cases, drops white space and encodes each pre-token by itself, so a text's ids are
the concatenation of its words' ids. Texts made of ASCII and Latin letters are split and numbered by
Arrow, many texts at a time, and each distinct word is encoded once. Any other text, and any text that
holds the string of an added token, goes through the tokenizer whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that are in composed form, whose lower case is in this range too.
LATIN = "À-ÖØ-öø-įı-ſ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}]*")
TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\s0-9a-z{LATIN}]+")


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells each non-ASCII character of a plain text.

    Printable bytes stand for themselves, the others are numbered from U+0100 in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    spell = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


class WordIds:
    """``limit`` bounds the pre-tokens that are remembered; a full cache gives way to words in use, which costs time only."""

    def __init__(self, tokenizer, limit: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.spelling = tokenizer, limit, byte_letters()
        self.model = Tokenizer(tokenizer.model)  # takes pre-tokens that are cut and spelled already
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        self.added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        self.tokens: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, tokens: list[str]) -> None:
        """Encode new pre-tokens, many at a time, each being one word of a joined text."""
        for at in range(0, len(tokens), 16_384):
            part = tokens[at : at + 16_384]
            joined = " ".join([t if t.isascii() else t.translate(self.spelling) for t in part])
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.tokens.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def find(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        cut = {k: TOKENS.findall(w) for k, w in enumerate(words) if not w.isalpha()}
        used = set(words).difference([words[k] for k in cut]).union(*cut.values())
        new = used.difference(self.tokens)
        if len(self.tokens) + len(new) > self.limit:
            self.tokens = {t: ids for t in used if (ids := self.tokens.get(t)) is not None}
        self.learn(list(new))
        get = self.tokens.get
        out = list(map(get, words))
        for k, tokens in cut.items():
            out[k] = b"".join(map(get, tokens))
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        lowered = [text.lower() if PLAIN.fullmatch(text) else None for text in texts]
        for k, text in enumerate(lowered):
            if text is not None and any(t in text for t in self.added):
                lowered[k] = None
        plain = [k for k, text in enumerate(lowered) if text is not None]
        out = [b"" if text is not None else self.encode(texts[k]) for k, text in enumerate(lowered)]
        if not plain:
            return out
        split = pc.ascii_split_whitespace(pa.array([lowered[k] for k in plain], pa.large_string()))
        filled = pc.not_equal(pc.binary_length(split.values), 0)  # a text's borders may give empty words
        coded = split.values.filter(filled).dictionary_encode()
        ends = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))][split.offsets.to_numpy()]
        encoded = self.find(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        pool, begins = np.frombuffer(b"".join(encoded), "<u4"), np.cumsum(sizes) - sizes
        own = sizes[index]
        reach = np.cumsum(own)
        raw, marks = pool[np.repeat(begins[index] - (reach - own), own) + np.arange(int(own.sum()))].tobytes(), (np.r_[0, reach][ends] * 4).tolist()
        for n, k in enumerate(plain):
            out[k] = raw[marks[n] : marks[n + 1]]
        return out


@functools.lru_cache(maxsize=2)
def word_ids(path: str, limit: int = 1_000_000) -> WordIds:
    """One tokenizer and cache for each Python worker."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path), limit)
