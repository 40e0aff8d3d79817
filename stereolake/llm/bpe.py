"""Byte-level BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a slice of texts are put in byte order, which is the preorder of their trie: the common prefix of
a word with its predecessor is the path to the node where it branches off. Walking that order depth first, each trie
node gets its state once: the last token of the encoding of the path to it. The last token of a path is the vocabulary
token t that ends it for which (last token of the path without t, t) is a pair that merging leaves as it is. A word's
encoding is read off by following the states back from its node, so shared prefixes are encoded once.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, small_batches

#: The public pre-tokenisation pattern of this vocabulary, and the characters that it counts as white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin-1 letters and digits, for texts of such characters only: the plain re module is faster.
LATIN_LETTERS, LATIN_DIGITS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
CACHED_WORDS = 150_000
KNOWN_PAIRS = 200_000
PIECE = 1 << 20


def word_pattern(letters: str, digits: str) -> str:
    """PATTERN with its classes of letters, digits and white space spelled out."""
    spelled = {r"[^\s\p{L}\p{N}]": f"[^{WHITE}{letters}{digits}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{digits}]", r"\S": f"[^{WHITE}]", r"\s": f"[{WHITE}]"}
    return re.sub("|".join(map(re.escape, spelled)), lambda m: spelled[m.group()], PATTERN)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind (fixed values of the format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in chars]
    chars |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: b for b, c in chars.items()}


class TrieCodec:
    """Encoder and decoder of one vocabulary file; the word cache is bounded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.ids = {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}
        self.bytes = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.added.items()}
        self.longest = max(map(len, self.ids)) + 1
        self.size = {v: len(k) for v, k in self.bytes.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.order = {v: -1 for v in vocab.values()} | {vocab[a + b]: rank for rank, (a, b) in enumerate(pairs)}
        self.halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        self.valid: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.find_latin = re.compile(word_pattern(LATIN_LETTERS, LATIN_DIGITS)).findall
        self.find_any = regex.compile(word_pattern(r"\p{L}", r"\p{N}")).findall
        self.beyond_latin = re.compile(r"[^\x00-\xff]").search
        self.four = {v: v.to_bytes(4, "little") for v in self.bytes}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.cut = regex.compile(r"\S(?= \S)")

    def stands(self, before: int, token: int) -> bool:
        """Whether merging keeps the boundary between two adjacent tokens, each already merged.

        The merges that build both tokens are undone from the latest one back, along the boundary only: if, at any
        point, the two tokens that then touch have a merge earlier than the one undone last, it would have come first
        and crossed the boundary.
        """
        order, halves, merges = self.order, self.halves, self.merges
        left, right, undone = before, token, 1 << 60
        while True:
            crossing = merges.get((left, right))
            if crossing is not None and (crossing < undone):
                return False
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                undone, left = a, halves[left][1]
            else:
                # An equal merge further left comes first, so the right token's own merge is no bar to it.
                undone, right = b + 1, halves[right][0]

    def walk(self, words: list[str]) -> None:
        """Put the encodings of distinct words into the cache, by the depth-first pass over their trie."""
        order = sorted((w.encode("utf-8"), w) for w in words)
        if len(self.valid) > KNOWN_PAIRS:
            self.valid.clear()
        get, valid, four, size, done, longest = self.ids.get, self.valid, self.four, self.size, self.words, self.longest
        known = valid.get
        last = [-1]  # by depth
        previous = b""
        for data, word in order:
            n, shared = len(data), 0
            most = min(n, len(previous))
            while shared < most and data[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                state = get(data[:end])  # a path that is a token is that token
                if state is None:
                    for start in range(end - 1, max(0, end - longest), -1):
                        token = get(data[start:end])
                        if token is not None:
                            key = last[start], token
                            fits = known(key)
                            if fits is None:
                                fits = valid[key] = self.stands(*key)
                            if fits:
                                state = token
                                break
                last.append(state)
            out, end = [], n
            while end:
                token = last[end]
                out.append(four[token])
                end -= size[token]
            out.reverse()
            done[word] = b"".join(out)
            previous = data

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if self.beyond_latin(text) else self.find_latin(text)

    def pieces(self, text: str):
        """(added token or None, text) in order; long texts are cut where a word certainly starts."""
        parts = self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else [text]
        for part in parts:
            if part in self.added:
                yield self.added[part], ""
                continue
            start = 0
            while len(part) - start > PIECE:
                m = self.cut.search(part, start + PIECE)
                if not m:
                    break
                yield None, part[start : m.end()]
                start = m.end()
            yield None, part[start:] if start else part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        split = [[(token, self.find(part)) for token, part in self.pieces(t)] for t in texts]
        new: set[str] = set()
        for parts in split:
            for _, words in parts:
                new.update(words)
        self.walk([w for w in new if w not in self.words])
        get = self.words.__getitem__
        return [b"".join(np.uint32(token).tobytes() if token is not None else b"".join(map(get, words)) for token, words in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> TrieCodec:
    """One codec per worker and vocabulary file."""
    return TrieCodec(path)


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """(id, ids): the ids of each whole text, little-endian unsigned 32-bit integers in a binary.

    Null and empty texts give no ids; repeated rows and null ids stay rows of their own; other columns are not carried.
    The strings of added tokens are these tokens. Nothing is shuffled: a task's trie covers the words of a slice of
    about half a MB of text, and a bounded cache keeps words already encoded.
    """
    small_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec(tokenizer).encode(texts), pa.binary())], ["id", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(source, run, "text", f"id {dict(source.dtypes)['id']}, ids binary")


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """(id, ids, text) of (id, ids): the bytes of the tokens joined and read as UTF-8, U+FFFD where they aren't."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = codec(tokenizer)
        texts = [table.decode(b or b"") for b in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    source = df.select("id", "ids")
    return map_slices(source, run, "ids", f"id {dict(source.dtypes)['id']}, ids binary, text string")
