"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. Leaf i of the tree holds the rank of the pair that
starts at symbol i; an inner node holds the smaller of its children, by rank and
then by place, so the root is the leftmost lowest-rank merge. A merge changes
three leaves, each in a logarithmic number of steps. Words repeat, so finished
ones are kept in a bounded cache per Python worker.

Null texts count as empty and give no ids. Columns of the input other than the
id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .runtime import small_batches

#: White space of Unicode, and the pattern of the vocabulary's pre-tokenizer.
WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pieces between spaces, and tokens before merging, in each of the two generations of a worker's cache.
CACHED, CACHED_TOKENS = 200_000, 500_000
NEVER = 1 << 62

_loaded: dict[tuple[str, str | None], Tokenizer] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class Pieces(dict):
    """Ids, as packed bytes, of pieces of text; a missing piece is encoded, and lead is put before it.

    Of two generations, the older goes when the younger is full.
    """

    def __init__(self, encode, lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most, self.old = encode, lead, most, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(self.lead + piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Tokenizer:
    """A byte-level vocabulary file: ids of texts, and texts of ids."""

    def __init__(self, path: str, ranks: str | None = None):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        names = byte_symbols()
        self.start = [vocab[c] for c in names]
        value = {c: b for b, c in enumerate(names)}
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.text[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.text[i] = token.encode()
        self.lengths = np.array([len(x) for x in self.text], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=load_ranks(ranks), special_tokens={}) if ranks else None
        self.apart = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # A space that another white space follows, or the end, does not begin a token for sure.
        self.unsafe = re.compile(f" (?:[{WHITE}]|\\Z)")
        self.plain, self.spaced = Pieces(self._pieces, "", CACHED), Pieces(self._pieces, " ", CACHED)
        self.tokens = Pieces(self._token, "", CACHED_TOKENS)

    def _token(self, token: str) -> bytes:
        return np.array(self.merged([self.start[b] for b in token.encode()]), "<u4").tobytes()

    def _pieces(self, text: str) -> bytes:
        if self.ranks:
            return array("I", self.ranks.encode_ordinary(text)).tobytes()
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(text)))

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until no pair of the vocabulary is left."""
        n = len(symbols)
        if n < 2:
            return symbols
        find = self.merge.get
        size = 1 << (n - 1).bit_length()
        low = size - 1
        # A leaf is rank * size + place, so the least leaf is the leftmost of the lowest rank.
        tree = [NEVER] * (2 * size)
        into = [0] * n
        a = symbols[0]
        for i in range(n - 1):
            b = symbols[i + 1]
            found = find(a << 32 | b)
            if found:
                into[i] = found[1]
                tree[size + i] = found[0] * size + i
            a = b
        for at in range(low, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < NEVER:
            i = tree[1] & low
            j = after[i]
            symbols[i] = into[i]
            k = after[i] = after[j]
            h = before[i]
            changed = [(j, NEVER)]
            value = NEVER
            if k < n:
                before[k] = i
                if found := find(symbols[i] << 32 | symbols[k]):
                    into[i] = found[1]
                    value = found[0] * size + i
            changed.append((i, value))
            if h >= 0:
                value = NEVER
                if found := find(symbols[h] << 32 | symbols[i]):
                    into[h] = found[1]
                    value = found[0] * size + h
                changed.append((h, value))
            for leaf, value in changed:
                at = size + leaf
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    b = tree[at ^ 1]
                    if b < value:
                        value = b
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def _ordinary(self, text: str) -> bytes:
        if self.unsafe.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.apart and any(x in text for x in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._ordinary(x) for x in self.apart.split(text) if x)
        return self._ordinary(text)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer(path: str, ranks: str | None = None) -> Tokenizer:
    """The vocabulary at path, loaded once in each Python process; with a rank file of the same ids, words that are
    not in the cache go to the tiktoken library instead of the segment tree."""
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = Tokenizer(path, ranks)
    return _loaded[path, ranks]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and `ids`, the packed ids of each whole text; one row for each row, null texts give no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.encode(x) for x in b.column(1).to_pylist()], pa.binary())], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_tokens, and digests of the packed ids and of the text decoded from them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            counts, ids, texts = [], [], []
            for x in b.column(1).to_pylist():
                packed = t.encode(x)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(t.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
