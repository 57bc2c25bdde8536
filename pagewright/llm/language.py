"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled text that is not held out: each Arrow
batch becomes a dense language by bucket count in numpy, each task sends its
counts once, and Spark sums them. The model is a matrix of log probabilities of
buckets by languages, bounded by its two sizes, which is broadcast. Scoring sums
the rows of the matrix that a text's n-grams hit.

Texts are lower-cased, and every character that is no letter counts as a space.
Null texts and texts without a letter get `und` and score 0. Without any labelled
row all texts get `und` and score 0. Only the key, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import buffers, slices, small_batches

#: Buckets, lengths of n-grams, and bytes of text handled at once.
BUCKETS, ORDERS, CHUNK = 1 << 15, (2, 3), 1 << 19
PAD = max(ORDERS) - 1
#: Characters of one text handled at once.
PART = 1 << 20
SMOOTH = 0.1
#: Least posterior of a text that is passed, and how far, per n-gram, its log-likelihood may be below what the model expects of its language.
LEAST, MARGIN = 0.5, 3.0

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _letters[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, code points with PAD spaces before each text and at the end, and the place of the first of them: no n-gram has letters of two texts."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    data, at = buffers(column)
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    table = letters()
    for i, j in slices(at, CHUNK):
        code = np.frombuffer(data[at[i] : at[j]].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        code = np.where(table[np.minimum(code, 0x10FFFF)], code, np.uint32(32))
        ends = np.concatenate([[0], np.cumsum(sizes[i:j])])
        if ends[-1] != len(code):  # lengths that the decoder disagrees with
            parts = [x.decode("utf-8", "replace") for x in (data[at[k] : at[k + 1]].tobytes() for k in range(i, j))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        yield i, j, np.append(np.insert(code, np.repeat(ends[:-1], PAD), 32), np.full(PAD, 32, np.uint32)), ends[:-1] + PAD * np.arange(j - i)


def buckets(code: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character; one bucket more for those without a letter or past the end."""
    m = len(code) - n + 1
    if m <= 0:
        return np.full(len(code), BUCKETS, np.int64)
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    some = np.zeros(m, bool)
    for k in range(n):
        h = (h ^ code[k : k + m]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        some |= code[k : k + m] != 32
    out = np.full(len(code), BUCKETS, np.int64)
    out[:m] = np.where(some, h >> np.uint32(32 - BUCKETS.bit_length() + 1), BUCKETS)
    return out


def counts(code: np.ndarray, n: int) -> np.ndarray:
    """How often each bucket occurs among the n-grams of one text, which is read in parts."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for s in range(0, len(code), PART):
        out += np.bincount(buckets(code[s : s + PART + n - 1], n)[:PART], minlength=BUCKETS + 1)
    return out


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the key as text leaves this remainder."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == part


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of (buckets + 1) x languages, the last row 0; the prior is left flat."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            column, names = b.column(0), b.column(1).to_pylist()
            for i, j, code, first in chunks(column):
                own = sorted(set(names[i:j]))
                number = {x: k for k, x in enumerate(own)}
                if j - i == 1:
                    for n in ORDERS:
                        found[own[0]] = found.get(own[0], 0) + counts(code, n)[:BUCKETS]
                    continue
                lang = np.repeat([number[x] for x in names[i:j]], np.diff(np.append(first, len(code))))
                for n in ORDERS:
                    c = np.bincount(lang * (BUCKETS + 1) + buckets(code, n), minlength=len(own) * (BUCKETS + 1)).reshape(len(own), -1)[:, :BUCKETS]
                    for x, k in number.items():
                        found[x] = found.get(x, 0) + c[k]
        for x, c in sorted(found.items()):
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(c[hit], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label).mapInArrow(run, "lang string, bucket int, n long")
    # At most languages x buckets rows come to the driver, however large the input is.
    counted = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    names = sorted(set(counted["lang"]))
    number = {x: k for k, x in enumerate(names)}
    table = np.full((BUCKETS + 1, len(names)), SMOOTH)
    if names:
        table[counted["bucket"], [number[x] for x in counted["lang"]]] += counted["n"]
    table = np.log(table / table[:BUCKETS].sum(axis=0))
    table[BUCKETS] = 0
    return names, table.astype(np.float32)


def decide(column: pa.Array, model: tuple[list[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language of each text, -1 for none, its posterior, and its log-likelihood per n-gram less what the language's own texts have."""
    names, table = model
    best, score, above = np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column))
    if names:
        whole = table.astype(np.float64)
        expected = (np.exp(whole[:BUCKETS]) * whole[:BUCKETS]).sum(axis=0)
        for i, j, code, first in chunks(column):
            total, size = np.zeros((j - i, len(names))), np.zeros(j - i)
            for n in ORDERS:
                # A text alone may be long: its n-grams are counted, not looked up one by one.
                if j - i == 1:
                    c = counts(code, n)
                    total += c @ whole
                    size += c[:BUCKETS].sum()
                else:
                    b = buckets(code, n)
                    total += np.add.reduceat(table[b], first, axis=0, dtype=np.float64)
                    size += np.add.reduceat((b < BUCKETS).astype(np.int64), first)
            some = np.add.reduceat((code != 32).astype(np.int64), first) > 0
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            own = total.argmax(axis=1)
            best[i:j], score[i:j] = np.where(some, own, -1), np.where(some, p, 0)
            above[i:j] = total[np.arange(j - i), own] / np.maximum(size, 1) - expected[own]
    return best, score, above


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred and score: the posterior of the language chosen, `und` and 0 where there is no letter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        for b in batches:
            best, score, _ = decide(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] if k >= 0 else "und" for k in best], pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def passed(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, that have a language with at least this posterior and look like a text in it.

    The posterior alone is near 1 for nearly all texts, as one language always fits best; what is in none of them, noise and code among it, is far
    less likely per n-gram than the language's own texts.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, above = decide(b.column(at), shared.value)
            yield b.filter(pa.array((best >= 0) & (score >= least) & (above >= -margin)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """Train on rows that are not held out, then predict all: key, held_out, lang_pred, score."""
    out = held_out(key, parts, part)
    return predict(docs, train(docs.where(~out), text, label), key, text).select(key, out.alias("held_out"), "lang_pred", "score")
