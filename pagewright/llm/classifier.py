"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of bytes other than white space. The features of a text are its
hashed words and word pairs, and the same of the words' shapes, which say of a
word whether it has capitals only, a symbol, a digit, or is the word one or two
places before. Values are square roots of counts, scaled to length one.
A score is a sparse dot product through the logistic function. Null and empty
texts have no feature, so the bias alone scores them.

The model is trained on a bounded sample: the labelled rows, not held out, with
the least hash of the key, `sample` of them at most, and so many that their features stay within a number of bytes. Everything is scored. Of
several labels of one key, and of repeated keys, each counts as a row. A null
label is no label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import U, grams, mix, words
from .runtime import buffers, materialise, slices, small_batches

#: Weights, labelled rows learned from at most, passes over them, and bytes of text handled at once.
BUCKETS, SAMPLE, PASSES, CHUNK = 1 << 18, 6000, 3, 1 << 20
#: Bytes of features learned from at most: rows of the sample beyond them are left out, in the sample's order.
FEATURES = 1 << 27
#: Rate, its offset, and the two penalties of the leader.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5

SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>!?@=_~^{}[]\\/+")] = 1
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
LOWER = np.zeros(256, np.int64)
LOWER[97:123] = 1
DIGIT = np.zeros(256, np.int64)
DIGIT[48:58] = 1


def held_out(key: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether the CRC-32 of the key as text leaves this remainder."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == part


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature, by row; values of a row have length one."""
    s, e, h, row = words(data, at)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def count(kind: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(kind[data])])
        return c[e] - c[s]

    up, low, symbols, digits = count(UPPER), count(LOWER), count(SYMBOL), count(DIGIT)
    shape = ((up > 1) & (low == 0)) + 2 * np.minimum(symbols, 3) + 8 * (digits > 0) + 16 * (e - s > 30)
    same = np.zeros(len(h), np.int64)
    for k in (1, 2):
        same[k:] |= ((h[k:] == h[:-k]) & (row[k:] == row[:-k])) * k
    shape = mix((shape + 32 * same).astype(U) + U(1 << 40))
    pair, pair_row = grams(h, row, 2)
    shapes, shapes_row = grams(shape, row, 2)
    keys = np.concatenate([h, pair, shape, shapes]) >> U(64 - BUCKETS.bit_length() + 1)
    rows = np.concatenate([row, pair_row, row, shapes_row])
    found, n = np.unique(rows * BUCKETS + keys.astype(np.int64), return_counts=True)
    rows, value = found // BUCKETS, np.sqrt(n)
    norm = np.sqrt(np.bincount(rows, value * value, minlength=len(at) - 1))
    return rows, found % BUCKETS, value / norm[rows]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights, the bias last, from (buckets, values, label) in the order given."""
    z, n, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(passes):
        for at, value, label in examples:
            i, x = np.append(at, BUCKETS), np.append(value, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[i] += g * g
    hit = np.abs(z) > L1
    w[hit] = -(z[hit] - np.sign(z[hit]) * L1) / ((BETA + np.sqrt(n[hit])) / ALPHA + L2)
    return w


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE, parts: int = 3, part: int = 1) -> DataFrame:
    """The bounded training sample: key, text and label."""
    chosen = labels.where(~held_out(key, parts, part) & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("__label")).orderBy(F.xxhash64(F.col(key).cast("string")), key, "__label").limit(most)
    # A limit of `most` bounds the side that is broadcast.
    return docs.select(key, text).join(F.broadcast(chosen), key)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE, parts: int = 3, part: int = 1) -> np.ndarray:
    """Weights learned from the sample; its features, not its texts, come to the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            buckets, values = [b""] * b.num_rows, [b""] * b.num_rows
            for i, j in slices(at, CHUNK):
                rows, bucket, value = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                cut = np.searchsorted(rows, np.arange(j - i + 1))
                for k in range(j - i):
                    buckets[i + k] = bucket[cut[k] : cut[k + 1]].astype("<i4").tobytes()
                    values[i + k] = value[cut[k] : cut[k + 1]].astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], [key, "label", "bucket", "value"])

    found = sample(docs, labels, key, text, label, most, parts, part).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, label int, bucket binary, value binary")
    found = materialise(found.withColumn("__order", F.xxhash64(F.col(key).cast("string"))))
    # Rows of repeated keys beyond the sample's size are bounded by their features' bytes, summed in the sample's order.
    size = F.sum(F.octet_length("bucket") + F.octet_length("value")).over(Window.orderBy("__order", key, "label", "bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("__bytes", size).where(F.col("__bytes") <= FEATURES).drop("__bytes", "__order").toArrow().to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(str(r[key]).encode()), str(r[key]), r["label"], r["bucket"]))
    return train([(np.frombuffer(r["bucket"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float), r["label"]) for r in rows])


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the probability of label 1, and whether it is a half or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            data, at = buffers(b.column(1))
            total = np.full(b.num_rows, w[BUCKETS])
            for i, j in slices(at, CHUNK):
                rows, bucket, value = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                total[i:j] += np.bincount(rows, w[bucket] * value, minlength=j - i)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], [key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 3, part: int = 1) -> DataFrame:
    """Train on the sample, then score all: key, held_out, score, predicted."""
    return score(docs, fit(docs, labels, key, text, label, parts=parts, part=part), key, text).select(key, held_out(key, parts, part).alias("held_out"), "score", "predicted")
