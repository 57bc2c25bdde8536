"""Document fingerprints: bottom-k sketches of shingle hashes.

All of it is DataFrame expressions. A sketch is the sorted array of the k least
48-bit hashes of a text's distinct five-word shingles; a text of one to four words is one
shingle, a text without words has the empty sketch. Sketches of parts merge into
the sketch of the whole by taking the k least of their union. From sketches come
estimates of resemblance, containment and the distinct shingle count, exact while
a sketch holds fewer than k hashes. Two empty sketches resemble each other fully.

Null texts count as empty. Keys are whole numbers, however far apart. A null key orders before all others; rows with the same
key order by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import join_small, materialise

#: Hashes of a sketch, words of a shingle, and bits of a hash.
K, WORDS, BITS = 128, 5, 48
#: Bits of the key values of a block, which one task orders; blocks whose first keys are broadcast at most.
BLOCK, BROADCAST = 8, 500_000
SPACE = "[\\x20\\x09-\\x0D]+"


def _next(values: Column | str, n: Column, far: int, other: Column | str, f) -> Column:
    """f of each of the first n - far values and the other array's value `far` places on."""
    size = F.greatest(n - far, F.lit(0))
    return F.zip_with(F.slice(values, 1, size), F.slice(other, far + 1, size), f)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column."""
    two = lambda a, b: F.xxhash64(a, b)
    h, n, a, b = (f"__{name}_{x}" for x in ("h", "n", "a", "b"))
    df = df.withColumn(h, F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), lambda w: F.xxhash64(w)))
    df = df.withColumn(n, F.size(h))
    df = df.withColumn(a, F.when(F.col(n) >= WORDS, _next(h, F.col(n), 1, h, two)))
    df = df.withColumn(b, _next(a, F.col(n) - 1, 2, a, two))
    whole = _next(b, F.col(n), 4, h, lambda x, y: F.shiftrightunsigned(F.xxhash64(x, y), 64 - BITS))
    few = F.when(F.col(n) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))).otherwise(F.array().cast("array<bigint>"))
    found = F.when(F.col(n) >= WORDS, F.slice(F.sort_array(F.array_distinct(whole)), 1, k)).otherwise(few)
    return df.withColumn(name, found).drop(h, n, a, b)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least))


def distinct_count(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles of a sketch."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of the first sketch's shingles that the second has; 1 if the first has none."""
    j = resemblance(a, b, k)
    own = distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (own + distinct_count(b, k)) / ((1 + j) * own)))


def merge(parts: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of `by`: the k least distinct hashes of its parts' sketches."""
    hashes = parts.select(*by, F.explode_outer(sketch).alias("__h")).distinct()
    ranked = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__h").asc_nulls_last()))).where(F.col("__r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def printed(a: Column | str) -> Column:
    """A sketch as a string: 12 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of all documents in blocks of keys, and after each block a marked row that stands for the next document.

    Columns: __key, __order, __block, __hash, __text, __mark. The last block is followed by the first document.
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62)))
    rows = docs.select(F.col(key).alias("__key"), order.alias("__order"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__block", F.shiftright("__order", BLOCK)).withColumn("__hash", F.xxhash64("__text")).withColumn("__mark", F.lit(False))
    firsts = docs.select(order.alias("__order")).groupBy(F.shiftright("__order", BLOCK).alias("__block")).agg(F.min("__order").alias("__first"))
    # Blocks in ranges, each ordered by a task; of the ranges, as many as shuffle partitions at most, one task takes the first keys.
    firsts = materialise(firsts.repartitionByRange("__block").withColumn("__range", F.spark_partition_id()))
    ranges = firsts.groupBy("__range").agg(F.min("__first").alias("__start"))
    whole = Window.orderBy("__start")
    ranges = ranges.select("__range", F.coalesce(F.lead("__start").over(whole), F.first("__start").over(whole)).alias("__after"))
    firsts = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy("__range").orderBy("__block"))).join(F.broadcast(ranges), "__range")
    ends = firsts.select("__block", F.coalesce("__next", "__after").alias("__order"))
    after = join_small(rows.select("__order", "__hash", "__text"), ends, "__order", "inner", BROADCAST)
    after = after.groupBy("__block").agg(F.min_by("__text", "__hash").alias("__text"))
    last = F.lit((1 << 63) - 1)
    marks = after.select(F.lit(None).cast(docs.schema[key].dataType).alias("__key"), last.alias("__order"), "__text", "__block", F.lit(0).cast("long").alias("__hash"), F.lit(True).alias("__mark"))
    return rows.unionByName(marks)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles of each row.

    The edited text has its last half replaced by as much, or all, of the next document's text; the last
    document's next is the first. Documents are ordered in blocks of keys, each within a task.
    """
    order = Window.partitionBy("__block").orderBy("__order", "__hash")
    rows = followed(docs, key, text).withColumn("__next", F.lead("__text").over(order))
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.left("__text", n - half), F.left(F.coalesce("__next", F.lit("")), half))).drop("__next")
    rows = with_sketch(with_sketch(rows, "__text", "__own", k), "__edited", "__other", k)
    rows = rows.select("__key", "__block", "__order", "__hash", "__mark", n.cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"), "__own", "__other")
    rows = rows.withColumn("__after", F.lead("__own").over(order)).where("not __mark")
    return rows.select(
        F.col("__key").alias(key), "n_chars", "edited_sha256", printed("__own").alias("fingerprint"), printed("__other").alias("edited_fingerprint"),
        resemblance("__own", "__other", k).alias("near_edited"), resemblance("__own", "__after", k).alias("near_next"), distinct_count("__own", k).alias("distinct_shingles"),
    )
