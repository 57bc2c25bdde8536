"""Quality rules: base rules, then a log-likelihood ratio of hashed n-grams between trusted texts and all texts.

All of it is DataFrame expressions. The n-grams of a text are its words, and pairs
of adjacent words' shapes (a run of capitals is A, a run of small letters a), each
hashed to one of a fixed number of buckets. Two multinomials over the buckets, of
trusted texts and of the whole corpus, both at the number of trusted n-grams and with one
added to every count, so that what is rare or seldom trusted says little, give a
log ratio per bucket: a table of fixed size, which becomes a constant of the scoring plan. A document's score is the mean
ratio of its n-grams, so it does not depend on length, and the document is kept if
the score reaches a fixed threshold and no base rule rejects it.

Null and empty texts have no words and fail the base rules. Without any trusted
text the ratio is zero everywhere, so the base rules alone decide. Repeated rows
are counted and judged each. Only the key, the text and the labels' key and label are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import join_small, materialise

#: Bits of a bucket number, least mean log ratio of a kept document, and trusted keys that are broadcast at most.
BITS, THRESHOLD, BROADCAST = 16, -0.75, 200_000
#: Least words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column | str) -> Column:
    """Runs of characters other than space and 9 to 13."""
    return F.array_remove(F.split(text, SPACE), "")


def bucket(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BITS).cast("int")


def adjacent(values: Column | str, n: Column, f) -> Column:
    """f of each value and the next; n is the number of values."""
    return F.when(n >= 2, F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(1))), F.slice(values, 2, F.greatest(n - 1, F.lit(1))), f))


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """docs with __words, __hashes, __n and the bucket array __grams."""
    whole = F.coalesce(F.col(text), F.lit(""))
    shape = words(F.regexp_replace(F.regexp_replace(whole, "\\p{Lu}+", "A"), "\\p{Ll}+", "a"))
    docs = docs.withColumn("__words", words(whole)).withColumn("__shapes", shape)
    docs = docs.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).withColumn("__n", F.size("__words"))
    pairs = adjacent("__shapes", F.size("__shapes"), lambda a, b: bucket(F.xxhash64(a, b)))
    none = F.array().cast("array<int>")
    return docs.withColumn("__grams", F.concat(F.transform("__hashes", bucket), F.coalesce(pairs, none))).drop("__shapes")


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The log ratio of every bucket in order, to six places, as a constant array; trusted has the keys of trusted texts."""
    marked = join_small(docs.select(key, text), trusted.select(key).distinct().withColumn("__trusted", F.lit(1)), key, "left", BROADCAST)
    # The plain explode would first filter on the array's size, and so compute the array twice.
    grams = prepared(marked, text).select("__trusted", F.explode_outer("__grams").alias("bucket")).where("bucket is not null")
    counts = materialise(grams.groupBy("bucket").agg(F.count("*").alias("all"), F.count("__trusted").alias("own")))
    size = 1 << BITS
    total = counts.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("total_all"), F.coalesce(F.sum("own"), F.lit(0)).alias("total_own"))
    expected = F.col("all") * (F.col("total_own") / F.greatest("total_all", F.lit(1)))
    log = F.log((F.col("own") + 1) / (expected + 1))
    # One total row and 2**BITS buckets at most, however large the input is.
    table = counts.select("bucket", "all", "own").unionAll(counts.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    table = table.groupBy("bucket").agg(F.sum("all").alias("all"), F.sum("own").alias("own")).withColumns({c: total.select(c).scalar() for c in ("total_all", "total_own")})
    row = table.select(F.struct("bucket", F.format_string("%.6f", log).alias("ratio")).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["ratio"]), ",")).first()
    return F.split(F.lit(row[0]), ",").cast("array<double>")


def with_repeats(rows: DataFrame, name: str) -> DataFrame:
    """rows with the number of words in windows of three that occur twice or more, the first occurrence included.

    Each step is a column of its own, as an expression that is used twice is else computed twice.
    """
    n = F.col("__n")
    size = F.greatest(n - 2, F.lit(1))
    rows = rows.withColumn("__pairs", adjacent("__hashes", n, lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("__triples", F.when(n >= 4, F.zip_with(F.slice("__pairs", 1, size), F.slice("__hashes", 3, size), lambda a, b: F.xxhash64(a, b))))
    rows = rows.withColumn("__again", F.size(F.array_distinct("__triples")) < n - 2)
    places = F.when(F.col("__again"), F.sort_array(F.transform("__triples", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.drop("__pairs").withColumn("__places", places).drop("__triples")
    same = F.when(F.col("__again"), F.zip_with("__places", F.slice("__places", 2, size), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    rows = rows.withColumn("__starts", F.when(F.col("__again"), starts)).drop("__places")
    # Each start covers up to the next one, three words at most; the last covers three.
    gaps = F.zip_with("__starts", F.slice("__starts", 2, size), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    total = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return rows.withColumn(name, F.when(F.col("__again"), total).otherwise(0).cast("long")).drop("__starts", "__again")


def judge(docs: DataFrame, ratio: Column, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns c0, c1, ... of docs, then base counts, base_failed, kept and score (mean log ratio, 0 without n-grams) of each row."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, own, strict=True)))
    text = own[docs.columns.index(text)]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = prepared(rows, text)
    rows = with_repeats(rows, "n_repeat_words")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumns({
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]", ""))).cast("long"),
        "__lines": lines,
        "__sum": F.aggregate(F.col("__grams"), F.lit(0.0), lambda a, x: a + ratio[x]),
    })
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = rows.withColumn("score", F.when(F.size("__grams") > 0, F.col("__sum") / F.size("__grams")).otherwise(0.0))
    return rows.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")


def trusted_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys of the rows that the labels call good."""
    return labels.where(F.col(label) == 1).select(key).where(F.col(key).isNotNull()).distinct()


def apply(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Key and verdict of every row of docs; the corpus is docs, trusted texts are those that labels call good."""
    ratio = ratios(docs, trusted_keys(labels, key), key, text)
    found = judge(docs.select(key, text), ratio, text, threshold)
    return found.select(F.col("c0").alias(key), *found.columns[2:])


def passed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that are kept."""
    ratio = ratios(docs, trusted_keys(labels, key), key, text)
    # A filter on the verdict alone would be pushed below its steps and compute each as often as it is used;
    # it cannot pass a column that is not deterministic.
    found = judge(docs, ratio, text, threshold).withColumn("__row", F.monotonically_increasing_id())
    return found.where("kept and __row >= 0").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
