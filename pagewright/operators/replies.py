"""Batches of texts to a model, and what comes back: prompts, numbered replies, repair.

A client is any function from a list of prompts to a list of replies, None for a
failure; it runs in Arrow batches on the executors, so tests inject a deterministic
one. Its results are written before they are used, so a lost task repeats no call
that others have read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagewright.functions import text as t
from pagewright.session import saved

#: Texts of a prompt, and tries of a call.
BATCH, TRIES = 10, 3
#: Seconds to wait after the first failure, and after each further one.
WAITS = (1.0, 2.0)
MARKER = r"^\s*(?:\[(\d+)\]|(\d+)[.)])\s*[:.)-]?\s*(.*)$"


def numbered(units: DataFrame, size: int = BATCH) -> DataFrame:
    """units (page, idx, text) with `batch` by position and `number`, dense over the batch's texts that are not blank."""
    filled = F.length(t.squeezed(F.col("text"))) > 0
    rows = units.withColumn("batch", F.floor(F.col("idx") / size))
    order = Window.partitionBy("page", "batch").orderBy("idx")
    return rows.withColumn("number", F.when(filled, F.sum(filled.cast("int")).over(order)).cast("int"))


def prompts(rows: DataFrame) -> DataFrame:
    """(page, batch, expected, prompt): the numbered lines of each batch that has any; rows may have `tag`."""
    tag = F.col("tag") if "tag" in rows.columns else F.lit("")
    line = F.concat(F.lit("["), F.col("number"), F.lit("] "), F.when(F.length(tag) > 0, F.concat(tag, F.lit(" "))).otherwise(""), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("number", line.alias("line"))))
    return rows.where("number is not null").groupBy("page", "batch").agg(F.max("number").alias("expected"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def parsed(reply: Column, expected: Column) -> Column:
    """Map from 1-based number to text of a numbered reply.

    A marker within range moves to its item, and its text, if any, replaces what the item had. Other
    lines go on with the item reached, or, if no marker was in range at all, stand for the items in order.
    """
    lines = F.filter(F.transform(F.split(F.trim(F.regexp_replace(reply, "\r\n?", "\n")), "\n"), F.trim), lambda x: F.length(x) > 0)

    def read(x: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(x, MARKER, 1), F.lit("")), F.nullif(F.regexp_extract(x, MARKER, 2), F.lit(""))).cast("int")
        marked = F.coalesce(number.between(1, expected), F.lit(False))
        return F.struct(F.when(marked, number).alias("number"), F.when(marked, F.trim(F.regexp_extract(x, MARKER, 3))).otherwise(x).alias("value"))

    items = F.transform(lines, read)
    start = F.struct(F.lit(None).cast("int").alias("at"), F.array_repeat(F.lit("").cast("string"), expected).alias("found"))

    def put(found: Column, at: Column, value: Column) -> Column:
        return F.transform(found, lambda old, i: F.when(i + 1 == at, value).otherwise(old))

    def step(state: Column, x: Column) -> Column:
        before = F.get(state["found"], state["at"] - 1)
        joined = F.when(F.length(before) > 0, F.concat(before, F.lit(" "), x["value"])).otherwise(x["value"])
        return (
            F.when(x["number"].isNotNull(), F.struct(x["number"].alias("at"), F.when(F.length(x["value"]) > 0, put(state["found"], x["number"], x["value"])).otherwise(state["found"]).alias("found")))
            .when(state["at"].isNotNull(), F.struct(state["at"].alias("at"), put(state["found"], state["at"], joined).alias("found")))
            .otherwise(state)
        )

    marked = F.exists(items, lambda x: x["number"].isNotNull())
    plain = F.transform(F.slice(items, 1, expected), lambda x: x["value"])
    values = F.when(marked, F.aggregate(items, start, step)["found"]).otherwise(plain)
    entries = F.transform(values, lambda v, i: F.struct((i + 1).alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: F.length(e["value"]) > 0))


def message_text(content: Column) -> Column:
    """The text of a message's content, as JSON: a string as it is, of a list each string or the first text of each block, '' for all else."""
    whole = F.try_parse_json(content)

    def string(v: Column, path: str) -> Column:
        # A number or flag is no text.
        found = F.trim(F.try_variant_get(v, path, "string"))
        return F.when((F.schema_of_variant(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("0")))) == "STRING") & (F.length(found) > 0), found)

    blocks = F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda v: F.coalesce(string(v, "$"), string(v, "$.text"), string(v, "$.output_text"), string(v, "$.content")))
    plain = F.when(F.schema_of_variant(whole) == "STRING", F.try_variant_get(whole, "$", "string"))
    return F.coalesce(plain, F.array_join(F.filter(blocks, lambda x: x.isNotNull()), "\n"), F.lit(""))


def asked(rows: DataFrame, client: Callable[[list[str]], list[str | None]], tries: int = TRIES, waits: Sequence[float] = WAITS, slots: int | None = None) -> DataFrame:
    """rows with `reply`, null where every try failed; rows have `prompt`.

    Between tries a task waits; at most `slots` tasks call at once, if that is given.
    """
    rows = rows.coalesce(slots) if slots else rows
    at = rows.columns.index("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            replies: list[str | None] = [None] * len(texts)
            for k in range(tries):
                left = [i for i, r in enumerate(replies) if r is None]
                if not left:
                    break
                if k and waits:
                    time.sleep(waits[min(k, len(waits)) - 1])
                for i, r in zip(left, client([texts[i] for i in left]), strict=True):
                    replies[i] = r
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], [*b.schema.names, "reply"])

    return saved(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("reply", StringType())])))


def translated(units: DataFrame, client: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(page, idx, text, target): each text's reply, repaired in batches, then one by one, then the text itself.

    A batch whose call fails gives its texts back as they are; blank texts give ''.
    """
    rows = saved(numbered(units))
    first = asked(prompts(rows), client).select("page", "batch", F.col("reply").isNull().alias("failed"), parsed(F.coalesce("reply", F.lit("")), F.col("expected")).alias("found"))
    got = rows.join(first, ["page", "batch"], "left").withColumn("target", F.element_at("found", F.col("number")))
    got = saved(got.drop("found"))
    for alone in (False, True):
        bad = got.where("number is not null and not failed").where(t.needs_repair(F.col("text"), F.coalesce("target", F.lit("")))).drop("number", "target", "failed")
        if alone:
            again = bad.withColumn("batch", F.col("idx")).withColumn("number", F.lit(1))
        else:
            again = bad.withColumn("number", F.row_number().over(Window.partitionBy("page", "batch").orderBy("idx")))
        fixed = asked(prompts(again), client).select("page", "batch", parsed(F.coalesce("reply", F.lit("")), F.col("expected")).alias("found"))
        new = again.join(fixed, ["page", "batch"]).select("page", "idx", F.element_at("found", F.col("number")).alias("new"), F.col("text").alias("source"))
        new = new.where(F.col("new").isNotNull() & ~t.needs_repair(F.col("source"), F.col("new"))).drop("source")
        got = saved(got.join(new, ["page", "idx"], "left").withColumn("target", F.coalesce("new", "target")).drop("new"))
    text = F.when(F.col("number").isNull(), "").when(F.col("failed"), F.col("text")).otherwise(t.postprocessed(F.coalesce("target", "text")))
    return got.select("page", "idx", "text", text.alias("target"))
