"""Relations derived from the sample tables, in Spark and as SQL text that the oracle shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 1050, 1480
#: Latin letters that stand for kana, kanji and marks in texts that have none.
LATIN, KANA = "aeiounstrlmqxz", "あえいおうんすたらるまッー愛"

ORDER = """l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus"""
CORNERS = """(l_partkey * 37) % 900 as x1, (l_suppkey * 53) % 1300 as y1,
  (l_partkey * 37) % 900 + 12 + cast(l_quantity as bigint) * 3 as x2, (l_suppkey * 53) % 1300 + 12 + l_partkey % 90 as y2"""
BOXES = f"""
select l_orderkey as page, row_number() over (partition by l_orderkey order by {ORDER}) as pos,
  {CORNERS}
from lineitem"""
#: Boxes of fewer pages, so that a page has as many as a region of many balloons; `pos` is what they are ordered by.
PAGED = f"select cast(floor(l_orderkey / 4) as bigint) as page, struct(l_orderkey, {ORDER}) as pos, {CORNERS} from {{lineitem}}"
#: A crop of a part and, in it, a block of marks, in expressions that both engines read alike.
CROP = {"page": "p_partkey", "w": "60 + p_partkey * 7 % 140", "h": "60 + p_partkey * 11 % 120", "style": "case when p_partkey % 3 = 0 then 'sfx' else 'dialogue' end", "text": "case when p_partkey % 5 = 0 then '...' else p_name end"}
INK = {"x": "p_partkey * 13 % (w - 56)", "y": "p_partkey * 17 % (h - 56)", "iw": "5 + p_size", "ih": "5 + p_partkey * 3 % 51"}
TEXTS = f"select conv_id as page, turn as idx, translate(lower(text), '{LATIN}', '{KANA}') as source, text as target from conversations"


def sql(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    """A query over tables of a folder, named in it as {name}."""
    return spark.sql(query, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages, made from lineitem."""
    return sql(spark, sf_dir, BOXES.replace("from lineitem", "from {lineitem}"), "lineitem")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of fewer pages, not numbered: kernels of pages sort them, which takes no shuffle of its own."""
    return sql(spark, sf_dir, PAGED, "lineitem")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a source in kana, made from conversations."""
    return sql(spark, sf_dir, TEXTS.replace("from conversations", "from {conversations}"), "conversations")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, reply, expected): turns of a conversation as numbered lines, every third without its marker."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.when(F.col("turn") % 3 == 2, F.regexp_replace("text", "\n", " ")).otherwise(F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.regexp_replace("text", "\n", " ")))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line"))))
    return c.groupBy(F.col("conv_id").alias("page")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("reply"), (F.max("turn") + 1).cast("int").alias("expected"))
