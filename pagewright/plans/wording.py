"""Queries over texts of units and replies of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import regions as r
from pagewright.operators import replies as a
from pagewright.plans import wording_sql
from pagewright.plans.tables import TEXTS, replies, texts

WITH = f"with u as ({TEXTS})"


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir)
    return u.select("page", "idx", t.script_profile(F.col("source")).alias("p")).select("page", "idx", "p.kana", "p.kanji", "p.script")


def unit_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir).select("page", "idx", F.explode(F.split("source", " ")).alias("word"))
    return words.groupBy("word", t.unit_style(F.col("word")).alias("style")).agg(F.count("*").alias("n"))


def ocr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("page", "idx", t.common_character_misses(F.trim("source")).alias("misses"), t.noisy(F.col("source")).alias("noisy"))


def ocr_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir)
    variants = F.array(F.col("source"), F.regexp_replace("source", "[^\\u3040-\\u30FF]", ""), F.left("source", F.lit(12)), F.col("target"))
    rows = u.select("page", "idx", F.posexplode(variants).alias("variant_idx", "text"))
    best = r.best_candidate(rows, ["page", "idx"], t.candidate_score(F.col("text")))
    return best.select("page", "idx", "variant_idx", F.round("score", 6).alias("score"))


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir)
    return u.select("page", "idx", t.sanitized(F.concat(F.lit("“"), F.col("target"), F.lit("” — "), F.col("source"))).alias("text"))


def postprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir)
    titled = F.concat(F.lit("*"), F.col("target"), F.when(F.col("idx") % 2 == 0, "-san!").otherwise("-kun*"))
    return u.select("page", "idx", t.postprocessed(titled).alias("text"))


def needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir)
    target = F.when(F.col("idx") % 5 == 0, F.col("source")).when(F.col("idx") % 5 == 1, "...").when(F.col("idx") % 5 == 2, "I cannot assist").when(F.col("idx") % 5 == 3, F.left("target", F.lit(9))).otherwise(F.col("target"))
    return u.select("page", "idx", t.needs_repair(F.col("source"), target).alias("repair"))


def constraint_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir).select("page", "idx", F.when(F.col("idx") % 2 == 0, "sfx").when(F.col("idx") % 3 == 0, "dialogue").alias("style"), (F.col("idx") % 4).cast("int").alias("words"), F.when(F.col("idx") % 5 > 0, F.col("idx").cast("int")).alias("chars"))
    return u.select("page", "idx", t.constraint_tag(F.col("style"), F.col("words"), F.col("chars")).alias("tag"))


def compress_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir)
    return u.select("page", "idx", t.truncated(F.col("target"), F.lit(6)).alias("cut"), t.compact_sound(F.col("target")).alias("sound"), t.compressed(F.col("target"), F.lit(6)).alias("short"))


def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir).groupBy("page", "idx").agg(F.max("target").alias("text"))
    return a.prompts(a.numbered(u, 3)).select("page", "batch", "expected", "prompt")


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replies(spark, sf_dir)
    return rows.select("page", F.explode(a.parsed(F.col("reply"), F.col("expected"))).alias("number", "text"))


def stub(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: every line backwards in capitals, some left out, a few refused."""
    out: list[str | None] = []
    for p in prompts:
        lines = []
        for line in p.split("\n"):
            mark, _, text = line.partition(" ")
            kind = sum(map(ord, text)) % 11
            if kind == 0:
                continue
            lines.append(f"{mark} I cannot assist" if kind == 1 else f"{mark} {text.upper()}")
        out.append("\n".join(lines))
    return out


def repair_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = texts(spark, sf_dir).groupBy("page", "idx").agg(F.max("target").alias("text"))
    return a.translated(u, stub).select("page", "idx", "target")


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides whether a reply is drawn, asked for again, or cut."""
    u, target = texts(spark, sf_dir), F.col("target")
    return u.select(
        "page", "idx", t.renderable(F.col("source"), target).alias("renderable"), t.romaji_noise(target).alias("noise"), t.violates(target, F.col("idx") % 7 + 3, F.col("idx") * 20 + 15).alias("over"),
        t.punctuation_only(target).alias("points_only"), t.ellipsis_like(target).alias("dots"), t.logged(target).alias("logged"),
    )


def render_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which replies are too small for their block, or noise, in boxes of several sizes on paper and on art."""
    u = texts(spark, sf_dir).withColumns({"area": (F.col("page") * 977 + F.col("idx") * 7919) % 90_000, "context": (F.col("page") * 331) % 60_000, "balloon": (F.col("page") + F.col("idx")) % 3 == 0})
    u = u.withColumns({"target": F.when(F.col("idx") % 3 == 0, F.left("target", F.lit(12))).otherwise(F.col("target")), "source": F.when(F.col("idx") % 2 == 0, F.left("source", F.lit(9))).otherwise(F.col("source"))})
    source, target = F.col("source"), F.col("target")
    return u.select("page", "idx", t.short_sound(target).alias("sound"), t.large_mismatch(source, target, F.col("area"), F.col("balloon")).alias("mismatch"), t.short_noise(source, target, F.col("area"), F.col("context"), F.col("balloon")).alias("noise"))


def drawing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How replies are drawn in boxes of several sizes, sounds, points and blanks among them."""
    u = texts(spark, sf_dir).withColumns({"w": F.col("page") * 13 % 90 + 5, "h": F.col("idx") * 29 % 120 + 5})
    target = F.when(F.col("idx") % 4 == 0, F.left("target", F.lit(11))).when(F.col("idx") % 4 == 1, F.regexp_replace("target", "[A-Za-z ]+", "")).otherwise(F.col("target"))
    u = u.withColumn("target", target)
    x, w, h = F.col("target"), F.col("w"), F.col("h")
    return u.select("page", "idx", t.tightened(x, w, h).alias("tight"), t.skipped(x, w, h).alias("skipped"), t.drawn_as_sound(x, w, h).alias("sound"), t.low_signal(x).alias("empty"))


QUERIES = {f.__name__: f for f in (script_profile, unit_style, ocr_noise, ocr_best, sanitize_text, postprocess_text, needs_repair, constraint_tag, compress_dialogue, prompt_batches, parse_responses, repair_cascade, text_rules, render_rules, drawing_rules)}


def counted(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


ORACLES = wording_sql.ORACLES | {
    "script_profile": f"{WITH}, c as (select page, idx, {counted('source', '[぀-ヿ]')} as kana, {counted('source', '[一-鿿]')} as kanji, len(regexp_extract_all(regexp_replace(source, '[぀-ヿ一-鿿]', '', 'g'), '[\\p{{L}}\\p{{N}}]')) as other from u) select page, idx, cast(kana as int) as kana, cast(kanji as int) as kanji, cast(kana + kanji + other as int) as script from c",
    "constraint_tag": f"""{WITH}, c as (select page, idx, case when idx % 2 = 0 then 'sfx' when idx % 3 = 0 then 'dialogue' end as style, idx % 4 as words, case when idx % 5 > 0 then idx end as chars from u),
  p as (select page, idx, concat_ws(', ', 'style=' || style, case when words > 0 then 'max_words=' || words end, case when chars > 0 then 'max_chars=' || chars end) as parts from c)
  select page, idx, case when parts <> '' then '(' || parts || ')' else '' end as tag from p""",
    "prompt_batches": f"""{WITH}, m as (select page, idx, max(target) as text from u group by all), n as (select page, idx // 3 as batch, text, row_number() over (partition by page, idx // 3 order by idx) as number from m where trim(text) <> '')
  select page, batch, cast(max(number) as int) as expected, string_agg('[' || number || '] ' || text, chr(10) order by number) as prompt from n group by page, batch""",
    "needs_repair": f"""{WITH}, c as (select page, idx, trim(source) as src, trim(case when idx % 5 = 0 then source when idx % 5 = 1 then '...' when idx % 5 = 2 then 'I cannot assist' when idx % 5 = 3 then left(target, 9) else target end) as tgt from u),
  d as (select *, length({wording_sql.gone("src", f"[{wording_sql.QUIET}]")}) as content from c)
  select page, idx, case when tgt = '' then true when content = 0 then false when tgt = src then true when tgt in ('[', ']', '[8', '[9', '..') then true when tgt = '...' and content >= 3 then true
  when {wording_sql.found("lower(tgt)", "|".join(t.REFUSALS))} or {wording_sql.found("tgt", f"[{wording_sql.CJK}─-◿]")} or {wording_sql.sound("tgt")} then true else length(src) >= 8 and length(tgt) <= 1 end as repair from d""",
}
