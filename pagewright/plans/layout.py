"""Queries over boxes of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators import contexts, grounds, lettering, ordered, splitting
from pagewright.operators import regions as r
from pagewright.plans.tables import BOXES, CROP, INK, PAGE_HEIGHT, PAGE_WIDTH, boxes, paged

GAP, DISTANCE, ROW = 30, 180, 60
AREA = PAGE_WIDTH * PAGE_HEIGHT
WITH = f"with boxes as ({BOXES})"
NEAR = f"greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) <= {GAP} and greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) <= {GAP}"
SHARED = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


def region_viability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.where(g.viable(g.box(), 40)).select("page", "pos", g.area(g.box()).alias("area"), g.vertical(g.box()).alias("vertical"))


def reading_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.reading_order(boxes(spark, sf_dir), PAGE_WIDTH).select("page", "pos", "place")


def reading_order_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.reading_order(boxes(spark, sf_dir), PAGE_WIDTH, 2).select("page", "pos", "place")


def box_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.near_pairs(boxes(spark, sf_dir), GAP).select("page", F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.overlap_pairs(boxes(spark, sf_dir))
    merge = g.overlapping(g.box("a"), g.box("b"), AREA)
    return found.select("page", F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), F.round("iou", 9).alias("iou"), F.round("share", 9).alias("share"), merge.alias("merges"))


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return r.contained(b, b).where("inner <> outer").select("page", F.col("inner").alias("inside"), F.col("outer").alias("holder"))


def box_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.closure(boxes(spark, sf_dir), GAP).select("page", "x1", "y1", "x2", "y2")


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.centroid_clusters(boxes(spark, sf_dir), DISTANCE).select("page", "pos", "root")


def row_islands_fixed_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.row_islands(boxes(spark, sf_dir), ROW).select("page", "pos", F.col("row").alias("island"))


def column_histogram_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.valleys(boxes(spark, sf_dir), 16, PAGE_WIDTH).select("page", "bin", "n", "smooth", "valley")


def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 50).alias("page"), (F.col("l_partkey") % 20).alias("region"), F.col("l_linenumber").alias("label"))
    areas = pixels.groupBy("page", "label").agg(F.count("*").alias("area"))
    return r.dominant_label(pixels, areas, 10)


def input_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pos"), F.concat_ws("/", "p_brand", "p_size").alias("path"))
    return r.first_of_each(p, ["path"]).select("pos", "path")


def translation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("style", F.when(F.col("pos") % 3 == 0, "sfx").otherwise("dialogue"))
    return b.select("page", "pos", g.budget(F.col("style"), g.width(g.box()), g.height(g.box())).alias("b")).select("page", "pos", F.col("b.max_words").alias("max_words"), F.col("b.max_chars").alias("max_chars"))


def surface_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    gray, sat = F.col("l_partkey") % 256, F.col("l_suppkey") % 128
    return p.groupBy((F.col("l_orderkey") % 500).alias("page")).agg(
        F.median(gray).alias("gray_median"), F.round(F.percentile(gray, 0.55), 6).alias("gray_p55"), F.round(F.avg(((gray >= 198) & (sat <= 60)).cast("int")), 9).alias("paper"), F.count("*").alias("n")
    )


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    units = c.select(F.col("conv_id").alias("page"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"), (F.col("turn") % 5 != 1).alias("renderable"), (F.length("text") % 3 != 0).alias("drawn"))
    return r.coverage(units)


def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.merged_regions(boxes(spark, sf_dir), PAGE_WIDTH, PAGE_HEIGHT)


def merged_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.merged_phrases(boxes(spark, sf_dir), PAGE_WIDTH, PAGE_HEIGHT)


def median_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.median_rows(boxes(spark, sf_dir))


def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_regions(paged(spark, sf_dir), PAGE_WIDTH, PAGE_HEIGHT)


def separated_balloons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.separated(paged(spark, sf_dir), PAGE_WIDTH, PAGE_HEIGHT)


def regrouped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.regrouped_closure(paged(spark, sf_dir), 3 * GAP, PAGE_WIDTH, PAGE_HEIGHT)


def phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.joined_rows(paged(spark, sf_dir), 600, 600)


def surface_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = paged(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    return splitting.joined_surfaces(b.withColumn("pos", number).withColumn("label", F.col("pos") % 3))


def render_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as units, of which some share a parent: the box at a third of their position."""
    b = boxes(spark, sf_dir)
    units = b.withColumns({"parent": F.floor((F.col("pos") + 2) / 3), "style": F.when(F.col("pos") % 2 == 0, "sfx").otherwise("dialogue")})
    return r.render_contexts(units, b, PAGE_WIDTH, PAGE_HEIGHT).select("page", "pos", "c_x1", "c_y1", "c_x2", "c_y2")


def local_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as units of which three share a parent: the page's hull, or the page where its key is even."""
    b = boxes(spark, sf_dir)
    units = b.withColumns({"parent": F.floor((F.col("pos") + 2) / 3), "style": F.lit("sfx")})
    even = F.col("page") % 2 == 0
    ends = [F.when(even, F.lit(page)).otherwise(f(c)).alias(c) for c, f, page in (("x1", F.min, 0), ("y1", F.min, 0), ("x2", F.max, PAGE_WIDTH), ("y2", F.max, PAGE_HEIGHT))]
    return contexts.local_contexts(units, units.groupBy("page", "parent").agg(*ends).withColumnRenamed("parent", "pos"), PAGE_WIDTH, PAGE_HEIGHT)


def fitted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # A box grows with its text: as much space for each word as one of 40 to 190 by 60 to 260 has for nine.
    stretch = F.greatest(F.lit(1.0), F.sqrt(F.size(F.split("text", "\\s+")) / 9))
    w, h = (((least + F.col("conv_id") % more) * stretch).cast("int") for least, more in ((60, 200), (40, 150)))
    units = c.select(F.col("conv_id").alias("page"), F.col("turn").alias("idx"), "text", F.when(F.col("turn") % 2 == 0, "dialogue").otherwise("sfx").alias("style"), w.alias("w"), h.alias("h"))
    return lettering.fit(units).select("page", "idx", "size", F.size("lines").alias("n_lines"), "skip_reason")


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a crop of dark red art and one block of marks, of sizes that go with the part's key."""
    # Crops are dealt to tasks before they have pixels, as a small table is one split; a stated number is not put together again.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name").repartition(tasks, "p_partkey")
    units = part.selectExpr(*(f"cast({CROP[name]} as int) as {name}" for name in ("w", "h")), *(f"{CROP[name]} as {name}" for name in ("page", "style", "text")), "p_partkey", "p_size")
    units = units.selectExpr("*", *(f"cast({INK[name]} as int) as {name}" for name in INK))
    line = "concat(repeat(char(0), x), repeat(char(1), iw), repeat(char(0), w - x - iw))"
    pixels, mask = "repeat(concat(char(0), char(0), 'x'), w * h)", f"concat(repeat(char(0), w * y), repeat({line}, ih), repeat(char(0), w * (h - y - ih)))"
    return units.selectExpr("page", "0L as idx", "style", "text", "w as width", "h as height", f"cast({pixels} as binary) as pixels", f"cast({mask} as binary) as mask")


def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounds.text_boxes(crops(spark, sf_dir)).select("page", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), "stands", F.length("mask").alias("n_mask"))


QUERIES = {f.__name__: f for f in (region_viability, reading_order_page, reading_order_local, box_near_pairs, iou_pairs, containment_pairs, box_closure, centroid_clusters, row_islands_fixed_gap, column_histogram_valleys, dominant_label, input_dedupe, translation_budget, surface_stats, page_coverage, merged_regions, merged_phrases, median_rows, split_regions, separated_balloons, regrouped_boxes, phrase_rows, surface_phrases, render_contexts, fitted_text, text_boxes, local_contexts)}


def sound_sql(a: str, size: str, most: str, share: float, least: int, part: float) -> tuple[str, str]:
    """Ends of a sound's box along one axis."""
    grow, least_size = f"greatest(5, floor({size} * {share}::double))", f"greatest({least}, floor({most} * {part}::double))"
    low, high = f"greatest(0, {a} - {grow})", f"least({most}, {a} + {size} + {grow})"
    middle, half = f"floor(({low} + {high}) / 2.0)", f"floor({least_size} / 2.0)"
    small = f"{high} - {low} < {least_size}"
    return f"case when {small} then greatest(0, {middle} - {half}) else {low} end", f"case when {small} then least({most}, {middle} + {half}) else {high} end"


def near_sql(a: str, size: str, most: str, share: float, also: str, tall: float, other: float, least: int) -> tuple[str, str]:
    """Ends of a box close to marks along one axis."""
    grow = f"greatest(8, floor({size} * {share}::double), floor(least(w, h) * 0.03::double), {also})"
    low, high = f"greatest(0, {a} - {grow})", f"least({most}, {a} + {size} + {grow})"
    longest = f"greatest({least}, floor({size} * case when ih > iw * 1.2::double then {tall}::double else {other}::double end))"
    return tuple(f"case when {high} - {low} <= {longest} then {end} else round_even(({low} + {high} {sign} {longest}) / 2.0, 0) end" for end, sign in ((low, "-"), (high, "+")))


def text_boxes_sql() -> str:
    names = ("x1", "x2", "y1", "y2")
    sound = *sound_sql("x", "iw", "w", 0.45, 28, 0.28), *sound_sql("y", "ih", "h", 0.60, 22, 0.24)
    across, down = "case when ih > iw * 1.35::double then least(58, floor(ih * 0.14::double)) else 0 end", "case when iw > ih * 1.8::double then least(52, floor(iw * 0.12::double)) else 0 end"
    near = *near_sql("x", "iw", "w", 0.38, across, 1.42, 1.70, 48), *near_sql("y", "ih", "h", 0.36, down, 1.38, 1.62, 42)
    columns = (f"{s} as s_{n}, {e} as n_{n}" for n, s, e in zip(names, sound, near, strict=True))
    filled = "iw * ih > floor(w * h * 0.75::double) or n_x2 - n_x1 < 18 or n_y2 - n_y1 < 18"
    whole = dict(zip(names, ("0", "w", "0", "h"), strict=True))
    ends = (f"cast(case when style = 'sfx' then s_{n} when {filled} then {whole[n]} else n_{n} end as bigint) as {n}" for n in names)
    return f"""with c as (select p_partkey, p_size, {', '.join(f'{CROP[n]} as {n}' for n in CROP)} from part), i as (select *, {', '.join(f'{INK[n]} as {n}' for n in INK)} from c),
  b as (select *, {', '.join(columns)} from i), e as (select *, {', '.join(ends)} from b),
  d as (select *, x2 - x1 as bw, y2 - y1 as bh from e)
  select page, x1, y1, x2, y2, case when style = 'sfx' then 'sound' when regexp_matches(text, '[A-Za-z0-9]') and bw >= 24 and bh >= 20 and bw * bh >= 700 and iw * ih >= greatest(24, floor(bw * bh * 0.004::double))
    and bw <= greatest(120, least(280, floor(iw * 5.0::double))) and bh <= greatest(140, floor(ih * 2.8::double)) then 'art' else 'none' end as stands, cast(null as integer) as n_mask from d"""


def context_sql(a: str, b: str, low: str, far: str, page: int, other: str, values: tuple, long: str) -> tuple[str, str]:
    """Ends of a unit's context along one axis, from its ends, its parent's, what siblings leave and its rules."""
    share, tight, least, most, small = values
    # Bounds are those of the page, sizes those of the parent.
    high = f"least({page}, {far})"
    size = f"({b} - {a})"
    usual = f"greatest(14, floor({size} * {share}::double), floor(({far} - {low}) * 0.04::double))"
    held = f"case when large then least({usual}, greatest(18, floor({size} * {tight}::double), {least})) else {usual} end"
    grow = f"greatest({held}, {long})"
    grow = f"case when large then least({grow}, {most}) else {grow} end"
    x, y = f"greatest({low}, least({a}, greatest({a} - ({grow}), {other}_low, {low})))", f"least({high}, greatest({b}, least({b} + ({grow}), {other}_high, {high})))"
    need = f"least({far} - {low}, greatest({size} + 8, {small}))"
    first = f"greatest({low}, round_even(({a} + {b}) / 2.0, 0) - floor({need} / 2.0))"
    last = f"least({high}, {first} + {need})"
    short = f"{y} - {x} < {need}"
    return f"cast(case when {short} then greatest({low}, {last} - {need}) else {x} end as bigint)", f"cast(case when {short} then {last} else {y} end as bigint)"


def local_contexts_sql() -> str:
    limits = []
    for axis, cross in (("x", "y"), ("y", "x")):
        beside = f"least(u.{cross}2, s.{cross}2) - greatest(u.{cross}1, s.{cross}1) >= greatest(8, floor(least(u.{cross}2 - u.{cross}1, s.{cross}2 - s.{cross}1) * 0.18::double))"
        middle, between = f"round_even((u.{axis}1 + u.{axis}2 + s.{axis}1 + s.{axis}2) / 4.0, 0)", f"greatest(4, floor(least(u.{axis}2 - u.{axis}1, s.{axis}2 - s.{axis}1) * 0.04::double))"
        own, its = f"u.{axis}1 + u.{axis}2", f"s.{axis}1 + s.{axis}2"
        limits += [f"max({middle} + {between}) filter (where {beside} and {its} < {own}) as {axis}_low", f"min({middle} - {between}) filter (where {beside} and {its} > {own}) as {axis}_high"]
    x = context_sql("x1", "x2", "p1", "p3", PAGE_WIDTH, "x", contexts.GROWTH[0], "case when y2 - y1 > (x2 - x1) * 1.45::double then least(90, floor((y2 - y1) * 0.20::double)) else 0 end")
    y = context_sql("y1", "y2", "p2", "p4", PAGE_HEIGHT, "y", contexts.GROWTH[1], "case when x2 - x1 > (y2 - y1) * 1.8::double then least(70, floor((x2 - x1) * 0.16::double)) else 0 end")
    return f"""{WITH}, u as (select *, (pos + 2) // 3 as parent from boxes),
  p as (select page, parent, case when page % 2 = 0 then 0 else min(x1) end as p1, case when page % 2 = 0 then 0 else min(y1) end as p2,
    case when page % 2 = 0 then {PAGE_WIDTH} else max(x2) end as p3, case when page % 2 = 0 then {PAGE_HEIGHT} else max(y2) end as p4 from u group by page, parent),
  l as (select u.page, u.pos, u.parent, any_value(u.x1) as x1, any_value(u.y1) as y1, any_value(u.x2) as x2, any_value(u.y2) as y2, {', '.join(limits)}
    from u join u s on s.page = u.page and s.parent = u.parent and s.pos <> u.pos group by u.page, u.pos, u.parent),
  j as (select *, (p3 - p1) * (p4 - p2) >= {contexts.LARGE} as large from l join p using (page, parent))
  select page, pos, {x[0]} as c_x1, {y[0]} as c_y1, {x[1]} as c_x2, {y[1]} as c_y2 from j"""


def order_sql(columns: int) -> str:
    return f"""{WITH} select page, pos, row_number() over (partition by page order by {columns - 1} - cast(floor((x1 + (x2 - x1) // 2) / ({PAGE_WIDTH} / {columns}.0)) as int),
  y1 + (y2 - y1) // 2, pos) as place from boxes"""


ORACLES = {
    "text_boxes": text_boxes_sql(),
    "local_contexts": local_contexts_sql(),
    "region_viability": f"{WITH} select page, pos, (x2 - x1) * (y2 - y1) as area, ((y2 - y1) > (x2 - x1) * 2 or ((y2 - y1) > (x2 - x1) * 1.5 and x2 - x1 < 200)) as vertical from boxes where x2 - x1 >= 40 and y2 - y1 >= 40",
    "reading_order_page": order_sql(3),
    "reading_order_local": order_sql(2),
    "box_near_pairs": f"{WITH} select a.page, a.pos as a, b.pos as b from boxes a join boxes b on a.page = b.page and a.pos < b.pos and {NEAR}",
    "iou_pairs": f"""{WITH}, p as (select a.page, a.pos as a, b.pos as b, {SHARED} as s, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab,
  (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) as hull,
  ((b.x1 + (b.x2 - b.x1) // 2 >= a.x1 and b.x1 + (b.x2 - b.x1) // 2 < a.x2 and b.y1 + (b.y2 - b.y1) // 2 >= a.y1 and b.y1 + (b.y2 - b.y1) // 2 < a.y2)
   or (a.x1 + (a.x2 - a.x1) // 2 >= b.x1 and a.x1 + (a.x2 - a.x1) // 2 < b.x2 and a.y1 + (a.y2 - a.y1) // 2 >= b.y1 and a.y1 + (a.y2 - a.y1) // 2 < b.y2)) as inside
  from boxes a join boxes b on a.page = b.page and a.pos < b.pos and {SHARED} > 0),
  q as (select *, s / cast(aa + ab - s as double) as iou, s / cast(least(aa, ab) as double) as share from p)
  select page, a, b, round(iou, 9) as iou, round(share, 9) as share,
  (not hull > (case when iou >= 0.35 or share >= 0.65 then {int(AREA * 0.72)} else {int(AREA * 0.38)} end)) and (iou > 0.2 or (inside and (iou >= 0.12 or share >= 0.55))) as merges from q""",
    "containment_pairs": f"""{WITH} select a.page, a.pos as inside, b.pos as holder from boxes a join boxes b on a.page = b.page and a.pos <> b.pos
  and b.x1 <= a.x1 + (a.x2 - a.x1) // 2 and a.x1 + (a.x2 - a.x1) // 2 < b.x2 and b.y1 <= a.y1 + (a.y2 - a.y1) // 2 and a.y1 + (a.y2 - a.y1) // 2 < b.y2""",
    "box_closure": f"""with recursive boxes as ({BOXES}), c as (select 0 as k, page, pos, x1, y1, x2, y2 from boxes
  union all select a.k + 1, a.page, a.pos, min(b.x1), min(b.y1), max(b.x2), max(b.y2) from c a join c b on a.page = b.page and {NEAR} where a.k < 40 group by a.k, a.page, a.pos)
  select distinct page, x1, y1, x2, y2 from c where k = 40""",
    "centroid_clusters": f"""with recursive boxes as ({BOXES}), e as (select a.page, a.pos as a, b.pos as b from boxes a join boxes b on a.page = b.page and
  ((a.x1 + a.x2) - (b.x1 + b.x2)) * ((a.x1 + a.x2) - (b.x1 + b.x2)) + ((a.y1 + a.y2) - (b.y1 + b.y2)) * ((a.y1 + a.y2) - (b.y1 + b.y2)) < {4 * DISTANCE * DISTANCE}),
  reach as (select page, pos as a, pos as b from boxes union select reach.page, reach.a, e.b from reach join e on reach.page = e.page and reach.b = e.a)
  select page, a as pos, min(b) as root from reach group by page, a""",
    "row_islands_fixed_gap": f"""{WITH}, o as (select page, pos, y1 + (y2 - y1) // 2 as cy from boxes), f as (select page, pos, cy, case when cy - lag(cy) over (partition by page order by cy, pos) > {ROW} then 1 else 0 end as fresh from o)
  select page, pos, cast(sum(fresh) over (partition by page order by cy, pos) as bigint) as island from f""",
    "column_histogram_valleys": f"""{WITH}, h as (select page, least(15, (x1 + (x2 - x1) // 2) * 16 // {PAGE_WIDTH}) as bin, count(*) as n from boxes group by all),
  e as (select p.page, g.bin, coalesce(h.n, 0) as n from (select distinct page from boxes) p cross join (select unnest(range(16)) as bin) g left join h on h.page = p.page and h.bin = g.bin),
  s as (select *, coalesce(lag(n) over (partition by page order by bin), 0) + 2 * n + coalesce(lead(n) over (partition by page order by bin), 0) as smooth from e)
  select page, bin, n, smooth, coalesce(smooth < lag(smooth) over (partition by page order by bin) and smooth < lead(smooth) over (partition by page order by bin), false) as valley from s""",
    "dominant_label": """with p as (select l_suppkey % 50 as page, l_partkey % 20 as region, l_linenumber as label from lineitem),
  a as (select page, label from p group by all having count(*) >= 10), c as (select page, region, label, count(*) as n from p where label > 0 group by all),
  k as (select c.*, row_number() over (partition by c.page, region order by n desc, c.label desc) as r from c join a on a.page = c.page and a.label = c.label)
  select page, region, label from k where r = 1""",
    "input_dedupe": "select min(p_partkey) as pos, concat_ws('/', p_brand, p_size) as path from part group by 2",
    "translation_budget": f"""{WITH}, b as (select page, pos, pos % 3 = 0 as sfx, cast(x2 - x1 as double) as w, cast(y2 - y1 as double) as h from boxes)
  select page, pos, cast(case when sfx then 3 when w < 60 then 5 when w < 80 then 7 when w < 100 then 8 when h / w >= 1.75 then (case when w < 120 or w * h < 24000 then 8 else 10 end)
  when h / w >= 1.35 then (case when w * h < 26000 then 9 else 12 end) when w * h < 18000 then 10 when w * h < 32000 then 12 else 14 end as int) as max_words,
  cast(case when sfx then (case when w >= 160 or h >= 220 then least(18, (case when w * h < 12000 then 12 else 16 end) + 2) else (case when w * h < 12000 then 12 else 16 end) end)
  when w < 60 then 22 when w < 80 then 28 when w < 100 then 34 when h / w >= 1.75 then (case when w < 120 then 32 else 44 end)
  when h / w >= 1.35 then (case when w * h < 26000 then 38 else 50 end) when w * h < 18000 then 44 when w * h < 32000 then 52 else 60 end as int) as max_chars from b""",
    "surface_stats": """select l_orderkey % 500 as page, median(l_partkey % 256) as gray_median, round(quantile_cont(l_partkey % 256, 0.55), 6) as gray_p55,
  round(avg(case when l_partkey % 256 >= 198 and l_suppkey % 128 <= 60 then 1 else 0 end), 9) as paper, count(*) as n from lineitem group by 1""",
    "median_rows": f"""with recursive boxes as ({BOXES}), o as (select page, row_number() over (partition by page order by pos) - 1 as pos, (y1 + y2) / 2.0 as cy, cast(y2 - y1 as double) as h from boxes),
  s as (select *, row_number() over (partition by page order by cy, pos) as k from o),
  r as (select page, pos, k, 0 as island, [cy] as ys, [h] as hs from s where k = 1
    union all select page, pos, k, case when near then island else island + 1 end, case when near then list_append(ys, cy) else [cy] end, case when near then list_append(hs, h) else [h] end from (
      select s.page, s.pos, s.k, r.island, r.ys, r.hs, s.cy, s.h, abs(s.cy - list_aggregate(r.ys, 'median')) <= greatest(50, least(135, floor(list_aggregate(list_append(r.hs, s.h), 'median') * 0.75))) as near
      from r join s on s.page = r.page and s.k = r.k + 1))
  select page, pos, cast(island as bigint) as row from r""",
    "render_contexts": f"""{WITH}, u as (select *, (pos + 2) // 3 as parent, count(*) over (partition by page, (pos + 2) // 3) = 1 and pos % 2 = 1 as alone from boxes),
  j as (select u.page, u.pos, u.x1, u.y1, u.x2, u.y2, p.x1 as a, p.y1 as b, p.x2 as c, p.y2 as d, p.x2 - p.x1 as w, p.y2 - p.y1 as h from u left join boxes p on u.alone and p.page = u.page and p.pos = u.parent),
  k as (select *, least(140, greatest(28, floor(w * 1.15), floor(h * 0.32))) as px, least(110, greatest(20, floor(h * 0.34), floor(w * 0.22))) as py from j),
  m as (select *, case when w >= 280 then least(px, greatest(24, floor(w * 0.18))) else px end as qx from k),
  n as (select *, cast(case when w * h >= 70000 then least(qx, 72) else qx end as bigint) as x, cast(case when w * h >= 70000 then least(py, 64) else py end as bigint) as y from m)
  select page, pos, case when a is null then x1 else greatest(0, a - x) end as c_x1, case when a is null then y1 else greatest(0, b - y) end as c_y1,
  case when a is null then x2 else least({PAGE_WIDTH}, c + x) end as c_x2, case when a is null then y2 else least({PAGE_HEIGHT}, d + y) end as c_y2 from n""",
    "page_coverage": """with u as (select conv_id as page, case when turn % 4 = 3 then '' else text end as text, turn % 5 <> 1 as renderable, length(text) % 3 <> 0 as drawn from conversations),
  f as (select *, length(trim(text)) > 0 as filled from u)
  select page, count(*) as detected, count(*) filter (where filled) as ocr, count(*) filter (where filled and renderable and drawn) as rendered, count(*) filter (where not filled) as ocr_empty,
  count(*) filter (where filled and renderable and not drawn) as render_failed, count(*) filter (where filled and not renderable) as filtered from f group by page""",
}
