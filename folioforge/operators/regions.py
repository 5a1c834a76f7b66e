"""Blocks of a page: boxes, overlaps, layout problems, merging of corrected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import geometry as G
from folioforge.functions import text as T
from folioforge.operators.words import SP, R, readings
from folioforge.session import table

TILE_COLUMNS, TILE_ROWS, TILE_MARGIN = 2, 4, 48


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_images", "page_id", "width_px", "height_px")


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of regions as fractions of their page, from left, top, width and height in pixels."""
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "box_px").where("size(box_px) = 4").join(_pages(spark, sf_dir), "page_id")
    b = [F.element_at("box_px", i) for i in (1, 2, 3, 4)]
    box = G.from_pixels(b[0], b[1], b[0] + b[2], b[1] + b[3], F.col("width_px"), F.col("height_px"))
    return r.withColumn("b", box).select("region_id", *[F.round(F.col("b")[c], 6).alias(c) for c in "xywh"])


def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region the others of its reading and page that it overlaps by over a tenth of the smaller one.

    The pairs are those of one page: bounded by what is printed on it.
    """
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "box_px").where("size(box_px) = 4")
    r = r.select("region_id", "page_id", *[F.element_at("box_px", i + 1).cast("double").alias(c) for i, c in enumerate(("l", "t", "w", "h"))])
    a, b = r.alias("a"), r.alias("b")
    inter = G.overlap(F.col("a.l"), F.col("a.l") + F.col("a.w"), F.col("b.l"), F.col("b.l") + F.col("b.w")) * G.overlap(F.col("a.t"), F.col("a.t") + F.col("a.h"), F.col("b.t"), F.col("b.t") + F.col("b.h"))
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.region_id") != F.col("b.region_id")))
    pairs = pairs.where(inter > 0.1 * F.least(F.col("a.w") * F.col("a.h"), F.col("b.w") * F.col("b.h")))
    hits = pairs.groupBy(F.col("a.region_id").alias("region_id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("b.region_id"))), ",").alias("overlaps"))
    return table(spark, sf_dir, "page_regions", "region_id").join(hits, "region_id", "left").select("region_id", F.coalesce("overlaps", F.lit("")).alias("overlaps"))


def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reading, whether its blocks, noise left out, hold at least nine tenths of its text."""
    g = table(spark, sf_dir, "page_regions", "reading_id", "region_role", "paragraphs").where("reading_id is not null and coalesce(region_role, 'text') <> 'noise'")
    g = g.groupBy("reading_id").agg(F.sum(F.length(F.array_join("paragraphs", ""))).alias("kept"))
    r = readings(spark, sf_dir, "full_text").select("reading_id", F.length("full_text").cast("long").alias("chars"))
    return r.join(g, "reading_id", "left").select("reading_id", "chars", F.coalesce("kept", F.lit(0)).alias("kept")).withColumn("complete", F.col("kept") >= 0.9 * F.col("chars"))


def merge_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(page_id, ord, id, role, paragraphs, indents, style, box_px, is_new): pages with corrected blocks put in.

    ``blocks``: page_id, ord, id, paragraphs, indents, style; ``answers``: page_id, pos, id, role, paragraphs, box_px.  The
    last answer for a block replaces its text and role; the block keeps its style, and its indents where it keeps its
    number of paragraphs.  A block without an answer is dropped if the page's answers, noise aside, hold nine tenths of its
    characters or more, as it was merged into another then; else it stays, as text.  Answers for numbers that the page
    doesn't have follow in their order, if they have a box of four numbers.  Noise and blocks without text are dropped.
    """
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
    had = blocks.groupBy("page_id").agg(F.sum(chars(F.coalesce("paragraphs", F.array().cast("array<string>")))).alias("had"))
    noise = F.coalesce("role", F.lit("")) == "noise"
    now = answers.where(~noise).groupBy("page_id").agg(F.sum(chars(F.coalesce("paragraphs", F.array().cast("array<string>")))).alias("now"))
    complete = had.join(now, "page_id", "left").select("page_id", (F.coalesce("now", F.lit(0)) >= 0.9 * F.col("had")).alias("complete"))
    last = answers.groupBy("page_id", "id").agg(F.max_by(F.struct("role", "paragraphs"), "pos").alias("a"))
    old = blocks.join(last, ["page_id", "id"], "left").join(complete, "page_id").where(F.col("a").isNotNull() | ~F.col("complete"))
    paragraphs = F.when(F.col("a").isNotNull(), F.col("a.paragraphs")).otherwise(F.col("paragraphs"))
    same = F.size(paragraphs) == F.size("indents")
    old = old.select(
        "page_id", F.struct(F.lit(0).alias("part"), F.col("ord").alias("n")).alias("ord"), "id", F.coalesce("a.role", F.lit("text")).alias("role"), paragraphs.alias("paragraphs"),
        F.when(same, F.col("indents")).alias("indents"), "style", F.lit(None).cast("array<int>").alias("box_px"), F.lit(False).alias("is_new"),
    )
    new = answers.join(blocks.select("page_id", "id"), ["page_id", "id"], "left_anti").where("size(box_px) = 4").select(
        "page_id", F.struct(F.lit(1).alias("part"), F.col("pos").alias("n")).alias("ord"), "id", F.coalesce("role", F.lit("text")).alias("role"), "paragraphs",
        F.lit(None).cast("array<string>").alias("indents"), F.lit(None).cast("string").alias("style"), "box_px", F.lit(True).alias("is_new"),
    )
    both = old.unionByName(new).where(F.col("role") != "noise").where(F.exists("paragraphs", lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "id")).cast("long"))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the pages with their numbers as text and their size in points: an eighth of the box's width a line."""
    return table(spark, sf_dir, "page_regions", "region_id", "page_id", "reading_id", "region_role", "box_px", "paragraphs", "indents").where("paragraphs is not null")


def region_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of what the tables have: blocks that a reading names are answered with their text squeezed and their role;
    notes come again as new blocks, footnotes as new ones without a place."""
    r = _sheets(spark, sf_dir)
    squeezed = F.transform("paragraphs", lambda p: T.squeeze(F.coalesce(p, F.lit(""))))
    known = r.where("reading_id is not null").select("page_id", F.col("region_id").alias("pos"), F.concat(F.lit("r"), "region_id").alias("id"), F.col("region_role").alias("role"), squeezed.alias("paragraphs"), F.lit(None).cast("array<int>").alias("box_px"))
    box = F.when(F.col("region_role") == "note", F.col("box_px"))
    extra = r.where("region_role in ('note', 'footnote')").select("page_id", (F.col("region_id") + 1_000_000_000).alias("pos"), F.concat(F.lit("n"), "region_id").alias("id"), F.col("region_role").alias("role"), F.slice("paragraphs", 1, 1).alias("paragraphs"), box.alias("box_px"))
    return known.unionAll(extra)


def corrected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with such answers put in: number, role, digest of the text, how many indents are kept, whether it is new."""
    r = _sheets(spark, sf_dir).select("page_id", F.col("region_id").alias("ord"), F.concat(F.lit("r"), "region_id").alias("id"), "paragraphs", "indents", F.lit("").alias("style"))
    m = merge_answers(r, region_answers(spark, sf_dir))
    text = F.array_join(F.transform("paragraphs", lambda p: F.coalesce(p, F.lit(""))), "\n")
    return m.select("page_id", "ord", "id", "role", F.sha2(text, 256).alias("digest"), F.coalesce(F.size("indents"), F.lit(-1)).cast("long").alias("n_indents"), "is_new").withColumn("n_indents", F.when(F.col("n_indents") < 0, None).otherwise(F.col("n_indents")))


def attempts(cached: DataFrame, *tries: DataFrame) -> DataFrame:
    """(page_id, how, paragraphs...): for each page the first answer that holds: cached, then each try in its order.

    Each frame has page_id, how, is_error, regions (an array); an answer holds if it isn't an error and has regions.
    """
    every = cached.withColumn("try", F.lit(0))
    for n, t in enumerate(tries, 1):
        every = every.unionByName(t.withColumn("try", F.lit(n)))
    good = every.where(~F.coalesce("is_error", F.lit(False)) & (F.size("regions") > 0))
    return good.groupBy("page_id").agg(F.min_by(F.struct("how", "regions"), "try").alias("a")).select("page_id", "a.how", "a.regions")


def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, page_id, font_size): the size of each block's text in points, from its height and its lines.

    The tables have no sizes: a block's height in points over its paragraphs, in lines of 1.2 em, at least 4.
    """
    p = table(spark, sf_dir, "page_images", "page_id", "dpi")
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "box_px", "paragraphs").where("size(box_px) = 4").join(p, "page_id")
    size = F.element_at("box_px", 4) * 72.0 / F.col("dpi") / (1.2 * F.greatest(F.size("paragraphs"), F.lit(1)))
    return r.select("region_id", "page_id", F.round(F.greatest(F.lit(4.0), size), 2).alias("font_size"))


def note_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the size of small print: that at the first quarter of its blocks' sorted sizes, 10 where it has none."""
    g = region_sizes(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list("font_size")).alias("s"))
    size = F.element_at("s", F.floor(F.size("s") / 4).cast("int") + 1)
    return _pages(spark, sf_dir).select("page_id").join(g, "page_id", "left").select("page_id", F.coalesce(F.when(F.size("s") > 0, size), F.lit(10.0)).alias("note_size"))


# What a glyph takes in em: its advance, above and below its baseline.
GLYPH, ASCENT, DESCENT = 0.55, 0.75, 0.2


def glyph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, page_id, x, y, size, glyphs): a run for each paragraph of a block as it would be drawn without wrapping,
    from its left edge, in lines of 1.2 em.  A renderer's own runs go into ``extents`` in their place."""
    p = table(spark, sf_dir, "page_images", "page_id", "dpi")
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "box_px", "paragraphs").where("size(box_px) = 4").join(region_sizes(spark, sf_dir).select("region_id", "font_size"), "region_id").join(p, "page_id")
    each = r.select("region_id", "page_id", "box_px", "dpi", "font_size", F.posexplode("paragraphs").alias("k", "p")).where("trim(coalesce(p, '')) <> ''")
    pt = lambda i: F.element_at("box_px", i) * 72.0 / F.col("dpi")
    return each.select("region_id", "page_id", pt(1).alias("x"), (pt(2) + F.col("font_size") * (ASCENT + 1.2 * F.col("k"))).alias("y"), F.col("font_size").alias("size"), F.length("p").alias("glyphs"))


def extents(runs: DataFrame) -> DataFrame:
    """(region_id, x0, y0, x1, y1): what the glyphs of each block cover; ``y`` of a run is its baseline from the top."""
    g = runs.groupBy("region_id").agg(
        F.min("x").alias("x0"), F.min(F.col("y") - ASCENT * F.col("size")).alias("y0"), F.max(F.col("x") + GLYPH * F.col("size") * F.greatest("glyphs", F.lit(1))).alias("x1"), F.max(F.col("y") + DESCENT * F.col("size")).alias("y1")
    )
    return g


def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per block where its text lands, in points, and what is wrong: text beside its box by over half an em (unless it may not
    wrap), text off the page by over a point, other blocks that it covers by over a tenth of the smaller one."""
    p = table(spark, sf_dir, "page_images", "page_id", "width_px", "height_px", "dpi").select("page_id", "dpi", (F.col("width_px") * 72.0 / F.col("dpi")).alias("pw"), (F.col("height_px") * 72.0 / F.col("dpi")).alias("ph"))
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "box_px", "paragraphs").where("size(box_px) = 4").join(region_sizes(spark, sf_dir).select("region_id", "font_size"), "region_id").join(p, "page_id")
    e = r.join(extents(glyph_runs(spark, sf_dir)), "region_id", "left")
    left, width = F.element_at("box_px", 1) * 72.0 / F.col("dpi"), F.element_at("box_px", 3) * 72.0 / F.col("dpi")
    half = 0.5 * F.greatest(F.col("font_size"), F.lit(1.0))
    outside = (F.size("paragraphs") != 1) & ((F.col("x0") < left - half) | (F.col("x1") > left + width + half))
    off = (F.col("x0") < -1) | (F.col("y0") < -1) | (F.col("x1") > F.col("pw") + 1) | (F.col("y1") > F.col("ph") + 1)
    e = e.select("region_id", "page_id", "x0", "y0", "x1", "y1", F.coalesce(outside, F.lit(False)).alias("outside_box"), F.coalesce(off, F.lit(False)).alias("off_page"), (F.col("x0").isNull() & (F.trim(F.array_join("paragraphs", "")) != "")).alias("not_drawn"))
    a, b = e.alias("a"), e.select("region_id", "page_id", "x0", "y0", "x1", "y1").alias("b")
    inter = G.overlap(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1")) * G.overlap(F.col("a.y0"), F.col("a.y1"), F.col("b.y0"), F.col("b.y1"))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    # Pairs of blocks of one page: bounded by what is printed on it.
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.region_id") != F.col("b.region_id"))).where(inter > 0.1 * F.least(area("a"), area("b")))
    hits = pairs.groupBy(F.col("a.region_id").alias("region_id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("b.region_id"))), ",").alias("overlaps"))
    rd = lambda c: F.round(c, 3).alias(c)
    return e.join(hits, "region_id", "left").select("region_id", "page_id", rd("x0"), rd("y0"), rd("x1"), rd("y1"), "outside_box", "off_page", "not_drawn", F.coalesce("overlaps", F.lit("")).alias("overlaps"))


def layout_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its blocks with text outside their box, off the page, over other blocks, and with text that isn't drawn."""
    return layout_report(spark, sf_dir).groupBy("page_id").agg(
        F.count("*").alias("regions"), F.count_if("outside_box").alias("outside_box"), F.count_if("off_page").alias("off_page"), F.count_if(F.col("overlaps") != "").alias("overlapping"), F.count_if("not_drawn").alias("not_drawn")
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping tiles of each page."""
    p = _pages(spark, sf_dir).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(TILE_ROWS - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(TILE_COLUMNS - 1))))
    edge = lambda k, n, size: F.floor(k * size / n)
    low = lambda k, n, size: F.greatest(F.lit(0), edge(k, n, size) - TILE_MARGIN)
    high = lambda k, n, size: F.least(size.cast("long"), edge(k + 1, n, size) + TILE_MARGIN)
    w, h, r, c = (F.col(x) for x in ("width_px", "height_px", "r", "c"))
    return p.select("page_id", (r * TILE_COLUMNS + c).cast("long").alias("tile"), low(c, TILE_COLUMNS, w).alias("x0"), low(r, TILE_ROWS, h).alias("y0"), high(c, TILE_COLUMNS, w).alias("x1"), high(r, TILE_ROWS, h).alias("y1"))


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, blocks): each page's blocks as a prompt states them: JSON of number, box in pixels (rounded from percents of
    three decimals) and paragraphs, in order of their numbers."""
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "box_px", "paragraphs").where("size(box_px) = 4").join(_pages(spark, sf_dir), "page_id")
    b = [F.element_at("box_px", i) for i in (1, 2, 3, 4)]
    edge = lambda v, size: F.round(v * 100.0 / F.col(size), 3)
    x0, y0, x1, y1 = edge(b[0], "width_px"), edge(b[1], "height_px"), edge(b[0] + b[2], "width_px"), edge(b[1] + b[3], "height_px")
    px = lambda v, size: F.bround(v / 100 * F.col(size), 0).cast("int")
    box = F.array(px(x0, "width_px"), px(y0, "height_px"), px(x1 - x0, "width_px"), px(y1 - y0, "height_px"))
    one = F.struct("region_id", F.struct(F.concat(F.lit("r"), "region_id").alias("id"), box.alias("box_px"), F.transform("paragraphs", lambda p: F.coalesce(p, F.lit(""))).alias("paragraphs")).alias("b"))
    g = r.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return g.select("page_id", F.to_json(F.transform("l", lambda x: x["b"])).alias("blocks"))


def prompt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of such prompts, read back from them."""
    p = prompt_blocks(spark, sf_dir).select("page_id", F.explode(F.from_json("blocks", "array<struct<id: string, box_px: array<int>, paragraphs: array<string>>>")).alias("b"))
    return p.select("page_id", "b.id", F.array_join("b.box_px", " ").alias("box_px"), F.size("b.paragraphs").cast("long").alias("n_paragraphs"))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes in points and millimetres, from the pixels where a size is missing, and the names of page files."""
    p = table(spark, sf_dir, "page_images")
    w, h = F.coalesce("width_pt", F.col("width_px") * 72.0 / F.col("dpi")), F.coalesce("height_pt", F.col("height_px") * 72.0 / F.col("dpi"))
    mm = lambda c: F.round(c * 25.4 / 72.0, 2)
    return p.select("page_id", F.format_string("page_%03d.html", F.col("page_num") + 1).alias("file"), F.round(w, 3).alias("width_pt"), F.round(h, 3).alias("height_pt"), mm(w).alias("width_mm"), mm(h).alias("height_mm"))


def region_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of each page's blocks in order of their numbers: role, box in percent, paragraphs with their indents."""
    r = table(spark, sf_dir, "page_regions", "region_id", "page_id", "region_role", "paragraphs", "indents", "box_px").where("size(box_px) = 4").join(_pages(spark, sf_dir), "page_id")
    pct = lambda i, size: F.element_at("box_px", i) * 100.0 / F.col(size)
    zipped = F.arrays_zip(F.col("paragraphs").alias("p"), F.coalesce("indents", F.array().cast("array<string>")).alias("i"))
    ps = F.array_join(F.transform(zipped, lambda z: F.concat(F.when(F.coalesce(z["i"], F.lit("")) != "", F.concat(F.lit('<p style="'), z["i"], F.lit(';">'))).otherwise(F.lit("<p>")), T.escape(F.coalesce(z["p"], F.lit(""))), F.lit("</p>"))), "")
    style = F.format_string("left: %.4f%%; top: %.4f%%; width: %.4f%%; font-size: 10.00pt;%s", pct(1, "width_px"), pct(2, "height_px"), pct(3, "width_px"), F.when(F.size("paragraphs") == 1, " white-space: nowrap;").otherwise(""))
    role = F.when(F.col("region_role").isNotNull(), F.concat(F.lit(' data-role="'), F.col("region_role"), F.lit('"'))).otherwise("")
    div = F.concat(F.lit('<div class="region"'), role, F.lit(' style="'), style, F.lit('">'), ps, F.lit("</div>"))
    g = r.withColumn("d", div).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "d"))).alias("ds"))
    return g.select("page_id", F.array_join(F.col("ds.d"), "\n").alias("html"))


def parse_regions(pages: DataFrame) -> DataFrame:
    """Blocks read from markup (page_id, html): role (text unless stated), box in percent, size, whether lines may wrap,
    paragraphs, and the first 80 characters of the text.  Numbers that can't be read are 0."""
    r = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?s)<div class="region"[^>]*>.*?</div>'), 0)).alias("pos", "d"))
    tag = F.regexp_extract("d", '(?s)^<div class="region"([^>]*)>', 1)
    style = F.regexp_extract(tag, ' style="([^"]*)"', 1)
    number = lambda key, unit: F.coalesce(F.regexp_extract(style, f"(?:^|; ?){key}: ([-0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    role = F.regexp_extract(tag, ' data-role="([^"]*)"', 1)
    paragraphs = F.transform(F.regexp_extract_all("d", F.lit("(?s)<p[^>]*>(.*?)</p>"), 1), lambda p: T.unescape(p))
    return r.select("page_id", F.col("pos").cast("long").alias("pos"), F.when(role == "", "text").otherwise(role).alias("role"), number("left", "%").alias("left"), number("top", "%").alias("top"), number("width", "%").alias("width"), number("font-size", "pt").alias("font_size"), style.contains("nowrap").alias("nowrap"), paragraphs.alias("paragraphs"), F.substring(T.strip_tags(F.regexp_replace("d", "(?s)^<div[^>]*>", "")), 1, 80).alias("text"))


def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every page written as markup and read back."""
    p = parse_regions(region_markup(spark, sf_dir))
    return p.select("page_id", "pos", "role", F.round("left", 4).alias("left"), F.round("top", 4).alias("top"), "nowrap", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("digest"))


_BOX = "WITH b AS (SELECT region_id, {cl[0]} AS x0, {cl[1]} AS y0, {cl[2]} AS x1, {cl[3]} AS y1 FROM page_regions r JOIN page_images p ON r.page_id = p.page_id WHERE len(box_px) = 4)".format(
    cl=[f"least(1.0, greatest(0.0, {e}))" for e in ("box_px[1]::DOUBLE / width_px", "box_px[2]::DOUBLE / height_px", "(box_px[1] + box_px[3])::DOUBLE / width_px", "(box_px[2] + box_px[4])::DOUBLE / height_px")]
)
_OV = """o AS (SELECT a.region_id, string_agg(b.region_id::VARCHAR, ',' ORDER BY b.region_id) AS overlaps FROM page_regions a JOIN page_regions b ON a.page_id = b.page_id AND a.region_id <> b.region_id
      WHERE len(a.box_px) = 4 AND len(b.box_px) = 4 AND greatest(0.0, least(a.box_px[1] + a.box_px[3], b.box_px[1] + b.box_px[3]) - greatest(a.box_px[1], b.box_px[1]))::DOUBLE * greatest(0.0, least(a.box_px[2] + a.box_px[4], b.box_px[2] + b.box_px[4]) - greatest(a.box_px[2], b.box_px[2]))::DOUBLE
        > 0.1 * least(a.box_px[3]::DOUBLE * a.box_px[4], b.box_px[3]::DOUBLE * b.box_px[4]) GROUP BY 1)"""

_SIZES = "sz AS (SELECT r.region_id, r.page_id, round(greatest(4.0, box_px[4] * 72.0::DOUBLE / dpi / (1.2::DOUBLE * greatest(len(paragraphs), 1))), 2) AS font_size FROM page_regions r JOIN page_images p ON r.page_id = p.page_id WHERE len(box_px) = 4)"
_LAYOUT = f"""{_SIZES},
    rg AS (SELECT r.*, dpi, sz.font_size, width_px * 72.0::DOUBLE / dpi AS pw, height_px * 72.0::DOUBLE / dpi AS ph FROM page_regions r JOIN sz ON sz.region_id = r.region_id JOIN page_images p ON r.page_id = p.page_id),
    ps AS (SELECT region_id, box_px, dpi, font_size, unnest(paragraphs) AS p, unnest(range(len(paragraphs))) AS k FROM rg),
    ex AS (SELECT region_id, min(box_px[1] * 72.0::DOUBLE / dpi) AS x0, min(box_px[2] * 72.0::DOUBLE / dpi + font_size * ({ASCENT}::DOUBLE + 1.2::DOUBLE * k) - {ASCENT}::DOUBLE * font_size) AS y0,
      max(box_px[1] * 72.0::DOUBLE / dpi + {GLYPH}::DOUBLE * font_size * len(p)) AS x1, max(box_px[2] * 72.0::DOUBLE / dpi + font_size * ({ASCENT}::DOUBLE + 1.2::DOUBLE * k) + {DESCENT}::DOUBLE * font_size) AS y1 FROM ps WHERE trim(coalesce(p, '')) <> '' GROUP BY 1),
    fl AS (SELECT rg.region_id, rg.page_id, x0, y0, x1, y1, coalesce(len(paragraphs) <> 1 AND (x0 < box_px[1] * 72.0::DOUBLE / dpi - 0.5::DOUBLE * greatest(font_size, 1.0) OR x1 > box_px[1] * 72.0::DOUBLE / dpi + box_px[3] * 72.0::DOUBLE / dpi + 0.5::DOUBLE * greatest(font_size, 1.0)), false) AS outside_box,
      coalesce(x0 < -1 OR y0 < -1 OR x1 > pw + 1 OR y1 > ph + 1, false) AS off_page, x0 IS NULL AND trim(array_to_string(paragraphs, '')) <> '' AS not_drawn FROM rg LEFT JOIN ex ON ex.region_id = rg.region_id),
    ho AS (SELECT a.region_id, string_agg(b.region_id::VARCHAR, ',' ORDER BY b.region_id) AS o FROM fl a JOIN fl b ON a.page_id = b.page_id AND a.region_id <> b.region_id
      WHERE greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.1 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY 1),
    rep AS (SELECT fl.*, coalesce(ho.o, '') AS overlaps FROM fl LEFT JOIN ho ON ho.region_id = fl.region_id)"""

QUERIES = {
    "region_boxes": (region_boxes, _BOX + " SELECT region_id, round(least(x0, x1), 6) AS x, round(least(y0, y1), 6) AS y, round(greatest(x0, x1) - least(x0, x1), 6) AS w, round(greatest(y0, y1) - least(y0, y1), 6) AS h FROM b"),
    "region_scan": (region_scan, """
        SELECT r.page_id, (row_number() OVER (PARTITION BY r.page_id ORDER BY region_id) - 1)::BIGINT AS pos, coalesce(nullif(region_role, ''), 'text') AS role, round(printf('%.4f', box_px[1] * 100.0::DOUBLE / width_px)::DOUBLE, 4) AS left,
          round(printf('%.4f', box_px[2] * 100.0::DOUBLE / height_px)::DOUBLE, 4) AS top, len(paragraphs) = 1 AS nowrap, len(paragraphs)::BIGINT AS n_paragraphs, sha256(array_to_string(list_transform(paragraphs, lambda p: coalesce(p, '')), chr(10))) AS digest
        FROM page_regions r JOIN page_images p ON r.page_id = p.page_id WHERE len(box_px) = 4"""),
    "region_overlaps": (region_overlaps, f"WITH {_OV} SELECT r.region_id, coalesce(o.overlaps, '') AS overlaps FROM page_regions r LEFT JOIN o ON r.region_id = o.region_id"),
    "layout_report": (layout_report, f"WITH {_LAYOUT} SELECT region_id, page_id, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1, outside_box, off_page, not_drawn, rep.overlaps AS overlaps FROM rep"),
    "layout_problems": (layout_problems, f"WITH {_LAYOUT} SELECT page_id, count(*) AS regions, count(*) FILTER (outside_box) AS outside_box, count(*) FILTER (off_page) AS off_page, count(*) FILTER (rep.overlaps <> '') AS overlapping, count(*) FILTER (not_drawn) AS not_drawn FROM rep GROUP BY 1"),
    "corrected_pages": (corrected_pages, f"""
        WITH r AS (SELECT * FROM page_regions WHERE paragraphs IS NOT NULL),
        an AS (SELECT page_id, region_id AS pos, 'r' || region_id AS id, region_role AS role, list_transform(paragraphs, lambda p: trim(regexp_replace(coalesce(p, ''), '[{SP}]+', ' ', 'g'))) AS ps, NULL::INT[] AS box FROM r WHERE reading_id IS NOT NULL
          UNION ALL SELECT page_id, region_id + 1000000000, 'n' || region_id, region_role, paragraphs[1:1], CASE WHEN region_role = 'note' THEN box_px END FROM r WHERE region_role IN ('note', 'footnote')),
        had AS (SELECT page_id, sum(list_sum(list_transform(paragraphs, lambda p: coalesce(len(p), 0)))) AS had FROM r GROUP BY 1), now AS (SELECT page_id, sum(list_sum(list_transform(ps, lambda p: coalesce(len(p), 0)))) AS now FROM an WHERE coalesce(role, '') <> 'noise' GROUP BY 1),
        cm AS (SELECT had.page_id, coalesce(now, 0) >= 0.9 * coalesce(had, 0) AS complete FROM had LEFT JOIN now ON now.page_id = had.page_id),
        la AS (SELECT page_id, id, arg_max(struct_pack(role := role, ps := ps), pos) AS a FROM an GROUP BY 1, 2),
        old AS (SELECT r.page_id, 0 AS part, region_id AS n, 'r' || region_id AS id, coalesce(a.role, 'text') AS role, CASE WHEN a IS NOT NULL THEN a.ps ELSE paragraphs END AS ps, CASE WHEN len(CASE WHEN a IS NOT NULL THEN a.ps ELSE paragraphs END) = len(indents) THEN len(indents) END AS n_indents, false AS is_new
          FROM r LEFT JOIN la ON la.page_id = r.page_id AND la.id = 'r' || r.region_id JOIN cm ON cm.page_id = r.page_id WHERE a IS NOT NULL OR NOT complete),
        nw AS (SELECT page_id, 1 AS part, pos AS n, id, coalesce(role, 'text') AS role, ps, NULL AS n_indents, true AS is_new FROM an WHERE len(box) = 4 AND id NOT IN (SELECT 'r' || region_id FROM r)),
        b AS (SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM nw) WHERE role <> 'noise' AND len(list_filter(ps, lambda p: trim(coalesce(p, '')) <> '')) > 0)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part, n, id)::BIGINT AS ord, id, role, sha256(array_to_string(list_transform(ps, lambda p: coalesce(p, '')), chr(10))) AS digest, n_indents::BIGINT AS n_indents, is_new FROM b"""),
    "answer_coverage": (answer_coverage, f"""
        WITH g AS (SELECT reading_id, sum(len(array_to_string(paragraphs, '')))::BIGINT AS kept FROM page_regions WHERE reading_id IS NOT NULL AND coalesce(region_role, 'text') <> 'noise' GROUP BY 1)
        SELECT r.reading_id, len(full_text)::BIGINT AS chars, coalesce(kept, 0)::BIGINT AS kept, coalesce(kept, 0) >= 0.9 * len(full_text) AS complete FROM {R} r LEFT JOIN g ON r.reading_id = g.reading_id"""),
    "note_size": (note_size, f"""
        WITH {_SIZES}, g AS (SELECT page_id, list_sort(list(font_size)) AS s FROM sz GROUP BY 1)
        SELECT p.page_id, coalesce(s[(len(s) // 4) + 1], 10.0::DOUBLE) AS note_size FROM page_images p LEFT JOIN g ON p.page_id = g.page_id"""),
    "page_tiles": (tiles, f"""
        SELECT page_id, (r * {TILE_COLUMNS} + c)::BIGINT AS tile, greatest(0, floor(c * width_px / {TILE_COLUMNS}.0)::BIGINT - {TILE_MARGIN}) AS x0, greatest(0, floor(r * height_px / {TILE_ROWS}.0)::BIGINT - {TILE_MARGIN}) AS y0,
          least(width_px::BIGINT, floor((c + 1) * width_px / {TILE_COLUMNS}.0)::BIGINT + {TILE_MARGIN}) AS x1, least(height_px::BIGINT, floor((r + 1) * height_px / {TILE_ROWS}.0)::BIGINT + {TILE_MARGIN}) AS y1
        FROM page_images, range({TILE_ROWS}) t(r), range({TILE_COLUMNS}) u(c)"""),
    "prompt_boxes": (prompt_boxes, """
        WITH e AS (SELECT r.region_id, r.page_id, width_px AS w, height_px AS h, len(paragraphs) AS n, round(box_px[1] * 100.0::DOUBLE / width_px, 3) AS x0, round(box_px[2] * 100.0::DOUBLE / height_px, 3) AS y0,
          round((box_px[1] + box_px[3]) * 100.0::DOUBLE / width_px, 3) AS x1, round((box_px[2] + box_px[4]) * 100.0::DOUBLE / height_px, 3) AS y1 FROM page_regions r JOIN page_images p ON r.page_id = p.page_id WHERE len(box_px) = 4)
        SELECT page_id, 'r' || region_id AS id, round_even(x0 / 100 * w, 0)::INT || ' ' || round_even(y0 / 100 * h, 0)::INT || ' ' || round_even((x1 - x0) / 100 * w, 0)::INT || ' ' || round_even((y1 - y0) / 100 * h, 0)::INT AS box_px, n::BIGINT AS n_paragraphs FROM e"""),
    "page_sizes": (page_sizes, """
        WITH s AS (SELECT page_id, page_num, CASE WHEN width_pt IS NULL THEN width_px * 72.0::DOUBLE / dpi ELSE width_pt END AS w, CASE WHEN height_pt IS NULL THEN height_px * 72.0::DOUBLE / dpi ELSE height_pt END AS h FROM page_images)
        SELECT page_id, printf('page_%03d.html', page_num + 1) AS file, round(w, 3) AS width_pt, round(h, 3) AS height_pt, round(w * 25.4::DOUBLE / 72.0, 2) AS width_mm, round(h * 25.4::DOUBLE / 72.0, 2) AS height_mm FROM s"""),
}
