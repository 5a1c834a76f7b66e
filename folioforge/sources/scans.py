"""What recognisers return, as words: parallel arrays, lines, nested pages, blocks of markup, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import geometry as G
from folioforge.functions import text as T
from folioforge.operators.words import SP, W, readings, words
from folioforge.session import table


def token_offsets(text: Column) -> Column:
    """Tokens of a text with where each begins and ends, in code points, as an array of structs."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"([{T.SPACES}]*)([^{T.SPACES}]+)"), 1).alias("gap"), F.regexp_extract_all(text, F.lit(f"([{T.SPACES}]*)([^{T.SPACES}]+)"), 2).alias("token"))
    none = F.array().cast("array<struct<token:string,a:int,b:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["token"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(x["token"].alias("token"), a.alias("a"), b.alias("b")))).alias("out"))

    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def split_line(text: Column, box: Column) -> Column:
    """The words of a recognised line as (text, bbox) structs, widths in proportion to characters; one word keeps the box."""
    span = F.greatest(F.length(F.regexp_replace(text, f"[{T.SPACES}]+$", "")), F.lit(1))
    # Told from the text, so that the tokens are worked out once.
    several = text.rlike(f"[^{T.SPACES}][{T.SPACES}]+[^{T.SPACES}]")
    whole = F.struct(*[box[c].alias(c) for c in "xywh"])
    return F.transform(token_offsets(text), lambda t: F.struct(t["token"].alias("text"), F.when(several, G.char_box(box, t["a"], t["b"], span)).otherwise(whole).alias("bbox")))


def split_block(lines: Column, box: Column) -> Column:
    """The lines of a block that aren't blank as (line, text, box) structs: equal heights, widths by their length."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    longest = F.array_max(F.transform(kept, lambda x: F.length(x)))
    h = box["h"] / F.size(kept)
    one = lambda x, i: F.struct(i.alias("line"), x.alias("text"), F.struct(box["x"].alias("x"), (box["y"] + i * h).alias("y"), (box["w"] * F.length(x) / longest).alias("w"), h.alias("h")).alias("bbox"))
    return F.transform(kept, one)


def columnar_words(rows: DataFrame) -> DataFrame:
    """Words from parallel arrays (text, conf in percent, left, top, width, height in pixels, block, par, line) of a page.

    Blank texts and negative confidences are no words; ids are page-unique by first appearance.
    """
    zipped = rows.select("page_id", "width_px", "height_px", F.posexplode(F.arrays_zip("text", "conf", "left", "top", "width", "height", "block", "par", "line")).alias("pos", "w"))
    w = zipped.where((F.trim("w.text") != "") & (F.col("w.conf") >= 0))
    box = G.from_pixels(F.col("w.left"), F.col("w.top"), F.col("w.left") + F.col("w.width"), F.col("w.top") + F.col("w.height"), F.col("width_px"), F.col("height_px"))
    return w.select("page_id", "pos", F.trim("w.text").alias("text"), box.alias("bbox"), (F.col("w.conf") / 100).alias("confidence"), F.col("w.block").alias("block"), F.col("w.par").alias("par"), F.col("w.line").alias("line"))


def line_words(rows: DataFrame) -> DataFrame:
    """Words from recognised lines (page_id, line, text, bbox, score).

    A line with ``words``, an array of (text, bbox, confidence) that the recogniser boxed itself, has those; any other line
    is split in proportion.  Null and blank lines give none.
    """
    split = F.transform(split_line(F.col("text"), F.col("bbox")), lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), F.col("score").alias("confidence")))
    if "words" in rows.columns:
        own = F.transform("words", lambda w: F.struct(w["text"].alias("text"), F.struct(*[w["bbox"][c].cast("double").alias(c) for c in "xywh"]).alias("bbox"), w["confidence"].cast("double").alias("confidence")))
        split = F.when(F.size(F.coalesce("words", F.array())) > 0, own).otherwise(split)
    return rows.select("page_id", "line", F.posexplode(split).alias("k", "w")).select("page_id", "line", "k", "w.text", "w.bbox", "w.confidence")


def polygon_words(rows: DataFrame) -> DataFrame:
    """Words from lines boxed by polygons in pixels (page_id, width_px, height_px, line, text, points, score)."""
    return line_words(rows.withColumn("bbox", G.from_points(F.col("points"), F.col("width_px"), F.col("height_px"))))


def nested_words(pages: DataFrame) -> DataFrame:
    """Words from nested blocks of lines of words: (page_id, blocks array<struct<lines array<struct<words array<struct<text, bbox, confidence>>>>>>).

    Blocks are numbered in their page, lines through all of its blocks.
    """
    b = pages.select("page_id", F.posexplode("blocks").alias("block", "b"))
    lines = b.select("page_id", "block", F.posexplode("b.lines").alias("l", "x"))
    from pyspark.sql import Window

    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy("page_id").orderBy("block", "l")) - 1)
    return numbered.select("page_id", "block", "line", F.posexplode("x.words").alias("k", "w")).select("page_id", "block", "line", "k", "w.text", "w.bbox", "w.confidence")


def markup_block_words(blocks: DataFrame) -> DataFrame:
    """Words from blocks of markup (page_id, block, html, bbox, skipped, error, score); line numbers go on through a page."""
    from pyspark.sql import Window

    good = blocks.where("not coalesce(skipped, false) and error is null and trim(coalesce(html, '')) <> ''").withColumn("lines", T.markup_lines(F.col("html")))
    before = F.coalesce(F.sum(F.size("lines")).over(Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = good.withColumn("first", before).select("page_id", "block", "first", "score", F.inline(split_block(F.col("lines"), F.col("bbox"))))
    return line_words(each.select("page_id", (F.col("first") + F.col("line")).alias("line"), "text", "bbox", "score"))


def text_layer_words(rows: DataFrame) -> DataFrame:
    """Words from a text layer (page_id, page_w, page_h, x0, y0, x1, y1, text, block, line), of confidence 1."""
    return rows.select("page_id", "text", G.from_corners(F.col("x0") / F.col("page_w"), F.col("y0") / F.col("page_h"), F.col("x1") / F.col("page_w"), F.col("y1") / F.col("page_h")).alias("bbox"), F.lit(1.0).alias("confidence"), "block", "line")


def observed_words(rows: DataFrame) -> DataFrame:
    """Words from observations measured from the bottom of the page (page_id, line, text, bbox, score).

    With ``ranges``, an array of (start, bbox) by where a token begins in UTF-16 units, each token has the box of its range;
    if the recogniser gave none for any of them, the line is split in proportion.
    """
    rows = rows.withColumn("bbox", G.flipped(F.col("bbox")))
    if "ranges" not in rows.columns:
        return line_words(rows)
    at = lambda t: G.utf16_length(F.substring(F.col("text"), F.lit(1), t["a"])).cast("int")
    hit = lambda t: F.element_at(F.filter("ranges", lambda r: r["start"] == at(t)), 1)
    words = F.transform(F.filter(token_offsets(F.col("text")), lambda t: t["token"] != ""), lambda t: F.struct(t["token"].alias("text"), F.when(F.exists("ranges", lambda r: r["start"] == at(t)), G.flipped(hit(t)["bbox"])).alias("bbox"), F.col("score").alias("confidence")))
    return line_words(rows.withColumn("words", words).withColumn("words", F.when(F.forall("words", lambda w: w["bbox"].isNotNull()), F.col("words"))))


def fragment_words(text: Column, fragments: Column, boxes: Column) -> Column:
    """Words of a line whose recogniser boxes fragments: each character takes a slice of its fragment's box.

    Null where the fragments' characters aren't those of the text, blanks aside: the line is split in proportion then.
    """
    chars = F.flatten(F.transform(F.arrays_zip(fragments.alias("f"), boxes.alias("b")), lambda p: F.filter(F.transform(F.filter(F.split(p["f"], ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), G.char_box(p["b"], i, i + 1, F.length(p["f"])).alias("b"))), lambda s: F.trim(s["c"]) != "")))
    tokens = T.words_of(text)
    starts = F.aggregate(tokens, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<t:string,a:int>>").alias("o")), lambda acc, t: F.struct((acc["at"] + F.length(t)).alias("at"), F.concat(acc["o"], F.array(F.struct(t.alias("t"), acc["at"].alias("a")))).alias("o")), lambda acc: acc["o"])

    def word(s: Column) -> Column:
        part = F.slice(chars, s["a"] + 1, F.length(s["t"]))
        x0, y0 = F.array_min(F.transform(part, lambda c: c["b"]["x"])), F.array_min(F.transform(part, lambda c: c["b"]["y"]))
        x1, y1 = F.array_max(F.transform(part, lambda c: c["b"]["x"] + c["b"]["w"])), F.array_max(F.transform(part, lambda c: c["b"]["y"] + c["b"]["h"]))
        return F.struct(s["t"].alias("text"), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).alias("bbox"))

    return F.when(F.size(chars) == F.length(F.array_join(tokens, "")), F.transform(starts, word))


# ------------------------------------------------------------------------------------------------ on the test tables


def columnar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each reading gathered into parallel arrays and scanned from them."""
    p = table(spark, sf_dir, "page_images", "page_id", "width_px", "height_px")
    w = words(spark, sf_dir, "reading_id", "page_id", "word_seq", "text", "confidence", "bbox", "block", "par", "line").join(p, "page_id")
    px = lambda c, size: F.round(c * size).cast("int")
    one = F.struct(
        "word_seq", "text", F.coalesce(F.round(F.col("confidence") * 100), F.lit(-1.0)).alias("conf"), px(F.col("bbox.x"), F.col("width_px")).alias("left"), px(F.col("bbox.y"), F.col("height_px")).alias("top"),
        px(F.col("bbox.w"), F.col("width_px")).alias("width"), px(F.col("bbox.h"), F.col("height_px")).alias("height"), "block", "par", "line",
    )
    g = w.groupBy("reading_id", "width_px", "height_px").agg(F.array_sort(F.collect_list(one)).alias("a"))
    cols = ("text", "conf", "left", "top", "width", "height", "block", "par", "line")
    out = columnar_words(g.select(F.col("reading_id").alias("page_id"), "width_px", "height_px", *[F.col("a")[c].alias(c) for c in cols]))
    return out.groupBy(F.col("page_id").alias("reading_id")).agg(F.count("*").alias("n_words"), F.round(F.sum(F.round(F.col("confidence") * 100)), 0).alias("sum_confidence"), F.sum(F.round(F.col("bbox.w") * 10000).cast("long")).alias("sum_width"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each line of the readings with boxes in proportion to their characters, in a line from 0 to 1."""
    r = readings(spark, sf_dir, "full_text").select("reading_id", F.posexplode(F.split("full_text", "\n")).alias("line", "text"))
    unit = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    w = r.select("reading_id", "line", F.posexplode(split_line(F.col("text"), unit)).alias("k", "w"))
    return w.select("reading_id", F.col("line").cast("long").alias("line"), F.col("k").cast("long").alias("k"), F.col("w.text").alias("text"), F.round("w.bbox.x", 6).alias("x"), F.round("w.bbox.w", 6).alias("w"))


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of each region spread over a block from 0 to 1."""
    unit = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    r = table(spark, sf_dir, "page_regions", "region_id", "paragraphs").select("region_id", F.inline(split_block(F.col("paragraphs"), unit)))
    return r.select("region_id", F.col("line").cast("long").alias("line"), F.round("bbox.y", 6).alias("y"), F.round("bbox.w", 6).alias("w"), F.round("bbox.h", 6).alias("h"))


def markup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents written as markup and read back as lines."""
    d = table(spark, sf_dir, "documents", "doc_id", F.concat(F.lit("<p>"), F.replace(T.escape(F.col("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")).alias("html"))
    return d.select("doc_id", F.posexplode(T.markup_lines(F.col("html"))).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents without the marks of Markdown."""
    d = table(spark, sf_dir, "documents", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return d.select("doc_id", F.col("line").cast("long").alias("line"), T.strip_markdown(F.col("s")).alias("text"))


def _word_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return words(spark, sf_dir, "reading_id", "word_id", "word_seq", "text", "bbox", "confidence", *columns).where("text is not null")


def _digest(w: DataFrame, *keys: str) -> DataFrame:
    """Of words (reading_id, ..., text, bbox, confidence) per reading their number and sums of places in ten-thousandths."""
    place = lambda c: F.sum(F.floor(F.col(f"bbox.{c}") * 10000 + 0.5)).alias(f"sum_{c}")
    return w.groupBy("reading_id").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"), *[place(c) for c in "xywh"], *[F.sum(F.col(k).cast("long")).alias(f"sum_{k}") for k in keys])


def word_results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word as a recognised line: those of an engine that reports confidences with a box of their own, others split."""
    w = _word_rows(spark, sf_dir)
    own = F.array(F.struct("text", "bbox", "confidence"))
    rows = w.select(F.col("reading_id").alias("page_id"), F.col("word_seq").alias("line"), "text", "bbox", F.col("confidence").alias("score"), F.when(F.col("confidence").isNotNull(), own).alias("words"))
    return _digest(line_words(rows).withColumnRenamed("page_id", "reading_id"), "line")


def polygon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's box given as the corners of a polygon in pixels of a page of 10,000 by 10,000, and scanned."""
    w = _word_rows(spark, sf_dir)
    px = lambda v: F.floor(v * 10000 + 0.5).cast("double")
    x0, y0, x1, y1 = px(F.col("bbox.x")), px(F.col("bbox.y")), px(F.col("bbox.x") + F.col("bbox.w")), px(F.col("bbox.y") + F.col("bbox.h"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    two = F.array(point(x1, y0), point(x0, y1))
    four = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    rows = w.select(F.col("reading_id").alias("page_id"), F.col("word_seq").alias("line"), F.lit(10000).alias("width_px"), F.lit(10000).alias("height_px"), F.col("confidence").alias("score"), "text", F.when(F.col("confidence").isNull(), two).otherwise(four).alias("points"))
    return _digest(polygon_words(rows).withColumnRenamed("page_id", "reading_id"), "line")


def observed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word as an observation from the bottom of the page, those with a confidence boxed by their range."""
    w = _word_rows(spark, sf_dir)
    up = F.struct(F.col("bbox.x").alias("x"), (1 - (F.col("bbox.y") + F.col("bbox.h"))).alias("y"), F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"))
    ranges = F.when(F.col("confidence").isNotNull(), F.array(F.struct(F.lit(0).alias("start"), up.alias("bbox"))))
    rows = w.select(F.col("reading_id").alias("page_id"), F.col("word_seq").alias("line"), "text", up.alias("bbox"), F.col("confidence").alias("score"), F.coalesce(ranges, F.array().cast("array<struct<start:int,bbox:struct<x:double,y:double,w:double,h:double>>>")).alias("ranges"))
    return _digest(observed_words(rows).withColumnRenamed("page_id", "reading_id"), "line")


def nested_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of readings with blocks and lines nested in them and scanned: blocks by number, lines counted through a page."""
    w = _word_rows(spark, sf_dir, "block", "line").where("block is not null and line is not null")
    one = F.struct("word_seq", "word_id", F.struct("text", "bbox", "confidence").alias("w"))
    lines = w.groupBy("reading_id", "block", "line").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["w"]).alias("words"))
    blocks = lines.groupBy("reading_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: F.struct(x["words"].alias("words"))).alias("lines"))
    pages = blocks.groupBy("reading_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "lines"))), lambda x: F.struct(x["lines"].alias("lines"))).alias("blocks"))
    return _digest(nested_words(pages.withColumnRenamed("reading_id", "page_id")).withColumnRenamed("page_id", "reading_id"), "block", "line", "k")


def text_layer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of readings as a text layer in points of their page and scanned from it; confidences are 1."""
    p = table(spark, sf_dir, "page_images", "page_id", "width_px", "height_px")
    w = words(spark, sf_dir, "reading_id", "page_id", "text", "bbox", "block", "line").where("text is not null").join(p, "page_id")
    x, y = F.col("bbox.x") * F.col("width_px"), F.col("bbox.y") * F.col("height_px")
    rows = w.select(F.col("reading_id").alias("page_id"), F.col("width_px").cast("double").alias("page_w"), F.col("height_px").cast("double").alias("page_h"), x.alias("x0"), y.alias("y0"), (x + F.col("bbox.w") * F.col("width_px")).alias("x1"), (y + F.col("bbox.h") * F.col("height_px")).alias("y1"), "text", "block", "line")
    return _digest(text_layer_words(rows).withColumnRenamed("page_id", "reading_id"), "confidence")


def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of each page's regions as blocks of markup and scanned: noise is skipped, lines count on through a page."""
    unit = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    html = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), T.escape(F.coalesce(p, F.lit(""))), F.lit("</p>"))), "")
    b = table(spark, sf_dir, "page_regions", "page_id", "region_id", "region_role", "paragraphs").where("paragraphs is not null")
    rows = b.select("page_id", F.col("region_id").alias("block"), html.alias("html"), unit.alias("bbox"), (F.coalesce("region_role", F.lit("")) == "noise").alias("skipped"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("score"))
    w = markup_block_words(rows)
    return w.groupBy("page_id").agg(F.count("*").alias("n_words"), F.countDistinct("line").alias("n_lines"), F.max("line").cast("long").alias("last_line"), F.sum(F.length("text")).alias("n_chars"))


def stripped_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents written as markup, and read back without tags."""
    d = table(spark, sf_dir, "documents", "doc_id", F.concat(F.lit("<div><p class='a'>"), F.replace(T.escape(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div>")).alias("html"))
    return d.select("doc_id", T.strip_tags(F.col("html")).alias("text"))


def page_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that the markup of each page states, written from its reading's label and read back."""
    from folioforge.operators.layout import html_lang

    r = readings(spark, sf_dir, "lang").select("reading_id", F.concat(F.lit('<!DOCTYPE html>\n<html dir="ltr" lang="'), F.coalesce("lang", F.lit("und")), F.lit('"><body lang="x"></body></html>')).alias("html"))
    return r.select("reading_id", html_lang(F.col("html")).alias("lang"))


_CL = lambda v, size="10000.0": f"least(1.0, greatest(0.0, {v} / {size}::DOUBLE))"
_GAP, _TOK = (f"regexp_extract_all(text, '([{SP}]*)([^{SP}]+)', {k})" for k in (1, 2))
QUERIES = {
    "columnar_scan": (columnar_round_trip, f"""
        SELECT reading_id, count(*) AS n_words, round(sum(round(confidence * 100)), 0) AS sum_confidence,
          sum(round((least(1.0, (round(bbox.x * width_px) + round(bbox.w * width_px)) / width_px) - least(1.0, round(bbox.x * width_px) / width_px)) * 10000)::BIGINT)::BIGINT AS sum_width
        FROM {W} w JOIN page_images p ON w.page_id = p.page_id WHERE confidence IS NOT NULL AND trim(text) <> '' GROUP BY 1"""),
    "split_lines": (split_lines, f"""
        WITH l AS (SELECT reading_id, unnest(string_split(full_text, chr(10))) AS text, unnest(range(len(string_split(full_text, chr(10))))) AS line FROM (SELECT DISTINCT reading_id, full_text FROM readings)),
        t AS (SELECT reading_id, line, greatest(len(regexp_replace(text, '[{SP}]+$', '')), 1) AS span, len({_TOK}) AS n, unnest({_GAP}) AS gap, unnest({_TOK}) AS token, unnest(range(len({_TOK}))) AS k FROM l),
        o AS (SELECT *, sum(len(gap) + len(token)) OVER (PARTITION BY reading_id, line ORDER BY k) AS b FROM t)
        SELECT reading_id, line::BIGINT AS line, k::BIGINT AS k, token AS text, CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE round((b - len(token)) * (1.0::DOUBLE / span), 6) END AS x, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE round(len(token) * (1.0::DOUBLE / span), 6) END AS w FROM o"""),
    "block_lines": (block_lines, """
        WITH p AS (SELECT region_id, list_filter(list_transform(paragraphs, lambda x: trim(x)), lambda x: x <> '') AS ps FROM page_regions),
        u AS (SELECT region_id, unnest(ps) AS s, unnest(range(len(ps))) AS line, len(ps) AS n, list_max(list_transform(ps, lambda x: len(x))) AS m FROM p)
        SELECT region_id, line::BIGINT AS line, round(line * (1.0::DOUBLE / n), 6) AS y, round(1.0::DOUBLE * len(s) / m, 6) AS w, round(1.0::DOUBLE / n, 6) AS h FROM u"""),
    "markup_lines": (markup_lines, f"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[{SP}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)
        SELECT doc_id, unnest(range(len(ls)))::BIGINT AS line, unnest(ls) AS text FROM l"""),
    "markdown_lines": (markdown_lines, f"""
        WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS line, unnest(string_split(text, chr(10))) AS s FROM documents)
        SELECT doc_id, line, regexp_replace(replace(replace(regexp_replace(s, '^[#>*+ \\-]+', ''), '**', ''), '__', ''), '^[{SP}]+|[{SP}]+$', '', 'g') AS text FROM l"""),
    "word_results_scan": (word_results_scan, f"""
        WITH t AS (SELECT *, confidence IS NOT NULL AS own, CASE WHEN confidence IS NULL THEN list_filter(regexp_extract_all(text, '[^{SP}]+'), lambda x: x <> '') ELSE [text] END AS ks FROM {W} WHERE text IS NOT NULL),
        u AS (SELECT t.*, unnest(ks) AS token, len(ks) AS n FROM t)
        SELECT reading_id, count(*) AS n_words, sum(len(token))::BIGINT AS n_chars, sum(floor(bbox.x * 10000 + 0.5))::BIGINT AS sum_x, sum(floor(bbox.y * 10000 + 0.5))::BIGINT AS sum_y, sum(floor(bbox.w * 10000 + 0.5))::BIGINT AS sum_w, sum(floor(bbox.h * 10000 + 0.5))::BIGINT AS sum_h, sum(word_seq)::BIGINT AS sum_line FROM u GROUP BY 1"""),
    "polygon_scan": (polygon_scan, f"""
        WITH e AS (SELECT reading_id, word_seq, text, floor(bbox.x * 10000 + 0.5) AS x0, floor(bbox.y * 10000 + 0.5) AS y0, floor((bbox.x + bbox.w) * 10000 + 0.5) AS x1, floor((bbox.y + bbox.h) * 10000 + 0.5) AS y1 FROM {W} WHERE trim(text) <> ''),
        c AS (SELECT *, {_CL('x0')} AS a, {_CL('y0')} AS b, {_CL('x1')} AS c, {_CL('y1')} AS d FROM e)
        SELECT reading_id, count(*) AS n_words, sum(len(text))::BIGINT AS n_chars, sum(floor(a * 10000 + 0.5))::BIGINT AS sum_x, sum(floor(b * 10000 + 0.5))::BIGINT AS sum_y, sum(floor((c - a) * 10000 + 0.5))::BIGINT AS sum_w, sum(floor((d - b) * 10000 + 0.5))::BIGINT AS sum_h, sum(word_seq)::BIGINT AS sum_line FROM c GROUP BY 1"""),
    "observed_scan": (observed_scan, f"""
        WITH e AS (SELECT reading_id, word_seq, text, bbox, 1 - ((1 - (bbox.y + bbox.h)) + bbox.h) AS y FROM {W} WHERE trim(text) <> '')
        SELECT reading_id, count(*) AS n_words, sum(len(text))::BIGINT AS n_chars, sum(floor(bbox.x * 10000 + 0.5))::BIGINT AS sum_x, sum(floor(y * 10000 + 0.5))::BIGINT AS sum_y, sum(floor(bbox.w * 10000 + 0.5))::BIGINT AS sum_w, sum(floor(bbox.h * 10000 + 0.5))::BIGINT AS sum_h, sum(word_seq)::BIGINT AS sum_line FROM e GROUP BY 1"""),
    "nested_scan": (nested_scan, f"""
        WITH w AS (SELECT *, dense_rank() OVER (PARTITION BY reading_id ORDER BY block) - 1 AS b, dense_rank() OVER (PARTITION BY reading_id ORDER BY block, line) - 1 AS l, row_number() OVER (PARTITION BY reading_id, block, line ORDER BY word_seq, word_id) - 1 AS k
          FROM {W} WHERE text IS NOT NULL AND block IS NOT NULL AND line IS NOT NULL)
        SELECT reading_id, count(*) AS n_words, sum(len(text))::BIGINT AS n_chars, sum(floor(bbox.x * 10000 + 0.5))::BIGINT AS sum_x, sum(floor(bbox.y * 10000 + 0.5))::BIGINT AS sum_y, sum(floor(bbox.w * 10000 + 0.5))::BIGINT AS sum_w, sum(floor(bbox.h * 10000 + 0.5))::BIGINT AS sum_h,
          sum(b)::BIGINT AS sum_block, sum(l)::BIGINT AS sum_line, sum(k)::BIGINT AS sum_k FROM w GROUP BY 1"""),
    "text_layer_scan": (text_layer_scan, f"""
        WITH e AS (SELECT w.*, {_CL('bbox.x * width_px', 'width_px')} AS a, {_CL('bbox.y * height_px', 'height_px')} AS b, {_CL('(bbox.x * width_px + bbox.w * width_px)', 'width_px')} AS c, {_CL('(bbox.y * height_px + bbox.h * height_px)', 'height_px')} AS d FROM {W} w JOIN page_images p ON w.page_id = p.page_id WHERE text IS NOT NULL)
        SELECT reading_id, count(*) AS n_words, sum(len(text))::BIGINT AS n_chars, sum(floor(a * 10000 + 0.5))::BIGINT AS sum_x, sum(floor(b * 10000 + 0.5))::BIGINT AS sum_y, sum(floor((c - a) * 10000 + 0.5))::BIGINT AS sum_w, sum(floor((d - b) * 10000 + 0.5))::BIGINT AS sum_h, count(*) AS sum_confidence FROM e GROUP BY 1"""),
    "block_scan": (block_scan, f"""
        WITH l AS (SELECT page_id, region_id, k, trim(regexp_replace(p, '[{SP}]+', ' ', 'g')) AS t FROM (SELECT page_id, region_id, unnest(list_transform(paragraphs, lambda p: coalesce(p, ''))) AS p, unnest(range(len(paragraphs))) AS k FROM page_regions WHERE coalesce(region_role, '') <> 'noise')),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY region_id, k) - 1 AS line FROM l WHERE t <> ''), w AS (SELECT page_id, line, unnest(string_split(t, ' ')) AS text FROM n)
        SELECT page_id, count(*) AS n_words, count(DISTINCT line) AS n_lines, max(line)::BIGINT AS last_line, sum(len(text))::BIGINT AS n_chars FROM w GROUP BY 1"""),
    "stripped_markup": (stripped_markup, f"SELECT doc_id, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) AS text FROM documents"),
    "page_langs": (page_langs, "SELECT DISTINCT reading_id, coalesce(lang, 'und') AS lang FROM readings"),
}
