"""Lines, word styles, paragraphs, white bands, page markup."""

from __future__ import annotations


from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.words import SP, W, words
from folioforge.session import table

CENTER_EM = 0.770 - 0.718 / 2  # the middle of capitals below the top of a line of height 1


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the greater of two; 0 for none."""
    v = F.array_sort(values)
    return F.when(F.size(v) == 0, 0.0).otherwise(F.element_at(v, (F.size(v) / 2).cast("int") + 1))


def with_lines(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """The words of the readings whose words all have a line."""
    w = words(spark, sf_dir, "word_id", "reading_id", "text", "bbox", "line", *columns)
    return w.withColumn("whole", F.bool_and(F.col("line").isNotNull()).over(Window.partitionBy("reading_id"))).where("whole").drop("whole")


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of readings by the engine's line numbers: text with words by x, top and left edge."""
    w = with_lines(spark, sf_dir)
    g = w.groupBy("reading_id", "line").agg(F.array_sort(F.collect_list(F.struct(F.col("bbox.x").alias("x"), "word_id", "text"))).alias("ws"), F.min("bbox.y").alias("top"), F.min("bbox.x").alias("left"))
    return g.select("reading_id", F.col("line").cast("long").alias("line"), F.array_join(F.col("ws.text"), " ").alias("text"), "top", "left")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each reading put together from its words: lines by top, then left edge, then number."""
    g = line_texts(spark, sf_dir).groupBy("reading_id").agg(F.array_sort(F.collect_list(F.struct("top", "left", "line", "text"))).alias("ls"))
    return g.select("reading_id", F.array_join(F.col("ls.text"), "\n").alias("text"))


def group_geometric(ys: list[float], hs: list[float], xs: list[float]) -> list[int]:
    """A line number for each box, from heights alone: boxes join one of the last three open lines that they overlap."""
    order = sorted(range(len(ys)), key=lambda i: (ys[i] + hs[i] / 2, xs[i]))
    last: list[int] = []
    number = [0] * len(ys)
    for i in order:
        for k in range(len(last) - 1, max(-1, len(last) - 4), -1):
            j = last[k]
            if min(ys[i] + hs[i], ys[j] + hs[j]) - max(ys[i], ys[j]) > 0.5 * min(hs[i], hs[j]):
                number[i], last[k] = k, i
                break
        else:
            number[i] = len(last)
            last.append(i)
    return number


def _geometric(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("word_id")
    pdf["k"] = group_geometric(pdf["y"].tolist(), pdf["h"].tolist(), pdf["x"].tolist())
    tops = pdf.groupby("k")["y"].min().sort_values(kind="stable")
    rank = {k: n for n, k in enumerate(tops.index)}
    pdf["line"] = pdf["k"].map(rank)
    pdf = pdf.sort_values(["line", "x"], kind="stable")
    out = pdf.groupby("line")["text"].agg(" ".join).reset_index()
    out.insert(0, "reading_id", pdf["reading_id"].iloc[0])
    return out


def geometric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of readings with words that lack a line, grouped by vertical overlap; one reading is one group."""
    w = words(spark, sf_dir, "word_id", "reading_id", "text", "bbox", "line")
    w = w.withColumn("whole", F.bool_and(F.col("line").isNotNull()).over(Window.partitionBy("reading_id"))).where("not whole and text is not null")
    w = w.select("reading_id", "word_id", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.h").alias("h"))
    return w.groupBy("reading_id").applyInPandas(_geometric, "reading_id long, line long, text string")


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, upper-median center and height of each line."""
    w = with_lines(spark, sf_dir)
    center = F.collect_list(F.col("bbox.y") + F.col("bbox.h") / 2)
    g = w.groupBy("reading_id", "line").agg(F.min("bbox.x").alias("x0"), F.max(F.col("bbox.x") + F.col("bbox.w")).alias("x1"), upper_median(center).alias("center"), upper_median(F.collect_list("bbox.h")).alias("size"))
    return g.withColumn("line", F.col("line").cast("long"))


def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the lines of each reading: the upper median of positive steps, else 1.2 times the first line's height."""
    s = line_stats(spark, sf_dir)
    step = F.col("center") - F.lag("center").over(Window.partitionBy("reading_id").orderBy("center", "line"))
    s = s.withColumn("step", step)
    g = s.groupBy("reading_id").agg(F.collect_list(F.when(F.col("step") > 0, F.col("step"))).alias("steps"), F.min_by("size", F.struct("center", "line")).alias("size"))
    return g.select("reading_id", F.when(F.size("steps") > 0, upper_median(F.col("steps"))).otherwise(1.2 * F.col("size")).alias("pitch"))


def white_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The white bands between the words of each reading from top to bottom."""
    w = words(spark, sf_dir, "reading_id", "word_id", F.col("bbox.y").alias("a"), (F.col("bbox.y") + F.col("bbox.h")).alias("b"))
    before = F.max("b").over(Window.partitionBy("reading_id").orderBy("a", "word_id").rowsBetween(Window.unboundedPreceding, -1))
    return w.withColumn("end", before).where("a > end").select("reading_id", F.col("end").alias("gap_from"), F.col("a").alias("gap_to"))


def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each reading from its lines: a new one where the engine's paragraph changes, the step is wide,
    an indented line follows one that isn't, or, without the engine's paragraphs, after a short line that ends a
    sentence.  Words broken at the end of a line are joined."""
    w = with_lines(spark, sf_dir, "par")
    n = w.groupBy("reading_id", "line", "par").agg(F.count("*").alias("n"), F.min("word_id").alias("first"))
    par = n.groupBy("reading_id", "line").agg(F.max_by(F.struct("par"), F.struct("n", "first")).alias("m")).select("reading_id", "line", F.col("m.par").alias("par"))
    lines = line_stats(spark, sf_dir).join(line_texts(spark, sf_dir).select("reading_id", "line", "text"), ["reading_id", "line"]).join(par, ["reading_id", "line"]).join(line_pitch(spark, sf_dir), "reading_id")
    page, order = Window.partitionBy("reading_id"), Window.partitionBy("reading_id").orderBy("center", "line")
    lines = lines.withColumns({
        "em": upper_median(F.collect_list("size").over(page)), "left": F.min("x0").over(page), "right": F.max("x1").over(page), "has_par": F.bool_and(F.col("par").isNotNull()).over(page),
        "p_center": F.lag("center").over(order), "p_x0": F.lag("x0").over(order), "p_x1": F.lag("x1").over(order), "p_par": F.lag("par").over(order), "p_text": F.lag("text").over(order), "i": F.row_number().over(order),
    })
    breaks = (
        (F.col("has_par") & (F.col("par") != F.col("p_par")))
        | (F.col("center") - F.col("p_center") > 1.6 * F.col("pitch"))
        | ((F.col("x0") - F.col("left") > 0.7 * F.col("em")) & (F.col("p_x0") - F.col("left") < 0.4 * F.col("em")))
        | (~F.col("has_par") & (F.col("p_x1") < F.col("right") - 3 * F.col("em")) & F.col("p_text").rlike("[.!?:]$"))
    )
    lines = lines.withColumn("number", F.sum(F.when(F.col("i") == 1, 1).otherwise(F.coalesce(breaks, F.lit(False)).cast("int"))).over(order))
    g = lines.groupBy("reading_id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "\n").alias("t"), F.count("*").alias("n_lines"))
    joined = F.regexp_replace(F.regexp_replace("t", r"(\p{L})[-¬]\n(\p{Ll})", "$1$2"), "\n", " ")
    return g.select("reading_id", F.col("number").cast("long").alias("paragraph"), "n_lines", joined.alias("text"))


def page_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reading_id, pw, ph): the size of each reading's page in points, from its pixels where it is missing."""
    p = table(spark, sf_dir, "page_images", "page_id", F.coalesce("width_pt", F.col("width_px") * 72.0 / F.col("dpi")).alias("pw"), F.coalesce("height_pt", F.col("height_px") * 72.0 / F.col("dpi")).alias("ph"))
    return table(spark, sf_dir, "readings", "reading_id", "page_id").dropDuplicates(["reading_id"]).join(p, "page_id").select("reading_id", "pw", "ph")


def styled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words with the size of their page, and font_size_pt, top and is_last where all words of their reading have a line.

    Words are exchanged once, by reading; all windows are within a reading.
    """
    w = words(spark, sf_dir, "reading_id", "word_id", "word_seq", "text", "bbox", "confidence", "block", "par", "line").join(page_points(spark, sf_dir), "reading_id")
    w = w.withColumn("em", T.width_em(F.col("text"))).withColumn("whole", F.bool_and(F.col("line").isNotNull()).over(Window.partitionBy("reading_id")) & F.col("text").isNotNull())
    line = Window.partitionBy("reading_id", "line", "whole")
    along = line.orderBy(F.col("bbox.x"), "word_id")
    w = w.withColumns({
        "fit": F.when(F.col("em") > 0, F.col("bbox.w") * F.col("pw") / F.col("em")), "lh": F.max("bbox.h").over(line) * F.col("ph"), "center": F.median(F.col("bbox.y") + F.col("bbox.h") / 2).over(line),
        "next": F.lead(F.col("bbox.x")).over(along),
    })
    w = w.withColumn("size", F.least(F.coalesce(F.median("fit").over(line), F.col("lh")), 1.5 * F.col("lh")))
    span = F.col("em") + F.when(F.col("next").isNull(), 0.0).otherwise(0.278)
    room = F.when(span > 0, (F.coalesce("next", F.lit(1.0)) - F.col("bbox.x")) * F.col("pw") / span).otherwise(F.col("size"))
    own = F.greatest(F.lit(1.0), F.least(F.col("size"), F.greatest(room, 0.5 * F.col("size"))))
    w = w.withColumn("own", F.when(F.col("whole"), own))
    top = F.round(F.when(F.col("whole"), F.greatest(F.lit(0.0), F.col("center") - CENTER_EM * F.col("own") / F.col("ph"))), 5)
    exact = F.when(F.col("whole"), F.greatest(F.lit(0.0), F.col("center") - CENTER_EM * F.col("own") / F.col("ph")))
    return w.select(
        "reading_id", "word_id", "word_seq", "text", "bbox", "confidence", "block", "par", "line", "pw", "ph", F.round("own", 4).alias("font_size_pt"), top.alias("top"),
        F.when(F.col("whole"), F.col("next").isNull()).alias("is_last"), F.col("own").alias("exact_size"), exact.alias("exact_top"),
    )


def word_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font size and top of each word: its line's size, from the median of sizes that span the boxes, squeezed only
    where the word would run into the next; the top centres it on its line."""
    return styled_words(spark, sf_dir).where("is_last is not null").select("word_id", "reading_id", "font_size_pt", "top", "is_last")


def fixed(value: Column, places: int) -> Column:
    """A number at so many decimals, halves up, so that no formatter rounds it in its own way."""
    return F.floor(value * 10**places + 0.5) / float(10**places)


def span_markup(word: Callable[[str], Column]) -> Column:
    """The markup of one positioned word: its place, size and confidence, the ids it has, and a blank after it where another
    follows on its line.  A word without a line has the size and top of its box, and a blank."""
    box, size = word("bbox"), F.coalesce(word("exact_size"), word("bbox")["h"] * word("ph"))
    style = F.format_string(
        "left: %.4f%%; top: %.4f%%; width: %.4f%%; height: %.4f%%; font-size: %.2fpt;", *[fixed(v * 100, 4) for v in (box["x"], F.coalesce(word("exact_top"), box["y"]), box["w"], box["h"])], fixed(size, 2)
    )
    data = [F.coalesce(F.format_string(' data-confidence="%.3f"', fixed(word("confidence"), 3)), F.lit("")) if c == "confidence" else F.when(word(c).isNotNull(), F.concat(F.lit(f' data-{c}="'), word(c), F.lit('"'))).otherwise("") for c in ("confidence", "block", "par", "line")]
    data[0] = F.when(word("confidence").isNotNull(), data[0]).otherwise("")
    return F.concat(F.lit('<span class="word" style="'), style, F.lit('"'), *data, F.lit(">"), T.escape(word("text")), F.when(F.coalesce(word("is_last"), F.lit(False)), "").otherwise(" "), F.lit("</span>"))


def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned markup of each reading's page, words in their order, with the size of the page in millimetres."""
    w = styled_words(spark, sf_dir).where("text is not null")
    one = F.struct("word_seq", "word_id", span_markup(F.col).alias("s"))
    g = w.groupBy("reading_id").agg(F.array_sort(F.collect_list(one)).alias("ws"), F.first("pw").alias("pw"), F.first("ph").alias("ph"))
    head = F.format_string('<!DOCTYPE html>\n<html lang="und"><head><meta charset="utf-8"><meta name="pdf.options.pageWidth" content="%.4f"><meta name="pdf.options.pageHeight" content="%.4f"></head><body><div class="page">\n', fixed(F.col("pw") * 25.4 / 72, 4), fixed(F.col("ph") * 25.4 / 72, 4))
    return g.select("reading_id", F.concat(head, F.array_join(F.col("ws.s"), "\n"), F.lit("\n</div></body></html>")).alias("html"))


def parse_markup(pages: DataFrame) -> DataFrame:
    """Positioned words read back from markup: (reading_id, pos, text, left, top, width, height, font_size, confidence, block,
    par, line); words without text or size are none; numbers that can't be read are 0, ids null."""
    spans = pages.select("reading_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?s)<span class="word"[^>]*>.*?</span>'), 0)).alias("pos", "s"))
    tag, text = F.regexp_extract("s", '(?s)^<span class="word"([^>]*)>', 1), T.unescape(F.regexp_extract("s", "(?s)>(.*)</span>", 1))
    style = F.regexp_extract(tag, ' style="([^"]*)"', 1)
    number = lambda key, unit: F.coalesce(F.regexp_extract(style, f"(?:^|;) *{key} *: *([-+0-9.eE]+) *{unit} *(?:;|$)", 1).try_cast("double"), F.lit(0.0))
    data = lambda key, kind: F.regexp_extract(tag, f' data-{key}="([^"]*)"', 1).try_cast(kind)
    bare = F.regexp_replace(text, f"^[{T.SPACES}]+|[{T.SPACES}]+$", "")
    words = spans.select(
        "reading_id", F.col("pos").cast("long").alias("pos"), bare.alias("text"), *[(number(k, "%") / 100).alias(k) for k in ("left", "top", "width", "height")], number("font-size", "pt").alias("font_size"),
        data("confidence", "double").alias("confidence"), *[data(k, "int").alias(k) for k in ("block", "par", "line")],
    )
    return words.where("text <> '' and font_size > 0")


def rewrite_texts(html: Column, change: Callable[[Column], Column]) -> Column:
    """Markup with the text of each word changed in place; blanks after a word, and all around the words, stay."""
    pattern = '(?s)(<span class="word"[^>]*>)(.*?)([ ]*</span>)'
    gaps = F.split(html, '(?s)<span class="word"[^>]*>.*?</span>', -1)
    parts = F.arrays_zip(gaps.alias("gap"), *[F.regexp_extract_all(html, F.lit(pattern), i).alias(n) for i, n in enumerate(("head", "text", "tail"), 1)])
    return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(F.concat(p["head"], T.escape(change(T.unescape(p["text"]))), p["tail"]), F.lit("")))), "")


def html_lang(html: Column) -> Column:
    """The language that the first html tag states, empty where it states none."""
    return F.regexp_extract(html, '<html[^>]*? lang="([^"]*)"', 1)


def transformed(pages: DataFrame, layout: str, long_s: str) -> DataFrame:
    """Pages of positioned markup (reading_id, html) as asked: kept, or with a long s in today's letters."""
    if layout not in ("positioned", "flow") or long_s not in ("keep", "s", "repair"):
        raise ValueError(f"unknown layout {layout!r} or mode {long_s!r}")
    if layout == "flow" or long_s == "repair":
        raise ValueError("flow_pages lays out and repairs from words; this works on markup alone")
    return pages if long_s == "keep" else pages.withColumn("html", rewrite_texts(F.col("html"), T.plain_s))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's markup with its vowels made capital word by word, and read back: a test of rewriting on whole tables."""
    pages = page_markup(spark, sf_dir).select("reading_id", rewrite_texts(F.col("html"), lambda t: F.translate(t, "aeiou", "AEIOU")).alias("html"))
    return parse_markup(pages).select("reading_id", "pos", "text")


def markup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words read back from the markup of every page."""
    w = parse_markup(page_markup(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return w.select("reading_id", "pos", "text", r("left"), r("width"), r("height"), F.round("font_size", 1).alias("font_size"), r("confidence"), *[F.col(c).cast("long").alias(c) for c in ("block", "par", "line")])


_WITH = f"wl AS (SELECT * FROM (SELECT *, bool_and(line IS NOT NULL) OVER (PARTITION BY reading_id) AS whole FROM {W}) WHERE whole)"
_UM = "list_sort({0})[(len({0}) // 2) + 1]"
_LT = f"{_WITH}, lt AS (SELECT reading_id, line, string_agg(text, ' ' ORDER BY bbox.x, word_id) AS text, min(bbox.y) AS top, min(bbox.x) AS left_x FROM wl GROUP BY 1, 2)"
_LS = f"""ls AS (SELECT reading_id, line, min(bbox.x) AS x0, max(bbox.x + bbox.w) AS x1, {_UM.format('list(bbox.y + bbox.h / 2)')} AS center, {_UM.format('list(bbox.h)')} AS size FROM wl GROUP BY 1, 2),
    st AS (SELECT *, center - lag(center) OVER (PARTITION BY reading_id ORDER BY center, line) AS step FROM ls),
    pi AS (SELECT reading_id, coalesce({_UM.format('list(step) FILTER (step > 0)')}, 1.2 * first(size ORDER BY center, line)) AS pitch FROM st GROUP BY 1)"""
_TABLE = ", ".join(f"('{ch.replace(chr(39), chr(39) * 2)}', {n})" for t in (T.ADVANCES, T.ACCENTED) for n, chars in t.items() for ch in chars)
_WIDE = "[\\x{1100}-\\x{115f}\\x{2e80}-\\x{303e}\\x{3041}-\\x{33ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{a000}-\\x{a4cf}\\x{ac00}-\\x{d7a3}\\x{f900}-\\x{faff}\\x{fe30}-\\x{fe6f}\\x{ff01}-\\x{ff60}\\x{ffe0}-\\x{ffe6}]"
# Composed first; marks take nothing, then the font's advances, then 1 em for wide characters and 0.6 for others.
_WIDTHS = f"""adv(ch, n) AS (VALUES {_TABLE}), dt AS (SELECT DISTINCT text FROM wl WHERE text IS NOT NULL), dc AS (SELECT text, unnest(string_split(nfc_normalize(text), '')) AS ch FROM dt WHERE text <> ''),
    em AS (SELECT text, sum(CASE WHEN regexp_matches(dc.ch, '\\p{{Mn}}') THEN 0 WHEN n IS NOT NULL THEN n WHEN regexp_matches(dc.ch, '{_WIDE}') THEN 1000 ELSE 600 END)::DOUBLE / 1000 AS em FROM dc LEFT JOIN adv ON adv.ch = dc.ch GROUP BY 1)"""

_FX = lambda v, k: f"(floor(({v}) * {10**k} + 0.5::DOUBLE) / {10**k}.0::DOUBLE)"
_STYLES = f"""{_WITH}, p AS (SELECT page_id, CASE WHEN width_pt IS NULL THEN width_px * 72.0::DOUBLE / dpi ELSE width_pt END AS pw, CASE WHEN height_pt IS NULL THEN height_px * 72.0::DOUBLE / dpi ELSE height_pt END AS ph FROM page_images), {_WIDTHS},
    a AS (SELECT w.word_id, w.reading_id, w.line, w.bbox AS b, pw, ph, coalesce(em.em, 0.0) AS em FROM wl w JOIN (SELECT DISTINCT reading_id, page_id FROM readings) r ON w.reading_id = r.reading_id JOIN p ON r.page_id = p.page_id LEFT JOIN em ON em.text = w.text WHERE w.text IS NOT NULL),
    c AS (SELECT *, max(b.h) OVER l * ph AS lh, median(b.y + b.h / 2) OVER l AS center, lead(b.x) OVER (PARTITION BY reading_id, line ORDER BY b.x, word_id) AS nx, median(CASE WHEN em > 0 THEN b.w * pw / em END) OVER l AS mf FROM a WINDOW l AS (PARTITION BY reading_id, line)),
    d AS (SELECT *, least(coalesce(mf, lh), 1.5 * lh) AS size, em + CASE WHEN nx IS NULL THEN 0.0 ELSE 0.278 END AS span FROM c),
    e AS (SELECT *, greatest(1.0, least(size, greatest(CASE WHEN span > 0 THEN (coalesce(nx, 1.0) - b.x) * pw / span ELSE size END, 0.5 * size))) AS own FROM d)"""

QUERIES = {
    "line_texts": (line_texts, f"WITH {_LT} SELECT reading_id, line::BIGINT AS line, text, top, left_x AS left FROM lt"),
    "page_texts": (page_texts, f"WITH {_LT} SELECT reading_id, string_agg(text, chr(10) ORDER BY top, left_x, line) AS text FROM lt GROUP BY 1"),
    "geometric_lines": (geometric_lines, None),
    "line_stats": (line_stats, f"WITH {_WITH}, {_LS} SELECT reading_id, line::BIGINT AS line, x0, x1, center, size FROM ls"),
    "line_pitch": (line_pitch, f"WITH {_WITH}, {_LS} SELECT * FROM pi"),
    "white_gaps": (white_gaps, f"""
        WITH i AS (SELECT reading_id, word_id, bbox.y AS a, bbox.y + bbox.h AS b FROM {W}),
        m AS (SELECT *, max(b) OVER (PARTITION BY reading_id ORDER BY a, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM i)
        SELECT reading_id, e AS gap_from, a AS gap_to FROM m WHERE a > e"""),
    "paragraphs": (paragraph_breaks, f"""
        WITH {_LT}, {_LS},
        pn AS (SELECT reading_id, line, par, row_number() OVER (PARTITION BY reading_id, line ORDER BY count(*) DESC, min(word_id) DESC) AS k FROM wl GROUP BY 1, 2, 3),
        l AS (SELECT ls.*, lt.text, pn.par, pi.pitch FROM ls JOIN lt USING (reading_id, line) JOIN pn USING (reading_id, line) JOIN pi USING (reading_id) WHERE k = 1),
        c AS (SELECT *, {_UM.format('list(size) OVER (PARTITION BY reading_id)')} AS em, min(x0) OVER p AS lft, max(x1) OVER p AS rgt, bool_and(par IS NOT NULL) OVER p AS has_par,
          lag(center) OVER o AS pc, lag(x0) OVER o AS px0, lag(x1) OVER o AS px1, lag(par) OVER o AS pp, lag(text) OVER o AS pt, row_number() OVER o AS i FROM l WINDOW p AS (PARTITION BY reading_id), o AS (PARTITION BY reading_id ORDER BY center, line)),
        b AS (SELECT *, sum(CASE WHEN i = 1 THEN 1 WHEN (has_par AND par <> pp) OR center - pc > 1.6 * pitch OR (x0 - lft > 0.7 * em AND px0 - lft < 0.4 * em) OR (NOT has_par AND px1 < rgt - 3 * em AND regexp_matches(pt, '[.!?:]$')) THEN 1 ELSE 0 END) OVER (PARTITION BY reading_id ORDER BY center, line) AS n FROM c)
        SELECT reading_id, n::BIGINT AS paragraph, count(*) AS n_lines, regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY i), '(\\pL)[-¬]\\n(\\p{{Ll}})', '\\1\\2', 'g'), '\\n', ' ', 'g') AS text FROM b GROUP BY 1, 2"""),
    "word_styles": (word_styles, f"WITH {_STYLES} SELECT word_id, reading_id, round(own, 4) AS font_size_pt, round(greatest(0.0, center - {CENTER_EM}::DOUBLE * own / ph), 5) AS top, nx IS NULL AS is_last FROM e"),
    "page_markup": (page_markup, f"""
        WITH {_STYLES}, z AS (SELECT DISTINCT r.reading_id, pw, ph FROM readings r JOIN p ON r.page_id = p.page_id),
        s AS (SELECT w.reading_id, w.word_seq, w.word_id, z.pw, z.ph, printf('<span class="word" style="left: %.4f%%; top: %.4f%%; width: %.4f%%; height: %.4f%%; font-size: %.2fpt;"', {_FX('bbox.x * 100', 4)}, {_FX('CASE WHEN e.word_id IS NULL THEN bbox.y ELSE greatest(0.0, e.center - ' + str(CENTER_EM) + '::DOUBLE * e.own / e.ph) END * 100', 4)}, {_FX('bbox.w * 100', 4)}, {_FX('bbox.h * 100', 4)}, {_FX('coalesce(e.own, bbox.h * z.ph)', 2)})
          || coalesce(printf(' data-confidence="%.3f"', {_FX('confidence', 3)}), '') || coalesce(' data-block="' || block || '"', '') || coalesce(' data-par="' || par || '"', '') || coalesce(' data-line="' || w.line || '"', '') || '>'
          || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), chr(39), '&#39;') || CASE WHEN e.word_id IS NOT NULL AND e.nx IS NULL THEN '' ELSE ' ' END || '</span>' AS s
          FROM {W} w JOIN z ON z.reading_id = w.reading_id LEFT JOIN e ON e.word_id = w.word_id WHERE text IS NOT NULL)
        SELECT reading_id, '<!DOCTYPE html>' || chr(10) || printf('<html lang="und"><head><meta charset="utf-8"><meta name="pdf.options.pageWidth" content="%.4f"><meta name="pdf.options.pageHeight" content="%.4f"></head><body><div class="page">', {_FX('any_value(pw) * 25.4::DOUBLE / 72', 4)}, {_FX('any_value(ph) * 25.4::DOUBLE / 72', 4)})
          || chr(10) || string_agg(s, chr(10) ORDER BY word_seq, word_id) || chr(10) || '</div></body></html>' AS html FROM s GROUP BY 1"""),
    "markup_rewrite": (rewritten, f"SELECT w.reading_id, (row_number() OVER (PARTITION BY w.reading_id ORDER BY word_seq, word_id) - 1)::BIGINT AS pos, regexp_replace(translate(text, 'aeiou', 'AEIOU'), '^[{SP}]+|[{SP}]+$', '', 'g') AS text FROM {W} w JOIN (SELECT DISTINCT r.reading_id FROM readings r JOIN page_images p ON r.page_id = p.page_id) z ON z.reading_id = w.reading_id WHERE text <> ''"),
    "markup_words": (markup_words, f"""
        WITH {_STYLES}, z AS (SELECT DISTINCT r.reading_id, ph FROM readings r JOIN p ON r.page_id = p.page_id)
        SELECT w.reading_id, (row_number() OVER (PARTITION BY w.reading_id ORDER BY word_seq, w.word_id) - 1)::BIGINT AS pos, regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g') AS text, round({_FX('bbox.x * 100', 4)} / 100, 6) AS left,
          round({_FX('bbox.w * 100', 4)} / 100, 6) AS width, round({_FX('bbox.h * 100', 4)} / 100, 6) AS height, round({_FX('coalesce(e.own, bbox.h * z.ph)', 2)}, 1) AS font_size,
          round({_FX('confidence', 3)}, 6) AS confidence, block::BIGINT AS block, par::BIGINT AS par, w.line::BIGINT AS line FROM {W} w JOIN z ON z.reading_id = w.reading_id LEFT JOIN e ON e.word_id = w.word_id WHERE text <> ''"""),
}
