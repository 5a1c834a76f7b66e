"""The word table: cleaning, geometry, layout ids, confidences, engine totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import geometry as G
from folioforge.functions import text as T
from folioforge.session import table

SP = "\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def words(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The words, each delivery once, partitioned by their readings: what is grouped by reading, or by reading and line, needs
    no further exchange.  A reading's words are bounded by what is printed on a page."""
    df = table(spark, sf_dir, "words")
    df = (df.select(*dict.fromkeys(["word_id", "reading_id", *columns])) if columns and all(isinstance(c, str) for c in columns) else df).repartition("reading_id").dropDuplicates(["reading_id", "word_id"])
    return df.select(*columns) if columns else df


def readings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The readings, each delivery once."""
    df = table(spark, sf_dir, "readings")
    return (df.select(*dict.fromkeys(["reading_id", *columns])) if columns else df).dropDuplicates(["reading_id"])


def clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a real box, trimmed, those with white space inside in parts that keep box and ids."""
    w = words(spark, sf_dir, "word_id", "text", "bbox").where("bbox.w > 0 and bbox.h > 0")
    return w.select(F.col("word_id"), F.posexplode(T.words_of(F.col("text"))).alias("part", "token")).withColumn("part", F.col("part").cast("long"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and area of each word's box, clamped to the page."""
    w = words(spark, sf_dir, "word_id", "bbox")
    b = w.withColumn("b", G.from_corners(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.x") + F.col("bbox.w"), F.col("bbox.y") + F.col("bbox.h")))
    r = lambda c: F.round(c, 6)
    return b.select("word_id", r("b.x").alias("x0"), r("b.y").alias("y0"), r(F.col("b.x") + F.col("b.w")).alias("x1"), r(F.col("b.y") + F.col("b.h")).alias("y1"), r(F.col("b.w") * F.col("b.h")).alias("area"), r(1 - (F.col("b.y") + F.col("b.h"))).alias("flipped_y"))


def same_line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reading, how many words stand on the same line as the word before them."""
    w = words(spark, sf_dir, "reading_id", "word_seq", "bbox")
    before = F.lag("bbox").over(Window.partitionBy("reading_id").orderBy("word_seq"))
    w = w.withColumn("same", before.isNotNull() & G.same_line(before, F.col("bbox")))
    return w.groupBy("reading_id").agg(F.count("*").alias("n_words"), F.count_if("same").alias("n_same_line"))


def layout_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block and paragraph of a reading a page-unique number by first appearance."""
    w = words(spark, sf_dir, "reading_id", "word_seq", "block", "par").where("block is not null and par is not null")
    keys = w.groupBy("reading_id", "block", "par").agg(F.min("word_seq").alias("first"))
    number = F.row_number().over(Window.partitionBy("reading_id").orderBy("first", "block", "par")) - 1
    return keys.select("reading_id", F.col("block").cast("long").alias("block"), F.col("par").cast("long").alias("par"), number.cast("long").alias("layout_id"))


def _mean_confidence() -> Column:
    """Mean of the reported confidences, summed in ten-thousandths so that the order of rows doesn't matter; 0 for none."""
    return F.coalesce(F.sum(F.round(F.col("confidence") * 10000).cast("long")).cast("double") / F.count("confidence") / 10000, F.lit(0.0))


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of each reading's words, 0 where there is none."""
    w = words(spark, sf_dir, "reading_id", "confidence")
    return w.groupBy("reading_id").agg(F.count("*").alias("n_words"), _mean_confidence().alias("avg_confidence"))


def engine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word-weighted confidence of each engine; null confidence where an engine reports none."""
    w = words(spark, sf_dir, "engine_name", "confidence").groupBy("engine_name").agg(F.count("*").alias("total_words"), F.avg("confidence").alias("c"))
    e = table(spark, sf_dir, "engines")
    out = e.join(w, "engine_name", "left")
    return out.select("engine_name", F.coalesce("total_words", F.lit(0)).alias("total_words"), F.when(F.col("reports_confidence"), F.round(F.coalesce("c", F.lit(0.0)), 4)).alias("avg_confidence"))


def page_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line the paragraph of most of its words: null counts as a value, ties go to the one first seen last."""
    w = words(spark, sf_dir, "reading_id", "line", "par", "word_seq").where("line is not null")
    n = w.groupBy("reading_id", "line", "par").agg(F.count("*").alias("n"), F.min("word_seq").alias("first"))
    # A struct keeps a null paragraph from being passed over.
    top = n.groupBy("reading_id", "line").agg(F.max_by(F.struct("par"), F.struct("n", "first")).alias("m"))
    return top.select("reading_id", F.col("line").cast("long").alias("line"), F.col("m.par").cast("long").alias("par"))


def engine_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine's run over a document came to: success if a page was read, pages read, the pages skipped or failed
    (from 1, in order, with commas between), and, where every page failed, the first error in page order."""
    r = readings(spark, sf_dir, "page_id", "engine_name", "skipped", "error", "elapsed_seconds")
    p = table(spark, sf_dir, "page_images", "page_id", "input_pdf", "page_num")
    bad = F.col("skipped") | F.col("error").isNotNull()
    g = r.join(p, "page_id").groupBy("input_pdf", "engine_name").agg(
        F.bool_or(~bad).alias("success"), F.count_if(~bad).alias("pages_processed"), F.array_sort(F.collect_set(F.when(bad, F.col("page_num") + 1))).alias("pages"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("page_num", "reading_id"))).alias("first"), F.round(F.sum("elapsed_seconds"), 3).alias("elapsed_seconds"),
    )
    # A document's pages are bounded by what one file of scans holds.
    error = F.when(~F.col("success"), F.coalesce("first", F.lit("no page succeeded")))
    return g.select("input_pdf", "engine_name", "success", "pages_processed", F.array_join("pages", ",").alias("pages_skipped"), error.alias("error"), "elapsed_seconds")


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of pages that were read: neither skipped nor failed."""
    return readings(spark, sf_dir, "page_id", "engine_name", "skipped", "error").where("not skipped and error is null").select("reading_id", "page_id", "engine_name")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct engines of each document in order of first appearance."""
    w = table(spark, sf_dir, "words", "input_pdf", "engine_name", "word_id")
    f = w.groupBy("input_pdf", "engine_name").agg(F.min("word_id").alias("first"))
    return f.groupBy("input_pdf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "engine_name"))), lambda s: s["engine_name"]), "+").alias("engines"))


W = "(SELECT DISTINCT * FROM words)"
R = "(SELECT DISTINCT * FROM readings)"
_CL = "least(1.0, greatest(0.0, {}))"

QUERIES = {
    "word_clean": (clean_words, f"""
        WITH t AS (SELECT word_id, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) AS s FROM {W} WHERE bbox.w > 0 AND bbox.h > 0),
        u AS (SELECT word_id, unnest(string_split(s, ' ')) AS token, unnest(range(len(string_split(s, ' ')))) AS part FROM t WHERE s <> '')
        SELECT word_id, part::BIGINT AS part, token FROM u"""),
    "word_geometry": (geometry, f"""
        WITH c AS (SELECT word_id, {_CL.format('bbox.x')} AS x0, {_CL.format('bbox.y')} AS y0, {_CL.format('bbox.x + bbox.w')} AS x1, {_CL.format('bbox.y + bbox.h')} AS y1 FROM {W}),
        b AS (SELECT word_id, least(x0, x1) AS x, least(y0, y1) AS y, greatest(x0, x1) - least(x0, x1) AS w, greatest(y0, y1) - least(y0, y1) AS h FROM c)
        SELECT word_id, round(x, 6) AS x0, round(y, 6) AS y0, round(x + w, 6) AS x1, round(y + h, 6) AS y1, round(w * h, 6) AS area, round(1 - (y + h), 6) AS flipped_y FROM b"""),
    "same_line_steps": (same_line_steps, f"""
        WITH l AS (SELECT reading_id, bbox AS b, lag(bbox) OVER (PARTITION BY reading_id ORDER BY word_seq) AS a FROM {W})
        SELECT reading_id, count(*) AS n_words, count(*) FILTER (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0.5 * least(a.h, b.h) AND a IS NOT NULL) AS n_same_line FROM l GROUP BY 1"""),
    "layout_ids": (layout_ids, f"""
        WITH k AS (SELECT reading_id, block, par, min(word_seq) AS f FROM {W} WHERE block IS NOT NULL AND par IS NOT NULL GROUP BY 1, 2, 3)
        SELECT reading_id, block::BIGINT AS block, par::BIGINT AS par, (row_number() OVER (PARTITION BY reading_id ORDER BY f, block, par) - 1)::BIGINT AS layout_id FROM k"""),
    "page_confidence": (page_confidence, f"SELECT reading_id, count(*) AS n_words, coalesce(sum(round(confidence * 10000)::BIGINT)::DOUBLE / count(confidence) / 10000, 0.0) AS avg_confidence FROM {W} GROUP BY 1"),
    "engine_totals": (engine_totals, f"""
        SELECT e.engine_name, coalesce(n, 0)::BIGINT AS total_words, CASE WHEN reports_confidence THEN round(coalesce(c, 0.0), 4) END AS avg_confidence
        FROM engines e LEFT JOIN (SELECT engine_name, count(*) AS n, avg(confidence) AS c FROM {W} GROUP BY 1) w ON e.engine_name = w.engine_name"""),
    "line_majority": (page_majority, f"""
        WITH n AS (SELECT reading_id, line, par, count(*) AS n, min(word_seq) AS f FROM {W} WHERE line IS NOT NULL GROUP BY 1, 2, 3),
        k AS (SELECT *, row_number() OVER (PARTITION BY reading_id, line ORDER BY n DESC, f DESC) AS i FROM n)
        SELECT reading_id, line::BIGINT AS line, par::BIGINT AS par FROM k WHERE i = 1"""),
    "engine_rollup": (engine_rollup, f"""
        WITH j AS (SELECT r.*, p.input_pdf, p.page_num, (r.skipped OR r.error IS NOT NULL) AS bad FROM {R} r JOIN page_images p ON r.page_id = p.page_id)
        SELECT input_pdf, engine_name, bool_or(NOT bad) AS success, count(*) FILTER (NOT bad) AS pages_processed,
          coalesce(string_agg(DISTINCT CASE WHEN bad THEN page_num + 1 END, ',' ORDER BY CASE WHEN bad THEN page_num + 1 END), '') AS pages_skipped,
          CASE WHEN NOT bool_or(NOT bad) THEN coalesce(first(error ORDER BY page_num, reading_id) FILTER (error IS NOT NULL), 'no page succeeded') END AS error, round(sum(elapsed_seconds), 3) AS elapsed_seconds FROM j GROUP BY 1, 2"""),
    "usable_pages": (usable, f"SELECT reading_id, page_id, engine_name FROM {R} WHERE NOT skipped AND error IS NULL"),
    "first_seen_engines": (first_seen, "WITH f AS (SELECT input_pdf, engine_name, min(word_id) AS f FROM words GROUP BY 1, 2) SELECT input_pdf, string_agg(engine_name, '+' ORDER BY f, engine_name) AS engines FROM f GROUP BY 1"),
}
