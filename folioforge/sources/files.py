"""Files in and out: zips of page markup with a manifest, reports, summaries, transcripts, word lists."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.compare import QUERIES as _RANK
from folioforge.operators.compare import rank_engines, rank_engines_full
from folioforge.operators.layout import _FX, fixed, page_markup
from folioforge.operators.words import QUERIES as _SQL
from folioforge.operators.words import R, W, engine_totals, readings, words
from folioforge.session import table


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, content) of every entry of the zips at a path; a broken zip gives one row with entry null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(p, n, z.read(n)) for n in z.namelist()]
                except zipfile.BadZipFile:
                    rows.append((p, None, None))
            yield pd.DataFrame(rows, columns=["path", "entry", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, entry string, content binary")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The pages that the manifests of zips list, in page order; a manifest without pages gives none."""
    page = "struct<page_num: int, html: string, width_pt: double, height_pt: double, words: int>"
    m = read_zips(spark, path).where("entry = 'metadata.json'").select("path", F.from_json(F.col("content").cast("string"), f"engine string, page_count int, pages array<{page}>").alias("m"))
    return m.select("path", "m.engine", F.inline("m.pages")).orderBy("path", "page_num")


def write_zips(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """Writes one zip of page markup and manifest per document and engine under ``out``; returns what was written.

    A document's pages by one engine are one group, bounded by what one file of scans holds.
    """
    pages = page_markup(spark, sf_dir).join(readings(spark, sf_dir, "page_id", "engine_name", "elapsed_seconds"), "reading_id")
    pages = pages.join(table(spark, sf_dir, "page_images", "page_id", "input_pdf", "page_num", "width_pt", "height_pt"), "page_id")
    pages = pages.join(words(spark, sf_dir, "reading_id").groupBy("reading_id").agg(F.count("*").alias("n")), "reading_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        pdf = pdf.sort_values(["page_num", "reading_id"])
        name = f"{pdf['input_pdf'].iloc[0].removesuffix('.pdf')}_{pdf['engine_name'].iloc[0]}.zip"
        listed = [
            {"page_num": int(r.page_num), "html": f"page_{int(r.page_num) + 1:03d}.html", "width_pt": None if pd.isna(r.width_pt) else float(r.width_pt), "height_pt": float(r.height_pt), "words": int(0 if pd.isna(r.n) else r.n)}
            for r in pdf.itertuples()
        ]
        manifest = {"engine": pdf["engine_name"].iloc[0], "page_count": len(pdf), "total_words": sum(p["words"] for p in listed), "elapsed_seconds": round(float(pdf["elapsed_seconds"].sum()), 3), "pages": listed}
        os.makedirs(out, exist_ok=True)
        part = os.path.join(out, f".{name}.{os.getpid()}")
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for p, html in zip(listed, pdf["html"], strict=True):
                z.writestr(p["html"], html)
            z.writestr("metadata.json", json.dumps(manifest))
        os.replace(part, os.path.join(out, name))  # a task that runs again writes the same file again
        return pd.DataFrame([(name, len(pdf), manifest["total_words"])], columns=["file", "pages", "total_words"])

    return pages.groupBy("input_pdf", "engine_name").applyInPandas(run, "file string, pages int, total_words long")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of each document's and engine's manifest: pages, words, seconds, mean confidence where it is reported."""
    w = words(spark, sf_dir, "reading_id", "confidence").groupBy("reading_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("c"), F.count("confidence").alias("k"))
    r = readings(spark, sf_dir, "page_id", "engine_name", "elapsed_seconds").join(table(spark, sf_dir, "page_images", "page_id", "input_pdf"), "page_id").join(w, "reading_id", "left")
    e = F.broadcast(table(spark, sf_dir, "engines", "engine_name", "reports_confidence"))  # a fixed table
    g = r.groupBy("input_pdf", "engine_name").agg(F.count("*").alias("page_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.round(F.sum("elapsed_seconds"), 3).alias("elapsed_seconds"), F.sum("c").alias("c"), F.sum("k").alias("k")).join(e, "engine_name")
    mean = F.when(F.col("reports_confidence"), F.when(F.col("k") > 0, F.col("c").cast("double") / F.col("k") / 10000).otherwise(0.0))
    return g.select("input_pdf", "engine_name", "page_count", "total_words", "elapsed_seconds", mean.alias("avg_confidence"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(engine_name, run_order, success, error, total_words, avg_confidence, elapsed): each engine's run over all tables."""
    r = readings(spark, sf_dir, "page_id", "engine_name", "skipped", "error", "elapsed_seconds").join(table(spark, sf_dir, "page_images", "page_id", "input_pdf", "page_num"), "page_id")
    ok = ~F.col("skipped") & F.col("error").isNull()
    g = r.groupBy("engine_name").agg(F.bool_or(ok).alias("success"), F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("input_pdf", "page_num", "reading_id"))).alias("error"), F.round(F.sum("elapsed_seconds"), 3).alias("elapsed"))
    e = F.broadcast(table(spark, sf_dir, "engines", "engine_name", "run_order"))  # a fixed table
    g = g.select("engine_name", "success", F.when(~F.col("success"), F.coalesce("error", F.lit("no page succeeded"))).alias("error"), "elapsed")
    return g.join(e, "engine_name").join(engine_totals(spark, sf_dir), "engine_name")


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line): a run as Markdown: a table of the engines, then their ranking by consensus."""
    s = run_summary(spark, sf_dir)
    status = F.when(F.col("success"), "✅").otherwise(F.concat(F.lit("❌ "), F.substring(F.coalesce("error", F.lit("")), 1, 100)))
    number = lambda c, k: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f"%.{k}f", fixed(F.col(c), k))), F.lit("-"))
    row = F.concat(F.lit("| "), "engine_name", F.lit(" | - | "), F.col("total_words"), F.lit(" | "), number("avg_confidence", 3), F.lit(" | "), number("elapsed", 1), F.lit(" | "), status, F.lit(" |"))
    heads = [(0, 1, "| Engine | Model | Words | Avg conf | Time (s) | Status |"), (0, 2, "|--------|-------|-------|----------|----------|--------|"), (2, 0, "### Ranking (by consensus agreement)")]
    lines = spark.createDataFrame(heads, "part int, n int, line string").unionAll(s.select(F.lit(1), F.col("run_order"), row))
    rank = F.concat(F.col("rank"), F.lit(". **"), "engine_name", F.lit("**: avg CER "), F.format_string("%.4f", fixed(F.col("avg_cer"), 4)), F.lit(", bbox IoU "), F.format_string("%.3f", fixed(F.col("avg_bbox_iou"), 3)))
    lines = lines.unionAll(rank_engines(spark, sf_dir).select(F.lit(3), F.col("rank").cast("int"), rank))
    # A line an engine: the window is as small as the fixed table of engines.
    return lines.select(F.row_number().over(Window.orderBy("part", "n")).cast("long").alias("line_no"), "line")


def ranking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking as a table of text, nine columns: an engine without a report has dashes, one without confidences n/a."""
    r = rank_engines_full(spark, sf_dir).join(run_summary(spark, sf_dir), "engine_name", "left")
    text = lambda c, k: F.format_string(f"%.{k}f", fixed(F.col(c), k))
    ran = F.col("total_words").isNotNull()
    return r.select(
        F.col("rank").alias("#"), F.col("engine_name").alias("Engine"), text("avg_cer", 4).alias("Avg CER"), text("avg_wer", 4).alias("Avg WER"), text("avg_agreement", 3).alias("Agreement"), text("avg_bbox_iou", 3).alias("BBox IoU"),
        F.when(ran, F.col("total_words").cast("string")).otherwise("-").alias("Words"), F.when(F.col("avg_confidence").isNotNull(), text("avg_confidence", 3)).otherwise("n/a").alias("Avg conf"), F.when(ran, text("elapsed", 1)).otherwise("-").alias("Time (s)"),
    ).orderBy("#")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The regions of the last result in each transcript of JSON lines; failed results give none."""
    region = "array<struct<id: int, role: string, paragraphs: array<string>, box_px: array<int>>>"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value").where("value like '{%'")
    r = lines.select("path", "at", F.from_json("value", f"type string, is_error boolean, structured_output struct<regions: {region}>").alias("j")).where("j.type = 'result'")
    last = r.groupBy("path").agg(F.max_by("j", "at").alias("j")).where("not coalesce(j.is_error, false)")
    return last.select("path", F.inline("j.structured_output.regions"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """A word list of one word a line: (word in lower case, proper), blank lines left out."""
    w = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''")
    first = F.substring("w", 1, 1)
    return w.select(F.lower("w").alias("word"), ((F.upper(first) == first) & (F.lower(first) != first)).alias("proper")).distinct()


def write_report(ranking: DataFrame, rollup: DataFrame, path: str) -> None:
    """One JSON file with the engines' totals and the ranking, both bounded by the number of engines."""
    a = rollup.groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("engines"))
    b = ranking.groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_list(F.struct("rank", "engine_name", "avg_cer"))).alias("ranking"))
    a.join(b, "k", "full_outer").drop("k").coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report's ranking back as rows."""
    return spark.read.json(path).select(F.inline("ranking"))


QUERIES = {
    "manifests": (manifests, f"""
        WITH w AS (SELECT reading_id, count(*) AS n, sum(round(confidence * 10000)::BIGINT) AS c, count(confidence) AS k FROM {W} GROUP BY 1),
        g AS (SELECT input_pdf, engine_name, count(*) AS page_count, coalesce(sum(n), 0)::BIGINT AS total_words, round(sum(elapsed_seconds), 3) AS elapsed_seconds, sum(c)::DOUBLE AS c, sum(k) AS k
          FROM {R} r JOIN page_images p ON r.page_id = p.page_id LEFT JOIN w ON r.reading_id = w.reading_id GROUP BY 1, 2)
        SELECT input_pdf, g.engine_name, page_count, total_words, elapsed_seconds, CASE WHEN reports_confidence THEN CASE WHEN k > 0 THEN c / k / 10000 ELSE 0.0 END END AS avg_confidence FROM g JOIN engines e ON g.engine_name = e.engine_name"""),
    "summary_lines": (summary_lines, f"""
        WITH tot AS ({_SQL["engine_totals"][1]}), rk AS ({_RANK["rank_engines"][1]}),
        j AS (SELECT r.*, p.input_pdf, p.page_num, NOT r.skipped AND r.error IS NULL AS good FROM {R} r JOIN page_images p ON r.page_id = p.page_id),
        g AS (SELECT engine_name, bool_or(good) AS success, first(error ORDER BY input_pdf, page_num, reading_id) FILTER (error IS NOT NULL) AS f, round(sum(elapsed_seconds), 3) AS elapsed FROM j GROUP BY 1),
        l AS (SELECT * FROM (VALUES (0, 1, '| Engine | Model | Words | Avg conf | Time (s) | Status |'), (0, 2, '|--------|-------|-------|----------|----------|--------|'), (2, 0, '### Ranking (by consensus agreement)')) t(part, n, line)
          UNION ALL SELECT 1, run_order, '| ' || g.engine_name || ' | - | ' || total_words || ' | ' || coalesce(printf('%.3f', {_FX('avg_confidence', 3)}), '-') || ' | ' || coalesce(printf('%.1f', {_FX('elapsed', 1)}), '-') || ' | ' || CASE WHEN success THEN '✅' ELSE '❌ ' || substring(coalesce(f, 'no page succeeded'), 1, 100) END || ' |'
            FROM g JOIN engines e ON e.engine_name = g.engine_name JOIN tot ON tot.engine_name = g.engine_name
          UNION ALL SELECT 3, rank, rank || '. **' || engine_name || '**: avg CER ' || printf('%.4f', {_FX('avg_cer', 4)}) || ', bbox IoU ' || printf('%.3f', {_FX('avg_bbox_iou', 3)}) FROM rk)
        SELECT row_number() OVER (ORDER BY part, n)::BIGINT AS line_no, line FROM l"""),
    "ranking_table": (ranking_table, None),
}
