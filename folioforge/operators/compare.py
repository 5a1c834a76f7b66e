"""Engines compared page by page without ground truth, and their ranking by consensus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.words import SP, R, W, readings, words
from folioforge.session import table

#: Height of the bands that the SQL joins boxes by; only its speed depends on it.
BAND = 0.02


def usable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, engine_name, run_order, reading_id, text) of the pages that were read, white space collapsed.

    A page that an engine read more than once counts by its last reading.
    """
    r = readings(spark, sf_dir, "page_id", "engine_name", "full_text", "skipped", "error").where("not skipped and error is null")
    one = r.groupBy("page_id", "engine_name").agg(F.max_by(F.struct("reading_id", "full_text"), "reading_id").alias("r"))
    e = F.broadcast(table(spark, sf_dir, "engines", "engine_name", "run_order"))  # a fixed table
    return one.join(e, "engine_name").select("page_id", "engine_name", "run_order", "r.reading_id", T.squeeze(F.coalesce("r.full_text", F.lit(""))).alias("text"))


def usable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``usable_texts`` without the texts: (page_id, engine_name, run_order, reading_id)."""
    r = readings(spark, sf_dir, "page_id", "engine_name", "skipped", "error").where("not skipped and error is null")
    e = F.broadcast(table(spark, sf_dir, "engines", "engine_name", "run_order"))  # a fixed table
    return r.groupBy("page_id", "engine_name").agg(F.max("reading_id").alias("reading_id")).join(e, "engine_name")


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of engines on each page both read, in run order: as many rows as pages and pairs of engines."""
    # A number of partitions of its own: by their few bytes the pages would be put into few tasks, for all their work.
    t = usable_texts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    per = t.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("run_order", "engine_name", "reading_id", "text"))).alias("r"))
    # A page has one reading an engine, so the pairs are made inside its row, without a join.
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b["run_order"] > a["run_order"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.a", "p.b")


def common_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each pair of engines has in common."""
    return page_pairs(spark, sf_dir).groupBy(F.col("a.engine_name").alias("engine_a"), F.col("b.engine_name").alias("engine_b")).agg(F.count("*").alias("pages"))


def page_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric character error rate of each pair of engines on each page."""
    return page_pairs(spark, sf_dir).select("page_id", F.col("a.engine_name").alias("engine_a"), F.col("b.engine_name").alias("engine_b"), F.round(T.cer(F.col("a.text"), F.col("b.text")), 6).alias("cer"))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def agreement(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; two empty texts agree."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements between two sequences, bit-parallel over ``a``."""
    if not a or not b:
        return len(a) or len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        hit = masks.get(y, 0)
        diagonal = ((hit & plus) + plus ^ plus) | hit | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal & full
    return score


def symmetric_error(a: Sequence, b: Sequence) -> float:
    """Edits over the length of the reference, at most 1, averaged over both directions."""
    edits = edit_distance(a, b)
    rate = lambda n, other: min(1.0, edits / n) if n else float(other > 0)
    return (rate(len(a), len(b)) + rate(len(b), len(a))) / 2


def _python_scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True))
        scores = [pa.array([f(x, y) for x, y in pairs], pa.float64()) for f in (lambda x, y: symmetric_error(x.split(), y.split()), agreement)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *scores], names=[*batch.schema.names[:-2], "wer", "agreement"])


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of characters and words, and text agreement, of each pair of engines on each page."""
    p = page_pairs(spark, sf_dir)
    p = p.select("page_id", F.col("a.engine_name").alias("engine_a"), F.col("b.engine_name").alias("engine_b"), T.cer(F.col("a.text"), F.col("b.text")).alias("cer"), F.col("a.text").alias("ta"), F.col("b.text").alias("tb"))
    return p.mapInArrow(_python_scores, "page_id long, engine_a string, engine_b string, cer double, wer double, agreement double")


def page_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric word error rate of each pair of engines on each page, in the JVM: words are coded as characters, so that
    the edit distance of texts is that of their words."""
    p = page_pairs(spark, sf_dir).select("page_id", F.col("a.engine_name").alias("engine_a"), F.col("b.engine_name").alias("engine_b"), T.words_of(F.col("a.text")).alias("wa"), T.words_of(F.col("b.text")).alias("wb"))
    both = F.array_distinct(F.concat("wa", "wb"))
    # Two bytes a word, read as one character each: from U+4E00 on, past all that UTF-16 keeps for itself.
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex((F.array_position("d", w) + 0x4E00).cast("long")), 4, "0")), "UTF-16BE")), "")
    p = p.withColumn("d", both).select("page_id", "engine_a", "engine_b", F.size("wa").alias("na"), F.size("wb").alias("nb"), T.edits(coded(F.col("wa")), coded(F.col("wb"))).alias("e"))
    return p.select("page_id", "engine_a", "engine_b", F.round(T.symmetric_rate(F.col("e"), F.col("na"), F.col("nb")), 6).alias("wer"))


def boxes_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Mean best overlap of the boxes (rows of x, y, w, h) of two readings, averaged over both directions.

    1 where neither has a box, 0 where only one has.  Boxes are compared where their heights meet, found by their order.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = a[np.argsort(a[:, 1], kind="stable")], b[np.argsort(b[:, 1], kind="stable")]
    tallest = b[:, 3].max()
    first, last = np.searchsorted(b[:, 1], a[:, 1] - tallest, "left"), np.searchsorted(b[:, 1], a[:, 1] + a[:, 3], "right")
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(a)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    over = lambda k: np.minimum(a[i, k] + a[i, k + 2], b[j, k] + b[j, k + 2]) - np.maximum(a[i, k], b[j, k])
    inter = np.maximum(over(0), 0) * np.maximum(over(1), 0)
    union = a[i, 2] * a[i, 3] + b[j, 2] * b[j, 3] - inter
    iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    np.maximum.at(best_a, i, iou)
    np.maximum.at(best_b, j, iou)
    return float((best_a.mean() + best_b.mean()) / 2)


def whole_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their ``page_id``, cut between pages: the last page of a batch waits for the rest of its rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        page = batch.column("page_id").to_numpy()
        cut = int(np.searchsorted(page, page[-1]))
        if kept and (cut or kept[0].column("page_id")[-1].as_py() != page[0]):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _page_iou(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_pages(batches):
        names = rows.column("engine_name").combine_chunks().dictionary_encode()
        page, order, engine = rows.column("page_id").to_numpy(), rows.column("run_order").to_numpy(), names.indices.to_numpy()
        by = np.lexsort((engine, order, page))
        page, order, engine = page[by], order[by], engine[by]
        boxes, real = np.column_stack([rows.column(k).to_numpy() for k in "xywh"])[by], rows.column("x").is_valid().to_numpy()[by]
        starts = np.r_[0, np.flatnonzero((np.diff(page) != 0) | (np.diff(engine) != 0)) + 1]
        read = [boxes[i:k] if real[i] else boxes[:0] for i, k in zip(starts, np.r_[starts[1:], len(page)], strict=True)]
        page, order, engine = page[starts], order[starts], engine[starts]
        ends = np.searchsorted(page, page, "right")
        pairs = [(i, k) for i in range(len(read)) for k in range(i + 1, ends[i]) if order[k] > order[i]]
        first, second = (np.array([p[x] for p in pairs], np.int64) for x in (0, 1))
        scores = [boxes_iou(read[i], read[k]) for i, k in pairs]
        yield pa.RecordBatch.from_pydict({"page_id": pa.array(page[first], pa.int64()), "engine_a": names.dictionary.take(pa.array(engine[first])), "engine_b": names.dictionary.take(pa.array(engine[second])), "bbox_iou": pa.array(scores, pa.float64())})


def page_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean best-match overlap of word boxes of each pair of engines on each page, averaged over both directions.

    Words come to Python as rows in order of their pages, of which one is held at a time with a batch of rows: what a task
    needs is bounded by what is printed on a page, however many pages it has.  A word without a box counts as one of no size.
    """
    sides = [F.coalesce(F.col(f"bbox.{k}"), F.lit(0.0)).alias(k) for k in "xywh"]
    boxes = words(spark, sf_dir, "reading_id", "bbox").select("reading_id", *sides)
    # A reading without words keeps one row, whose box is null.
    rows = usable_ids(spark, sf_dir).where("page_id is not null").join(boxes, "reading_id", "left").select("page_id", "run_order", "engine_name", *"xywh")
    # Sorted by the page alone, which needs no comparisons; its readings are told apart in Python.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id").sortWithinPartitions("page_id")
    found = rows.mapInArrow(_page_iou, "page_id long, engine_a string, engine_b string, bbox_iou double")
    return found.withColumn("bbox_iou", F.round("bbox_iou", 6))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric matrices of error rate and box overlap over all common pages, with their diagonals, rounded to 4."""
    cer = page_cer(spark, sf_dir).groupBy("engine_a", "engine_b").agg(F.round(F.avg("cer"), 4).alias("cer"))
    iou = page_iou(spark, sf_dir).groupBy("engine_a", "engine_b").agg(F.round(F.avg("bbox_iou"), 4).alias("bbox_iou"))
    return filled(cer.join(iou, ["engine_a", "engine_b"]), table(spark, sf_dir, "engines", "engine_name"), {"cer": 0.0, "bbox_iou": 1.0})


def filled(pairs: DataFrame, engines: DataFrame, diagonal: dict[str, float]) -> DataFrame:
    """A matrix from its upper half: both directions and the diagonal."""
    ways = F.array(*[F.struct(F.col(x).alias("engine_a"), F.col(y).alias("engine_b")) for x, y in (("engine_a", "engine_b"), ("engine_b", "engine_a"))])
    both = pairs.select(F.explode(ways).alias("way"), *diagonal).select("way.*", *diagonal)  # made from each pair once
    return both.unionByName(engines.select(F.col("engine_name").alias("engine_a"), F.col("engine_name").alias("engine_b"), *[F.lit(v).alias(k) for k, v in diagonal.items()]))


def ranked(matrix: DataFrame, engines: DataFrame, metrics: list[str], order: list) -> DataFrame:
    """Engines by the means of their matrix rows without themselves, rounded again; run order breaks ties."""
    means = matrix.where("engine_a <> engine_b").groupBy(F.col("engine_a").alias("engine_name")).agg(*[F.round(F.avg(m), 4).alias(f"avg_{m}") for m in metrics])
    out = means.join(F.broadcast(engines.select("engine_name", "run_order")), "engine_name")
    from pyspark.sql import Window

    # One row an engine: the window without partitions is as small as the fixed table of engines.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order, "run_order")).cast("long")).drop("run_order")


def rank_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by character error rate, with box overlap."""
    return ranked(matrix(spark, sf_dir), table(spark, sf_dir, "engines"), ["cer", "bbox_iou"], [F.col("avg_cer")])


def rank_engines_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking over all four metrics: least character error, then greatest agreement."""
    s = page_scores(spark, sf_dir).groupBy("engine_a", "engine_b").agg(*[F.round(F.avg(m), 4).alias(m) for m in ("cer", "wer", "agreement")])
    iou = page_iou(spark, sf_dir).groupBy("engine_a", "engine_b").agg(F.round(F.avg("bbox_iou"), 4).alias("bbox_iou"))
    e = table(spark, sf_dir, "engines")
    m = filled(s.join(iou, ["engine_a", "engine_b"]), e.select("engine_name"), {"cer": 0.0, "wer": 0.0, "agreement": 1.0, "bbox_iou": 1.0})
    return ranked(m, e, ["cer", "wer", "agreement", "bbox_iou"], [F.col("avg_cer"), F.desc("avg_agreement")])


def best_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the ranking; where fewer than two engines read a page, the first that did; no row without any."""
    first = rank_engines_full(spark, sf_dir).where("rank = 1").select(F.lit(0).alias("k"), "engine_name", F.lit(0).alias("run_order"))
    e = F.broadcast(table(spark, sf_dir, "engines", "engine_name", "run_order"))  # a fixed table
    read = usable_ids(spark, sf_dir).select("engine_name").distinct().join(e, "engine_name").select(F.lit(1).alias("k"), "engine_name", "run_order")
    return first.unionAll(read).orderBy("k", "run_order").limit(1).select("engine_name")


_TEXTS = f"""
    texts AS (SELECT page_id, r.engine_name, run_order, reading_id, trim(regexp_replace(coalesce(full_text, ''), '[{SP}]+', ' ', 'g')) AS t
      FROM {R} r JOIN engines e ON r.engine_name = e.engine_name WHERE NOT skipped AND error IS NULL
      QUALIFY row_number() OVER (PARTITION BY page_id, r.engine_name ORDER BY reading_id DESC) = 1)"""
# DuckDB compares bytes: the characters of both texts are numbered and written as single bytes first.
_CER = f"""{_TEXTS},
    pairs AS (SELECT a.page_id, a.engine_name AS engine_a, b.engine_name AS engine_b, a.t AS ta, b.t AS tb FROM texts a JOIN texts b ON a.page_id = b.page_id AND a.run_order < b.run_order),
    chars AS (SELECT *, list_distinct(string_split(ta || tb, '')) AS d FROM pairs),
    coded AS (SELECT page_id, engine_a, engine_b, len(ta) AS na, len(tb) AS nb,
      levenshtein(array_to_string(list_transform(string_split(ta, ''), lambda c: chr(list_position(d, c)::INT)), ''), array_to_string(list_transform(string_split(tb, ''), lambda c: chr(list_position(d, c)::INT)), '')) AS e FROM chars),
    page_cer AS (SELECT page_id, engine_a, engine_b, round(((CASE WHEN na = 0 THEN (nb > 0)::INT::DOUBLE ELSE least(1.0, e / na) END) + (CASE WHEN nb = 0 THEN (na > 0)::INT::DOUBLE ELSE least(1.0, e / nb) END)) / 2, 6) AS cer FROM coded)"""
# Words that both texts have are single bytes, up to 125 of them; all others of a text are one byte that no word of the other has.
_WER = f"""{_TEXTS},
    wp AS (SELECT a.page_id, a.engine_name AS engine_a, b.engine_name AS engine_b, CASE WHEN a.t = '' THEN [] ELSE string_split(a.t, ' ') END AS wa, CASE WHEN b.t = '' THEN [] ELSE string_split(b.t, ' ') END AS wb FROM texts a JOIN texts b ON a.page_id = b.page_id AND a.run_order < b.run_order),
    wi AS (SELECT *, list_intersect(list_distinct(wa), list_distinct(wb)) AS d FROM wp),
    wc AS (SELECT page_id, engine_a, engine_b, len(wa) AS na, len(wb) AS nb, levenshtein(array_to_string(list_transform(wa, lambda w: chr((CASE WHEN list_contains(d, w) THEN list_position(d, w) + 2 ELSE 1 END)::INT)), ''),
      array_to_string(list_transform(wb, lambda w: chr((CASE WHEN list_contains(d, w) THEN list_position(d, w) + 2 ELSE 2 END)::INT)), '')) AS e FROM wi),
    page_wer AS (SELECT page_id, engine_a, engine_b, round(((CASE WHEN na = 0 THEN (nb > 0)::INT::DOUBLE ELSE least(1.0, e / na) END) + (CASE WHEN nb = 0 THEN (na > 0)::INT::DOUBLE ELSE least(1.0, e / nb) END)) / 2, 6) AS wer FROM wc)"""
_IOU = f"""
    uw AS (SELECT w.word_id, w.bbox AS b, t.reading_id, t.page_id, t.run_order, floor(w.bbox.y / {BAND})::INT AS f, greatest(floor(w.bbox.y / {BAND}), floor((w.bbox.y + w.bbox.h) / {BAND}))::INT AS l FROM {W} w JOIN texts t ON w.reading_id = t.reading_id),
    banded AS (SELECT *, unnest(range(f, l + 1)) AS band FROM uw),
    meet AS (SELECT p.reading_id AS ra, q.reading_id AS rb, p.word_id AS wa, q.word_id AS wb,
      greatest(0.0, least(p.b.x + p.b.w, q.b.x + q.b.w) - greatest(p.b.x, q.b.x)) * greatest(0.0, least(p.b.y + p.b.h, q.b.y + q.b.h) - greatest(p.b.y, q.b.y)) AS i, p.b.w * p.b.h + q.b.w * q.b.h AS s
      FROM banded p JOIN banded q ON p.page_id = q.page_id AND p.band = q.band AND p.run_order < q.run_order AND p.band = greatest(p.f, q.f)),
    iou AS (SELECT *, CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0.0 END AS v FROM meet WHERE i > 0),
    ba AS (SELECT ra, rb, sum(m) AS sa FROM (SELECT ra, rb, wa, max(v) AS m FROM iou GROUP BY 1, 2, 3) GROUP BY 1, 2),
    bb AS (SELECT ra, rb, sum(m) AS sb FROM (SELECT ra, rb, wb, max(v) AS m FROM iou GROUP BY 1, 2, 3) GROUP BY 1, 2),
    n AS (SELECT t.*, coalesce(c, 0) AS n FROM texts t LEFT JOIN (SELECT reading_id, count(*) AS c FROM {W} GROUP BY 1) x ON t.reading_id = x.reading_id),
    page_iou AS (SELECT a.page_id, a.engine_name AS engine_a, b.engine_name AS engine_b, round(CASE WHEN a.n = 0 AND b.n = 0 THEN 1.0 WHEN a.n = 0 OR b.n = 0 THEN 0.0 ELSE (coalesce(sa, 0.0) / a.n + coalesce(sb, 0.0) / b.n) / 2 END, 6) AS bbox_iou
      FROM n a JOIN n b ON a.page_id = b.page_id AND a.run_order < b.run_order LEFT JOIN ba ON ba.ra = a.reading_id AND ba.rb = b.reading_id LEFT JOIN bb ON bb.ra = a.reading_id AND bb.rb = b.reading_id)"""
_MATRIX = """
    half AS (SELECT c.engine_a, c.engine_b, c.cer, i.bbox_iou FROM (SELECT engine_a, engine_b, round(avg(cer), 4) AS cer FROM page_cer GROUP BY 1, 2) c
      JOIN (SELECT engine_a, engine_b, round(avg(bbox_iou), 4) AS bbox_iou FROM page_iou GROUP BY 1, 2) i ON c.engine_a = i.engine_a AND c.engine_b = i.engine_b),
    matrix AS (SELECT * FROM half UNION ALL SELECT engine_b, engine_a, cer, bbox_iou FROM half UNION ALL SELECT engine_name, engine_name, 0.0, 1.0 FROM engines)"""
_RANK = """
    means AS (SELECT engine_a AS engine_name, round(avg(cer), 4) AS avg_cer, round(avg(bbox_iou), 4) AS avg_bbox_iou FROM matrix WHERE engine_a <> engine_b GROUP BY 1),
    ranking AS (SELECT m.*, row_number() OVER (ORDER BY avg_cer, run_order)::BIGINT AS rank FROM means m JOIN engines e ON m.engine_name = e.engine_name)"""

QUERIES = {
    "common_pages": (common_pages, f"WITH {_TEXTS} SELECT a.engine_name AS engine_a, b.engine_name AS engine_b, count(*) AS pages FROM texts a JOIN texts b ON a.page_id = b.page_id AND a.run_order < b.run_order GROUP BY 1, 2"),
    "page_cer": (page_cer, f"WITH {_CER} SELECT * FROM page_cer"),
    "page_scores": (page_scores, None),
    "page_wer": (page_wer, f"WITH {_WER} SELECT * FROM page_wer"),
    "page_iou": (page_iou, f"WITH {_TEXTS}, {_IOU} SELECT * FROM page_iou"),
    "compare_matrix": (matrix, f"WITH {_CER}, {_IOU}, {_MATRIX} SELECT * FROM matrix"),
    "rank_engines": (rank_engines, f"WITH {_CER}, {_IOU}, {_MATRIX}, {_RANK} SELECT * FROM ranking"),
    "rank_engines_full": (rank_engines_full, None),
    "best_engine": (best_engine, f"WITH {_CER}, {_IOU}, {_MATRIX}, {_RANK} SELECT engine_name FROM ranking WHERE rank = 1"),
}
