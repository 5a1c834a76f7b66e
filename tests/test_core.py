"""Core operators against brute force, known cases and DuckDB on the smallest tables."""

import glob
import json
import math
import os
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.functions import geometry as G
from folioforge.functions import text as T
from folioforge.operators import compare, flow, images, layout, regions, repairs
from folioforge.plans import catalog, planning, routing, selection
from folioforge.sources import engines, files, scans
from folioforge.streaming import ingest

SF = "/root/testdata/sf0.001"
F = pytest.importorskip("pyspark.sql.functions")


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abcd ", max_size=30))
def test_edit_distance_and_agreement(a, b):
    assert compare.edit_distance(a, b) == brute_edits(a, b)
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    assert compare.lcs_length(a, b) == row[-1]


def test_metric_cases(spark):
    rows = [("abcd", "abce", 0.25), ("abcd", "abc", (0.25 + 1 / 3) / 2), ("", "x", 1.0), ("", "", 0.0), ("a", "xyzw" * 3, 1.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select(T.cer(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(abs(r.got - r.want) < 1e-9 for r in got)
    assert compare.agreement("", "") == 1.0 and compare.agreement("a b", "a b") == 1.0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    key = lambda t: tuple((x is None, str(x)) for x in t)
    ours = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(tidy(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=key)
    assert ours == theirs


def test_queries_without_sql_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0, name


def test_page_scores_match_brute_force(spark):
    texts = {(r.page_id, r.engine_name): r.text for r in compare.usable_texts(spark, SF).collect()}
    for r in compare.page_scores(spark, SF).limit(30).collect():
        a, b = texts[r.page_id, r.engine_a], texts[r.page_id, r.engine_b]
        e = brute_edits(a.split(), b.split())
        rate = lambda n, m: min(1.0, e / n) if n else float(m > 0)
        assert r.wer == pytest.approx((rate(len(a.split()), len(b.split())) + rate(len(b.split()), len(a.split()))) / 2)


# ------------------------------------------------------------------------------------------------ geometry, markup, text


def test_geometry(spark):
    row = spark.range(1).select(
        G.from_corners(F.lit(1.2), F.lit(0.5), F.lit(0.2), F.lit(-1.0)).alias("b"), T.unescape(F.lit("&amp;lt; &#39;")).alias("u"), T.strip_tags(F.lit("<p>a<br>b &amp; c</p>")).alias("s"),
        T.markup_lines(F.lit("<p>a</p><div> b  c<br/></div>")).alias("m"), T.squeeze(F.lit(" a  b\x1c ")).alias("q"), T.strip_markdown(F.lit("## **Hi** __x__ ")).alias("md"), T.words_of(F.lit("  ")).alias("w"),
        G.utf16_length(F.lit("a\U0001f600")).alias("n"), T.plain_s(F.lit("Moſeſ")).alias("ls"), T.width_em(F.lit("iW ż")).alias("em"),
    ).first()
    assert (row.b.x, row.b.y, row.b.w, row.b.h) == (0.2, 0.0, 0.8, 0.5)
    assert row.u == "&lt; '" and row.s == "a b & c" and list(row.m) == ["a", "b c"] and row.q == "a b" and row.md == "Hi x" and row.w == []
    assert row.n == 3 and row.ls == "Moses" and row.em == pytest.approx(0.222 + 0.944 + 0.278 + 0.6)


def test_entities(spark):
    want = {
        "a&amp;b &#34;c&#x27; &lt;&gt; & x": "a&b \"c' <> & x", "caf&#233; &#x2014;&#X1F600;": "café —\U0001f600", "a&nbsp;b": "a\u00a0b", "&amp;#233; &amp;lt;": "&#233; &lt;",
        "&#xD800; &#1114112; &#; &#x; &#xg; &eacute; &#0000000233;": "&#xD800; &#1114112; &#; &#x; &#xg; &eacute; &#0000000233;", "&#65279;": "\ufeff", "&&lt;": "&<", "": "", None: None,
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", T.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == want


def test_widths_beyond_ascii(spark):
    want = {"Grüße": 0.778 + 0.333 + 0.556 + 0.611 + 0.556, "é": 0.556, "ï": 0.278, "u\u0308": 0.556, "q\u0323": 0.556, "漢字": 2.0, "ｅ": 1.0, "ж": 0.6, "a": 0.556, "": 0.0, None: None}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", T.width_em(F.col("t")).alias("em")).collect()
    assert {r.t: r.em for r in got} == {t: em if em is None else pytest.approx(em) for t, em in want.items()}


def test_word_styles_of_accented_and_wide_words(spark, tmp_path):
    # The boxes are as wide as the words at 12 points, so each word must get that size; no word runs into the next.
    ems = {"Größe": 0.778 + 0.333 + 0.556 + 0.611 + 0.556, "naïf": 0.556 * 2 + 0.278 * 2, "漢字": 2.0, "re\u0301e\u0301": 0.333 + 2 * 0.556}
    box = lambda k, em: (0.1 + 0.2 * k, 0.1, em * 12 / 600, 0.03)
    rows = [(k, 1, 1, "p.pdf", "inkline", k, None, t, box(k, em), 0.9, 0, 0, 0) for k, (t, em) in enumerate(ems.items())]
    like = {n: spark.read.parquet(f"{SF}/{n}.parquet").schema for n in ("words", "page_images", "readings")}
    spark.createDataFrame([(1, 1, "inkline", "eng", 1250, 1667, "", 0.1, False, None, None, None)], like["readings"]).write.parquet(f"{tmp_path}/readings.parquet")
    spark.createDataFrame(rows, like["words"]).write.parquet(f"{tmp_path}/words.parquet")
    spark.createDataFrame([(1, "p.pdf", 0, "p.png", 1250, 1667, 600.0, 800.0, 150)], like["page_images"]).write.parquet(f"{tmp_path}/page_images.parquet")
    assert [r.font_size_pt for r in layout.word_styles(spark, str(tmp_path)).collect()] == [12.0] * 4


def test_split_line_block_and_fragments(spark):
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.7).alias("w"), F.lit(0.05).alias("h"))
    w = spark.range(1).select(scans.split_line(F.lit("ab cdef"), box).alias("w")).first().w
    assert [(round(x.bbox.x, 6), round(x.bbox.w, 6)) for x in w] == [(0.1, 0.2), (0.4, 0.4)]
    b = spark.range(1).select(scans.split_block(F.array(F.lit("one two"), F.lit(""), F.lit("three")), box).alias("b")).first().b
    assert [x.text for x in b] == ["one two", "three"] and round(b[1].bbox.y, 6) == 0.225
    unit = lambda x: F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(1.0).alias("h"))
    got = spark.range(1).select(scans.fragment_words(F.lit("ab cd"), F.array(F.lit("ab"), F.lit("cd")), F.array(unit(0), unit(20))).alias("w"), scans.fragment_words(F.lit("abx"), F.array(F.lit("ab")), F.array(unit(0))).alias("none")).first()
    assert [(x.text, x.bbox.x, x.bbox.w) for x in got.w] == [("ab", 0.0, 10.0), ("cd", 20.0, 10.0)] and got.none is None


def test_scans_of_lines_and_blocks(spark):
    pts = [(10.0, 10.0), (60.0, 10.0), (60.0, 30.0), (10.0, 30.0)]
    rows = [(1, 100, 100, 0, "ab cd", pts, 0.9), (1, 100, 100, 1, "  ", pts, 0.9)]
    got = scans.polygon_words(spark.createDataFrame(rows, "page_id long, width_px int, height_px int, line int, text string, points array<struct<x: double, y: double>>, score double")).orderBy("k").collect()
    assert [r.text for r in got] == ["ab", "cd"] and got[0].bbox.x == pytest.approx(0.1)
    blocks = [(1, 0, "<p>a b</p>", (0.0, 0.0, 1.0, 0.5), False, None, 0.8), (1, 1, "<p>c</p><p>d</p>", (0.0, 0.5, 1.0, 0.5), False, None, 0.8), (1, 2, "<p>x</p>", (0.0, 0.0, 1.0, 1.0), True, None, 0.8), (1, 3, None, None, None, "boom", None)]
    got = scans.markup_block_words(spark.createDataFrame(blocks, "page_id long, block int, html string, bbox struct<x: double, y: double, w: double, h: double>, skipped boolean, error string, score double"))
    assert sorted((r.line, r.text) for r in got.collect()) == [(0, "a"), (0, "b"), (1, "c"), (2, "d")]
    flipped = scans.observed_words(spark.createDataFrame([(1, 0, "z", (0.1, 0.7, 0.2, 0.1), 1.0)], "page_id long, line int, text string, bbox struct<x: double, y: double, w: double, h: double>, score double")).first()
    assert flipped.bbox.y == pytest.approx(0.2)
    nested = [(1, [([([("a", (0.0, 0.0, 0.1, 0.1), 0.9)],)],), ([([("b", (0.0, 0.0, 0.1, 0.1), 0.9)],), ([("c", (0.0, 0.0, 0.1, 0.1), 0.9)],)],)])]
    word = "struct<text: string, bbox: struct<x: double, y: double, w: double, h: double>, confidence: double>"
    got = scans.nested_words(spark.createDataFrame(nested, f"page_id long, blocks array<struct<lines: array<struct<words: array<{word}>>>>>"))
    assert sorted((r.block, r.line, r.text) for r in got.collect()) == [(0, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_markup_keeps_words(spark):
    html = (
        '<span class="word" style="left: 1.5%; top: x%; width: 2%; height: 3%; font-size: 9.50pt;" data-confidence="0.910" data-block="2" data-line="x">Moſes&#39;s &amp;lt; </span>'
        '<span class="word" style="font-size: 9pt;"> </span><span class="word" style="left: 1%; font-size: 0pt;">none</span><span class="word" style="left: 1%">none</span>'
    )
    got = layout.parse_markup(spark.createDataFrame([(1, html)], "reading_id long, html string")).collect()
    assert [(r.text, r.left, r.top, r.height, r.font_size, r.confidence, r.block, r.par, r.line) for r in got] == [("Moſes's &lt;", 0.015, 0.0, 0.03, 9.5, 0.91, 2, None, None)]


# ------------------------------------------------------------------------------------------------ lines, flow, repairs


def test_geometric_groups():
    assert layout.group_geometric([0.0, 0.001, 0.5], [0.02, 0.04, 0.02], [0.1, 0.3, 0.1]) == [0, 0, 1]
    assert layout.group_geometric([], [], []) == []


def test_white_bands_and_medians():
    low, high = np.array([0.0, 1.0, 5.0, 6.5]), np.array([2.0, 3.0, 6.0, 7.0])
    assert flow.white(low, high, 0.0).tolist() == [4.0, 6.25] and flow.white(low, high, 1.0).tolist() == [4.0]
    assert flow.middle(np.array([1, 2, 3, 4])) == 3 and flow.middle(np.array([])) == 0.0
    nan = float("nan")
    assert flow.majority(np.array([1, 2, 2, 1])) == 2 and math.isnan(flow.majority(np.array([nan, nan, 3])))


def page_of(words):
    """A page of 400 by 400 points with words (text, x, center, width, par, line) of 10 points."""
    text, x, center, width, par, line = zip(*words, strict=True)
    nan = float("nan")
    number = lambda v: np.array([nan if n is None else n for n in v], float)
    x, width = np.array(x, float), np.array(width, float)
    return flow.Page(list(text), x, x + width, np.array(center, float), np.full(len(text), 10.0), np.full(len(text), nan), number(par), number(line), 400.0, 400.0)


@pytest.mark.parametrize("numbered", [True, False])
def test_flow_reads_columns_in_order_and_joins_hyphens(numbered):
    words = [("HEAD", 150, 20, 60, 0, 0)]
    left = [["The", "first", "con-"], ["tinues", "here."], ["New", "para-"], ["graph", "ends."]]
    right = [["Right", "column", "starts"], ["and", "ends"], ["just", "now", "after"], ["four", "lines."]]
    for rows, x0, x1, line, pars in ((left, 20, 175, 1, [1, 1, 2, 2]), (right, 200, 380, 10, [3, 3, 3, 3])):
        for r, row in enumerate(rows):
            indent = 15 if x0 == 20 and r == 2 else 0
            step = (x1 - x0 - indent) / len(row)
            words += [(t, x0 + indent + step * k + 3 * ((r + k) % 3), 50 + 12 * r, step - 12, pars[r], line + r) for k, t in enumerate(row)]
    page = page_of([w if numbered else (*w[:4], None, None) for w in words])
    regions = flow.read_page(page, None)
    assert [t for r in regions for _, t in r.paragraphs] == ["HEAD", "The first continues here.", "New paragraph ends.", "Right column starts and ends just now after four lines."]
    assert len(regions) == 3 and sum(r.joins for r in regions) == 2
    html = "".join(r.markup(400, 400) for r in regions)
    assert html.count("text-indent:") == 1 and html.count("white-space: nowrap;") == 1 and html.count("text-align: justify;") == 2


def test_flow_merges_fragments_of_a_line():
    words = [("The", 20, 50, 30, None, 0), ("first", 60, 50, 40, None, 0), ("line", 120, 50.4, 30, None, 1), ("here.", 160, 50.4, 40, None, 1), ("Second", 20, 62, 60, None, 2), ("line.", 90, 62, 110, None, 2)]
    (region,) = flow.read_page(page_of(words), None)
    assert [t for _, t in region.paragraphs] == ["The first line here. Second line."]
    size, line = region.set(400.0)
    assert size <= 10 and line / size == pytest.approx(1.16) and region.bottom(400.0, 0.7) < region.bottom(400.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 300), st.floats(10, 390), st.floats(1, 60)), min_size=1, max_size=25))
def test_flow_keeps_every_word(boxes):
    page = page_of([(f"w{i}", x, c, w, None, None) for i, (x, c, w) in enumerate(boxes)])
    found = sorted(w for r in flow.read_page(page, None) for _, t in r.paragraphs for w in t.split())
    assert found == sorted(page.text)


WORDS = repairs.Dictionary(frozenset("should address the same after if staff during ear ring new side so".split()), frozenset({"moses", "york"}))


def test_repairs():
    r = lambda w: repairs.read_as_f(w, WORDS)
    assert r("fhould,") == "should," and r("Addreffes") == "Addresses" and r("fame") == "same" and r("Fame") is None and r("Mofes's") == "Moses's"
    assert r("after") is None and r("if") is None and r("staff") is None and r("...") is None and r("") is None
    assert repairs.repair_word("ſhould", WORDS) == "should"
    j = lambda a, b: repairs.join_hyphenated(a, b, WORDS)
    assert j("du-", "ring") == "during" and j("Ear-", "rings") == "Ear-rings" and j("New-", "York") is None and j("a", "b") is None and j("-", "b") is None


def test_base_forms_column_matches_function(spark):
    words = ["lov'd", "stopped", "receiving", "moses's", "carries", "is", "ladies", "größes", "x", "'s", "ed"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", repairs.base_forms(F.col("w")).alias("b")).collect()
    for r in got:
        assert set(r.b) == repairs.bases(r.w), r.w
    assert repairs.bases("stopped") >= {"stop", "stopp", "stoppe", "stopped"} and "carry" in repairs.bases("carries") and "moses" in repairs.bases("moses's")


def test_long_s_by_joins_matches_function(spark, tmp_path):
    listed = ["should", "address", "the", "same", "after", "if", "staff", "Moses", "assess", "sofas"]
    spark.createDataFrame([(w, "eng", w[0].isupper()) for w in listed], "word string, lang string, is_proper boolean").write.parquet(f"{tmp_path}/wordlist.parquet")
    d = repairs.dictionary(spark, str(tmp_path))
    words = ["fhould,", "Addreffes", "fame", "Fame", "Mofes's", "after", "if", "ſhould", "affeff", "fofaf", "...", "", "(fee)", "ffffffff", "f" * 500, "Faying", "ﬅaff", "xfhould"]
    got = {r.word: r.repaired for r in repairs.long_s(spark.createDataFrame([(w,) for w in words], "word string"), spark, str(tmp_path)).collect()}
    assert got == {w: r for w in words if (r := repairs.repair_word(w, d)) != w} and got["fhould,"] == "should," and "Fame" not in got and got["fame"] == "same"


def test_merge_answers(spark):
    block = "page_id long, ord long, id string, paragraphs array<string>, indents array<string>, style string"
    blocks = [
        (1, 1, "r1", ["abcdefghij"], ["i"], "s1"), (1, 2, "r2", ["xy"], [""], "s2"), (1, 3, "r3", ["zz"], [""], "s3"),
        (2, 1, "r1", ["keep this text"], [""], "s"), (2, 2, "r2", ["and what is left of a long page"], [""], "s"), (3, 1, "r1", ["as it was"], None, "s"),
    ]
    answer = "page_id long, pos long, id string, role string, paragraphs array<string>, box_px array<int>"
    answers = [
        (1, 1, "r1", "text", ["first answer"], None), (1, 2, "r1", "header", ["abcdefghiJ and more"], None), (1, 3, "r2", "noise", ["xy"], None),
        (1, 4, "n1", "note", ["new one"], [0, 0, 5, 5]), (1, 5, "n2", "note", ["no box"], None), (1, 6, "n3", None, [" "], [0, 0, 5, 5]),
        (2, 1, "r1", "text", ["two", "parts"], None),
    ]
    got = [(r.page_id, r.ord, r.id, r.role, list(r.paragraphs), r.indents, r.style, r.is_new) for r in regions.merge_answers(spark.createDataFrame(blocks, block), spark.createDataFrame(answers, answer)).orderBy("page_id", "ord").collect()]
    assert got == [
        (1, 1, "r1", "header", ["abcdefghiJ and more"], ["i"], "s1", False),  # the last answer; r3 is dropped, as the page is complete
        (1, 2, "n1", "note", ["new one"], None, None, True),
        (2, 1, "r1", "text", ["two", "parts"], None, "s", False),  # no longer as many paragraphs as indents
        (2, 2, "r2", "text", ["and what is left of a long page"], [""], "s", False),  # low coverage keeps what has no answer
        (3, 1, "r1", "text", ["as it was"], None, "s", False),
    ]


def test_attempts_in_order(spark):
    schema = "page_id long, how string, is_error boolean, regions array<string>"
    tries = [[(1, "cached", False, ["a"]), (2, "cached", True, ["b"]), (3, "cached", None, [])], [(1, "zoom", False, ["z"]), (2, "zoom", False, ["y"]), (3, "zoom", None, None)], [(3, "no zoom", None, ["x"]), (4, "no zoom", True, ["w"])]]
    got = {(r.page_id, r.how, r.regions[0]) for r in regions.attempts(*[spark.createDataFrame(t, schema) for t in tries]).collect()}
    assert got == {(1, "cached", "a"), (2, "zoom", "y"), (3, "no zoom", "x")}


def test_boxes_iou():
    a, b = np.array([[0, 0, 2, 1], [5, 5, 1, 1.0]]), np.array([[1, 0, 2, 1.0]])
    assert compare.boxes_iou(a, b) == pytest.approx((1 / 6 + 1 / 3) / 2) and compare.boxes_iou(a, b[:0]) == 0.0 and compare.boxes_iou(a[:0], b[:0]) == 1.0
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, y = (np.column_stack([rng.random((n, 2)), rng.random((n, 2)) * 0.3]) for n in rng.integers(1, 30, 2))
        one = lambda p, q: max(0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])) * max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
        iou = np.array([[one(p, q) / (p[2] * p[3] + q[2] * q[3] - one(p, q)) for q in y] for p in x])
        assert compare.boxes_iou(x, y) == pytest.approx((iou.max(1).mean() + iou.max(0).mean()) / 2)


def test_whole_pages():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 7, 100):
        page = np.sort(rng.integers(0, 12, 60))
        cut = pa.RecordBatch.from_pydict({"page_id": page, "n": np.arange(60)})
        parts = list(compare.whole_pages([cut.slice(0, 0), *(cut.slice(i, size) for i in range(0, 60, size)), cut.slice(0, 0)]))
        assert pa.concat_tables(parts).column("n").to_pylist() == list(range(60))
        ids = [set(p.column("page_id").to_pylist()) for p in parts]
        assert sum(map(len, ids)) == len(set(page.tolist())) and (size > 1 or all(len(x) == 1 for x in ids))


def test_page_iou_takes_few_rows_at_a_time(spark, monkeypatch):
    want = {(r.page_id, r.engine_a, r.engine_b): r.bbox_iou for r in compare.page_iou(spark, SF).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        # Pages of several batches, and all of them in one task.
        assert {(r.page_id, r.engine_a, r.engine_b): r.bbox_iou for r in compare.page_iou(spark, SF).collect()} == want
        as_page = lambda batches: (pa.RecordBatch.from_pydict({"page_id": [b.nbytes], "engine_a": [""], "engine_b": [""], "bbox_iou": [0.0]}) for b in batches)
        monkeypatch.setattr(compare, "_page_iou", as_page)
        sizes = [r.page_id for r in compare.page_iou(spark, SF).collect()]
        assert max(sizes) < 10_000 and len(sizes) > 50, max(sizes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_page_iou_counts_words_without_box(spark, tmp_path):
    like = {n: spark.read.parquet(f"{SF}/{n}.parquet").schema for n in ("words", "readings", "engines")}
    reading = lambda i, page, engine: (i, page, engine, "eng", 10, 10, "a b", 0.1, False, None, None, None)
    word = lambda i, reading, box: (i, reading, 1, "p.pdf", "", i, None, "a", box, None, None, None, None)
    rows = [reading(1, 1, "serifold"), reading(2, 1, "inkline"), reading(3, 1, "third"), reading(4, 2, "serifold"), reading(5, 2, "third")]
    box = (0.1, 0.1, 0.2, 0.1)
    written = [word(1, 1, box), word(2, 1, None), word(3, 2, box)]
    for name, data in (("readings", rows), ("words", written), ("engines", [("inkline", 1, False, True), ("serifold", 2, False, True), ("third", 3, False, True)])):
        spark.createDataFrame(data, like[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in like:
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, compare.page_iou(spark, str(tmp_path)).select("page_id", "engine_a", "engine_b", "bbox_iou").collect()))
    assert got == [(1, "inkline", "serifold", 0.75), (1, "inkline", "third", 0.0), (1, "serifold", "third", 0.0), (2, "serifold", "third", 1.0)]
    assert got == sorted(con.execute(f"select page_id, engine_a, engine_b, bbox_iou from ({catalog.oracle_sql()['page_iou']})").fetchall())


def test_best_engine_of_one(spark, tmp_path):
    like = {n: spark.read.parquet(f"{SF}/{n}.parquet").schema for n in ("words", "page_images", "readings", "engines")}
    rows = [(1, 1, "serifold", "eng", 10, 10, "a b", 0.1, False, None, None, None), (2, 1, "inkline", "eng", 10, 10, "", 0.1, True, "timeout", None, None)]
    for name, data in (("readings", rows), ("words", []), ("page_images", [(1, "p.pdf", 0, "p.png", 10, 10, 6.0, 8.0, 150)]), ("engines", [("inkline", 1, False, True), ("serifold", 2, False, True)])):
        spark.createDataFrame(data, like[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.engine_name for r in compare.best_engine(spark, str(tmp_path)).collect()] == ["serifold"]


# ------------------------------------------------------------------------------------------------ images


def test_images(spark):
    rng = np.random.default_rng(1)
    page = np.full((200, 300), 250, np.uint8)
    for y in range(20, 180, 16):
        page[y : y + 5, 20:280] = rng.integers(0, 40)
    assert 0 < images.otsu_level(page) < 250 and set(np.unique(images.binarize(page))) == {0, 255}
    turned = images.rotate(page, 2.0)
    assert abs(images.skew_angle(turned) + 2.0) <= 0.5 and images.deskew(page).shape == page.shape
    speck = np.full((9, 9), 255, np.uint8)
    speck[4, 4] = 0
    assert images.denoise(speck).min() == 255 and images.is_bilevel(speck) and images.ink_box(speck)[0] == pytest.approx(4 / 9)
    assert images.ink_box(np.full((5, 5), 255, np.uint8)) == (0.0, 0.0, 1.0, 1.0)
    assert images.sharpen(page).shape == page.shape and images.autocontrast(page).max() == 255
    df = spark.createDataFrame([(300, 200, 1, bytearray(page.tobytes()))], "width int, height int, channels int, data binary")
    assert set(images.apply_filters(df, "grayscale, Binarize").first().data) == {0, 255} and images.apply_filters(df, "") is df
    with pytest.raises(ValueError, match="unknown filter"):
        images.parse_filters("blur,sharpen")


# ------------------------------------------------------------------------------------------------ planning


def test_pages():
    assert selection.select_pages("1,3,7-10", 12) == [0, 2, 6, 7, 8, 9] and selection.select_pages("2-99", 4) == [1, 2, 3] and selection.select_pages("3,1,3", 5) == [0, 2]
    assert selection.select_pages("all", 2) == [0, 1]
    for bad in ("0", "5-2", "9", "a-b", "1,,2"):
        with pytest.raises(selection.InputError):
            selection.select_pages(bad, 4)
    assert selection.script_pages("1,3-9,6-5", 5) == {1, 3, 4, 5} and selection.script_pages(None, 5) is None


def test_options_and_engines():
    parse = lambda raw, chosen: selection.parse_engine_options(raw, chosen)
    assert parse(["macos-vision.level=fast", "rapidocr.text_orientation=no"], ["macos_vision", "rapidocr"]) == {"macos_vision": {"level": "fast"}, "rapidocr": {"text_orientation": False}}
    for bad in ("x", "tesseract.psm", "nope.a=1", "doctr.straight_pages=yes", "tesseract.zoom=1", "tesseract.psm=2", "rapidocr.min_score=1.5", "rapidocr.min_score=x"):
        with pytest.raises(selection.InputError):
            parse([bad], ["tesseract", "rapidocr"])
    engines_ = list(routing.ENGINES)
    assert "olmocr" not in selection.select_engines("all", engines_, selection.GPU_ENGINES) and selection.select_engines(" OLMOCR ,tesseract,tesseract", engines_, selection.GPU_ENGINES) == ["olmocr", "tesseract"]


def test_plans(spark):
    got = {}
    for r in planning.plans(spark, SF).collect():
        got.setdefault(r.request, []).append((r.engine, r.status, r.detail))
    error = {k: v[0][2] for k, v in got.items() if v[0][1] == "error"}
    assert error[7].startswith("unknown engine(s): nonesuch, other_one") and error[8] == "language unknown: xyz" and error[5].startswith("cannot run the requested engines for --lang rus: doctr: ")
    assert set(error) == {5, 6, 7, 8, 9, 11} and "not installed (ocrmypdf_rapidocr)" in error[9] and "macOS only" in error[11]
    assert {e for e, s, _ in got[1] if s == "skip"} == {"paddleocr", "ocrmypdf_rapid", "macos_vision"} and "olmocr" not in {e for e, *_ in got[1]}
    assert "olmocr" in {e for e, *_ in got[3]} and [e for e, *_ in got[10]] == ["olmocr"]
    lines = [r.line for r in planning.plan_log(spark, SF).where("request = 2").orderBy("line_no").collect()]
    assert lines[:3] == ["Languages: deu (German), eng (English)", "Preprocessing: grayscale -> deskew", "Engine routing:"] and lines[-1].startswith("  macos_vision    skipped: macOS only")
    installed = spark.createDataFrame([("eng",), ("Fraktur",)], "model string")
    gaps = {r.spec: r.gap for r in planning.model_gaps(spark, spark.createDataFrame([("deu_frak+eng",), ("eng+deu+rus",)], "spec string"), installed).collect()}
    assert gaps == {"eng+deu+rus": "no Tesseract model for deu (deu); install tesseract-ocr-deu"}


def test_routes(spark):
    got = {(r.spec, r.engine): r for r in routing.routes(spark, SF).collect()}
    assert got["deu+eng", "rapidocr"].lang == "latin" and not got["rus+eng", "doctr"].ok and got["rus+ukr", "easyocr"].ok and not got["jpn+kor", "easyocr"].ok
    assert got["deu_frak+eng", "tesseract"].lang == "frk+eng" and not got["xyz+eng", ""].ok
    installed = spark.createDataFrame([("eng",), ("deu",), ("Fraktur",)], "model string")
    models = {r.code: r.model for r in routing.resolve_models(spark, installed).collect()}
    assert models["deu_frak"] == "Fraktur" and models["eng"] == "eng" and models["rus"] is None


# ------------------------------------------------------------------------------------------------ files, engines, streams


def test_zip_round_trip(spark, tmp_path):
    done = files.write_zips(spark, SF, str(tmp_path / "out")).collect()
    assert done and all(zipfile.is_zipfile(tmp_path / "out" / r.file) for r in done)
    m = files.read_manifests(spark, str(tmp_path / "out"))
    assert m.count() == sum(r.pages for r in done)
    (tmp_path / "out" / "broken.zip").write_bytes(b"nothing")
    assert files.read_zips(spark, str(tmp_path / "out")).where("entry is null").count() == 1
    total = layout.parse_markup(files.read_zips(spark, str(tmp_path / "out")).where("entry like '%.html'").select(F.xxhash64("path", "entry").alias("reading_id"), F.col("content").cast("string").alias("html"))).count()
    assert total == sum(r.total_words for r in done)


def test_transcripts_reports_and_lists(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(["log", json.dumps({"type": "result", "structured_output": {"regions": [{"id": 1, "role": "text", "paragraphs": ["old"]}]}}), json.dumps({"type": "result", "structured_output": {"regions": [{"id": 2, "role": "note", "paragraphs": ["a", "b"]}]}})]))
    assert [(r.id, list(r.paragraphs)) for r in files.read_transcripts(spark, str(tmp_path / "t.jsonl")).collect()] == [(2, ["a", "b"])]
    (tmp_path / "words.txt").write_text("walk\n\n Moses \nwalk\n")
    assert sorted(tuple(r) for r in files.read_word_list(spark, str(tmp_path / "words.txt")).collect()) == [("moses", True), ("walk", False)]
    ranking = spark.createDataFrame([("a", 0.1, 1)], "engine_name string, avg_cer double, rank long")
    files.write_report(ranking, spark.createDataFrame([("a", 3)], "engine_name string, pages long"), str(tmp_path / "report"))
    assert files.read_report(spark, str(tmp_path / "report")).first().engine_name == "a"


def test_engine_isolation(spark):
    class Fake(engines.Engine):
        name = "fake"
        options = {"fail_on": -1}

        def read(self, page):
            if page["page_id"] == 1:
                raise RuntimeError("boom")
            if page["page_id"] == 2:
                import time

                time.sleep(5)
            return [{"text": "Hello world", "x": 0.1, "y": 0.1, "w": 0.2, "h": 0.1, "confidence": 0.9}, {"text": "flat", "x": 0, "y": 0, "w": 0.0, "h": 1.0, "confidence": 1.0}]

        def close(self):
            raise RuntimeError("never fatal")

    class Broken(Fake):
        def prepare(self):
            raise ImportError("no model")

    got = {r.page_id: r for r in engines.run_engine(spark.range(3).withColumnRenamed("id", "page_id"), Fake, timeout=1).collect()}
    assert [w.text for w in got[0].words] == ["Hello", "world"] and got[1].error == "RuntimeError: boom" and not got[1].skipped and got[2].skipped and got[2].error.startswith("timeout")
    assert {r.error for r in engines.run_engine(spark.range(2).withColumnRenamed("id", "page_id"), Broken).collect()} == {"ImportError: no model"}
    with pytest.raises(ValueError):
        Fake(other=1)


def test_streams(spark, tmp_path):
    r = spark.read.parquet(f"{SF}/readings.parquet")
    r.repartition(3).write.parquet(str(tmp_path / "in"))
    s = ingest.engine_windows(ingest.stream(spark, str(tmp_path / "in"), r, 10), "3650 days", "9999 days")
    q = s.writeStream.format("memory").queryName("totals").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    total = spark.sql("select sum(pages) as n from totals").first().n
    assert total >= r.select("reading_id").distinct().count()
    w = spark.read.parquet(f"{SF}/words.parquet")
    w.write.parquet(str(tmp_path / "w"))
    ingest.append_words(ingest.stream(spark, str(tmp_path / "w"), w, 10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == w.select("word_id").distinct().count()


def test_cli(capsys):
    from folioforge import cli

    assert cli.main(["check", "--lang", "deu+eng", "--engines", "tesseract", "-O", "tesseract.psm=6"]) == 0
    assert cli.main(["check", "--lang", "xyz"]) == 2 and cli.main(["filters"]) == 0 and cli.main(["languages"]) == 0
    assert "deskew" in capsys.readouterr().out


def test_markup_of_regions_and_rewriting(spark):
    html = '<html lang="de"><body><span class="word" style="left: 1%">Moſes&#39;s </span>x<span class="word">a</span></body></html>'
    row = spark.createDataFrame([(html,)], "html string").select(layout.rewrite_texts(F.col("html"), T.plain_s).alias("h"), layout.html_lang(F.col("html")).alias("lang")).first()
    assert row.h == html.replace("ſ", "s") and row.lang == "de"
    pages = spark.createDataFrame([(1, '<div class="region" data-role="note" style="left: 1.5%; top: x; font-size: 9.00pt; white-space: nowrap;"><p>a &amp; b</p><p style="">c</p></div><div class="region"></div>'), (2, "")], "page_id long, html string")
    got = regions.parse_regions(pages).orderBy("pos").collect()
    assert [(r.role, r.left, r.top, r.font_size, r.nowrap, list(r.paragraphs), r.text) for r in got] == [("note", 1.5, 0.0, 9.0, True, ["a & b", "c"], "a & b c"), ("text", 0.0, 0.0, 0.0, False, [], "")]
    with pytest.raises(ValueError):
        layout.transformed(pages, "sideways", "keep")
    assert layout.transformed(pages, "positioned", "keep") is pages
