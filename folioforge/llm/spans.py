"""Long exact spans that documents share (problem 8).

Anchors are chosen by the content of the text alone (the least of the hashes of LEAST - CORE + 1 successive stretches of CORE
characters), so every span of LEAST characters that two documents share holds the same anchor in both.  Around each
anchor that different texts have, a window is cut that holds every span of LEAST characters around it.  Windows are
spread over shards by their anchor; each shard has an FM-index of its distinct windows, and every one of them is streamed
against it by backward search.  So no document meets documents that it shares nothing with, and the work grows with what
is shared.

An anchor with more different windows than a group may have (``group``) is parted by what stands around it: of two
windows that share LEAST characters one of the EIGHTHS of the characters beside the anchor is the same.  Where even that
leaves more in a group, what they have in common is all but a span already; their spans of LEAST characters are then
counted by their hashes, which gives the same result.

Exact copies are one text: they share all of it, if it is long enough, and what the text shares with others.  Null texts
and texts of less than LEAST characters have no row.  Repeated rows of one doc_id are one document.  Documents are read
twice, for their anchors and for the windows of those that share some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.fmindex import shared_stretches
from folioforge.llm.skew import FREQUENT, sifted, spread_join
from folioforge.session import checkpointed, stored, table

LEAST = 200
CORE = 120
REACH = LEAST - CORE  # how far a span of LEAST characters reaches beyond an anchor in it
EIGHTHS = 8  # ways to part the characters beside an anchor to its left and right, where many windows have it
PIECE = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MANY: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse modulo 2**64."""
    if len(_MANY.get("up", ())) <= n:
        size = max(n + 1, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _MANY["up"] = np.multiply.accumulate(np.full(size, _BASE))
        _MANY["down"] = np.multiply.accumulate(np.full(size, inverse))
    return _MANY["up"], _MANY["down"]


def _slide(x: np.ndarray, width: int, take: np.ufunc, forward: bool) -> np.ndarray:
    """``take`` over the ``width`` values from (or up to) each place, in a number of passes that is logarithmic in it."""
    x = x.copy()
    done = 1
    while done < width:
        step = min(done, width - done)
        if forward:
            x[:-step] = take(x[:-step], x[step:])
        else:
            x[step:] = take(x[step:], x[:-step])
        done += step
    return x


def anchors(texts: list[str], core: int = CORE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, hash) of the anchors of some texts."""
    width = least - core + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(7)) * up[:n], out=total[1:])
    h = (total[core:] - total[:-core]) * down[: n - core + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    top = np.uint64(2**64 - 1)
    ends = np.cumsum(sizes)
    whose = np.repeat(np.arange(len(texts)), sizes)
    room = ends[whose[: len(h)]] - np.arange(len(h))  # characters left in the text
    h = np.where(room >= core, np.minimum(h, top - np.uint64(1)), top)
    least_hash = _slide(h, width, np.minimum, True)
    least_hash = np.where(room >= least, least_hash, 0)
    chosen = (_slide(least_hash, width, np.maximum, False) >= h) & (h != top)
    at = np.flatnonzero(chosen)
    text = whose[at]
    return text, at - (ends - sizes)[text], h[at]


def _pieces(ids: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Rows, offsets and texts in lots of about PIECE characters; long texts in pieces that overlap by LEAST - 1."""
    rows, offsets, parts, size = [], [], [], 0
    for i, t in zip(ids, texts, strict=True):
        for start in range(0, max(1, len(t) - LEAST + 1), PIECE):
            part = t[start : start + PIECE + LEAST - 1]
            rows.append(i)
            offsets.append(start)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, parts


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("anchor", pa.int64())])
ANCHORS = "doc_id long, cls long, size int, place int, anchor long"


def _hash64(*parts: str) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "big", signed=True)


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the hash and size of its text, and its anchors."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        long = [i for i, t in enumerate(texts) if t is not None and len(t) >= LEAST]
        cls, size = {i: _hash64(texts[i]) for i in long}, {i: len(texts[i]) for i in long}
        for rows, offsets, parts in _pieces(long, [texts[i] for i in long]):
            text, place, h = anchors(parts)
            row = np.array(rows)[text] if len(text) else np.zeros(0, np.int64)
            place = place + np.array(offsets)[text] if len(text) else place
            # Overlaps of pieces may name an anchor twice; that changes nothing but work.
            of = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[row]), pa.array([cls[i] for i in of], pa.int64()), pa.array([size[i] for i in of], pa.int32()), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], schema=_ANCHORS
            )


_WINDOWS = pa.schema([("cls", pa.int64()), ("size", pa.int32()), ("anchor", pa.int64()), ("start", pa.int32()), ("core", pa.int32()), ("window", pa.string()), ("id", pa.binary())])
WINDOWS = "cls long, size int, anchor long, start int, core int, window string, id binary"


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, cls, size, found): the window around each anchor, with a number of 128 bits for its content."""
    for batch in batches:
        out = []
        for text, cls, size, found in zip(*(batch.column(n).to_pylist() for n in ("text", "cls", "size", "found")), strict=True):
            for f in found if size == len(text) and cls == _hash64(text) else ():
                a = max(0, f["place"] - REACH)
                window = text[a : f["place"] + CORE + REACH]
                number = hashlib.blake2b(f"{f['anchor']} {f['place'] - a} {window}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                out.append((cls, size, f["anchor"], a, f["place"] - a, window, number))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, _WINDOWS, strict=True)], schema=_WINDOWS)


def _search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of the windows of one shard, from the shard's FM-index."""
    pdf = pd.concat([*batches, pd.DataFrame(columns=["key", "id", "window", "core", "low", "high"])])
    if not len(pdf):
        return
    owners = pd.factorize(pdf["low"])[0]
    many = (pdf["low"] != pdf["high"]).tolist()
    cores = [(c, c + CORE) for c in pdf["core"]]
    found = shared_stretches(pdf["window"].tolist(), owners.tolist(), many, cores, LEAST)
    rows = [(i, s, e) for i, spans in zip(pdf["id"], found, strict=True) for s, e in spans]
    yield pd.DataFrame(rows, columns=["id", "s", "e"])


_PARTS = pa.schema([("key", pa.int64()), ("id", pa.binary()), ("window", pa.string()), ("core", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window (anchor, id, window, core, low, high) for each way to part the characters beside its anchor.

    If two windows share LEAST characters around the anchor, a of them to its left, they have the anchor with the
    step * k characters before it and the REACH - step * (k + 1) after it in common, for the k that a falls in.
    """
    step = REACH // EIGHTHS
    for batch in batches:
        out = []
        for anchor, number, window, core, low, high in zip(*(batch.column(n).to_pylist() for n in ("anchor", "id", "window", "core", "low", "high")), strict=True):
            for k in range(EIGHTHS):
                a, b = core - step * k, core + CORE + REACH - step * (k + 1)
                if a >= 0 and b <= len(window):
                    out.append((_hash64(f"{anchor} {k} ", window[a:b]), number, window, core, low, high))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, _PARTS, strict=True)], schema=_PARTS)


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, low, high, s, gram) for each stretch of LEAST characters of a window."""
    for batch in batches:
        out = []
        for number, window, low, high in zip(*(batch.column(n).to_pylist() for n in ("id", "window", "low", "high")), strict=True):
            coded = window.encode("utf-32-le", "surrogatepass")
            out += [(number, low, high, s, hashlib.blake2b(coded[4 * s : 4 * (s + LEAST)], digest_size=16).digest()) for s in range(len(window) - LEAST + 1)]
        schema = pa.schema([("id", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("s", pa.int32()), ("gram", pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


def covered(spans: object) -> object:
    """Characters in the union of an array of (start, end) structs, as a column."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum"))
    add = lambda acc, x: F.struct(
        F.greatest(acc["to"], x["end"]).alias("to"), (acc["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).alias("sum")
    )
    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["sum"])


def window_spans(distinct: DataFrame, group: int, shard_chars: int) -> DataFrame:
    """(id, s, e): the stretches of distinct windows (anchor, id, window, core, low, high) that other owners have too."""
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("count"))
    crowded = checkpointed(sizes.where(F.col("count") > group).select("anchor"))
    columns = ["key", "id", "window", "core", "low", "high"]
    routed, counted = distinct.join(crowded, "anchor", "left_anti").withColumnRenamed("anchor", "key").select(*columns), None
    if not crowded.isEmpty():
        parts = stored(distinct.join(crowded, "anchor", "left_semi").mapInArrow(_parts, "key long, id binary, window string, core int, low long, high long"))
        full = checkpointed(parts.groupBy("key").agg(F.count("*").alias("count")).where(F.col("count") > group).select("key"))
        routed = routed.unionAll(spread_join(parts, full.withColumn("full", F.lit(True)), ["key"]).where("full is null").select(*columns))
        if not full.isEmpty():
            left = spread_join(parts, full.withColumn("full", F.lit(True)), ["key"], "inner").select("id").distinct()
            grams = stored(distinct.join(left, "id", "left_semi").mapInArrow(_grams, "id binary, low long, high long, s int, gram binary"))
            # Owners are combined before the shuffle, so a stretch of very many windows is a row a task.
            several = grams.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("gram")
            counted = spread_join(grams, several, ["gram"], "inner").select("id", "s", (F.col("s") + LEAST).alias("e"))
    chars = routed.agg(F.sum(F.length("window")).alias("n")).first()["n"] or 0
    shards = max(1, int(chars // shard_chars) + 1)
    found = routed.repartition(shards, "key").mapInPandas(_search, "id binary, s int, e int")
    return found if counted is None else found.unionAll(counted)


def class_spans(spark: SparkSession, sf_dir: str, group: int = 20_000, shard_chars: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, cls, size), and for each text (cls, size) that shares anything its spans."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where(F.length("text") >= LEAST)
    found = stored(docs.mapInArrow(_anchor_rows, ANCHORS))
    each = checkpointed(found.groupBy("doc_id", "cls", "size").agg(F.lit(1).alias("one")).drop("one"))
    texts = each.groupBy("cls", "size").agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") < F.max("doc_id")).alias("copied"))
    # The aggregates are combined before the shuffle, so an anchor of very many documents is no more than a row a task.
    least = max(1.0, found.count() * FREQUENT)
    seen = found.groupBy("anchor").agg((F.min("cls") < F.max("cls")).alias("common"), F.count("*").alias("count"))
    seen = stored(seen.where(F.col("common") | (F.col("count") > least)))
    common, often = seen.where("common").select("anchor"), seen.where(F.col("count") > least)
    near = sifted(found.select("anchor", "doc_id", "cls", "size", "place"), common, "anchor")
    hot = near.join(F.broadcast(often.where("common").select("anchor")), "anchor")  # at most 1 / FREQUENT anchors
    rare = near.join(F.broadcast(often.select("anchor")), "anchor", "left_anti").join(common, "anchor", "left_semi")
    # A text's first document stands for it.
    mine = hot.unionByName(rare).join(texts.select("doc_id", "cls", "size"), ["doc_id", "cls", "size"], "left_semi")
    mine = stored(mine.groupBy("doc_id", "cls", "size").agg(F.collect_list(F.struct("anchor", "place")).alias("found")))
    windows = stored(sifted(docs, mine.select("doc_id"), "doc_id").join(mine, "doc_id").select("text", "cls", "size", "found").mapInArrow(_windows, WINDOWS))
    distinct = stored(windows.groupBy("anchor", "id", "core").agg(F.any_value("window").alias("window"), F.min("cls").alias("low"), F.max("cls").alias("high")))
    # At most one stretch for each end in a window.
    spans = stored(window_spans(distinct, group, shard_chars).groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    placed = spread_join(windows.select("id", "cls", "size", "start"), spans, ["id"], "inner")
    at = F.transform("spans", lambda x: F.struct((F.col("start") + x["s"]).alias("start"), (F.col("start") + x["e"]).alias("end")))
    whole = texts.where("copied").select("cls", "size", F.struct(F.lit(0).alias("start"), F.col("size").alias("end")).alias("span"))
    every = placed.select("cls", "size", F.explode(at).alias("span")).unionAll(whole)
    return each, every.groupBy("cls", "size").agg(F.collect_set("span").alias("spans"))


def shared_spans(spark: SparkSession, sf_dir: str, group: int = 20_000, shard_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, start, end) of the stretches of documents.text that stand in another document too, overlaps not merged."""
    each, spans = class_spans(spark, sf_dir, group, shard_chars)
    return spread_join(each, spans, ["cls", "size"], "inner").select("doc_id", F.inline("spans"))


def find_shared(spark: SparkSession, sf_dir: str, group: int = 20_000, shard_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, shared_chars): code points of each document in spans of LEAST or more that another document has."""
    each, spans = class_spans(spark, sf_dir, group, shard_chars)
    sums = spans.select("cls", "size", covered(F.col("spans")).cast("int").alias("shared_chars")).where("shared_chars > 0")
    return spread_join(each, sums, ["cls", "size"], "inner").select("doc_id", "shared_chars").groupBy("doc_id").agg(F.max("shared_chars").alias("shared_chars"))
