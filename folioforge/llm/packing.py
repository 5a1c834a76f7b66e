"""Filling containers of fixed capacity with documents (problem 6).

Minimum bin slack: each container starts with the largest item left; subset-sum dynamic programming over the lengths
left, as a bit set, then finds the fullest feasible combination with it, which is taken out.  A text larger than the
capacity is cut into pieces of the capacity and a rest that is packed like any item; no other text is split.

Items are spread over shards by a hash of their number, so that a task packs a bounded number of them; each shard
leaves about one container that is not full.  Null and empty texts need no room and are left out.  Rows that are
repeated are items of their own.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.tokens import VOCABULARY, with_tokens
from folioforge.session import checkpointed, table

SHARD_ITEMS = 5000


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """Lengths whose sum is the greatest that fits into ``room``; ``lengths`` are distinct and descending."""
    reach, steps = 1, []
    keep = (1 << room + 1) - 1
    goal = 1 << room
    for n in lengths:
        if n > room:
            continue
        count, size = min(left[n], room // n), 1
        while count > 0:
            size = min(size, count)
            wider = (reach | reach << n * size) & keep
            if wider != reach:
                steps.append((reach, n, size))
                reach = wider
            count -= size
            size *= 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, []
    for before, n, size in reversed(steps):
        if not before >> at & 1:
            chosen += [n] * size
            at -= n * size
    return chosen


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (item, piece, size); every item is in one of them, cut only if it exceeds the capacity."""
    bins: list[list[tuple[int, int, int]]] = []
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, n in enumerate(sizes):
        pieces, rest = divmod(n, capacity) if n > capacity else (0, n)
        bins += [[(item, k, capacity)] for k in range(pieces)]
        if rest:
            waiting[rest].append((item, pieces))
    left = {n: len(x) for n, x in waiting.items()}
    lengths = sorted(left, reverse=True)
    while lengths:
        first = lengths[0]
        left[first] -= 1
        taken = [first, *fullest(capacity - first, lengths if left[first] else lengths[1:], left)]
        for n in taken[1:]:
            left[n] -= 1
        bins.append([(*waiting[n].pop(), n) for n in taken])
        if any(not left[n] for n in taken):
            lengths = [n for n in lengths if left[n]]
    return bins


def _pack_shard(pdf: pd.DataFrame, kinds: list[tuple[str, int]]) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
    ids, sizes, shard = pdf["doc_id"].tolist(), pdf["tokens"].tolist(), int(pdf["shard"].iloc[0])
    rows = []
    for name, capacity in kinds:
        for b, content in enumerate(pack(sizes, capacity)):
            rows += [(name, capacity, f"{shard}-{b}", ids[i], k, n) for i, k, n in content]
    return pd.DataFrame(rows, columns=["container", "capacity_tokens", "bin", "doc_id", "piece", "tokens"])


def pack_documents(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, capacity_tokens, bin, doc_id, piece, tokens): which documents, or pieces, share a container."""
    kinds = [(r[0], int(r[1])) for r in table(spark, sf_dir, "pack_sizes", "container", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()]
    items = with_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary).where("tokens > 0")
    shards = table(spark, sf_dir, "documents", "doc_id").count() // shard_items + 1
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)))
    schema = "container string, capacity_tokens int, bin string, doc_id long, piece int, tokens long"
    # As many partitions as shards: by their few bytes they would all be put into one task.
    return sharded.repartition(int(shards), "shard").groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, kinds), schema)


def packing_report(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per kind of container: containers, documents, tokens, and the share of room that is used."""
    packed = checkpointed(pack_documents(spark, sf_dir, vocabulary))
    total = packed.groupBy("container", "capacity_tokens", "bin").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    return total.groupBy("container", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("fill"), F.count_if(F.col("used") == F.col("capacity_tokens")).alias("full"),
    )
