"""One text per printed item from several engines' readings, with agreement and reliability (problem 2).

Each engine's vote on an item is right with probability sigmoid(skill x easiness): a skill for each engine and each
class of the confidence it reports (so an engine that is sure of its errors earns nothing by being sure), an easiness
for each item.  Gradient expectation-maximisation learns both jointly, together with the weights of a prior over the
competing texts (how common a text is in the whole table, whether the word list has it).  Posteriors give the labels.

Votes on the same item by the same engine with the same text count once, whatever their number.  Null texts and items
are no votes.  Votes that differ only in the form of their characters (problem 4) are equal.  Ties go to the text that
sorts first.  Agreement is corrected for the chance that two texts drawn from the whole table are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.forms import clean, is_clean, script_of
from folioforge.llm.kinds import STRIP, vocabulary
from folioforge.session import checkpointed, table

#: Lower edges of the classes of reported confidence; class 0 is for votes without one.
EDGES = (0.0, 0.7, 0.8, 0.87, 0.91, 0.95)
CLASSES = len(EDGES) + 1
ROUNDS = 8
_ITEM = pa.schema([("item_id", pa.int64()), ("forms", pa.list_(pa.string())), ("listed", pa.list_(pa.bool_())), ("who", pa.list_(pa.int32())), ("what", pa.list_(pa.int32()))])
ITEM = "item_id long, forms array<string>, listed array<boolean>, who array<int>, what array<int>"


def _cleaned(batches: Iterable[pa.RecordBatch], words: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """From (item_id, votes [who, text]): the competing clean forms, sorted, and each vote's engine class and form."""
    memo: dict[str, str] = {}
    for batch in batches:
        out = []
        for item, votes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts = [v["text"] for v in votes]
            if not all(map(is_clean, texts)):
                around = script_of("".join(texts))
                texts = [memo.setdefault((t, around), clean(t, around)) for t in texts]
                if len(memo) > 200_000:
                    memo.clear()
            forms = sorted(set(texts))
            cast = sorted({(v["who"], forms.index(t)) for v, t in zip(votes, texts, strict=True)})
            out.append((item, forms, [f.strip(STRIP).lower() in words for f in forms], [w for w, _ in cast], [k for _, k in cast]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, _ITEM, strict=True)], schema=_ITEM)


class Votes:
    """A batch of items as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        col = {n: batch.column(n) for n in batch.schema.names}
        self.items = col["item_id"]
        sizes = np.diff(col["forms"].offsets.to_numpy())
        self.n, self.size = len(sizes), sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.item_of_form = np.repeat(np.arange(self.n), sizes)
        self.forms = col["forms"].flatten()
        known = np.asarray(col["listed"].flatten().to_numpy(zero_copy_only=False), float)
        count = np.asarray(col["counts"].flatten().to_numpy(zero_copy_only=False), float)
        self.feats = np.column_stack([np.log1p(count), known])
        cast = np.diff(col["who"].offsets.to_numpy())
        self.item = np.repeat(np.arange(self.n), cast)
        self.who = col["who"].flatten().to_numpy()
        self.form = col["what"].flatten().to_numpy() + self.first[self.item]
        self.spread = np.log(np.maximum(sizes - 1, 1))

    def expect(self, skill: np.ndarray, prior: np.ndarray, steps: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of the forms, the prior's probabilities, and the items' easiness by gradient steps from 1."""
        log_prior = self.feats @ prior
        b = np.zeros(self.n)
        for step in range(steps):
            ease = np.exp(b)
            x = skill[self.who] * ease[self.item]
            score = log_prior + np.bincount(self.form, x + self.spread[self.item], len(log_prior))
            post = self.normal(score)
            if step < steps - 1:
                p = 1 / (1 + np.exp(-x))
                grad = np.bincount(self.item, (post[self.form] - p) * x, self.n) - b / 0.25
                curve = np.bincount(self.item, p * (1 - p) * x * x, self.n) + 1 / 0.25
                b = np.clip(b + grad / curve, -1.5, 1.0)
        return post, self.normal(log_prior), ease

    def normal(self, score: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(score, self.first)
        e = np.exp(score - top[self.item_of_form])
        return e / np.add.reduceat(e, self.first)[self.item_of_form]


def _gradients(batches: Iterable[pa.RecordBatch], skill: np.ndarray, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over items of the gradients and curvatures of the expected likelihood, one row per parameter."""
    total = np.zeros((2, len(skill) + len(prior)))
    for batch in batches:
        if not batch.num_rows:
            continue
        v = Votes(batch)
        post, pi, ease = v.expect(skill, prior)
        e = ease[v.item]
        p = 1 / (1 + np.exp(-skill[v.who] * e))
        total[0, : len(skill)] += np.bincount(v.who, (post[v.form] - p) * e, len(skill))
        total[1, : len(skill)] += np.bincount(v.who, p * (1 - p) * e * e, len(skill))
        total[0, len(skill) :] += (post - pi) @ v.feats
        total[1, len(skill) :] += (pi * (1 - pi)) @ v.feats**2
    yield pa.RecordBatch.from_pydict({"k": list(range(total.shape[1])), "grad": total[0], "curve": total[1]}, schema=pa.schema([("k", pa.int32()), ("grad", pa.float64()), ("curve", pa.float64())]))


def _labels(batches: Iterable[pa.RecordBatch], skill: np.ndarray, prior: np.ndarray, chance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        v = Votes(batch)
        post, _, ease = v.expect(skill, prior)
        top = np.maximum.reduceat(post, v.first)
        order = np.flatnonzero(post == top[v.item_of_form])
        pick = order[np.unique(v.item_of_form[order], return_index=True)[1]]  # forms are sorted: the first of equals
        n = np.bincount(v.item, minlength=v.n)
        per = np.bincount(v.form, minlength=len(post))
        same = np.add.reduceat((per * (per - 1)).astype(float), v.first) / np.maximum(n * (n - 1), 1)
        yield pa.RecordBatch.from_pydict(
            {"item_id": v.items, "label": v.forms.take(pa.array(pick)), "posterior": post[pick], "easiness": ease, "agreement": (same - chance) / (1 - chance), "n_votes": n, "n_forms": v.size},
            schema=pa.schema([("item_id", pa.int64()), ("label", pa.string()), ("posterior", pa.float64()), ("easiness", pa.float64()), ("agreement", pa.float64()), ("n_votes", pa.int32()), ("n_forms", pa.int32())]),
        )


LABEL = "item_id long, label string, posterior double, easiness double, agreement double, n_votes int, n_forms int"


class Consensus:
    """The learned model over the items of a data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, rounds: int = ROUNDS):
        words = vocabulary(spark, sf_dir)
        self.spark = spark
        self.engines = sorted(r[0] for r in table(spark, sf_dir, "engines", "engine_name").where("engine_name is not null").distinct().collect())
        votes = table(spark, sf_dir, "words", "item_id", "engine_name", "text", "confidence").where("item_id is not null and text is not null and text <> ''")
        number = F.coalesce(*[F.when(F.col("engine_name") == e, F.lit(i)) for i, e in enumerate(self.engines)], F.lit(len(self.engines)))
        level = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0).otherwise(sum((F.col("confidence") >= e).cast("int") for e in EDGES))
        votes = votes.select("item_id", F.struct((number * CLASSES + level).cast("int").alias("who"), "text").alias("vote"))
        # Copies of a delivery fall together before the shuffle already.
        items = checkpointed(votes.groupBy("item_id").agg(F.collect_set("vote").alias("votes")).withColumn("differ", F.size(F.array_distinct("votes.text")) > 1))
        self.same = items.where("not differ")
        forms = items.where("differ").select("item_id", "votes").mapInArrow(lambda it: _cleaned(it, words), ITEM)
        counts = table(spark, sf_dir, "words", "text").groupBy("text").agg(F.count("*").alias("n"))
        chance = counts.where("text is not null").agg((F.sum(F.col("n").cast("double") ** 2) / F.sum("n").cast("double") ** 2).alias("p")).first()["p"]
        self.chance = min(float(chance or 0.0), 0.99)
        each = forms.select("item_id", F.posexplode("forms").alias("k", "text"), "listed", "who", "what")
        each = each.join(counts, "text", "left").groupBy("item_id").agg(
            F.array_sort(F.collect_list(F.struct("k", "text", F.coalesce("n", F.lit(0)).alias("n")))).alias("f"),
            F.first("listed").alias("listed"), F.first("who").alias("who"), F.first("what").alias("what"),
        )
        self.items = checkpointed(each.select("item_id", F.col("f.text").alias("forms"), F.col("f.n").cast("array<double>").alias("counts"), "listed", "who", "what"))
        self.base = np.zeros((len(self.engines) + 1) * CLASSES)
        for who, n in self.same.select(F.explode("votes.who").alias("who")).groupBy("who").count().collect():  # one row per engine and class
            self.base[who] = n
        self.skill, self.prior = np.full(len(self.base), 2.5), np.array([0.3, 0.5])
        for _ in range(rounds):
            self.step()

    def step(self) -> None:
        skill, prior = self.skill, self.prior
        grad = self.items.mapInArrow(lambda it: _gradients(it, skill, prior), "k int, grad double, curve double").groupBy("k").agg(F.sum("grad"), F.sum("curve"))
        g, h = np.zeros((2, len(skill) + len(prior)))
        for k, a, b in grad.collect():  # one row per parameter
            g[k], h[k] = a, b
        n, p = len(skill), 1 / (1 + np.exp(-skill))
        gs, hs = g[:n] + self.base * (1 - p) - (skill - 2.5) / 1.0, h[:n] + self.base * p * (1 - p) + 1.0
        self.skill = skill + np.clip(gs / hs, -1, 1)
        self.prior = np.clip(prior + np.clip((g[n:] - (prior - [0.3, 0.5]) * 5) / (h[n:] + 5), -0.3, 0.3), 0.0, 4.0)

    def disputed(self) -> DataFrame:
        """Labels of the items with different texts as delivered; n_forms is 1 where only characters differed."""
        skill, prior, chance = self.skill, self.prior, self.chance
        return self.items.mapInArrow(lambda it: _labels(it, skill, prior, chance), LABEL)

    def labels(self) -> DataFrame:
        """Label, posterior, easiness and chance-corrected agreement of every item."""
        agreed = self.same.select(
            "item_id", F.element_at("votes.text", 1).alias("label"), F.lit(1.0).alias("posterior"), F.lit(1.0).alias("easiness"),
            F.lit(1.0).alias("agreement"), F.size("votes").alias("n_votes"), F.lit(1).alias("n_forms"),
        )
        return agreed.mapInArrow(_tidy, LABEL).unionAll(self.disputed())

    def reliability(self) -> DataFrame:
        """Per engine: votes, expected share of right votes, mean skill, and agreement with the labels beyond chance."""
        skill, prior, n_engines = self.skill, self.prior, len(self.engines) + 1
        rows = self.items.mapInArrow(lambda it: _right(it, skill, prior), "who int, n double, right double").groupBy("who").agg(F.sum("n"), F.sum("right")).collect()
        n, right = self.base.copy(), self.base.copy()
        for who, a, b in rows:
            n[who] += a
            right[who] += b
        out = []
        for e, name in enumerate([*self.engines, None][:n_engines]):
            at = slice(e * CLASSES, (e + 1) * CLASSES)
            if n[at].sum():
                share = right[at].sum() / n[at].sum()
                out.append((name, int(n[at].sum()), float(share), float((n[at] * skill[at]).sum() / n[at].sum()), float((share - self.chance) / (1 - self.chance))))
        return self.spark.createDataFrame(out, "engine_name string, n_votes long, reliability double, skill double, chance_corrected double")


def _tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = pa.array([t if is_clean(t) else clean(t) for t in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), labels, *batch.columns[2:]], names=batch.schema.names)


def _right(batches: Iterable[pa.RecordBatch], skill: np.ndarray, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, right = np.zeros((2, len(skill)))
    for batch in batches:
        if batch.num_rows:
            v = Votes(batch)
            post = v.expect(skill, prior)[0]
            n += np.bincount(v.who, minlength=len(skill))
            right += np.bincount(v.who, post[v.form], len(skill))
    yield pa.RecordBatch.from_pydict({"who": pa.array(range(len(skill)), pa.int32()), "n": n, "right": right})


def find_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, label) of the items that engines read differently in clean form."""
    return Consensus(spark, sf_dir).disputed().where("n_forms > 1").select("item_id", "label")
