"""Mixing sources to target shares of all tokens (problem 7).

Tokens are summed per source.  The size of the mix is the greatest at which every source with records reaches its share
without a record being used more than ``max_repeats`` times, unless a size is given; a source that can't reach its share
of a given size is used up to its cap.  A source's rate is what it must give divided by what it has; each document comes
floor(rate) times, and once more if a hash of its number, seeded, falls below the fraction: one Bernoulli draw a
document, whatever its length, so that a source reaches its share in expectation.  The shares reached are reported.

Documents without a source, or of a source without a target, are not used; a target without records gets share 0 and
the others keep their proportions.  Null texts are not used.  Repeated rows are records of their own, drawn alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.tokens import VOCABULARY, with_tokens
from folioforge.session import checkpointed, table

SCALE = 1 << 40


class Mix:
    """The rates of a mix and the documents it takes."""

    def __init__(self, spark: SparkSession, sf_dir: str, total: float | None = None, seed: int = 1, vocabulary: str = VOCABULARY):
        targets = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in table(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats").where("source is not null").collect()}
        docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").where("text is not null")
        docs = docs.where(F.col("source").isin(*targets)) if targets else docs.where("false")
        self.docs = checkpointed(with_tokens(docs, vocabulary))
        # One row per target at most, whatever the number of documents; sums are combined before the shuffle.
        have = {r[0]: (r[1] or 0, r[2]) for r in self.docs.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
        usable = {s: t for s, t in targets.items() if have.get(s, (0, 0))[0] > 0 and t[0] > 0 and t[1] > 0}
        reached = sum(share for share, _ in usable.values()) or 1.0
        most, scarcest = min(((cap * have[s][0] / (share / reached), s) for s, (share, cap) in usable.items()), default=(0.0, None))
        self.total = most if total is None else total
        # The source that holds the mix to its size; none where a size is given.
        self.limiting = scarcest if total is None else None
        self.rates = {s: min(float(cap), share / reached * self.total / have[s][0]) for s, (share, cap) in usable.items()}
        self.targets, self.have, self.seed, self.spark = targets, have, seed, spark

    def documents(self) -> DataFrame:
        """(doc_id, source, tokens, copy): each use of each document; copies are numbered from 1."""
        rows = [(s, int(rate), rate - int(rate)) for s, rate in sorted(self.rates.items())]
        rated = self.docs.join(F.broadcast(self.spark.createDataFrame(rows, "source string, whole int, fraction double")), "source")  # one row per target
        luck = F.pmod(F.xxhash64("doc_id", "tokens", F.lit(self.seed)), F.lit(SCALE)) / F.lit(float(SCALE))
        drawn = rated.withColumn("times", (F.col("whole") + (luck < F.col("fraction")).cast("int")).cast("int")).where("times > 0")
        return drawn.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))

    def shares(self) -> DataFrame:
        """Per target: share wanted and reached, tokens, documents and the greatest number of uses of one; in each row also
        the tokens wanted of the whole mix and the source that limits them."""
        used = self.documents().groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("uses"), F.max("copy").alias("most_repeats"))
        wanted = self.spark.createDataFrame(
            [(s, share, cap, int(self.have.get(s, (0, 0))[0]), self.rates.get(s, 0.0)) for s, (share, cap) in sorted(self.targets.items())],
            "source string, target_share double, max_repeats int, source_tokens long, rate double",
        )
        out = wanted.join(used, "source", "left").fillna(0, ["mixed_tokens", "uses", "most_repeats"])
        whole = out.agg(F.sum("mixed_tokens").alias("all_tokens"))
        # ``whole`` is one row.
        return out.join(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens").withColumns({"mix_tokens": F.lit(float(self.total)), "limiting_source": F.lit(self.limiting).cast("string")})


def mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of documents in the greatest exact mix."""
    return Mix(spark, sf_dir).documents()


def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares wanted and reached in the greatest exact mix."""
    return Mix(spark, sf_dir).shares()
