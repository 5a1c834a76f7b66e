"""Statistics of a text and its kind: prose, list, table or junk (problem 5).

Thresholds on the statistics are taken as noisy labelling functions, none of which decides by itself.  How often each of
them fires on each kind of text is learned by expectation-maximisation from their agreements over all records; a
record's kind is the one of greatest posterior probability.  Only counts of the vote patterns that occur (at most 2**16,
some seventy in practice) reach the driver, whatever the number of records.

Null and empty texts, and texts without a word, are prose of probability 0.  Of kinds that are equally probable the
first of KINDS counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import checkpointed, table

KINDS = ("prose", "list", "table", "junk")
#: The statistics, in the order of ``text_stats``.  Shares are of the characters, in lines of that make.
STATS = (
    "n_chars", "n_words", "n_lines", "mean_word_len", "symbol_ratio", "numeric_ratio", "odd_ratio", "common_ratio", "end_punct_ratio", "words_per_line", "sentence_ratio",
    "item_share", "entry_share", "number_share", "gap_share", "end_number_share", "leader_share", "short_share",
)
EMPTY = -1

_NUM = r"[(\[]?[0-9lIOoSZ]*[0-9][0-9lIOoSZ]*(?:[./,][0-9lIOoSZ]+)*[)\]]?"
NUMERIC = regex.compile(rf"(?:{_NUM}|[-–—|])[.,;:]?$")
#: Digits as they may be misread.
DIGITS = frozenset("0123456789lIO")
MARK = regex.compile(r"(?:[-*•·–]|[0-9lIO]{1,3}[.)])$")
ODD = regex.compile(r"\p{Ll}\p{Lu}|\p{L}\d|\d\p{L}|\p{Lu}{2}\p{Ll}|^[^\p{L}\d]+$")
SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-]")
SENTENCE = regex.compile(r"\p{Ll}{2}[.!?;]$")
STRIP = " \t.,;:!?'\"()[]{}*•·|-—¬="


_STEP = 32
_FIELD = (1 << _STEP) - 1


class Tokens(dict):
    """What each distinct token adds to the counts of its line, packed into one number and worked out once.

    From the lowest bits, _STEP bits each: listed words, numbers, odd tokens, ends of sentences, marks of items, symbols.
    """

    def __init__(self, words: frozenset[str]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:  # bounds the memory; tokens are simply worked out again
            self.clear()
        number = bool(NUMERIC.match(token))
        known = token.strip(STRIP).lower() in self.words
        odd = not number and not known and bool(ODD.search(token))
        packed = known | number << _STEP | odd << 2 * _STEP | bool(SENTENCE.search(token)) << 3 * _STEP | bool(MARK.match(token)) << 4 * _STEP | len(SYMBOL.findall(token)) << 5 * _STEP
        self[token] = packed
        return packed


_tokens: Tokens | None = None


def tokens_of(words: frozenset[str]) -> Tokens:
    """The token table of a word list, one per Python worker."""
    global _tokens
    if _tokens is None or _tokens.words is not words and _tokens.words != words:
        _tokens = Tokens(words)
    return _tokens


def text_stats(text: str, words: frozenset[str]) -> tuple:
    """The numbers of STATS for one text; all zero for an empty one."""
    n_words = n_lines = ends = total = counts = 0
    item = entry = number = gap = end_number = leader = short = 0
    get = tokens_of(words).__getitem__
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            continue
        n, size, last = len(tokens), len(line), tokens[-1]
        packed = sum(map(get, tokens))
        counts += packed
        n_lines += 1
        total += size
        n_words += n
        numeric = packed >> _STEP & _FIELD
        ends += last[-1] in ".!?;:,\"')"
        end_number += size * (last.rstrip(",")[-1:] in DIGITS)
        if n <= 4:
            short += size
        if n > 1:
            item += size * (get(tokens[0]) >> 4 * _STEP & 1)
            entry += size * (numeric == 1 and get(last) >> _STEP & 1)
        if 2 * numeric >= n:
            number += size
        if "\t" in line or " | " in line or "  " in line.strip():
            gap += size
        if "..." in line or "···" in line or "•••" in line:
            leader += size
    if not total:
        return (len(text),) + (0,) * (len(STATS) - 1)
    common, numeric, odd, sentences = (counts >> k * _STEP & _FIELD for k in range(4))
    symbols = counts >> 5 * _STEP
    return (
        len(text), n_words, n_lines, (total - n_words - symbols) / n_words, symbols / total, numeric / n_words, odd / n_words, common / n_words, ends / n_lines, n_words / n_lines, sentences / n_words,
        item / total, entry / total, number / total, gap / total, end_number / total, leader / total, short / total,
    )


#: The labelling functions: a statistic, a threshold, and how often it is expected to be above it in prose, lists, tables
#: and junk, which is where the learning starts.
FUNCTIONS = (
    ("item_share", 0.5, (0.02, 0.60, 0.02, 0.05)),
    ("entry_share", 0.5, (0.03, 0.50, 0.02, 0.05)),
    ("number_share", 0.5, (0.02, 0.05, 0.95, 0.02)),
    ("gap_share", 0.5, (0.02, 0.05, 0.70, 0.05)),
    ("numeric_ratio", 0.4, (0.02, 0.05, 0.95, 0.02)),
    ("numeric_ratio", 0.12, (0.05, 0.60, 0.95, 0.10)),
    ("symbol_ratio", 0.2, (0.02, 0.02, 0.05, 0.60)),
    ("odd_ratio", 0.35, (0.02, 0.05, 0.02, 0.90)),
    ("common_ratio", 0.4, (0.95, 0.90, 0.05, 0.03)),
    ("common_ratio", 0.82, (0.85, 0.15, 0.02, 0.02)),
    ("sentence_ratio", 0.012, (0.95, 0.10, 0.05, 0.05)),
    ("words_per_line", 9.0, (0.60, 0.02, 0.05, 0.10)),
    ("leader_share", 0.25, (0.02, 0.30, 0.02, 0.02)),
    ("mean_word_len", 3.0, (0.97, 0.95, 0.60, 0.40)),
    ("end_number_share", 0.5, (0.05, 0.50, 0.90, 0.10)),
    ("short_share", 0.5, (0.05, 0.40, 0.50, 0.05)),
)
PRIOR = np.array([expected for _, _, expected in FUNCTIONS])
_TESTS = tuple((STATS.index(name), least, 1 << k) for k, (name, least, _) in enumerate(FUNCTIONS))


def votes(stats: tuple) -> int:
    """The labelling functions' votes on one record as bits; EMPTY where there is no word."""
    return sum(bit for i, least, bit in _TESTS if stats[i] > least) if stats[1] else EMPTY


def kind_bits(text: str | None, words: frozenset[str]) -> int:
    """The votes on one text; EMPTY for null and empty ones."""
    return votes(text_stats(text, words)) if text else EMPTY


def fit_kinds(counts: dict[int, int], rounds: int = 60, weight: float = 0.1, base: float = 20.0) -> dict[int, tuple[str, float]]:
    """Kind and its posterior for each vote pattern, learned from how often each pattern occurs.

    PRIOR counts as ``base`` records of each kind and ``weight`` of the data's own, so that a kind which is rare or
    absent in the data keeps its meaning.  EMPTY is prose of probability 0.
    """
    patterns = sorted(p for p in counts if p >= 0)
    result: dict[int, tuple[str, float]] = {EMPTY: ("prose", 0.0)}
    if not patterns:
        return result
    n = np.array([counts[p] for p in patterns], float)
    x = np.array([[p >> j & 1 for j in range(len(PRIOR))] for p in patterns], float)
    fires, share = PRIOR.copy(), np.array([0.85, 0.06, 0.06, 0.03])
    for _ in range(rounds):
        log = np.log(share) + x @ np.log(fires) + (1 - x) @ np.log(1 - fires)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post.T @ n
        extra = weight * mass + base
        fires = ((n[:, None] * x).T @ post + PRIOR * extra) / (mass + extra)
        fires = fires.clip(1e-3, 1 - 1e-3)
        share = (mass + 1) / (mass + 1).sum()
    for p, row in zip(patterns, post, strict=True):
        result[p] = (KINDS[int(row.argmax())], float(row.max()))
    return result


# ------------------------------------------------------------------------------------------------ Spark operators


def vocabulary(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The words of the fixed word list, lower case; the list does not grow with the data."""
    return frozenset(r[0] for r in table(spark, sf_dir, "wordlist", F.lower("word").alias("word")).where("word is not null").distinct().collect())


def kinds_of(bits: DataFrame) -> dict[int, tuple[str, float]]:
    """Learns the kinds from a column ``bits`` of all records; at most 2**16 + 1 counts come to the driver."""
    return fit_kinds({r["bits"]: r["count"] for r in bits.groupBy("bits").count().collect()})


def with_kind(df: DataFrame, kinds: dict[int, tuple[str, float]]) -> DataFrame:
    """Adds ``kind`` and ``kind_prob`` by the column ``bits``."""
    cases = [(b, k, p) for b, (k, p) in kinds.items()]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(cases, "bits int, kind string, kind_prob double")), "bits", "left")


RECORD = "tab string, rec_id long, text string"


def records(spark: SparkSession, sf_dir: str, *tabs: str) -> DataFrame:
    """(tab, rec_id, text) of the named tables; the paragraphs of a region are its lines, null ones empty."""
    parts = {
        "documents": lambda: table(spark, sf_dir, "documents", F.lit("documents").alias("tab"), F.col("doc_id").alias("rec_id"), "text"),
        "readings": lambda: table(spark, sf_dir, "readings", F.lit("readings").alias("tab"), F.col("reading_id").alias("rec_id"), F.col("full_text").alias("text")),
        "page_regions": lambda: table(
            spark, sf_dir, "page_regions", F.lit("page_regions").alias("tab"), F.col("region_id").alias("rec_id"),
            F.array_join(F.transform("paragraphs", lambda p: F.translate(F.coalesce(p, F.lit("")), "\n", " ")), "\n").alias("text"),
        ),
    }
    out = parts[tabs[0]]()
    for t in tabs[1:]:
        out = out.unionAll(parts[t]())
    return out


_STATS_SCHEMA = "tab string, rec_id long, bits int, " + ", ".join(f"{s} double" for s in STATS)


def _stats(batches: Iterable[pa.RecordBatch], words: frozenset[str]) -> Iterator[pa.RecordBatch]:
    from folioforge.llm.forms import clean

    for batch in batches:
        rows = [text_stats(clean(t) or "", words) for t in batch.column(2).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [[] for _ in STATS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(votes, rows), pa.int32()), *(pa.array(c, pa.float64()) for c in (map(float, c) for c in cols))],
            names=["tab", "rec_id", "bits", *STATS],
        )


def text_statistics(spark: SparkSession, sf_dir: str, *tabs: str) -> DataFrame:
    """One row per record with the numbers of STATS and the votes; nulls count as empty texts."""
    words = vocabulary(spark, sf_dir)
    return records(spark, sf_dir, *(tabs or ("documents", "readings", "page_regions"))).mapInArrow(lambda it: _stats(it, words), _STATS_SCHEMA)


def text_kinds(spark: SparkSession, sf_dir: str, *tabs: str) -> DataFrame:
    """``text_statistics`` with the learned kind and its posterior; rows delivered twice give one row."""
    stats = checkpointed(text_statistics(spark, sf_dir, *tabs))
    return with_kind(stats, kinds_of(stats.select("bits"))).drop("bits").distinct()


def find_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, kind) of the records that are lists, tables or junk for the greater part."""
    stats = checkpointed(text_statistics(spark, sf_dir).select("tab", "rec_id", "bits"))
    return with_kind(stats, kinds_of(stats.select("bits"))).where("kind <> 'prose'").select("tab", "rec_id", "kind").distinct()
