"""Languages of documents, readings and their segments by cross parsing (problem 1).

A suffix automaton of labelled running text is built per language.  A text is parsed against each of them into longest
matches, which run on from word to word; the fewer phrases a language needs, normalised by the size of its text, the
closer it is.  Segments are the cheapest sequence of languages for the units of a text, each change of language costing
a fixed number.

The labelled text is that of a bounded sample of labelled documents (``sample`` rows, at most ``size`` characters a
language) and the words of the fixed word list.  As labels may be wrong, only stretches of lines are taken whose words
are about as common in the documents of that label as in those of any other.

Null and empty texts have no language; texts without a letter get none either.  Of languages that are equally cheap the
first by code counts.  What stands in brackets and quotation marks doesn't change the language of what holds it, and
lines that look like page furniture are no segments, as a record's segments are prose.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.automata import CrossParser, SuffixAutomaton
from folioforge.llm.forms import clean, leader, scripts_in, told
from folioforge.llm.furniture import looks_like_furniture
from folioforge.llm.kinds import kind_bits, kinds_of, records, vocabulary, with_kind
from folioforge.session import checkpointed, table

WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*")
QUOTED = regex.compile(r"\(\s*[\"“„«][^\"”“»]{1,600}[\"”“»]\s*\)")
PARAGRAPHS = regex.compile(r"\n[^\S\n]*\n\s*")
#: Rows of labelled documents that the automata are built from, and characters taken of them a language.
SAMPLE = 6000
SIZE = 20_000
#: Longest piece of a unit that is parsed in one go; a phrase ends where a piece does.
PIECE = 600


class Plain(dict):
    """What each distinct token leaves of itself as running text, worked out once: its words in small letters."""

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:  # bounds the memory; tokens are simply worked out again
            self.clear()
        found = self[token] = " ".join(WORD.findall(token)).lower()
        return found


_plain = Plain()


class LanguageModel:
    """The languages' automata, and the sizes of their texts."""

    def __init__(self, texts: dict[str, list[str]]):
        self.codes = sorted(texts)
        self.parser = CrossParser([SuffixAutomaton(f" {t} " for t in texts[c]) for c in self.codes])
        self.scale = np.array([math.log(sum(map(len, texts[c])) + len(texts[c]) + 2) for c in self.codes])

    def costs(self, units: list[list[str]]) -> np.ndarray:
        """Normalised phrases of each unit's tokens (rows) in each language (columns), and in the last column its words."""
        pieces: list[str] = []
        owner: list[int] = []
        words = np.zeros(len(units))
        for k, tokens in enumerate(units):
            if not (text := " ".join(filter(None, map(_plain.__getitem__, tokens)))):
                continue
            words[k] = text.count(" ") + 1
            while len(text) > PIECE:
                at = text.rfind(" ", 0, PIECE) + 1 or PIECE
                pieces.append(f" {text[:at].rstrip()} ")
                owner.append(k)
                text = text[at:]
            pieces.append(f" {text} ")
            owner.append(k)
        out = np.zeros((len(units), len(self.codes) + 1))
        if pieces:
            np.add.at(out[:, :-1], np.array(owner), self.parser.phrases(pieces) * self.scale)
        out[:, -1] = words
        return out

    def best(self, total: np.ndarray) -> tuple[int, float]:
        """The cheapest language of summed costs and its confidence, the posterior of an exponential code."""
        i = int(total.argmin())
        gap = np.exp(-(total - total[i]) / 8)
        return i, float(1 / gap.sum())


#: What a change of language costs, in normalised phrases.
CHANGE = 35.0


def smooth(costs: np.ndarray, main: int, change: float) -> list[int]:
    """The cheapest sequence of languages for successive units (rows) if each change of language costs ``change``."""
    n, k = costs.shape
    best, back = costs[0].copy(), np.zeros((n, k), int)
    best[np.arange(k) != main] += change / 2
    for i in range(1, n):
        other = int(best.argmin())
        stay = best <= best[other] + change
        back[i] = np.where(stay, np.arange(k), other)
        best = np.where(stay, best, best[other] + change) + costs[i]
    best[np.arange(k) != main] += change / 2
    path = [int(best.argmin())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def pays(gains: list[float], change: float) -> bool:
    """Whether a passage in other languages can be as cheap as the main language: whether units in a row gain together what
    their changes cost, of which ``smooth`` counts a half at each end of the text."""
    run, last = -np.inf, len(gains) - 1
    for i, g in enumerate(gains):
        run = max(run, -change if i else -change / 2) + g
        if run - (change if i < last else change / 2) >= -1e-6:
            return True
    return False


Found = tuple[str | None, float, list[tuple[int, str, float]]]


def languages_of(text: str | None, model: LanguageModel, by_line: bool, change: float = CHANGE) -> Found:
    """Language and confidence of a text, and (number, language, confidence) of the segments in another language.

    Segments are lines if ``by_line``, else paragraphs; a segment without a letter is none.
    """
    return languages_of_all([text], [by_line], model, change)[0]


def languages_of_all(texts: list[str | None], by_line: list[bool], model: LanguageModel, change: float = CHANGE) -> list[Found]:
    """``languages_of`` for many texts at once."""
    result: list[Found] = [(None, 0.0, [])] * len(texts)
    owner: list[int] = []  # text of each unit that has tokens
    number: list[int] = []  # its number in the text
    units: list[list[str]] = []
    raws: dict[int, list[str]] = {}
    for t, text in enumerate(texts):
        if not text:
            continue
        # Quotations in brackets don't change the language of what holds them; their line breaks stay.
        if "(" in text and ('("' in text or "(“" in text or "(„" in text or "(«" in text):
            text = QUOTED.sub(lambda m: "\n" * m[0].count("\n"), text)
        raws[t] = raw = text.split("\n") if by_line[t] else PARAGRAPHS.split(text) if "\n" in text else [text]
        for n, u in enumerate(raw):
            if tokens := u.split():
                owner.append(t)
                number.append(n)
                units.append(tokens)
    if not units:
        return result
    sums = model.costs(units)
    of = np.array(owner)
    first = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
    ends = np.concatenate([first[1:], [len(of)]])
    totals = np.add.reduceat(sums, first, axis=0)
    mains = totals[:, :-1].argmin(1)
    gaps = np.exp(-(totals[:, :-1] - totals[np.arange(len(mains)), mains][:, None]) / 8)
    sure = 1 / gaps.sum(1)
    each = np.repeat(mains, ends - first)
    others = sums[:, :-1].copy()
    others[np.arange(len(of)), each] = np.inf
    gains = sums[np.arange(len(of)), each] - others.min(1)
    deviates = [pays(gains[a:b].tolist(), change) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    for t, a, b, main, p, w, other in zip(of[first].tolist(), first.tolist(), ends.tolist(), mains.tolist(), sure.tolist(), totals[:, -1].tolist(), deviates, strict=True):
        if not w:
            continue
        parts: list[tuple[int, str, float]] = []
        if other and b - a > 1:
            costs, words = sums[a:b, :-1], sums[a:b, -1]
            path = smooth(costs, main, change)
            # The language of most words, which need not be the cheapest for the whole.
            main = int(np.bincount(path, words, len(model.codes)).argmax())
            for k, i in enumerate(path):
                if i != main and words[k] and not looks_like_furniture(raws[t][number[a + k]]):
                    parts.append((number[a + k] + 1, model.codes[i], model.best(costs[k])[1]))
        result[t] = (model.codes[main], p, parts)
    return result


def running_text(docs: list[tuple[str, str]], own: dict[str, set[str]], size: int) -> dict[str, list[str]]:
    """Of labelled documents (code, text) for each language the stretches of lines whose words are its own, nine in ten
    at least, as words with single blanks; each stretch once, until there are ``size`` characters."""
    texts: dict[str, list[str]] = defaultdict(list)
    seen: set[tuple[str, str]] = set()
    room = dict.fromkeys(own, size)
    script = {code: scripts_in(next(iter(sorted(words)), "")) for code, words in own.items()}
    for code, text in docs:
        stretch: list[str] = []
        for line in [*clean(text).split("\n"), None]:
            words = [w.lower() for w in WORD.findall(line or "")]
            if len(words) > 2 and 10 * sum(w in own[code] for w in words) >= 9 * len(words) and scripts_in("".join(words)) == script[code] and (code, key := " ".join(words)) not in seen:
                seen.add((code, key))
                stretch += words
            elif stretch and (line is None or words):
                part = " ".join(stretch)[: room[code]]
                texts[code] += [part] if part else []
                room[code] -= len(part)
                stretch = []
    return texts


def train(spark: SparkSession, sf_dir: str, sample: int = SAMPLE, size: int = SIZE) -> LanguageModel:
    """Learns the automata on the driver from the word list and about ``sample`` labelled documents, chosen by a hash of
    their numbers."""
    codes = {r[0] for r in table(spark, sf_dir, "languages", "code").collect()}
    listed: dict[str, set[str]] = defaultdict(set)
    for word, code in table(spark, sf_dir, "wordlist", "word", "lang").where("lang is not null and word is not null").collect():
        listed[code].add(word.lower())
    part = min(1.0, sample / max(table(spark, sf_dir, "documents", "doc_id").count(), 1))
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("luck"))
    docs = docs.where(F.col("lang").isin(*sorted(codes or {""})) & F.col("text").isNotNull() & (F.col("luck") < int(part * (1 << 20)) + 1))
    drawn = [(r["lang"], r["text"]) for r in docs.orderBy("luck", "doc_id").limit(2 * sample).collect()]
    seen: dict[str, Counter] = defaultdict(Counter)
    count = Counter(code for code, _ in drawn)
    for code, text in drawn:
        seen[code].update({w.lower() for w in WORD.findall(clean(text))})
    rate: dict[str, float] = defaultdict(float)
    for code, words in seen.items():
        for w, n in words.items():
            rate[w] = max(rate[w], n / (count[code] + 10))
    own = {code: {w for w, n in words.items() if n >= 2 and n / (count[code] + 10) > 0.25 * rate[w]} | listed[code] for code, words in seen.items() if count[code] >= 30}
    for code, words in own.items():
        # Words in letters of another script than the language's, as numerals are, are no part of its text.
        script = leader([sum(x) for x in zip(*map(told, words), strict=True)]) if words else ""
        own[code] = {w for w in words if scripts_in(w) == script} if script else words
    running = running_text([d for d in drawn if d[0] in own], own, size)
    texts = {c: [*running.get(c, ()), *sorted(listed[c])] for c in sorted(set(listed) | set(running))}
    return LanguageModel({c: t for c, t in texts.items() if t})


SCHEMA = "tab string, rec_id long, seg int, code string, confidence double, bits int, lang string"
_ARROW = pa.schema([("tab", pa.string()), ("rec_id", pa.int64()), ("seg", pa.int32()), ("code", pa.string()), ("confidence", pa.float64()), ("bits", pa.int32()), ("lang", pa.string())])


def _identify(batches: Iterable[pa.RecordBatch], model: LanguageModel, words: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            tabs, recs, raw, langs = (whole.column(i).slice(at, 500).to_pylist() for i in range(4))
            texts = [clean(t) for t in raw]
            found = languages_of_all(texts, [t == "readings" for t in tabs], model)
            out: list[tuple] = []
            for tab, rec, text, lang, (code, sure, parts) in zip(tabs, recs, texts, langs, found, strict=True):
                bits = kind_bits(text, words)
                out.append((tab, rec, 0, code, sure, bits, lang))
                out += [(tab, rec, n, c, p, bits, lang) for n, c, p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, _ARROW, strict=True)], schema=_ARROW)


def identify_languages(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> DataFrame:
    """One row per record (seg 0) and per segment in another language, with code, confidence, delivered lang and kind.

    Rows delivered twice give one row.  Records without words have code null and confidence 0.
    """
    words = vocabulary(spark, sf_dir)
    model = spark.sparkContext.broadcast(train(spark, sf_dir, sample))  # its size is bounded by the word list and the sample
    docs = table(spark, sf_dir, "documents", F.lit("documents").alias("tab"), F.col("doc_id").alias("rec_id"), "text", "lang")
    reads = table(spark, sf_dir, "readings", F.lit("readings").alias("tab"), F.col("reading_id").alias("rec_id"), F.col("full_text").alias("text"), "lang")
    found = checkpointed(docs.unionAll(reads).mapInArrow(lambda it: _identify(it, model.value, words), SCHEMA))
    return with_kind(found, kinds_of(found.where("seg = 0").select("bits"))).drop("bits").distinct()


def find_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, seg, code) where the delivered label is not the language of most words, and segments in prose."""
    found = identify_languages(spark, sf_dir).where("code is not null")
    whole = F.col("kind").isin("prose", "list") & (F.col("seg") == 0) & ~F.col("code").eqNullSafe(F.col("lang"))
    part = (F.col("kind") == "prose") & (F.col("seg") > 0)
    return found.where(whole | part).select("tab", "rec_id", "seg", "code")
