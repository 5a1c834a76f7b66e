"""Repair of scanned text: broken words, misread words, page furniture (problem 3).

Line-pair classifiers decide which lines are page furniture and which line ends break a word; every line and every
marked line end is put to them.  What running heads look like is learned from lines that recur in a bounded sample of
the records.  For words that no list has, candidates come from an inverted join of character q-grams with the word list; a gradient-boosted ranker, with
costs of misreadings learned from the corpus itself, accepts one of them or none.

Nulls and empty texts give nothing; rows delivered twice give one row.  Records that are lists, tables or junk for the
greater part are left alone.  Ties between candidates go to the one that sorts first.  A paragraph that is null keeps
its place.  The candidate search covers every distinct word; only the classifiers are fitted on bounded samples.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.boosting import Boosted
from folioforge.llm.forms import clean, is_clean
from folioforge.llm.furniture import NUMBER, ROMAN, SHEET, TITLE, VOLUME
from folioforge.llm.kinds import fit_kinds, kind_bits, kinds_of, records
from folioforge.llm.skew import spread_join
from folioforge.session import checkpointed, table

MARKS = "-¬="
AROUND = " \t.,;:!?'\"()[]{}*•·|—¬=^~_<>/\\#§°+&%"
PAIR = regex.compile(r"(?<![\p{L}])(\p{L}+)[-¬=] (\p{Ll}[\p{L}'’]*)")
#: Documents, and as many readings, from whose lines the furniture classifier is trained.
SAMPLE_DOCS = 600
#: Places by which a word may be off where engines count words that the text doesn't have.
SHIFT = 8


class Words(dict):
    """The word list as lookups; by token, its bare word and the languages that list it, worked out once."""

    def __init__(self, rows: list[tuple[str, str | None, bool]]):
        super().__init__()
        langs: dict[str, set[str]] = defaultdict(set)
        for word, lang, _ in rows:
            langs[word.lower()].add(lang or "")
        self.langs = {w: frozenset(x) for w, x in langs.items()}
        self.all = frozenset(self.langs)
        self.longest = max(map(len, self.langs), default=0)
        self.rows = rows

    def __reduce__(self):
        return Words, (self.rows,)

    def __missing__(self, token: str) -> tuple[str, frozenset[str] | None]:
        if len(self) > 300_000:  # bounds the memory; tokens are simply worked out again
            self.clear()
        bare = token.strip(AROUND)
        found = self[token] = (bare, self.langs.get(bare.lower()))
        return found

    def main(self, sets: Iterable[frozenset[str] | None], least: int, default: str) -> str:
        """The language that lists most of the tokens; ``default`` where it lists fewer than ``least``."""
        votes: Counter = Counter()
        for langs, n in Counter(sets).items():
            for lang in langs or ():
                votes[lang] += n
        votes.pop("", None)
        top = max(votes.items(), key=lambda kv: (kv[1], kv[0]), default=("", 0))
        return top[0] if top[1] >= least else default


def load_words(spark: SparkSession, sf_dir: str) -> Words:
    """The fixed word list on the driver."""
    return Words([(r[0], r[1], bool(r[2])) for r in table(spark, sf_dir, "wordlist", "word", "lang", "is_proper").where("word is not null").collect()])


# ------------------------------------------------------------------------------------------------ furniture


class Looks(dict):
    """What each distinct token adds to the look of its line, packed into one number and worked out once.

    From the lowest bits, WIDTH bits each: letters, capitals, digits, words in small letters, numbers, words that no title
    has.
    """

    WIDTH = 24

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:  # bounds the memory; tokens are simply worked out again
            self.clear()
        bare = w.strip(AROUND)
        facts = (
            *(sum(map(test, w)) for test in (str.isalpha, str.isupper, str.isdigit)),
            len(bare) > 1 and bare[0].islower() and bool(bare.strip("ivxlc")), bool(NUMBER.match(w)), w[0].isalpha() and not w[0].isupper(),
        )
        found = self[w] = sum(int(n) << self.WIDTH * k for k, n in enumerate(facts))
        return found


_looks = Looks()


@lru_cache(1 << 16)
def _own_features(s: str) -> tuple:
    """What a line shows by itself."""
    words = s.split()
    packed = sum(map(_looks.__getitem__, words))
    letters, capitals, digits, small, numbers, untitled = (packed >> Looks.WIDTH * k & (1 << Looks.WIDTH) - 1 for k in range(6))
    title = len(words) > 1 and not untitled
    # The patterns are only tried on lines that have few enough letters for them, or capitals enough.
    return (
        letters < 9 and bool(NUMBER.match(s)), letters < 10 and s.islower() and bool(ROMAN.match(s)), len(s) < 5 and bool(SHEET.match(s)), len(s) < 72 and bool(VOLUME.match(s)),
        letters > 3 and 2 * capitals >= letters and bool(TITLE.match(s)), capitals / letters if letters else 0.0, digits / len(s) if s else 0.0, min(len(s), 80), min(len(words), 20), title,
        s[-1:] in ".!?;:,", "." in s[:-1] and not title, s == s.upper(), min(9, small), min(9, numbers), "\t" in s or "|" in s or "  " in s,
    )


def line_features(lines: list[str], i: int) -> tuple:
    """What line ``i`` and its neighbours show of its being page furniture."""
    before, after = lines[i - 1].strip() if i else "", lines[i + 1].strip() if i + 1 < len(lines) else ""
    return (*_own_features(lines[i].strip()), not before, not after, before[-1:] in MARKS or after[:1].islower(), i == 0, i == len(lines) - 1)


def recurring_titles(pages: list[str], least: int = 3) -> list[str]:
    """Running heads as the pages show them: lines that several pages have, numbers aside, with few words and no end of a
    sentence."""
    seen: dict[str, set[int]] = defaultdict(set)
    spelt: dict[str, Counter] = defaultdict(Counter)
    for n, text in enumerate(pages):
        for line in text.split("\n"):
            bare = [w for w in line.split() if any(map(str.isalpha, w)) and not any(map(str.isdigit, w))]
            if 2 <= len(bare) <= 8 and bare[-1][-1] not in ".!?;:," and bare[0][:1].isupper():
                key = " ".join(w.strip(AROUND) for w in bare).casefold()
                seen[key].add(n)
                spelt[key][" ".join(bare)] += 1
    return sorted(max(sorted(spelt[k]), key=spelt[k].__getitem__) for k, at in seen.items() if len(at) >= least)


def invented_furniture(rng: random.Random, titles: list[str]) -> str:
    """A line of furniture of one of the usual makes, now and then with a misread character."""
    title, n = rng.choice(titles), str(rng.randint(1, 999))
    numeral = "".join(x * k for x, k in (("c", rng.randint(0, 1)), ("l", rng.randint(0, 1)), ("x", rng.randint(0, 3)), ("v", rng.randint(0, 1)), ("i", rng.randint(0, 3)))) or "x"
    line = rng.choice([
        n, f"[ {n} ]", f"— {n} —", f"Page {n}", numeral, f"{rng.choice('ABCDEFGHKL')} {rng.randint(1, 9)}", f"Vol. {numeral.upper()}. — {n}", title.upper(), f"{title.upper()} {n}",
        f"{n} {title.upper()}", f"{title.title()}, p. {n}", f"{title.upper()}. Chap. {numeral}.",
    ])
    if rng.random() < 0.2 and " " in line:  # engines leave words out
        words = line.split()
        words.pop(rng.randrange(len(words)))
        line = " ".join(words)
    misread = {"1": "l7", "0": "O", "O": "0", "I": "1", "E": "F", "5": "S", "7": "1"}
    places = [i for i, c in enumerate(line) if c in misread]
    if places and rng.random() < 0.3:
        k = rng.choice(places)
        line = line[:k] + rng.choice(misread[line[k]]) + line[k + 1 :]
    return line


def train_furniture(pages: list[str], names: list[str], seed: int = 7) -> Boosted:
    """Learns from lines of the corpus against invented furniture put between them."""
    rng = random.Random(seed)
    names = names or ["Name"]
    # Titles that recur, and names side by side, so that the look of a title is learned and not its words.
    titles = recurring_titles(pages) + [f"{rng.choice(names)} {rng.choice(names)}" for _ in range(100)]
    x, y = [], []
    for text in pages:
        lines = text.split("\n")
        plain = [i for i, s in enumerate(lines) if s.strip() and (not (f := line_features(lines, i))[0] and not any(f[1:4]) and f[5] < 0.6)]
        for i in rng.sample(plain, min(len(plain), 12)):
            x.append(line_features(lines, i))
            y.append(0)
        for _ in range(3):
            k = rng.choice([0, len(lines), rng.randrange(len(lines) + 1)])
            mixed = [*lines[:k], invented_furniture(rng, titles), *lines[k:]]
            x.append(line_features(mixed, k))
            y.append(1)
        # Short last lines of paragraphs, cut from the corpus.
        full = [ws for i in plain if len(ws := lines[i].split()) > 4 and ws[-1][-1] in ".!?"]
        for ws in rng.sample(full, min(len(full), 4)):
            tail = " ".join(ws[-rng.randint(1, 5) :])
            x.append(line_features([*lines, tail, *rng.choice([[], [lines[0]]])], len(lines)))
            y.append(0)
        # Rows of tables: cells of names and numbers.
        cells = [rng.choice(names), *(rng.choice([str(rng.randint(1, 999)), f"{rng.randint(1, 99)}.{rng.randint(10, 99)}", f"{rng.randint(0, 20)}/{rng.randint(1, 19)}", rng.choice(names), "-"]) for _ in range(rng.randint(2, 5)))]
        row = rng.choice([" ", "  ", "   ", "\t", " | "]).join(cells)
        x.append(line_features([*lines, row, row], len(lines)))
        y.append(0)
    if not x:
        x, y = [line_features(["12"], 0), line_features(["the end of it."], 0)] * 8, [1, 0] * 8
    return Boosted(trees=80, depth=4).fit(np.array(x, float), np.array(y))


# ------------------------------------------------------------------------------------------------ joins


def join_features(first: str, mark: str, second: str, same_line: bool, words: Words, lang: str) -> tuple:
    """What two parts show of being one word in a text of the language ``lang``."""
    whole, part, rest = (first + second).lower(), first.lower(), second.lower()
    dashed = f"{part}-{rest}"
    own = lambda w: bool(found := words.langs.get(w)) and (not lang or lang in found)
    return (
        whole in words.all, dashed in words.all, own(part), own(rest), len(first), len(second), second[:1].islower(), first[:1].isupper(), mark == "-", same_line,
        not any(c in "aeiouyäöüáéíóúàèìòùâêîôûąęаеиоуыэюяіїє" for c in rest),
    )


def train_joins(words: Words, seed: int = 11) -> Boosted:
    """Learns from broken words of the list, whole and misread, and made-up names, against parts that don't belong together."""
    rng = random.Random(seed)
    listed = sorted((w, lang or "") for w, lang, _ in words.rows if len(w) >= 4) or [("word", ""), ("other", "")]
    x, y = [], []
    names = [w for w, _, p in words.rows if p] or ["Name"]
    for _ in range(3000):
        w, lang = rng.choice(listed)
        if rng.random() < 0.25:
            a, b = rng.choice(names), rng.choice(names)
            w = a[: rng.randint(2, 5)] + b[-rng.randint(3, 6) :].lower()
        k = rng.randint(2, max(2, len(w) - 2))
        if rng.random() < 0.2:
            j = rng.randrange(len(w))
            w = w[:j] + rng.choice("ceolnu") + w[j + 1 :]
        mark = rng.choice(MARKS)
        x.append(join_features(w[:k], mark, w[k:], rng.random() < 0.2, words, lang))
        y.append(1)
        if rng.random() < 0.3:
            other, _ = rng.choice(listed)
            x.append(join_features(w[:k], mark, other, rng.random() < 0.2, words, ""))
            y.append(0)
    return Boosted(trees=40).fit(np.array(x, float), np.array(y))


def joined(first: str, second: str, words: Words) -> str:
    """The whole word; compounds that the list has with a hyphen keep it."""
    dashed = f"{first}-{second}"
    return dashed if dashed.lower() in words.all and (first + second).lower() not in words.all else first + second


# ------------------------------------------------------------------------------------------------ pages to units


class Page:
    """The units of a text with what the line classifiers find in them; ``settle`` runs those for many pages at once."""

    def __init__(self, units: list[str], inline: bool, words: Words):
        self.units, self.inline = units, inline
        self.furniture: set[int] = set()
        self.joins: list[tuple[int, str, int, int, int]] = []  # unit, whole word, unit of the second part, places of both
        self.used: set[tuple[int, int]] = set()  # tokens that are parts of broken words
        self.tokens = [u.split() for u in units]
        get = words.__getitem__
        self.looked = [list(map(get, tokens)) for tokens in self.tokens]
        self.lang = words.main([x for seen in self.looked for _, x in seen], 1, "")

    def pairs(self) -> list[tuple[int, int, int, int]]:
        """(unit, place, unit, place) of the two parts of what may be broken words, over furniture and blank lines."""
        pairs: list[tuple[int, int, int, int]] = []
        for i, tokens in enumerate(self.tokens):
            if not tokens or i in self.furniture:
                continue
            last = tokens[-1]
            if last[-1] in MARKS and len(last) > 1 and last[-2].isalpha():
                j = i + 1
                while j < len(self.tokens) and (not self.tokens[j] or j in self.furniture):
                    j += 1
                if j < len(self.tokens) and self.tokens[j][0][:1].isalpha():
                    pairs.append((i, len(tokens) - 1, j, 0))
            if self.inline:
                pairs += [(i, k, i, k + 1) for k, t in enumerate(tokens[:-1]) if len(t) > 1 and t[-1] in MARKS and t[-2].isalpha() and tokens[k + 1][:1].islower()]
        return pairs


def settle(pages: list[Page], words: Words, furniture: Boosted, joins: Boosted) -> None:
    """Decides on furniture and broken words of all the pages."""
    lines = [(p, i) for p in pages for i, t in enumerate(p.tokens) if t]
    if lines:
        for (p, i), score in zip(lines, furniture.predict(np.array([line_features(p.units, i) for p, i in lines], float)), strict=True):
            if score > 0.5:
                p.furniture.add(i)
    pairs = [(p, *x) for p in pages for x in p.pairs()]
    if pairs:
        parts = [(p.tokens[i][k].lstrip(AROUND).rstrip(MARKS), p.tokens[i][k][-1], p.tokens[j][m].strip(AROUND), i == j) for p, i, k, j, m in pairs]
        for (p, i, k, j, m), (a, _, b, _), score in zip(pairs, parts, joins.predict(np.array([join_features(*x, words, p[0].lang) for p, x in zip(pairs, parts, strict=True)], float)), strict=True):
            p.used |= {(i, k), (j, m)}
            if score > 0.5 and a and b:
                p.joins.append((i, joined(a, b, words), j, k, m))


def unlisted(page: Page, words: Words, lang: str) -> Iterator[tuple[int, int, str, str]]:
    """(unit, token number, word, language) of the words in running text that the list doesn't have.

    The language is that of the lines around the word, else that of the record.
    """
    ended = True
    for i, tokens in enumerate(page.tokens):
        if not tokens:
            ended = True
            continue
        if i in page.furniture:
            continue
        seen = page.looked[i]
        odd = [k for k, (w, langs) in enumerate(seen) if langs is None and len(w) > 1]
        if odd:
            local = words.main([x for j in range(max(0, i - 1), i + 2) for _, x in (page.looked[j] if j < len(page.looked) else ())], 3, lang)
            for k in odd:
                w = seen[k][0]
                if (i, k) in page.used or not any(c.isalpha() for c in w) or 2 * sum(c.isalpha() for c in w) < len(w) or len(w) > words.longest + 2 or w[-1] == "-":
                    continue
                start = tokens[k - 1][-1] in ".!?\")" if k else ended or len(tokens) < 12
                if w[0].isupper() and not start and local != "deu" or w.isupper() and len(w) > 1:
                    continue
                yield i, k, w, local
        ended = tokens[-1][-1] in ".!?\")"


_ROWS = pa.schema([("tab", pa.string()), ("rec_id", pa.int64()), ("unit", pa.int32()), ("kind", pa.string()), ("word", pa.string()), ("lang", pa.string()), ("place", pa.int32()), ("unit2", pa.int32()), ("place2", pa.int32()), ("raw", pa.string()), ("bits", pa.int32())])
ROWS = "tab string, rec_id long, unit int, kind string, word string, lang string, place int, unit2 int, place2 int, raw string, bits int"


def _scan(batches: Iterable[pa.RecordBatch], words: Words, furniture: Boosted, joins: Boosted) -> Iterator[pa.RecordBatch]:
    """Joins, furniture and unlisted words of records (tab, rec_id, text); one row of kind ``record`` for each record."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            out: list[tuple] = []
            pages: list[tuple[Page, str, int, str, int]] = []
            for tab, rec, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = clean(raw)
                bits = kind_bits(text, words.all)
                if text:
                    pages.append((Page(text.split("\n"), tab == "page_regions", words), tab, rec, raw, bits))
                else:
                    out.append((tab, rec, 0, "record", None, "", 0, 0, 0, None, bits))
            settle([p[0] for p in pages], words, furniture, joins)
            for page, tab, rec, raw, bits in pages:
                lang = page.lang
                out.append((tab, rec, 0, "record", None, lang, 0, 0, 0, None, bits))
                out += [(tab, rec, i + 1, "furniture", "", lang, 0, 0, 0, None, bits) for i in page.furniture]
                out += [(tab, rec, i + 1, "join", word, lang, k, j + 1, m, None, bits) for i, word, j, k, m in page.joins]
                found = unlisted(page, words, lang)
                if tab != "readings":
                    out += [(tab, rec, i + 1, "word", w, local, k, 0, 0, None, bits) for i, k, w, local in found]
                    continue
                # The place of a word among the reading's words as delivered.
                lines = [x.split() for x in raw.split("\n")]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
                for i, k, w, local in found:
                    tokens = lines[i]
                    if len(tokens) != len(page.tokens[i]):  # tokens that show nothing are none in clean form
                        shown = [n for n, t in enumerate(tokens) if clean(t).strip()]
                        k = shown[k] if k < len(shown) else k
                    out.append((tab, rec, i + 1, "word", w, local, int(starts[i]) + k, 0, 0, tokens[k] if k < len(tokens) else None, bits))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 11, _ROWS, strict=True)], schema=_ROWS)


# ------------------------------------------------------------------------------------------------ candidates and ranking


def grams(word: object) -> object:
    """The distinct padded q-grams of a column: pairs for short words, triples for longer ones."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    q = F.when((F.length(word) <= 5) | word.rlike("[0-9]"), 2).otherwise(3)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, q)))


def block(read: str, meant: str) -> tuple[str, str]:
    """What remains of two words without their common beginning and end."""
    n = min(len(read), len(meant))
    i = 0
    while i < n and read[i] == meant[i]:
        i += 1
    j = 0
    while j < n - i and read[-1 - j] == meant[-1 - j]:
        j += 1
    return read[i : len(read) - j], meant[i : len(meant) - j]


class Costs:
    """Costs of reading one to two characters for others, from how often the corpus shows it."""

    def __init__(self, ops: dict[tuple[str, str], int]):
        top = max(ops.values(), default=1)
        self.cost = {o: max(0.2, -math.log((n + 0.1) / (top + 0.1)) / 2) for o, n in ops.items()}
        self.other = max(2.5, -math.log(0.1 / (top + 0.1)) / 2)
        self.known: dict[tuple[str, str], tuple[float, int]] = {}

    def align(self, read: str, meant: str) -> tuple[float, int]:
        """The least cost of ``read`` for ``meant`` and the number of misreadings in it; once per differing part."""
        part = block(read, meant)
        if (found := self.known.get(part)) is None:
            if len(self.known) > 300_000:  # bounds the memory; parts are simply worked out again
                self.known.clear()
            found = self.known[part] = self._align(*part)
        return found

    def _align(self, read: str, meant: str) -> tuple[float, int]:
        n, m = len(read), len(meant)
        if n <= 2 and m <= 2 and (read, meant) in self.cost:
            return self.cost[read, meant], 1
        get, other = self.cost.get, self.other
        rows: list[list[tuple[float, int]]] = []
        for i in range(n + 1):
            row: list[tuple[float, int]] = []
            for j in range(m + 1):
                if not i and not j:
                    row.append((0.0, 0))
                    continue
                best = (1e9, 0)
                for a in range(min(i, 2) + 1):
                    for b in range(min(j, 2) + 1):
                        if not a and not b:
                            continue
                        c, k = row[j - b] if not a else rows[i - a][j - b]
                        if c >= best[0]:
                            continue
                        x, y = read[i - a : i], meant[j - b : j]
                        if a == b == 1 and x == y:
                            pass
                        elif (w := get((x, y))) is not None:
                            c, k = c + w, k + 1
                        elif a + b == 1 or a == b == 1:
                            c, k = c + other, k + 1
                        else:
                            continue
                        if c < best[0]:
                            best = (c, k)
                row.append(best)
            rows.append(row)
        return rows[n][m]


def rank_features(read: str, meant: str, shared: float, costs: Costs) -> tuple:
    """What speaks for ``meant`` where ``read`` stands; both lower case."""
    cost, k = costs.align(read, meant)
    n = max(len(read), len(meant))
    digits = sum(c.isdigit() for c in read)
    return cost, k, cost / n, k / n, cost / max(k, 1), len(meant), len(read) - len(meant), shared, read[0] == meant[0], read[-1] == meant[-1], digits > 0


def _shared(a: str, b: str) -> float:
    x, y = ({f"^{w}$"[i : i + 2] for i in range(len(w) + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def train_ranker(words: Words, ops: dict[tuple[str, str], int], seed: int = 5, size: int = 1500) -> tuple[Boosted, Costs]:
    """Learns from listed words misread by the corpus's own misreadings, against listed words that are near them.

    Half of the queries are words taken out of the list, for which every candidate is wrong.
    """
    rng, costs = random.Random(seed), Costs(ops)
    by_lang: dict[str, list[str]] = defaultdict(list)
    for w, lang, proper in words.rows:
        by_lang["" if proper else lang or ""].append(w.lower())
    pool = sorted({(w, lang) for w, lang in ((w.lower(), "" if p else lang or "") for w, lang, p in words.rows) if len(w) > 1})
    ranked = sorted(ops.items())
    x, y = [], []

    def near(word: str, lang: str) -> list[tuple[str, float]]:
        found = [(c, s) for c in by_lang[lang] if abs(len(c) - len(word)) <= 2 and (s := _shared(word, c)) > 0.1]
        return sorted(found, key=lambda cs: -cs[1])[:6]

    for n in range(size if pool else 0):
        word, lang = rng.choice(pool)
        if n % 2:
            for lang2 in [lang] if lang else rng.sample(sorted(by_lang), min(2, len(by_lang))):
                for c, s in near(word, lang2):
                    if c != word:
                        x.append(rank_features(word, c, s, costs))
                        y.append(0)
            continue
        if not lang:
            continue
        read = word
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            fit = [(o, k) for o, k in ranked if o[1] and o[1] in read]
            if fit:
                (a, b), _ = rng.choices(fit, [k for _, k in fit])[0]
                at = rng.choice([i for i in range(len(read)) if read.startswith(b, i)])
                read = read[:at] + a + read[at + len(b) :]
        if read == word or read in words.all or len(read) < 2:
            continue
        for c, s in {*near(read, lang), (word, _shared(read, word))}:
            x.append(rank_features(read, c, s, costs))
            y.append(c == word)
    if len(set(y)) < 2:
        x, y = [rank_features("tbe", "the", 0.5, costs), rank_features("xyzzy", "the", 0.0, costs)] * 10, [1, 0] * 10
    return Boosted(trees=60, depth=4).fit(np.array(x, float), np.array(y)), costs


def _ops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: Counter = Counter()
        for read, meant in zip(batch.column("low").to_pylist(), batch.column("key").to_pylist(), strict=True):
            a, b = block(read, meant)
            if len(a) <= 2 and len(b) <= 2 and len(a) + len(b) >= 2 and a and b:
                count[a, b] += 1
        yield pa.RecordBatch.from_pydict({"a": [k[0] for k in count], "b": [k[1] for k in count], "n": list(count.values())}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))


def _rank(batches: Iterable[pa.RecordBatch], ranker: Boosted, costs: Costs) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        reads, metas = batch.column("low").to_pylist(), batch.column("key").to_pylist()
        feats = np.array([rank_features(r, m, _shared(r, m), costs) for r, m in zip(reads, metas, strict=True)], float)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.predict(feats)), pa.array(-feats[:, 0])], names=[*batch.schema.names, "score", "ease"])


def candidates(tokens: DataFrame, listed: DataFrame) -> DataFrame:
    """(word, lang, low, key, spelling, proper): listed words that share q-grams with distinct words (word, lang).

    The gram index is as large as the fixed word list, so it is sent to every executor; no shuffle follows the one of
    the distinct words.
    """
    index = listed.select(F.col("lang").alias("of"), "key", "spelling", "proper", F.explode(grams(F.col("key"))).alias("gram"))
    both = index.unionAll(listed.where(F.length("key") >= 4).select("lang", "key", "spelling", "proper", F.explode(grams_of(F.col("key"), 2)).alias("gram")))
    index = both.unionAll(listed.where(F.length("key").between(4, 5)).select("lang", "key", "spelling", "proper", F.explode(grams_of(F.col("key"), 3)).alias("gram"))).distinct()
    each = tokens.withColumn("low", F.lower("word")).select("word", "lang", "low", F.explode(grams(F.lower("word"))).alias("gram"))
    near = each.join(F.broadcast(index.withColumnRenamed("gram", "g")), (F.col("gram") == F.col("g")) & ((F.col("of") == F.col("lang")) | F.col("proper")) & (F.abs(F.length("low") - F.length("key")) <= 2))
    near = near.groupBy("word", "lang", "low", "key", "spelling", "proper").agg(F.count("*").alias("n"))
    most = F.least(F.lit(4), (F.length("low") / 3 + 1).cast("int"))
    return near.where((F.col("n") > 1) | (F.length("low") < 7)).where(F.levenshtein("low", "key") <= most).drop("n")


def grams_of(word: object, q: int) -> object:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q))))


def misreadings(pairs: DataFrame) -> dict[tuple[str, str], int]:
    """How often the corpus reads one or two characters for others, all that it does more than once: a table bounded by
    the characters in use."""
    ops = pairs.where("not proper").mapInArrow(_ops, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    return {(r["a"], r["b"]): r["n"] for r in ops.orderBy("a", "b").collect()}


def sample_pages(spark: SparkSession, sf_dir: str, words: Words, size: int = SAMPLE_DOCS) -> list[str]:
    """The prose among about ``size`` documents and as many readings, chosen by a hash of their numbers."""
    texts: list[str] = []
    for name, key, text in (("documents", "doc_id", "text"), ("readings", "reading_id", "full_text")):
        part = min(1.0, size / max(1, table(spark, sf_dir, name, key).count()))
        luck = F.pmod(F.xxhash64(key), F.lit(1 << 20))
        drawn = table(spark, sf_dir, name, key, text, luck.alias("luck")).where(F.col("luck") <= int(part * (1 << 20))).orderBy("luck", key).limit(2 * size)
        texts += [clean(r[text]) or "" for r in drawn.collect()]
    bits = [kind_bits(t, words.all) for t in texts]
    kinds = fit_kinds(Counter(bits))
    return [t for t, b in zip(texts, bits, strict=True) if t and kinds[b][0] == "prose"]


class Repairer:
    """The classifiers of a data folder and what they found: (tab, rec_id, unit, kind, word, fixed, place, unit2, place2, raw).

    ``words`` of which the reading's text has no token are read by themselves, in the language of their reading.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        words = load_words(spark, sf_dir)
        names = [w for w, _, p in words.rows if p]
        pages = sample_pages(spark, sf_dir, words)
        furniture, joins = train_furniture(pages, names), train_joins(words)
        rows = checkpointed(records(spark, sf_dir, "documents", "readings", "page_regions").mapInArrow(lambda it: _scan(it, words, furniture, joins), ROWS))
        prose = [b for b, (kind, _) in kinds_of(rows.where("kind = 'record'").select("bits")).items() if kind == "prose"]
        self.rows, self.prose = rows, prose
        record = rows.where((F.col("kind") == "record") & F.col("bits").isin(*prose))
        rows = rows.where(F.col("bits").isin(*prose) & (F.col("kind") != "record"))
        strays = checkpointed(stray_words(spark, sf_dir, record).mapInArrow(lambda it: _by_themselves(it, words), ROWS))
        listed = table(spark, sf_dir, "wordlist", "word", "lang", "is_proper").where("word is not null").select(
            F.coalesce("lang", F.lit("")).alias("lang"), F.lower("word").alias("key"), F.col("word").alias("spelling"), F.coalesce("is_proper", F.lit(False)).alias("proper")
        )
        known = listed.select("key").distinct()
        doubtful = rows.where("kind in ('word', 'join') and word <> ''").unionAll(strays)
        tokens = doubtful.select("word", "lang").distinct().withColumn("key", F.lower("word")).join(F.broadcast(known), "key", "left_anti").drop("key")
        pairs = checkpointed(candidates(tokens, listed))
        trained = spark.sparkContext.broadcast(train_ranker(words, misreadings(pairs)))
        best = pairs.mapInArrow(lambda it: _rank(it, *trained.value), "word string, lang string, low string, key string, spelling string, proper boolean, score double, ease double")
        best = best.groupBy("word", "lang").agg(F.max_by(F.struct("spelling", "proper", "score"), F.struct("score", "ease", F.col("spelling"))).alias("top"))
        best = best.where("top.score > 0.5").select("word", "lang", F.col("top.spelling").alias("spelling"), F.col("top.proper").alias("proper"))
        found = spread_join(doubtful, checkpointed(best), ["word", "lang"])
        upper = F.substring("word", 1, 1) != F.lower(F.substring("word", 1, 1))
        whole = F.when(F.col("spelling").isNull(), F.col("word")).when(upper, F.concat(F.upper(F.substring("spelling", 1, 1)), F.expr("substring(spelling, 2)"))).otherwise(F.col("spelling"))
        columns = ["tab", "rec_id", "unit", "kind", "word", "fixed", "place", "unit2", "place2", "raw"]
        # A listed noun keeps its capital only where one was read: a small letter in the middle of a sentence is another word.
        found = found.where("kind <> 'word' or (spelling is not null and not proper)").withColumn("fixed", F.when(F.col("kind") == "word", F.col("spelling")).otherwise(whole))
        self.found = found.select(*columns).unionAll(rows.where("kind = 'furniture'").withColumn("fixed", F.lit("")).select(*columns))


def stray_words(spark: SparkSession, sf_dir: str, record: DataFrame) -> DataFrame:
    """(word_id, text, lang) of the words in prose whose text is no token of their reading's text."""
    words = table(spark, sf_dir, "words", "word_id", "reading_id", F.col("word_seq").alias("place"), "text").where("text <> ''")
    tokens = table(spark, sf_dir, "readings", "reading_id", F.explode(F.array_distinct(F.split("full_text", r"[ \n]+"))).alias("text"))
    alone = words.join(tokens, ["reading_id", "text"], "left_anti")
    return alone.join(record.where("tab = 'readings'").select(F.col("rec_id").alias("reading_id"), "lang").distinct(), "reading_id").select("word_id", "text", "lang")


def _by_themselves(batches: Iterable[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    """Rows of unlisted words (word_id, text, lang) as ``unlisted`` has them, without a text around them."""
    for batch in batches:
        out = []
        for word_id, text, lang in zip(*(batch.column(n).to_pylist() for n in ("word_id", "text", "lang")), strict=True):
            token = clean(text).strip()
            w, langs = words[token]
            if langs is not None or len(w) < 2 or len(w) > words.longest + 2 or 2 * sum(map(str.isalpha, w)) < len(w) or token[-1:] in MARKS or w[0].isupper() or " " in token:
                continue
            out.append(("words", word_id, 0, "word", w, lang, 0, 0, 0, text, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 11, _ROWS, strict=True)], schema=_ROWS)


def find_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, unit, kind, fixed) in documents, readings and page_regions, and of misread words in words.

    A word has what was found at the nearest place of its reading, at most SHIFT places off, where the same text stands.
    """
    found = checkpointed(Repairer(spark, sf_dir).found)
    words = table(spark, sf_dir, "words", "word_id", "reading_id", F.col("word_seq").alias("at"), "text")
    flagged = found.where("tab = 'readings' and kind = 'word' and raw is not null").select(F.col("rec_id").alias("reading_id"), F.col("raw").alias("text"), "place", "fixed")
    # Bounded by one reading's text.
    flagged = flagged.groupBy("reading_id", "text").agg(F.collect_set(F.struct("place", "fixed")).alias("places"))
    near = F.array_min(F.transform("places", lambda p: F.struct(F.abs(p["place"] - F.col("at")).alias("off"), p["fixed"].alias("fixed"))))
    same = words.join(flagged, ["reading_id", "text"]).withColumn("near", near).where(F.col("near.off") <= SHIFT)
    of_words = same.select(F.lit("words").alias("tab"), F.col("word_id").alias("rec_id"), F.lit(0).alias("unit"), F.lit("word").alias("kind"), F.col("near.fixed").alias("fixed"))
    return found.select("tab", "rec_id", "unit", "kind", "fixed").unionAll(of_words).distinct()


# ------------------------------------------------------------------------------------------------ mended texts


Found = tuple[str, int, str, str, int, int, int]


def mend(text: str, inline: bool, found: Iterable[Found]) -> str:
    """The text without furniture, with broken words joined and misread words replaced, lines run into paragraphs.

    ``found`` has (kind, unit from 1, word as read, word meant, place, unit and place of the second part).  Paragraphs
    are parted by blank lines; verse, whose lines are short and begin with capitals, keeps its lines.
    """
    furniture = {f[1] for f in found if f[0] == "furniture"}
    joins = {(f[1], f[4]): f for f in found if f[0] == "join"}
    seconds = {(f[5], f[6]) for f in joins.values()}
    fixes = {(f[1], f[2]): f[3] for f in found if f[0] == "word"}
    tokens = [u.split() for u in clean(text).split("\n")]
    out: list[str] = []
    for i, parts in enumerate(tokens, 1):
        if i in furniture:
            continue
        line = []
        for k, t in enumerate(parts):
            if (i, k) in seconds and (i, k) not in joins:
                continue
            if join := joins.get((i, k)):
                tail = tokens[join[5] - 1][join[6]]
                t = t[: len(t) - len(t.lstrip(AROUND))] + join[3] + tail[len(tail.rstrip(AROUND)) :]
            elif new := fixes.get((i, bare := t.strip(AROUND))):
                t = t.replace(bare, new[0].upper() + new[1:] if bare[0].isupper() else new, 1)
            line.append(t)
        out.append(" ".join(line))
    if inline:
        return "\n".join(out)
    paragraphs: list[str] = []
    now: list[str] = []
    for x in [*out, ""]:
        if x:
            now.append(x)
        elif now:
            verse = len(now) > 2 and all(y[0].isupper() or not y[0].isalpha() for y in now)
            paragraphs.append(("\n" if verse else " ").join(now))
            now = []
    return "\n\n".join(paragraphs)


def _mended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for tab, text, found, prose in zip(*(batch.column(n).to_pylist() for n in ("tab", "text", "found", "prose")), strict=True):
            done.append(mend(text, tab == "page_regions", [tuple(f.values()) for f in found or ()]) if text and prose else clean(text))
        yield pa.RecordBatch.from_arrays([batch.column("tab"), batch.column("rec_id"), pa.array(done, pa.string())], names=["tab", "rec_id", "text"])


def mended_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, text): every record of documents, readings and page_regions as continuous readable paragraphs.

    Records that are lists, tables or junk for the greater part are only brought to clean form.  Null texts stay null.
    """
    model = Repairer(spark, sf_dir)
    # What was found in one record is bounded by its text; which records are prose comes in the same rows.
    one = F.struct("kind", "unit", "word", "fixed", "place", "unit2", "place2")
    found = model.found.where("tab <> 'words'").select("tab", "rec_id", one.alias("one"))
    prose = model.rows.where((F.col("kind") == "record") & F.col("bits").isin(*model.prose)).select("tab", "rec_id", F.lit(None).cast(found.schema["one"].dataType).alias("one"))
    # A collected set has no nulls, so a record of prose without anything found has an empty one.
    grouped = found.unionAll(prose).groupBy("tab", "rec_id").agg(F.collect_set("one").alias("found"), F.lit(True).alias("prose"))
    texts = records(spark, sf_dir, "documents", "readings", "page_regions").join(grouped, ["tab", "rec_id"], "left")
    return texts.mapInArrow(_mended, "tab string, rec_id long, text string").distinct()
