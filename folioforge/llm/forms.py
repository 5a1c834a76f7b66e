"""One written form for print that looks the same (problem 4).

``clean`` brings a text to compatibility-composed form, maps every kind of space to a plain one, drops code points
that show nothing, and writes each word in letters of one script: Latin, Cyrillic or Greek.  ``compare_key`` is the
case-folded form that decides whether two prints are equal.  ``None`` stays ``None`` and an empty text stays empty; tabs
and line breaks are kept.  A word whose letters look alike in several scripts takes the script of its line, else that of
the text; where as many of its letters tell of one script as of another, likewise.

Texts are worked on by line and words by themselves, each distinct value of a batch once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.kinds import kind_bits, kinds_of, records, vocabulary
from folioforge.session import checkpointed, table

# Letters of one shape in Latin, Cyrillic and Greek script, of the published tables of confusable letters;
# a blank where a script has none.
ALIKE = """
A А Α
B В Β
C С _
E Е Ε
H Н Η
I І Ι
J Ј _
K К Κ
M М Μ
N _ Ν
O О Ο
P Р Ρ
S Ѕ _
T Т Τ
X Х Χ
Y _ Υ
Z _ Ζ
a а α
c с _
e е _
i і ι
j ј _
k _ κ
o о ο
p р ρ
s ѕ _
v _ ν
x х χ
y у _
"""
# Letters that look like a Latin one, which is not taken for them in turn: rare Cyrillic letters, Greek upsilon
# and Latin letters of phonetic script.
LOOKS_LATIN = {"Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "υ": "u", "ɑ": "a", "ɡ": "g"}
VARIANTS = {c: n for c, n in LOOKS_LATIN.items() if c < "Ͱ"}

SCRIPTS = "LCG"
_ROWS = [line.split() for line in ALIKE.split("\n") if line]
#: For each script the letters of the others that look like one of its own.
TO = {
    s: str.maketrans({other: row[k] for row in _ROWS if row[k] != "_" for m, other in enumerate(row) if m != k and other != "_"} | (LOOKS_LATIN if s == "L" else {}))
    for k, s in enumerate(SCRIPTS)
}
INVISIBLE = regex.compile(r"[[\p{Default_Ignorable_Code_Point}\p{Cc}]--[\t\n]]+", regex.V1)
SPACES = regex.compile(r"\p{Zs}")
# What shows nothing although it counts as printable; letters beyond Latin; Latin letters: all as plain ranges, for speed.
HIDDEN = re.compile("[\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0\U000e0100-\U000e01ef]")
BEYOND = re.compile("[\u0370-\u052f]")
ROMAN = re.compile("[A-Za-z\u00c0-\u024f]")
def _plain(codec: str, letters: str) -> tuple[str, bytes]:
    """A one-byte encoding, and its bytes for characters that are no clean form or letters of another script."""
    bad = []
    for n in range(256):
        try:
            c = bytes([n]).decode(codec)
        except UnicodeDecodeError:
            continue
        kept = unicodedata.normalize("NFKC", c) == c and (c.isprintable() or c in "\t\n")
        if not kept or c.isalpha() and letters not in unicodedata.name(c, ""):
            bad.append(n)
    return codec, bytes(bad)


# A text that one of these holds without its bad bytes is clean: encoding it is the fastest of tests.
PLAIN = (_plain("latin-1", "LATIN"), _plain("cp1251", "CYRILLIC"), _plain("cp1250", "LATIN"))
_NAMES = {"L": "Latin", "C": "Cyrillic", "G": "Greek"}
LETTER = {s: regex.compile(rf"\p{{{n}}}") for s, n in _NAMES.items()}
ONLY = {s: regex.compile(f"[\\p{{{n}}}--[{''.join(row[k] for row in _ROWS if row[k] != '_')}{''.join(LOOKS_LATIN)}]]", regex.V1) for k, (s, n) in enumerate(_NAMES.items())}
GREEK, CYRILLIC, VARIANT = re.compile("[\u0370-\u03ff]"), re.compile("[\u0400-\u052f]"), re.compile("[" + "".join(VARIANTS) + "]")
TOKEN = regex.compile(r"[^ \t\n]+")
OPENING, CLOSING = "([\"'«„“", ")]\"'»”"


@lru_cache(1 << 17)
def told(text: str) -> tuple[int, int, int]:
    """How many letters of a text only Latin, only Cyrillic, only Greek has."""
    return tuple(len(ONLY[s].findall(text)) for s in SCRIPTS)


def leader(counts: tuple[int, ...] | list[int]) -> str:
    """The script of the greatest count; ``""`` where there is none or several have it."""
    top = max(counts)
    return SCRIPTS[counts.index(top)] if top and counts.count(top) == 1 else ""


def script_of(text: str) -> str:
    """``L``, ``C`` or ``G`` by the letters that only one script has, ``""`` where there are none or as many of two."""
    return leader(told(text))


def scripts_in(text: str) -> str:
    """The scripts that a text has letters of."""
    return "L" if text.isascii() else "".join(s for s in SCRIPTS if LETTER[s].search(text))


@lru_cache(1 << 17)
def one_script(word: str, around: str) -> str:
    """The word in letters of its own script, or of the script around it where its letters don't tell."""
    script = script_of(word) or around
    return word.translate(TO[script]) if script else word


def is_clean(text: str) -> bool:
    """Whether the text surely is in clean form; a quick test that never answers yes wrongly."""
    ascii_only = text.isascii()
    if not ascii_only:
        for codec, bad in PLAIN:
            try:
                coded = text.encode(codec)
            except UnicodeEncodeError:
                continue
            if len(coded.translate(None, bad)) == len(coded):
                return True
    if not text.replace("\n", "").replace("\t", "").isprintable():
        return False
    if ascii_only:
        return True
    mixed = BEYOND.search(text) and ROMAN.search(text) or GREEK.search(text) and CYRILLIC.search(text)
    return not mixed and unicodedata.is_normalized("NFKC", text) and not HIDDEN.search(text) and not VARIANT.search(text)


def plain(text: str) -> str:
    """The text composed, with plain spaces, without what shows nothing; its letters are those it has."""
    return SPACES.sub(" ", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)))


def clean(text: str | None, around: str = "") -> str | None:
    """The one written form of a text; ``around`` is the script for words and lines that don't tell theirs."""
    if text is None:
        return None
    sure = is_clean(text)
    # A text of one script may still be a look-alike of the script around it.
    if sure and (not around or scripts_in(text) in ("", around)):
        return text
    text = text if sure else plain(text)
    has = scripts_in(text)
    if (len(has) < 2 and (not around or has in ("", around))) and not VARIANT.search(text):
        return text
    around = script_of(text) or around or has[:1]
    return "\n".join(_by_neighbours(line, around) for line in text.split("\n"))


@lru_cache(1 << 16)
def _by_neighbours(line: str, around: str) -> str:
    """The line with each word in one script.

    Words that don't tell their script take that of the words beside them where those agree, else that of the line.
    """
    if line.isascii() and around == "L":
        return line
    tokens = TOKEN.findall(line)
    counts = [told(t) for t in tokens]
    total = [sum(c) for c in zip(*counts, strict=True)] or [0, 0, 0]
    own = leader(total) or around
    if sum(n > 0 for n in total) < 2:
        return TOKEN.sub(lambda m: one_script(m[0], own), line)
    scripts = [leader(c) for c in counts]
    chosen: list[str] = []
    for i, (t, s) in enumerate(zip(tokens, scripts, strict=True)):
        if not s:
            before = next((x for x in reversed(scripts[:i]) if x), "")
            after = next((x for x in scripts[i + 1 :] if x), "")
            # A word that opens a quotation goes with what follows, one that closes it with what went before.
            s = before if before == after else after if t[0] in OPENING else before if t[-1] in CLOSING else own
        chosen.append(s)
    parts = iter(chosen)
    return TOKEN.sub(lambda m: one_script(m[0], next(parts)), line)


def clean_lines(texts: pa.Array) -> list[tuple[list[str], list[str], str]]:
    """For each text its lines, their clean forms, and the scripts of its letters in clean form.

    Lines are told apart first, so that each distinct one is tested, composed and counted once; only texts with letters of
    several scripts are then looked at line by line in the script of the whole.  A null is an empty text.
    """
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = lines.values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    forms = [t if is_clean(t) else plain(t) for t in distinct]
    has = [scripts_in(f) for f in forms]
    which, ends = coded.indices.to_numpy(), lines.offsets.to_numpy()
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        ids = which[a:b].tolist()
        seen = {has[i] for i in ids}
        new = [forms[i] for i in ids]
        scripts = "".join(sorted(set("".join(seen)), key=SCRIPTS.index))
        if len(scripts) > 1 or any(VARIANT.search(f) for f in new if not f.isascii()):
            around = leader([sum(told(forms[i])[k] for i in ids) for k in range(3)]) or scripts[:1]
            new = [_by_neighbours(f, around) for f in new]
        out.append(([distinct[i] for i in ids], new, scripts))
    return out


def compare_key(text: str | None) -> str | None:
    """The form that equal prints share: clean, then fully case-folded and composed again."""
    return None if text is None else unicodedata.normalize("NFKC", clean(text).casefold())


# ------------------------------------------------------------------------------------------------ Spark operators

#: Java's regular expression for a word that may be out of form: anything beyond the stable characters, or two scripts.
MAYBE = r"[^\x21-\x7e§°¬·À-İĴ-ľŁ-ňŊ-žЀ-ԯ—•]|[a-zA-ZÀ-ž].*[Ѐ-ԯ]|[Ѐ-ԯ].*[a-zA-ZÀ-ž]"
_ALIKE = "".join(sorted({c for row in _ROWS for c in row} - {"_"} | set(LOOKS_LATIN)))

_LINES = pa.list_(pa.struct([("line_no", pa.int32()), ("form", pa.string())]))


def unclean_lines(batches: Iterable[pa.RecordBatch], words: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """For each record (tab, rec_id, text): its votes, its script and its lines that are out of form."""
    for batch in batches:
        bits, scripts, lines, mixed = [], [], [], []
        for old, new, has in clean_lines(batch.column(2)):
            whole = "\n".join(new)
            bits.append(kind_bits(whole, words))
            # By line where a text has words of several scripts, for words of the reading that don't tell theirs.
            counts = told(whole) if len(has) > 1 else ()
            scripts.append(leader(counts) if counts else has)
            mixed.append([script_of(x) for x in new] if sum(n > 0 for n in counts) > 1 else None)
            lines.append([{"line_no": n, "form": b} for n, (a, b) in enumerate(zip(old, new, strict=True), 1) if a != b])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(scripts, pa.string()), pa.array(lines, _LINES), pa.array(mixed, pa.list_(pa.string()))], names=["tab", "rec_id", "bits", "script", "lines", "mixed"])


_WORDS = pa.schema([("tab", pa.string()), ("rec_id", pa.int64()), ("line_no", pa.int32()), ("form", pa.string()), ("bits", pa.int32())])


def clean_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The form of words (word_id, text, script, bits), once per distinct text and script; keeps changed rows."""
    memo: dict[tuple[str, str], str] = {}
    for batch in batches:
        rows = []
        for i, t, s, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            form = memo.get(k := (t, s or ""))
            if form is None:
                if len(memo) > 200_000:
                    memo.clear()
                form = memo[k] = clean(t, s or "")
            if form != t:
                rows.append(("words", i, 0, form, b))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _WORDS, strict=True)], schema=_WORDS)


def maybe_unclean(column: Column) -> Column:
    """A JVM-side test that no unclean word fails: odd characters, two scripts, or look-alike letters only."""
    return column.rlike(MAYBE) | column.rlike(f"^\\P{{L}}*[{_ALIKE}]([{_ALIKE}]|\\P{{L}})*$")


def unify_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line or word that is not in clean form, with that form: (tab, rec_id, line_no, form).

    Null and empty texts give no row; rows delivered twice give one; records that are no language at all give none.
    Words are tested in the JVM first, so only doubtful ones reach Python, where each distinct text is mapped once.
    """
    words = vocabulary(spark, sf_dir)
    facts = checkpointed(
        records(spark, sf_dir, "documents", "readings").mapInArrow(
            lambda it: unclean_lines(it, words), "tab string, rec_id long, bits int, script string, lines array<struct<line_no: int, form: string>>, mixed array<string>"
        )
    )
    junk = [b for b, (kind, _) in kinds_of(facts.select("bits")).items() if kind == "junk"] or [-2]
    lines = facts.where(F.size("lines") > 0).select("tab", "rec_id", F.inline("lines"), "bits")
    doubtful = table(spark, sf_dir, "words", "word_id", "reading_id", "text", "line").where(maybe_unclean(F.col("text")))
    around = facts.where("tab = 'readings'").select(F.col("rec_id").alias("reading_id"), "script", "bits", "mixed")
    # On a page with both scripts the line tells; without a line nothing does.
    script = F.when(F.col("mixed").isNull(), F.col("script")).otherwise(F.coalesce(F.expr("try_element_at(mixed, line + 1)"), F.lit("")))
    doubtful = doubtful.join(around, "reading_id", "left").select("word_id", "text", script.alias("script"), F.coalesce("bits", F.lit(-1)).alias("bits"))
    found = lines.unionAll(doubtful.mapInArrow(clean_words, "tab string, rec_id long, line_no int, form string, bits int"))
    return found.where(~F.col("bits").isin(*junk)).drop("bits").distinct()


_KEYS = "text string, n long, form string, key string"


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        forms = [t if is_clean(t) else clean(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("n"), pa.array(forms, pa.string()), pa.array(map(compare_key, forms), pa.string())], names=["text", "n", "form", "key"])


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, n_words, n_texts, most_common): the words of ``words`` that are equal in print and but for their capitals, with
    how many words and different stored texts each has, and the commonest form; keys that have one stored text are left out.

    Each distinct text is cleaned and folded once.  Null and empty texts are left out; rows delivered twice count once;
    of equally common forms the one that sorts first is given.
    """
    distinct = table(spark, sf_dir, "words", "word_id", "text").where("text <> ''").groupBy("text").agg(F.countDistinct("word_id").alias("n"))
    keyed = distinct.mapInArrow(_keyed, _KEYS).groupBy("key", "form").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    g = keyed.groupBy("key").agg(F.sum("n").alias("n_words"), F.sum("k").alias("n_texts"), F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("most_common"))
    return g.where("n_texts > 1 and key <> ''")
