"""Text functions as columns; lengths and positions are in code points, white space is Unicode's."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as code points, the advances of Helvetica in thousandths of an em by character.
SPACES = "\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
ADVANCES = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz",
    556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
# The same beyond ASCII, for the glyphs of Helvetica's published metrics but ż, which stays with the characters not listed.
ACCENTED = {
    167: "⁄", 222: "‘’‚łįļĺ", 260: "¦", 278: "\u00a0·ÌÍÎÏìíîïİĪĮīıţ", 299: "ľ", 317: "ť", 333: "¡¨\u00ad¯²³´¸¹ˆ˜ˇ˘˙˚˛˝“”„‹›ŕřŗ",
    350: "•", 365: "º", 370: "ª", 400: "°", 500: "çýÿćčķśšşșźžﬁﬂ", 537: "¶", 549: "√≠≤≥",
    556: "¢£¤¥§«»µ–†‡ƒ€àáâãäåèéêëðñòóôõöùúûüþāăąēėęěđğģńňņōőūůűųŁĹĽĻ", 584: "¬±×÷−", 611: "ßøŹŻŽ¿ŤŢȚ", 643: "ď",
    667: "ÀÁÂÃÄÅÈÉÊËÝÞŠŸĀĂĄĒĖĘĚĶŚŞȘ", 722: "ÇÐÑÙÚÛÜĆČĎĐŃŇŅŔŘŖŪŮŰŲ", 737: "©®", 778: "ÒÓÔÕÖØŌŐĞĢ", 834: "¼½¾", 889: "æ", 944: "œ", 1000: "ÆŒ—…‰™",
}


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def words_of(c: Column) -> Column:
    """The words of a text in order; an empty array for an empty text."""
    flat = squeeze(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def error_rate(edits: Column, reference: Column, other: Column) -> Column:
    """Edits over the length of the reference, at most 1; an empty reference is 0 against empty, else 1."""
    return F.when(reference == 0, (other > 0).cast("double")).otherwise(F.least(F.lit(1.0), edits / reference))


def symmetric_rate(edits: Column, a: Column, b: Column) -> Column:
    """The error rate averaged over both directions, each capped by itself."""
    return (error_rate(edits, a, b) + error_rate(edits, b, a)) / 2


def edits(a: Column, b: Column, near: int = 64) -> Column:
    """Edit distance; the band of ``near`` edits is tried first, which is all that readings of one page mostly need."""
    return F.coalesce(F.nullif(F.levenshtein(a, b, near), F.lit(-1)), F.levenshtein(a, b))


def cer(a: Column, b: Column) -> Column:
    """Symmetric character error rate of two squeezed texts; the distance is worked out once for both directions."""
    return F.element_at(F.transform(F.array(edits(a, b)), lambda e: symmetric_rate(e, F.length(a), F.length(b))), 1)


def escape(c: Column) -> Column:
    """The five characters of markup as entities."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
#: Entities of at most nine characters between ``&`` and ``;``.
ENTITY = "&(?=[^;]{1,9};)(?:" + "|".join(NAMED) + "|#[xX]\\+?[0-9a-fA-F]+|#\\+?[0-9]+);"


def _decoded(e: Column) -> Column:
    """The character of an entity; one whose number is no character stays."""
    number = F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).when(e.startswith("&#"), F.regexp_extract(e, "([0-9]+);", 1)).cast("long")
    valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    # After a mark of byte order, so that a number that is one itself isn't taken for it.
    char = F.when(valid, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0"))), "UTF-32"))
    for name, ch in NAMED.items():
        char = F.when(e == f"&{name};", F.lit(ch)).otherwise(char)
    return F.coalesce(char, e)


def unescape(c: Column) -> Column:
    """Named and numeric entities as characters, each decoded once: ``&amp;lt;`` becomes ``&lt;``."""
    decoded = F.array_join(F.zip_with(F.split(c, ENTITY, -1), F.regexp_extract_all(c, F.lit(ENTITY), 0), lambda gap, e: F.concat(gap, F.coalesce(_decoded(e), F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Markup without its tags, white space collapsed, entities decoded."""
    return unescape(squeeze(F.regexp_replace(c, "<[^>]*>", " ")))


def markup_lines(c: Column) -> Column:
    """The lines of markup: breaks and ends of blocks end a line; blank lines are dropped."""
    broken = F.regexp_replace(c, "(?i)<br[^>]*>|</(?:p|div|li|tr|h[1-6])>", "\n")
    lines = F.transform(F.split(F.regexp_replace(broken, "<[^>]*>", " "), "\n"), lambda x: squeeze(unescape(x)))
    return F.filter(lines, lambda x: x != "")


def strip_markdown(c: Column) -> Column:
    """A line of Markdown without its leading marks and its emphasis."""
    bare = F.regexp_replace(c, "^[#>*+ \\-]+", "")
    return F.regexp_replace(F.replace(F.replace(bare, F.lit("**"), F.lit("")), F.lit("__"), F.lit("")), f"^[{SPACES}]+|[{SPACES}]+$", "")


def plain_s(c: Column) -> Column:
    """The long s and its ligature as today's letters."""
    return F.replace(F.replace(c, F.lit("ſ"), F.lit("s")), F.lit("ﬅ"), F.lit("st"))


_KNOWN = {ch: n for table in (ADVANCES, ACCENTED) for n, chars in table.items() for ch in chars}


@lru_cache(1 << 16)
def text_width(text: str) -> int:
    """Width at font size 1000, composed first: marks take nothing, wide characters without an advance 1000, others 600."""
    return sum(0 if unicodedata.combining(ch) else _KNOWN.get(ch) or (1000 if unicodedata.east_asian_width(ch) in "WF" else 600) for ch in unicodedata.normalize("NFC", text))


def _text_widths(texts: pd.Series) -> pd.Series:
    return texts.map(text_width, na_action="ignore").astype("Int64")


def width_em(c: Column) -> Column:
    """Width at font size 1 as ``text_width`` has it; texts of ASCII alone are worked out in the JVM."""
    known = F.create_map(*[F.lit(x) for n, chars in ADVANCES.items() for ch in chars for x in (ch, n)])
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    plain = F.aggregate(chars, F.lit(0), lambda a, x: a + F.coalesce(F.try_element_at(known, x), F.lit(600)))
    return F.coalesce(F.pandas_udf(_text_widths, "long")(F.when(c.rlike("[^\\x00-\\x7f]"), c)), plain) / 1000


def rough_width_em(c: Column) -> Column:
    """A coarse width, enough to estimate how many lines a paragraph needs."""
    def one(x: Column) -> Column:
        return (
            F.when(x.isin(*" ijl.,:;'!|"), 0.24).when(x.isin(*"ftrI()-[]"), 0.32).when(x.isin(*"mMW"), 0.85).when(x == "w", 0.72)
            .when((F.upper(x) == x) & (F.lower(x) != x), 0.68).when(x.rlike("[0-9]"), 0.556).otherwise(0.54)
        )

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0.0), lambda a, x: a + one(x))
