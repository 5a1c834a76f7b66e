"""What a line shows by itself of being page furniture: running heads, page, sheet and volume numbers."""

from __future__ import annotations

import regex

# Digits as they may be misread.
_D = r"[0-9lIOoSZB]"
NUMBER = regex.compile(rf"^\W*(?:[Pp]age\s*)?{_D}{{1,4}}\W*$")
ROMAN = regex.compile(r"^\W*[ivxlcdm1]{1,9}\W*$", regex.I)
SHEET = regex.compile(rf"^[A-ZА-Я] ?{_D}{{1,2}}$")
VOLUME = regex.compile(rf"^\W*Vol\b.{{0,14}}$|^.{{3,50}}[,.] (?:p|pp|Chap|chap)\. ?\S{{1,8}}$")
TITLE = regex.compile(rf"^(?:{_D}{{1,4}} )?(?:[\p{{Lu}}0-9l'.\-]{{1,}} ?)+(?: {_D}{{1,4}})?$")


def looks_like_furniture(line: str) -> bool:
    """Whether a line in clean form has the look of page furniture, whatever stands around it."""
    s = line.strip()
    if not s or len(s) > 60:
        return False
    if NUMBER.match(s) or SHEET.match(s) or VOLUME.match(s) or ROMAN.match(s) and s.islower():
        return True
    letters = [c for c in s if c.isalpha()]
    return len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.85 * len(letters) and bool(TITLE.match(s))
