"""Suffix automata and the cross parsing of texts against them, many texts and languages at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex


class SuffixAutomaton:
    """The smallest automaton of all substrings of the texts it was built from."""

    __slots__ = ("next", "link", "length", "last")

    def __init__(self, texts: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        for text in texts:
            self.last = 0  # each text starts anew, so no substring runs across two of them
            for c in text:
                self._extend(c)

    def _new(self, edges: dict[str, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        """The state of the strings of ``q`` that end with an edge from ``p``; a copy of ``q`` where it has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, c: str) -> None:
        p = self.last
        if c in self.next[p]:
            self.last = self._split(p, self.next[p][c], c)
            return
        state = self._new({}, 0, self.length[p] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        self.link[state] = self._split(p, self.next[p][c], c) if p >= 0 else 0
        self.last = state

    def longest(self, text: str, start: int) -> int:
        """Length of the longest prefix of ``text[start:]`` that the texts hold."""
        state, i, n = 0, start, len(text)
        while i < n and (state := self.next[state].get(text[i], -1)) >= 0:
            i += 1
        return i - start

    def phrases(self, text: str) -> int:
        """Number of longest-match phrases that ``text`` is parsed into; an unknown character is a phrase of its own."""
        edges = self.next
        root = edges[0]
        state = count = 0
        for c in text:
            after = edges[state].get(c, 0)
            if not after and state:
                count += 1
                after = root.get(c, 0)
            if not after:
                count += 1
            state = after
        return count + (state > 0)


class CrossParser:
    """Automata as one table of transitions, through which many texts go in step, a character at a time.

    Only the edges are sent to workers; each builds its table when it first parses.
    """

    def __init__(self, automata: list[SuffixAutomaton]):
        self.sizes = [len(a.next) for a in automata]
        self.letters = ["".join(sorted({c for edges in a.next for c in edges})) for a in automata]
        self.edges = []
        for a, letters in zip(automata, self.letters, strict=True):
            number = {c: k for k, c in enumerate(letters, 1)}
            rows = [(state, number[c], after) for state, edges in enumerate(a.next) for c, after in edges.items()]
            self.edges.append(np.array(rows, np.int32).reshape(-1, 3))
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _build(self) -> None:
        width = [len(x) + 1 for x in self.letters]
        offsets = np.cumsum([0, *(n * w for n, w in zip(self.sizes, width, strict=True))])
        # Each entry has the place of the next state's row and, in its two lowest bits, how many phrases end on the way: none
        # along an edge, one where a match ends and another begins, and one more for an unknown character.
        parts = []
        for (state, symbol, after), first, w, n in zip((e.T for e in self.edges), offsets, width, self.sizes, strict=False):
            rows = np.full((n, w), first << 2 | 2, np.int32)
            begin = np.full(w, -1, np.int64)
            at_root = state == 0
            begin[symbol[at_root]] = first + after[at_root] * w
            rows[:, begin >= 0] = begin[begin >= 0] << 2 | 1
            rows[0] = first << 2 | 1
            rows[state, symbol] = first + after * w << 2
            parts.append(rows.ravel())
        self.root = offsets[:-1].astype(np.int32)
        self.top = max((ord(c) for x in self.letters for c in x), default=0) + 1
        self.symbol = np.zeros((self.top + 1, len(self.letters)), np.int32)
        for k, letters in enumerate(self.letters):
            for n, c in enumerate(letters, 1):
                self.symbol[ord(c), k] = n
        self.table = np.concatenate(parts) if parts else np.zeros(1, np.int32)
        # Alphabets that have no letter in common are never parsed together: each character is a phrase then.
        self.families = [[k for k, x in enumerate(self.letters) if family & set(x)] for family in _families(self.letters)]
        self.family_of = [regex.compile(f"[{regex.escape(''.join(sorted(family)))}]") for family in _families(self.letters)]

    def phrases(self, texts: list[str], at_once: int = 4096) -> np.ndarray:
        """Number of longest-match phrases of each text (rows) by each automaton (columns); an unknown character is a
        phrase of its own."""
        if self.table is None:
            self._build()
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.tile(sizes[:, None], (1, len(self.letters))).astype(np.int32)
        order = np.argsort(-sizes, kind="stable")
        for automata, letters in zip(self.families, self.family_of, strict=True):
            some = np.array([k for k in order.tolist() if letters.search(texts[k])], np.int64)
            for i in range(0, len(some), at_once):
                part = some[i : i + at_once]
                counts[np.ix_(part, automata)] = self._parse([texts[k] for k in part], sizes[part], np.array(automata))
        return counts

    def _parse(self, texts: list[str], sizes: np.ndarray, automata: np.ndarray) -> np.ndarray:
        """``phrases`` by some automata of texts in descending order of their sizes."""
        codes = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), self.top).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        root, symbol = self.root[automata], np.ascontiguousarray(self.symbol[:, automata])
        state = np.tile(root, (len(texts), 1))
        counts = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # texts longer than each place
        for at, n in enumerate(live.tolist()):
            entry = self.table[state[:n] + symbol[codes[first[:n] + at]]]
            counts[:n] += entry & 3
            np.right_shift(entry, 2, out=state[:n])
        return counts + (state != root)


def _families(alphabets: list[str]) -> list[set[str]]:
    """The letters of the alphabets, those together that any alphabet has together; blanks aside."""
    out: list[set[str]] = []
    for letters in alphabets:
        mine = set(letters) - {" "}
        for other in [f for f in out if f & mine]:
            out.remove(other)
            mine |= other
        out.append(mine)
    return out
