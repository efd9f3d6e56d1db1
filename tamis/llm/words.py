"""Words of texts and hashes of word runs, computed for whole batches with numpy.

A word is a maximal run of letters and digits, taken without case and accents.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

OTHER, WORD, MARK = 0, 1, 2
#: Code points from here on are rare ideographs (letters) and tags (others).
LIMIT = 0x20000
#: Texts are folded in portions of about so many characters, which bounds the memory of a task.
PORTION = 1_000_000


def _folded(ch: str) -> str:
    """Base letters of one character, without case and accents; '' for a mark alone."""
    if "가" <= ch <= "힣":  # syllables stay whole
        return ch
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch).casefold())
    return "".join(x for x in plain if unicodedata.category(x) not in ("Mn", "Me"))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, dict[str, str], re.Pattern]:
    """(kind, folded code point) by code point; characters that fold to several, and their pattern."""
    kind, fold = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    kind[LIMIT:0xE0000] = WORD
    several: dict[str, str] = {}
    for c in range(LIMIT):
        ch, category = chr(c), unicodedata.category(chr(c))
        if category in ("Mn", "Me"):
            kind[c] = MARK
        elif category[0] == "L" or category == "Nd":
            kind[c] = WORD
            if ch.isascii() or unicodedata.decomposition(ch) or ch != ch.casefold():
                base = _folded(ch)
                if len(base) == 1:
                    fold[c] = ord(base)
                elif base:
                    several[ch] = base
    return kind, fold, several, re.compile("[" + "".join(several) + "]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)


class Words:
    """The words of a portion of texts: for each its text's place, its place in the text, and its hash."""

    def __init__(self, texts: list[str]):
        kind, fold, several, pattern = tables()
        joined = "\n".join(texts)
        if not joined.isascii() and pattern.search(joined):
            texts = [pattern.sub(lambda m: several[m[0]], t) for t in texts]
            joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(texts), np.int64)
        if texts:
            np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
        kinds = kind[points]
        keep = kinds != MARK
        if not keep.all():
            first = np.concatenate(([0], np.cumsum(keep)))[first]
            points, kinds = points[keep], kinds[keep]
        self.points = fold[points]
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = kinds == WORD
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = np.searchsorted(first, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.at = np.arange(len(self.start)) - before[self.text] if len(texts) else np.zeros(0, np.int64)
        n = len(points)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            back = np.full(n + 1, _BACK, np.uint64)
            back[0] = 1
            np.cumprod(back, out=back)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
            self.hash = _mixed((sums[self.end] - sums[self.start]) * back[self.start])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within one text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total, factor = np.zeros(m, np.uint64), 1
            for j in range(k):
                factor = factor * _BASE % (1 << 64)
                total += self.hash[j : j + m] * np.uint64(factor)
            valid = self.text[:m] == self.text[k - 1 :]
            return np.flatnonzero(valid), _mixed(total[valid])

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def span(self, i: int, j: int) -> list[str]:
        return [self.word(x) for x in range(i, j)]


def portions(texts: list[str | None]):
    """(indices, Words) of the texts that aren't null, in portions of bounded size; a longer text is a portion by itself."""
    chosen, size = [], 0
    for i, t in enumerate(texts):
        if t:
            chosen.append(i)
            size += len(t)
            if size >= PORTION:
                yield chosen, Words([texts[j] for j in chosen])
                chosen, size = [], 0
    if chosen:
        yield chosen, Words([texts[j] for j in chosen])
