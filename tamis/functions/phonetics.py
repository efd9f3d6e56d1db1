"""Phonetic keys of first words: a two-code variant of metaphone, as rules by letter.

Each rule looks at the word around a position and gives (primary, secondary, letters consumed). Places
outside the word count as vowels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = set("AEIOUY")
LENGTH = 4
# Beginnings whose first letter is silent.
SILENT = ("GN", "KN", "PN", "WR", "PS")
# Letters with one sound, single or doubled.
PLAIN = {"B": "P", "F": "F", "K": "K", "L": "L", "N": "N", "R": "R", "V": "F", "Z": "S"}


class _Word:
    def __init__(self, text: str):
        self.text = text

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def vowel(self, i: int) -> bool:
        return self.at(i) == "" or self.at(i) in VOWELS

    def has(self, i: int, *options: str) -> bool:
        return i >= 0 and any(self.text.startswith(o, i) for o in options)


def _both(code: str, n: int) -> tuple[str, str, int]:
    return code, code, n


def _c(w: _Word, i: int) -> tuple[str, str, int]:
    follows = w.at(i + 2)
    if i > 1 and not w.vowel(i - 2) and w.has(i - 1, "ACH") and follows != "I" and (follows != "E" or w.has(i - 2, "BACHER", "MACHER")):
        return _both("K", 2)
    if i == 0 and w.has(0, "CAESAR"):
        return _both("S", 2)
    if w.has(i, "CH"):
        if i > 0 and w.has(i, "CHAE"):
            return "K", "X", 2
        greek = w.has(0, "CHARAC", "CHARIS", "CHOR", "CHYM", "CHIA", "CHEM") and not w.has(0, "CHORE")
        return _both("K" if i == 0 and greek else "X", 2)
    if w.has(i, "CZ") and not w.has(i - 2, "WICZ"):
        return "S", "X", 2
    if w.has(i, "CIA"):
        return _both("X", 3)
    if w.has(i, "CC") and not (i == 1 and w.at(0) == "M"):
        if follows in ("I", "E", "H") and follows and not w.has(i + 2, "HU"):
            hard = i == 1 and w.at(0) == "A" or w.has(i - 1, "UCCEE", "UCCES")
            return _both("KS" if hard else "X", 3)
        return _both("K", 2)
    if w.has(i, "CK", "CG", "CX"):
        return _both("K", 2)
    if w.has(i, "CI", "CE", "CY"):
        return _both("S", 2)
    if w.has(i, "CQ"):
        return _both("K", 3)
    return _both("K", 2 if w.at(i + 1) == "C" and not w.has(i + 1, "CE", "CI") else 1)


def _d(w: _Word, i: int) -> tuple[str, str, int]:
    if w.has(i, "DG"):
        return _both("J", 3) if w.at(i + 2) in ("I", "E", "Y") and w.at(i + 2) else _both("TK", 2)
    return _both("T", 2 if w.has(i, "DT", "DD") else 1)


def _g(w: _Word, i: int) -> tuple[str, str, int]:
    n = w.at(i + 1)
    if n == "H":
        if i > 0 and not w.vowel(i - 1):
            return _both("K", 2)
        if i == 0:
            return _both("J" if w.at(2) == "I" else "K", 2)
        if any(i - k >= 0 and w.at(i - k) in letters for k, letters in ((2, "BHD"), (3, "BHD"), (4, "BH"))):
            return _both("", 2)
        if i > 2 and w.at(i - 1) == "U" and w.at(i - 3) in "CGLRT":
            return _both("F", 2)
        return _both("K" if w.at(i - 1) != "I" else "", 2)
    if n == "N":
        if w.vowel(i + 2):
            return _both("KN", 2)
        return ("KN", "N", 2) if i == 1 and w.vowel(0) else ("N", "KN", 2)
    if n == "L" and w.vowel(i + 2):
        return "KL", "L", 2
    if n in ("E", "I", "Y"):
        return "K", "J", 2
    return _both("K", 2 if n == "G" else 1)


def _j(w: _Word, i: int) -> tuple[str, str, int]:
    if w.has(i, "JOSE"):
        return _both("H", 1)
    if i == 0:
        return "J", "A", 1
    if w.vowel(i - 1) and not w.vowel(i + 1):
        return "J", "H", 1
    return _both("J", 2 if w.at(i + 1) == "J" else 1)


def _s(w: _Word, i: int) -> tuple[str, str, int]:
    if w.has(i, "SCH"):
        return ("X", "X", 3) if w.has(i + 3, "ER", "EN") else ("X", "K", 3)
    if w.has(i, "SH", "SI", "SZ"):
        return _both("X", 2)
    if i == 0 and w.has(0, "SUGAR"):
        return "X", "S", 1
    return _both("S", 2 if w.at(i + 1) in ("S", "Z") and w.at(i + 1) else 1)


def _t(w: _Word, i: int) -> tuple[str, str, int]:
    if w.has(i, "TION"):
        return _both("X", 3)
    if w.has(i, "TH"):
        return "0", "T", 2
    return _both("T", 2 if w.at(i + 1) in ("T", "D") and w.at(i + 1) else 1)


def _w(w: _Word, i: int) -> tuple[str, str, int]:
    if w.has(i, "WR"):
        return _both("R", 2)
    if i == 0 and (w.vowel(1) or w.at(1) == "H"):
        return "A", "F", 1
    return _both("", 1)


def _rule(w: _Word, i: int) -> tuple[str, str, int]:
    letter, n = w.at(i), w.at(i + 1)
    if letter in VOWELS:
        return _both("A" if i == 0 else "", 1)
    if letter in PLAIN:
        return _both(PLAIN[letter], 2 if n == letter else 1)
    if letter == "H":
        return _both("H", 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else _both("", 1)
    if letter == "M":
        silent_b = n == "B" and (i + 2 == len(w.text) or w.has(i + 2, "ER"))
        return _both("M", 2 if n == "M" or silent_b else 1)
    if letter == "P":
        return _both("F", 2) if n == "H" else _both("P", 2 if n == "P" else 1)
    if letter == "Q":
        return _both("K", 2 if n == "Q" else 1)
    if letter == "X":
        french = i == len(w.text) - 1 and (w.has(i - 1, "I", "E") or w.has(i - 2, "AU", "OU"))
        return _both("" if french else "KS", 1)
    return {"C": _c, "D": _d, "G": _g, "J": _j, "S": _s, "T": _t, "W": _w}[letter](w, i)


def phonetic_keys(text: str | None) -> tuple[str, str]:
    """(primary, secondary) codes of the first word, letters A to Z only; two empty codes if there is none."""
    words = re.sub("[^A-Z ]", "", (text or "").upper()).split()
    if not words:
        return "", ""
    w = _Word(words[0])
    primary, secondary, i = "", "", 0
    if w.has(0, *SILENT):
        i = 1
    elif w.at(0) == "X":
        primary, secondary, i = "S", "S", 1
    while i < len(w.text) and (len(primary) < LENGTH or len(secondary) < LENGTH):
        one, two, step = _rule(w, i)
        primary, secondary, i = primary + one, secondary + two, i + step
    return primary[:LENGTH], secondary[:LENGTH]


def _run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("primary", pa.string()), ("secondary", pa.string())])
    for batch in batches:
        known: dict = {}
        rows = []
        for text in batch.to_pylist():
            if text not in known:
                known[text] = dict(zip(("primary", "secondary"), phonetic_keys(text)))
            rows.append(known[text])
        yield pa.array(rows, kind)


def phonetic(c: Column | str) -> Column:
    """struct<primary, secondary> of the first word of a name without accents."""
    kind = T.StructType([T.StructField("primary", T.StringType()), T.StructField("secondary", T.StringType())])
    return F.arrow_udf(_run, kind)(c)
