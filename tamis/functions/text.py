"""Columns that clean and describe text; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters whose base is found by taking the accent off, by rule from the character database.
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
# Legal forms that say nothing about a company's identity.
NOISE = ("SA", "SARL", "LLC", "LTD", "GMBH", "SOCIETE", "INC", "FZE")
# Scripts that names are checked for.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hangul", "Hiragana", "Katakana", "Thai", "Devanagari")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_accents(c: Column | str) -> Column:
    """Text with Latin accents taken off; ASCII text is passed through untouched."""
    c = column(c)
    folded = F.regexp_replace(F.translate(c, "".join(_ACCENTED), _BASES), r"\p{Mn}", "")
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(folded)


def normal_term(c: Column | str) -> Column:
    """Upper case without accents, every run of other characters one blank."""
    return F.trim(F.regexp_replace(F.upper(without_accents(c)), "[^A-Z0-9]+", " "))


def alphanumeric(c: Column | str) -> Column:
    """Upper-cased letters and digits only, as identity numbers are compared."""
    return F.regexp_replace(F.upper(column(c)), "[^A-Z0-9]", "")


def cleansed(c: Column | str, company: Column | bool = False) -> Column:
    """A name as the quality gate keeps it: blanks collapsed, joiners to blanks, symbols dropped, upper case, no accents, no legal form."""
    text = F.regexp_replace(F.trim(F.regexp_replace(column(c), r"\s+", " ")), r"[._\-]", " ")
    text = without_accents(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")))
    bare = F.regexp_replace(text, rf"\b({'|'.join(NOISE)})\b", "")
    company = F.lit(company) if isinstance(company, bool) else company
    return F.trim(F.regexp_replace(F.when(company, bare).otherwise(text), r"\s+", " "))


def scripts_of(c: Column | str) -> Column:
    """The scripts that occur in a text, as a sorted array."""
    c = column(c)
    return F.array_compact(F.array(*(F.when(c.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in sorted(SCRIPTS))))


def words_of(c: Column | str, least: int = 2) -> Column:
    """Distinct words of at least `least` characters of the normal form."""
    return F.array_distinct(F.filter(F.split(normal_term(c), " "), lambda w: F.char_length(w) >= least))


def rotations(c: Column | str) -> Column:
    """The name with each of its words leading once."""
    words = F.filter(F.split(F.trim(column(c)), r"\s+"), lambda w: w != "")
    n = F.size(words)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n - i), F.slice(words, F.lit(1), i)))
    return F.when(n > 0, turned).otherwise(F.array().cast("array<string>"))


def values_of(c: Column | str) -> Column:
    """Items of a multi-value cell, separated by semicolons, trimmed and without blanks."""
    return F.filter(F.transform(F.split(column(c), ";"), F.trim), lambda x: x != "")


def iso_date(c: Column | str) -> Column:
    """A date from its usual written forms; a bare year becomes its first day, anything else null."""
    c = F.trim(column(c))
    forms = [F.try_to_date(c, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy")]
    year = F.when(c.rlike(r"^\d{4}"), F.try_to_date(F.concat(F.substring(c, 1, 4), F.lit("-01-01")), "yyyy-MM-dd"))
    return F.coalesce(*forms, year)


def spreadsheet_safe(c: Column | str) -> Column:
    """Text that a spreadsheet will not take for a formula."""
    c = column(c)
    return F.when(c.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def content_checksum(*names: str) -> Column:
    """SHA-256 over the named columns as JSON, members in alphabetical order, nulls included."""
    row = F.to_json(F.struct(*(F.col(n) for n in sorted(names))), {"ignoreNullFields": "false"})
    return F.sha2(row, 256)
