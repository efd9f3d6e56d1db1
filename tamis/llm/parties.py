"""Parties with their spellings and what is known about them, and candidate pairs by a set-similarity join.

The sets are the q-grams of a spelling's tokens. Rare q-grams come first; two spellings with enough common q-grams share one
within their prefixes, which is joined with each full birth date. Slips in a date, dates known in part and names without a date
are joined by the outer q-grams of a word by sound (its beginning and end), for a common word with those of a second one, beside the parts
of the date, or the country, so that common names meet only where the rest can agree.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.spelling import LINKS, company_likeness, full_names, nickname_table, person_agreement, plain, shape_mask, sound, spellings, use_nicknames
from tamis.session import checkpointed, clean_id

CLIENT, LISTED = "C", "L"
Q = 3
#: Least share of common q-grams (of the larger set) by evidence: equal dates; and of the rare tokens of a company. Persons below the
#: share of equal dates still meet by the outer q-grams of their words.
SHARES = {"date": 0.5, "company": 0.5}
#: Common q-grams of the rare tokens that two companies must show in their prefixes.
EVIDENCE = 3
#: Weight that the shared keys of two parties must reach, and weight of a key of a person and of one of a company (two are needed).
ENOUGH = 3
HEAVY, MIDDLE = 3, 2
#: A token in at least this part of the parties is common: there are at most (tokens per name) / part such tokens. Their frequencies
#: are broadcast; those of all other tokens travel with the names that contain them.
COMMON = 0.0005
#: Counters of the sketch that orders q-grams by frequency; of this size whatever the alphabet.
GRAM_COUNTERS = 1 << 17
#: Bits of the filter that tells which keys a party without a full date asks for. It has this size whatever their number, and only
#: saves the shuffle of keys that meet none.
FILTER_BITS = 1 << 25
#: Edits by sound up to which the words beside the framed ones may be spellings of one: three slips are the most that `likeness` allows
#: (two in shorter words), and a transposition is two edits.
FAR_EDITS, NEAR_EDITS = 4, 3
_FOLD = 1 << 15  # bits of one bitmap of bitmap_construct_agg
#: Languages whose names of countries are read.
LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "nl")
# Usual short forms that are no names of the locale data.
_SHORT = {"uk": "GB", "uae": "AE", "usa": "US", "great britain": "GB", "england": "GB", "russian federation": "RU", "czech republic": "CZ", "ivory coast": "CI", "burma": "MM", "dprk": "KP", "drc": "CD"}

PARTY = "universe string, kind string, names array<string>, masks array<string>, dates array<string>, countries array<string>, numbers array<string>"

_country_tables: dict[str, dict[str, str]] = {}


def country_table(spark: SparkSession | None = None) -> dict[str, str]:
    """Two- and three-letter codes and names of all ISO 3166 countries, in several languages, to the two-letter code; from the
    locale data of the Java runtime."""
    context = spark.sparkContext if spark else SparkContext._active_spark_context
    if context.applicationId not in _country_tables:
        locale = context._jvm.java.util.Locale
        languages = [locale.forLanguageTag(x) for x in LANGUAGES]
        table = dict(_SHORT)
        for code in locale.getISOCountries():
            country = locale.forLanguageTag(f"und-{code}")
            labels = [code, country.getISO3Country(), *(country.getDisplayCountry(x) for x in languages)]
            table.update({plain(label).replace("’", "'"): code for label in labels if label})
        _country_tables[context.applicationId] = table
    return _country_tables[context.applicationId]


def country_codes(text: str | None, table: dict[str, str] | None = None) -> frozenset[str]:
    """Codes of the countries a text names; a label that is no country's says nothing."""
    if not text:
        return frozenset()
    table = country_table() if table is None else table
    parts = (p.strip() for p in re.split(r"[,;/|]", text))
    return frozenset(c for p in parts if p and (c := table.get(p.lower()) or table.get(plain(p).replace("’", "'").strip())))


@lru_cache(1 << 16)
def date_of(text: str | None) -> str:
    """yyyymmdd with 00 for what is not known; '' if no year is found."""
    t = (text or "").strip()
    if m := re.match(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", t):
        y, mo, d = m.groups()
    elif m := re.match(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", t):
        d, mo, y = m.groups()
    elif m := re.match(r"(\d{4})(?:[-/.](\d{1,2}))?$", t):
        y, mo, d = m[1], m[2] or "00", "00"
    else:
        return ""
    mo, d = mo.zfill(2), d.zfill(2)
    if mo > "12" and d <= "12":
        mo, d = d, mo
    return y + ("00" if mo > "12" else mo) + ("00" if d > "31" else d)


def texts_of(value: object, inside: tuple[str, ...] = ("name", "variants", "code")) -> list[str]:
    """Text items of parsed JSON, whatever its shape; of objects only the named members and lists of a priority."""
    if isinstance(value, str):
        return [value] if value.strip() else []
    if isinstance(value, list):
        return [t for v in value for t in texts_of(v, inside)]
    if isinstance(value, dict):
        return [t for k, v in value.items() if k in inside for t in texts_of(v, inside)]
    return []


@lru_cache(1 << 15)
def parsed_json(text: str | None) -> object:
    """The value of JSON text, also of JSON inside a JSON string; None if it is not valid. Not to be changed by the caller."""
    for _ in range(4):
        if not isinstance(text, str):
            return text
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return None


def _party(universe: str, kind: str, names: list[tuple[str, ...]], dates: set[str], countries: set[str], numbers: set[str]) -> tuple | None:
    least = 1 if kind != "P" else 2
    distinct = {tuple(sorted(n)): n for n in names if len(n) >= least}
    if not distinct:
        return None
    full = {d for d in dates if d and not d.endswith("00")}
    kept = full | {d for d in dates if d and d.endswith("00") and not any(f[:4] == d[:4] for f in full)}
    spelled = sorted(" ".join(n) for n in distinct.values())
    return universe, kind, spelled, [f"{shape_mask(n):x}" for n in spelled], sorted(kept), sorted(countries), sorted(numbers)


def _client(rows: list[tuple], codes) -> tuple | None:
    names, dates, countries = [], set(), set()
    for first, last, maiden, aliases, born, nationality, birth in rows:
        first, last, maiden = first or "", last or "", maiden or ""
        names += spellings(f"{first} {last}", False)
        if maiden.strip() and first.strip():
            names += spellings(f"{first} {maiden}", False)
        for alias in texts_of(parsed_json(aliases)):
            names += spellings(alias, False)
        dates.add(date_of(born))
        countries |= codes(nationality) | codes(birth)
    return _party(CLIENT, "P", names, dates, countries, set())


def _listed(rows: list[tuple], codes) -> tuple | None:
    names, dates, countries, numbers, kinds = [], set(), set(), set(), Counter()
    for kind, primary, parsed, aliases, born, where, imo, lei, passports in rows:
        kind = {"I": "P", "V": "V"}.get(kind, "O")
        kinds[kind] += 1
        company = kind != "P"
        names += spellings(primary, company)
        aliases = parsed_json(aliases)
        strong = texts_of(aliases.get("high_priority")) if isinstance(aliases, dict) else []
        loose = texts_of(aliases.get("low_priority")) if isinstance(aliases, dict) else []
        plainly = texts_of(aliases) if not isinstance(aliases, dict) or "name" in aliases else []
        for alias in strong + plainly + [x for x in loose if len(x.split()) > 1]:
            names += spellings(alias, company)
        parsed = parsed_json(parsed)
        for p in parsed if isinstance(parsed, list) else [parsed]:
            if isinstance(p, dict) and isinstance(p.get("first_name"), str):
                for last in ("last_name", "maiden_name"):
                    if isinstance(p.get(last), str) and p[last].strip():
                        names += spellings(f"{p['first_name']} {p[last]}", False)
        for d in texts_of(parsed_json(born)):
            dates.add(date_of(d))
        where = parsed_json(where)
        if isinstance(where, dict):
            for k in ("citizenship", "birth_country") if not company else ("jurisdiction_country", "residence", "citizenship", "birth_country"):
                for c in texts_of(where.get(k)):
                    countries |= codes(c)
        if imo:
            numbers.add("imo" + re.sub(r"\D", "", imo).upper())
        if lei:
            numbers.add("lei" + re.sub(r"\W", "", lei).upper())
        papers = parsed_json(passports)
        for p in papers if isinstance(papers, list) else []:
            if isinstance(p, dict) and isinstance(p.get("number"), str):
                numbers.add("pp" + re.sub(r"\W", "", p["number"]).upper())
    return _party(LISTED, kinds.most_common(1)[0][0], names, dates, countries, numbers)


def _profiled(rows: DataFrame, build) -> DataFrame:
    """(ref, PARTY) of (ref, rows): one party per ref, from its distinct contents."""
    table = country_table(rows.sparkSession)
    kinds = [("universe", pa.string()), ("kind", pa.string()), *((n, pa.list_(pa.string())) for n in ("names", "masks", "dates", "countries", "numbers"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lru_cache(1 << 14)(lambda text: country_codes(text, table))
        for batch in batches:
            lists = batch.column(1)
            rows = [*zip(*(c.to_pylist() for c in lists.flatten().flatten()))]  # by column: a dictionary for each row takes several times as long
            ends = itertools.accumulate(lists.value_lengths().to_pylist())
            found, begin = [], 0
            for ref, end in zip(batch.column(0).to_pylist(), ends):
                if p := build(rows[begin:end], codes):
                    found.append((ref, *p))
                begin = end
            if found:
                columns = list(zip(*found))
                yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], kinds))], names=["ref", *(n for n, _ in kinds)])

    return rows.mapInArrow(run, f"ref string, {PARTY}")


def client_parties(clients: DataFrame) -> DataFrame:
    """One party per client_id of a person; the contents of all its rows count, repeated ones once."""
    c = clients.where("client_type = 'PP'").select(
        clean_id("client_id").alias("ref"),
        F.struct(F.col("client_first_name").alias("first"), F.col("client_last_name").alias("last"), F.col("client_maiden_name").alias("maiden"), F.col("client_aliases").alias("aliases"),
                 F.col("client_dob").alias("dob"), "nationality", F.col("birth_country").alias("birth")).alias("row"),
    )
    return _profiled(c.where("ref is not null").groupBy("ref").agg(F.collect_set("row").alias("rows")), _client)


def listed_parties(entities: DataFrame, individuals: bool = False) -> DataFrame:
    """One party per entity_id; the contents of all its rows count, repeated ones once (reduced before the shuffle)."""
    if individuals:
        entities = entities.where("entity_type = 'I'")
    e = entities.select(
        clean_id("entity_id").alias("ref"),
        F.struct(F.col("entity_type").alias("type"), F.col("primary_name").alias("primary"), F.col("individual_name_parsed").alias("parsed"), "aliases", F.col("dates_of_birth").alias("dates"), "countries",
                 F.col("imo_number").alias("imo"), F.col("lei_number").alias("lei"), F.col("passport_documents").alias("passports")).alias("row"),
    )
    return _profiled(e.where("ref is not null").groupBy("ref").agg(F.collect_set("row").alias("rows")), _listed)


@lru_cache(1 << 15)
def _token_grams(token: str) -> tuple[int, ...]:
    s = f"^{token}$"
    return tuple({code(s[i : i + Q]) for i in range(len(s) - Q + 1)})


def grams(name: str) -> set[int]:
    """q-grams of the tokens of a spelling, with the ends of the tokens marked; links and legal forms count only alone."""
    tokens = [t for t in name.split() if t not in LINKS and t[0] != "#"] or name.split()
    return {g for t in tokens for g in _token_grams(t)}


def party_classes(parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): parties with equal contents are one class, so copies are compared once.

    classes: class (64-bit digest of the contents), universe, kind, facts (one text, as it is read and moved many times), dated (any
    date), full (a full date). The last part of the facts are the tokens that several, but not a large part of the parties share,
    each with the number of parties that have it.
    """
    content = ["universe", "kind", "names", "masks", "dates", "countries", "numbers"]
    joined = lambda c: F.array_join(c, ";")
    facts = F.concat_ws("|", "kind", *(joined(c) for c in content[2:]))
    kept = parties.withColumn("facts", facts).select(
        "ref", "universe", "kind", "facts", (F.size("dates") > 0).alias("dated"), F.exists("dates", lambda d: ~d.endswith("00")).alias("full"), F.xxhash64("universe", "facts").alias("class"),
    )
    kept = checkpointed(kept)
    classes = kept.drop("ref").dropDuplicates(["class"])
    total = kept.select("class").distinct().count()
    tokens = checkpointed(classes.select("class", F.explode(F.array_distinct(F.split(F.get(F.split("facts", r"\|"), F.lit(1)), "[; ]"))).alias("token")))
    counts = tokens.groupBy("token").count().where(F.col("count").between(2, common_from(total) - 1))
    shared = tokens.join(counts, "token").groupBy("class").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "token", "count"))), ";").alias("shared"))
    classes = classes.join(shared, "class", "left").withColumn("facts", F.concat_ws("|", "facts", F.coalesce("shared", F.lit("")))).drop("shared")
    return checkpointed(classes), kept.select("class", "universe", "ref")


def common_from(total: int) -> int:
    """Number of parties from which on a token is common."""
    return max(2, math.ceil(COMMON * total))


def names_of(facts: str) -> list[str]:
    return facts.split("|", 2)[1].split(";")


def gram_counts(classes: DataFrame) -> np.ndarray:
    """Number of classes with each q-gram, in a table of fixed size by digest; q-grams of one cell count together, which only
    changes the order among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GRAM_COUNTERS, np.int64)
        for batch in batches:
            found = [g for facts in batch.column(0).to_pylist() for g in set().union(*map(grams, names_of(facts)))]
            counts += np.bincount(np.array(found, np.int64) % GRAM_COUNTERS, minlength=GRAM_COUNTERS) if found else 0
        cells = np.flatnonzero(counts)
        if len(cells):
            yield pa.record_batch([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])

    totals = classes.select("facts").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(GRAM_COUNTERS, np.int64)
    table[totals.column("cell").to_numpy()] = totals.column("n").to_numpy()
    return table


def token_counts(classes: DataFrame) -> tuple[dict[str, int], int]:
    """(number of classes with each common token, number of all classes)."""
    words = F.split(F.get(F.split("facts", r"\|"), F.lit(1)), "[; ]")
    total = classes.count()
    counts = classes.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").count()
    return {t: n for t, n in counts.where(F.col("count") >= common_from(total)).collect()}, total


_BITS = (1 << 61) - 1
PLACES, ASKS = 61, 61  # bits of the countries in a tag, and the bit that tells that its key asks
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(1 << 17)
def code(text: str) -> int:
    return xxhash.xxh64_intdigest(text) & _BITS


def mixed(*codes: int) -> int:
    """One code of several, in order."""
    key = 0
    for c in codes:
        key = (key * _FACTOR + c) & _BITS
    return key


def _prefix(ordered: list[int], share: float, evidence: int) -> list[int]:
    """The rarest q-grams, of which any set with that share of common q-grams has at least `evidence`."""
    return ordered[: len(ordered) - math.ceil(share * len(ordered) - 1e-9) + evidence]


@lru_cache(1 << 16)
def heard(token: str) -> frozenset[str]:
    """A word by sound, and the names it may be short for."""
    return frozenset({sound(token), *map(sound, full_names(token))})


@lru_cache(1 << 16)
def frame(token: str) -> tuple[int, ...]:
    """Beginning and end by sound of a word, and of the names it may be short for. None of an initial."""
    return tuple({code(f"^{s[:Q]}-{s[-Q:]}$") for s in heard(token)}) if len(token) > 1 else ()


@lru_cache(1 << 16)
def outer(token: str, letters: int) -> tuple[int, ...]:
    """Beginning and, with a letter more, end by sound of a word (a slip leaves one of them), and of the names it may be short for, as the
    first of two codes to be mixed. Of an initial, one letter at most."""
    sides = {("^" + s[:letters]) for s in heard(token)} | ({s[-letters - 1 :] + "$" for s in heard(token)} if len(token) > 1 else set())
    return tuple({mixed(code(e), 0) for e in sides}) if letters == 1 or len(token) > 1 else ()


@lru_cache(1 << 16)
def _beside(token: str) -> str | None:
    """What a word beside a framed one must be alike to, by sound; None of an initial and of a short name, whose partners may be any."""
    return None if len(token) == 1 or full_names(token) else sound(token)


def alike(x: str, y: str) -> str:
    """SQL condition that two words by sound, if both are given, may be spellings of one: few edits, a beginning, or one with a slip."""
    short = lambda a, b: f"startswith({b}, {a}) OR length({a}) <= 5 AND left({a}, 1) = left({b}, 1) AND levenshtein({a}, left({b}, length({a})), 2) >= 0"
    few = f"CASE WHEN greatest(length({x}), length({y})) >= 6 THEN levenshtein({x}, {y}, {FAR_EDITS}) ELSE levenshtein({x}, {y}, {NEAR_EDITS}) END >= 0"
    return f"({x} IS NULL OR {y} IS NULL OR {x} = {y} OR {few} OR {short(x, y)} OR {short(y, x)})"


@lru_cache(1 << 16)
def _date_parts(date: str) -> tuple[int, ...]:
    """Codes of year and month, of year and day, and of day and month with two years: those that differ by one share one."""
    y, m, d = date[:4], date[4:6], date[6:]
    return code(f"M{y}{m}"), code(f"T{y}-{d}"), code(f"B{m}{d}{y}"), code(f"B{m}{d}{int(y) + 1}")


@lru_cache(1 << 16)
def _year(year: str) -> int:
    return mixed(_YEAR, code(year))


@lru_cache(1 << 16)
def _place(country: str) -> int:
    return mixed(_PLACE, code(country))


@lru_cache(1 << 16)
def _digits(date: str) -> int:
    """Code of a full date, whatever the order of the digits of its day and month."""
    return code("D" + date[:4] + "".join(sorted(date[4:])))


def joined(tokens: list[str]) -> list[tuple[int, str]]:
    """Key of a name without blanks, by its beginning and end by sound, with all of it, and with the first and last word alone."""
    whole = sound("".join(tokens))
    key = code("=" + whole[:Q] + whole[-Q:])
    return [(key, whole), *([(key, sound(tokens[0] + tokens[-1]))] if len(tokens) > 2 else [])]


def words_of(name: str) -> list[str]:
    return [t for t in name.split() if t not in LINKS] or name.split()


class Spans:
    """Keys of many parties: their second codes, listed once, and spans of them that are to be mixed with each first code."""

    def __init__(self):
        self.codes: list[int] = []
        self.beside: list[int] = []
        #: Numbers of the words beside the framed ones.
        self.words: dict[str | None, int] = {None: 0}
        self.spans: list[tuple] = []
        #: Of the party whose spans are added: its row, its universe and the bits of its countries.
        self.party = (0, 0, 0)

    def add(self, found: Collection[tuple[int, int]]) -> int:
        """Add pairs of a code and the number of a word; where they begin."""
        begin = len(self.codes)
        if found:
            codes, beside = zip(*found)
            self.codes += codes
            self.beside += beside
        return begin

    def span(self, first: int, asks: bool, weight: int, begin: int, size: int) -> None:
        if size:
            self.spans.append((first, begin, size, asks, weight, *self.party))

    def mixed(self, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, row of its party, tag, number of its word) of each key that asks, and of those that answer a bit that is set."""
        first, begin, size, asks, weight, row, world, places = (np.array(x, np.uint64) for x in zip(*self.spans))
        first *= np.uint64(_FACTOR)
        sizes = size.astype(np.int64)
        at = np.arange(sizes.sum()) + np.repeat(begin.astype(np.int64) - sizes.cumsum() + sizes, sizes)
        keys = np.array(self.codes, np.uint64)[at] + np.repeat(first, sizes) & np.uint64(_BITS)  # only the low bits count
        keys = (keys ^ np.repeat(world, sizes)) << np.uint64(2) | np.repeat(weight, sizes)
        kept = np.repeat(asks > 0, sizes)
        if bits is not None:  # answers that nobody asks for stay here
            cell = (keys >> np.uint64(2)) % np.uint64(FILTER_BITS)  # the weight would leave three of four bits unused
            kept |= bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 > 0
        of = np.repeat(np.arange(len(sizes)), sizes)[kept]
        return keys[kept].view(np.int64), row[of].view(np.int64), (places | asks << np.uint64(ASKS))[of].view(np.int64), np.array(self.beside, np.int32)[at[kept]]


class Keys:
    """Join keys of parties, from the frequencies of all q-grams and the common tokens."""

    def __init__(self, counts: np.ndarray, common: set[str]):
        self.order = lru_cache(1 << 16)(lambda g: (int(counts[g % GRAM_COUNTERS]), g))
        self.common = {t for t in common if len(t) > 3}
        self.starts = {t[:n] for t in self.common for n in range(3, min(len(t), 7) + 1)}
        self.heads: dict[str, str | None] = {}
        self.near = {k: t for t in sorted(self.common) if len(t) > 5 for k in self._cut(t)}

    @staticmethod
    def _cut(token: str) -> set[str]:
        return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}

    def ordered(self, name: str) -> list[int]:
        return sorted(grams(name), key=self.order)

    def head(self, token: str) -> str | None:
        """The first letters of the common token that a token is, perhaps with a slip or cut short; None for rare tokens."""
        if token not in self.heads:
            if len(self.heads) > 1 << 17:
                self.heads.clear()
            self.heads[token] = self._head(token)
        return self.heads[token]

    def _head(self, token: str) -> str | None:
        if token in self.common:
            return token[:3]
        if len(token) > 5:
            if found := self._cut(token) & self.near.keys():
                return self.near[min(found)][:3]
        return token[:3] if 3 <= len(token) <= 7 and token in self.starts else None

    def framed(self, names: list[str], numbers: dict[str | None, int]) -> set[tuple[int, int]]:
        """The frame of each word with the initial or end of another, for a common word with more of it; with each, the number of the other
        word by sound, if its partner must be alike."""
        found: set[tuple[int, int]] = set()
        for name in names:
            tokens = words_of(name)
            beside = [numbers.setdefault(_beside(t), len(numbers)) for t in tokens]
            for i, t in enumerate(tokens):
                if frames := frame(t):
                    letters = 1 if self.head(t) is None else Q
                    found.update([(x + y & _BITS, beside[j]) for j, other in enumerate(tokens) if i != j for x in outer(other, letters) for y in frames])
        return found

    def person(self, names: list[str], dates: list[str], countries: list[str], keys: Spans) -> None:
        """Add the keys of a person that ask, and that only answer, each with the word beside the framed one.

        With full dates it asks by a rare q-gram and the date, and by its frames and two parts of the date, for slips. Without, by its
        frames and its year, or else each country (and anywhere among those that state none). It answers by its frames and years,
        countries and anywhere. With the frames goes the name without blanks, which must be alike where no date is asked for.
        """
        framed, unspaced = self.framed(names, keys.words), {x for name in names for x in joined(words_of(name))}
        begin = keys.add([(k, 0) for k in {k for k, _ in unspaced}])
        middle = keys.add(framed)
        end = keys.add([(k, keys.words.setdefault(w, len(keys.words))) for k, w in unspaced])
        dated, placed = (begin, end - begin), (middle, len(keys.codes) - middle)
        full = [d for d in dates if d[6:] != "00"]
        years, places = [*map(_year, {d[:4] for d in dates})], [*map(_place, countries)]
        if full:
            rare = {g for name in names for g in _prefix(self.ordered(name), SHARES["date"], 1)}
            span = keys.add([(g, 0) for g in rare]), len(rare)
            for d in full:
                keys.span(_digits(d), True, HEAVY, *span)
            asked = [(p, dated) for d in full for p in _date_parts(d)]
        else:
            asked = [(y, dated) for y in years] or [(p, placed) for p in (*places, _PLACELESS if countries else _ANYWHERE)]
        answered = {**dict.fromkeys(years, dated), **dict.fromkeys((*places, _ANYWHERE, *(() if countries else (_PLACELESS,))), placed)}
        for c, span in asked:
            keys.span(c, True, HEAVY, *span)
            answered.pop(c, None)
        for c, span in answered.items():
            keys.span(c, False, HEAVY, *span)

    def company(self, kind: str, names: list[str]) -> set[int]:
        """Keys of two q-grams of the rare tokens, with the heads of the common ones."""
        keys: set[int] = set()
        for name in names:
            tokens = [t for t in name.split() if t not in LINKS and t[0] != "#"]
            heads = [self.head(t) for t in tokens]
            rare = [t for t, h in zip(tokens, heads) if h is None] or tokens
            around = mixed(code(" ".join([kind, *sorted(h for h in heads if h)])), 0)
            prefix = sorted(_prefix(self.ordered(" ".join(rare)), SHARES["company"], EVIDENCE))
            for i, x in enumerate(prefix):
                x = mixed(around + x, 0)
                keys.update([x + y & _BITS for y in prefix[i + 1 :]])
        return keys


def asked_keys(keys: DataFrame) -> np.ndarray:
    """A bit array with the bits of all keys set; what reaches the driver is at most its fixed size."""
    bit = keys.select((F.pmod(F.shiftright("key", 2), F.lit(FILTER_BITS)) + 1).alias("bit"))
    maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, content in maps:
        begin = (bucket - 1) * (_FOLD // 8)
        bits[begin : begin + _FOLD // 8] = np.frombuffer(content, np.uint8)
    return bits


_YEAR, _PLACE, _ANYWHERE, _PLACELESS = (code(x) for x in ("year", "place", "anywhere", "placeless"))


def candidate_pairs(classes: DataFrame, across: bool, nicknames: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(a, b): pairs of classes with common keys; within one universe, or across both (a a client, b listed).

    Persons with full dates meet by date and q-gram, or by parts of the date and ends of words. Only the few without pair by
    year or country with all others, so common names of people with known dates never meet without their dates. Companies meet
    by their rare tokens beside equal common ones. All keys of a party are made in one pass and join with themselves; the
    two lowest bits of a key are its weight; its tag tells whether it asks and, as bits, the party's countries, and its word is the one
    beside the framed one, so that parties whose countries differ, or whose words are not alike, never become a pair. The shuffle files of
    the keys are gone when the pairs are returned, before what is known of the parties travels with them.
    """
    spark = classes.sparkSession
    counts, common = gram_counts(classes), set(token_counts(classes)[0])
    shared = spark.sparkContext.broadcast((counts, common, nicknames or nickname_table()))
    worlds = {u: 0 if across else code(u) for u in (CLIENT, LISTED)}

    def keyed(rows: DataFrame, asked=None) -> DataFrame:
        """Keys that ask; with `asked`, the bits of those of parties without a full date, also the keys that answer them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Keys(*shared.value[:2])
            use_nicknames(shared.value[2])
            for batch in batches:
                keys = Spans()
                for i, (universe, facts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    kind, names, _, dates, countries, _ = facts.split("|", 5)
                    names, dates, countries = (x.split(";") if x else [] for x in (names, dates, countries))
                    keys.party = i, worlds[universe], sum({1 << code(c) % PLACES for c in countries})
                    if kind != "P":
                        found = make.company(kind, names)
                        keys.span(0, True, MIDDLE, keys.add([(k, 0) for k in found]), len(found))
                    else:
                        make.person(names, dates, countries, keys)
                if keys.spans:
                    key, own, tags, beside = keys.mixed(asked.value if asked is not None else None)
                    word = pa.array(keys.words, pa.string()).take(pa.array(beside))
                    yield pa.record_batch([pa.array(key), batch.column(0).take(pa.array(own)), pa.array(tags), word], names=["key", "class", "tag", "word"])

        return rows.select("class", "universe", "facts").mapInArrow(run, "key bigint, class bigint, tag bigint, word string")

    asking = classes.where((F.col("kind") == "P") & ~F.col("full"))

    def asked_by(rows: DataFrame):
        return spark.sparkContext.broadcast(asked_keys(keyed(rows)))

    def side(rows: DataFrame, name: str, flag: str, bits) -> DataFrame:
        return keyed(rows, bits).select("key", F.col("class").alias(name), F.col("tag").alias(flag), F.col("word").alias(f"{flag}_word"))

    all_places = (1 << PLACES) - 1
    agree = f"(p & q & {all_places}L <> 0 OR p & {all_places}L = 0 OR q & {all_places}L = 0)"
    p_asks, q_asks = (f"shiftright({x}, {ASKS}) = 1" for x in "pq")
    agree = f"{agree} AND {alike('p_word', 'q_word')}"

    if across:
        of = lambda rows, u: rows.where(F.col("universe") == u)
        # Either side answers only what the other one asks.
        left, right = (side(of(classes, u), n, f, asked_by(of(asking, v))) for u, v, n, f in ((CLIENT, LISTED, "a", "p"), (LISTED, CLIENT, "b", "q")))
        pairs = left.join(right, "key").where(f"({p_asks} OR {q_asks}) AND {agree}")
    else:
        # One condition over both sides, so that no filter makes the shuffles of the two sides different plans.
        met = F.expr(f"CASE WHEN NOT {p_asks} OR NOT ({agree}) THEN false WHEN NOT {q_asks} THEN a <> b ELSE a < b END")
        bits = asked_by(asking)
        pairs = side(classes, "a", "p", bits).join(side(classes, "b", "q", bits), "key").where(met).select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    weight = F.col("key").bitwiseAND(3)
    return checkpointed(pairs.groupBy("a", "b").agg(F.sum(weight).alias("weight")).where(F.col("weight") >= ENOUGH).select("a", "b"))


EQUAL, PARTLY, UNKNOWN, SLIP, DIFFERENT = 4, 3, 2, 1, 0


def _dates(a: str, b: str) -> int:
    if a == b and not a.endswith("00"):
        return EQUAL
    if a[:4] == b[:4] and (a.endswith("00") or b.endswith("00")):
        return PARTLY if "00" in (a[4:6], b[4:6]) or a[4:6] == b[4:6] else DIFFERENT
    if "00" in (a[6:], b[6:]):
        return DIFFERENT
    if a[:4] == b[:4] and (a[4:6], a[6:]) == (b[6:], b[4:6]):
        return SLIP
    if a[:4] == b[:4] and (sum(x != y for x, y in zip(a, b)) == 1 or swapped(a, b)):
        return SLIP
    return SLIP if a[4:] == b[4:] and abs(int(a[:4]) - int(b[:4])) == 1 else DIFFERENT


def swapped(a: str, b: str) -> bool:
    """Whether two neighbouring digits changed places."""
    at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


def dates_agree(a: list[str], b: list[str]) -> int:
    """The best agreement of any two stated dates."""
    return max((_dates(x, y) for x in a for y in b), default=UNKNOWN)


def sets_agree(a: list[str], b: list[str]) -> int:
    """1 common values, 0 one side states none, -1 different ones."""
    return 0 if not a or not b else 1 if set(a) & set(b) else -1


def numbers_agree(a: list[str], b: list[str]) -> int:
    """1 a common number, -1 different numbers of one kind, else 0."""
    if set(a) & set(b):
        return 1
    kinds = {n[:2] for n in a} & {n[:2] for n in b} - {"pp"}
    return -1 if kinds else 0


#: Parties are taken as a sample of at least so many people: in a small table every name looks common or unique.
POPULATION = 1_000
#: Likeness below which a spelling meets many names of other people, and what a point below it takes off the evidence.
LOOSE, LOOSE_COST = 0.9, 40.0
#: Least share of common letter pairs, of the shorter spelling, for two spellings to be compared at all: with equal dates, and else, where
#: more of a name must agree.
NEAR, NEARER = 0.34, 0.5


def name_agreement(kind: str, a: list[str], b: list[str], weight, common=lambda t: True, masks: tuple[list[int], list[int]] | None = None, near: float = NEAR) -> tuple[float, float]:
    """Best likeness of any two spellings, and best evidence. masks of their letter pairs, if given, rule out most at once."""
    if kind != "P":  # a spelling may lack the legal form, but two parties' forms may not differ
        forms_a, forms_b = ({t for n in names for t in n.split() if t[0] == "#"} for names in (a, b))
        if forms_a and forms_b and not forms_a & forms_b:
            return 0.0, 0.0
    best = proof = 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if masks:
                m, n = masks[0][i], masks[1][j]
                if (m & n).bit_count() < near * min(m.bit_count(), n.bit_count()):
                    continue
            if kind == "P":
                value, found = person_agreement(tuple(x.split()), tuple(y.split()), weight, common)
                proof = max(proof, found - LOOSE_COST * max(0.0, LOOSE - value) if value else 0.0)
            else:
                value = company_likeness(tuple(x.split()), tuple(y.split()), weight)
            best = max(best, value)
            if best >= 0.995 and kind != "P":
                return best, 0.0
    return best, proof


@lru_cache(1 << 15)
def _facts(text: str) -> list:
    kind, *lists = text.split("|")
    names, masks, *others, shared = (x.split(";") if x else [] for x in lists)
    return [kind, names, [int(m, 16) for m in masks], *others, {t: int(n) for t, n in (x.rsplit(":", 1) for x in shared)}]


def compared(pairs: DataFrame, classes: DataFrame, nicknames: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(a, b, kind, name, evidence, dates, countries, numbers) of candidate pairs whose stated facts do not exclude each other.

    Facts that exclude are tested before names are compared. A token weighs the logarithm of all parties over the others that
    have it. `evidence` is the weight of what two persons' names share, less what their slips cost, less the logarithm of the
    number of parties: minus the logarithm of how many parties would share as much by chance. What is known of a party
    travels as one short text, as it is moved once for every pair.
    """
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((*token_counts(classes), nicknames or nickname_table()))
    known = classes.select("class", "facts")
    schema = [("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string()), ("name", pa.float64()), ("evidence", pa.float64()), ("dates", pa.int32()), ("countries", pa.int32()), ("numbers", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, short = shared.value
        total = max(total, POPULATION)
        use_nicknames(short)
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                (kind, na, ma, da, ca, ua, ta), (kind_b, nb, mb, db, cb, ub, tb) = _facts(x), _facts(y)
                if kind != kind_b or (countries := sets_agree(ca, cb)) < 0 or (dates := dates_agree(da, db)) == DIFFERENT or (numbers := numbers_agree(ua, ub)) < 0:
                    continue

                def weight(t: str) -> float:
                    return math.log(total / max(0.5, (counts.get(t) or ta.get(t) or tb.get(t) or 1) - 1))

                name, proof = name_agreement(kind, na, nb, weight, counts.__contains__, (ma, mb), NEAR if dates == EQUAL or numbers > 0 or kind != "P" else NEARER)
                if name >= 0.5:
                    rows.append((a, b, kind, name, proof - math.log(total), dates, countries, numbers))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])

    left, right = known.select(F.col("class").alias("a"), F.col("facts").alias("x")), known.select(F.col("class").alias("b"), F.col("facts").alias("y"))
    sides = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return sides.mapInArrow(run, "a bigint, b bigint, kind string, name double, evidence double, dates int, countries int, numbers int")
