"""Postal addresses that denote the same building.

Addresses are parsed into number, street and locality; distinct readings are indexed by number,
locality and the deletion neighbourhood of their street tokens; candidates are verified by an optimal
assignment of their street components, with hard vetoes on number (and unit, where wanted).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.similarity import assigned, edit_distance
from tamis.session import checkpointed, clean_id

# Street types of four languages with their usual short forms.
TYPES = {
    "rue": "rue r", "avenue": "avenue avenida ave av avd avda", "boulevard": "boulevard blvd bd boul bvd", "place": "place plaza platz pl pza plz pza",
    "impasse": "impasse imp", "chemin": "chemin chem ch", "calle": "calle cl c", "paseo": "paseo pso pº p", "camino": "camino cno cmno cam", "ronda": "ronda rda",
    "street": "street st str", "road": "road rd", "lane": "lane ln la", "drive": "drive dr drv", "square": "square sq",
    "strasse": "strasse str", "weg": "weg wg", "allee": "allee al", "gasse": "gasse g", "ufer": "ufer uf", "quai": "quai q", "cours": "cours crs", "route": "route rte", "travesia": "travesia trva",
}
LEADING = {w: t for t in ("rue", "avenue", "boulevard", "place", "impasse", "chemin", "calle", "paseo", "camino", "ronda", "quai", "cours", "route", "travesia") for w in TYPES[t].split() if w != "platz"}
TRAILING = {w: t for t in ("street", "road", "lane", "drive", "square") for w in TYPES[t].split()} | {"avenue": "avenue", "ave": "avenue", "place": "place"}
COMPOUND = {w: t for t in ("strasse", "weg", "allee", "gasse", "ufer") for w in TYPES[t].split()} | {"platz": "place", "pl": "place"}
_COMPOUND = re.compile(r"^(.{4,}?)-?(strasse|weg|platz|allee|gasse|ufer|str\.?|wg\.?|pl\.|al\.|g\.|uf\.)$")
# Words before a street's name that are part of it, with their short forms.
QUALIFIERS = {
    "saint": "saint st ste sainte", "san": "san santa sta", "sankt": "sankt", "doctor": "doctor docteur dr", "general": "general gal gral gen",
    "upper": "upper upr", "lower": "lower lwr", "north": "north n", "south": "south s", "alte": "alte alt alter", "neue": "neue neuer",
}
QUALIFIER = {w: q for q, words in QUALIFIERS.items() for w in words.split()}
# Linking words without weight.
LINKS = {"de", "la", "del", "du", "des", "le", "les", "los", "las", "el", "d", "l", "der", "den", "dem", "am", "an", "the", "of", "y"}
# How units inside a building, boxes and mail codes are written.
_UNIT = re.compile(
    r"\b\d+\s*(?:er|eme|re|e)?\s+etage\b|\b\d+\.?\s*(?:og|ug|eg)\b\.?|\b\d+\s*[ºo°]\s*(?:izq|dcha|der|cto)\b\.?|\b(?:hinterhaus|vorderhaus|seitenhaus)\b"
    r"|\b(?:bat|batiment|appt|apt|appartement|app|bp|cs|suite|ste|flat|floor|unit|apartment|piso|puerta|esc|escalera|postfach|etage|esc|porte|box|apartado|po box|p\.o\. box)\b\.?\s*[a-z]?\d*[a-z]?\b(?=\s*(?:,|$|\d|\s))"
)
_CEDEX = re.compile(r"\bcedex\b(?:\s+\d{1,2}\b)?")
_POSTCODE = re.compile(r"\b(?:[a-z]{1,2}-)?(\d{4,6})\b")
_NUMBER = re.compile(r"(?:\b(?:nr|no|num|numero|n)\b\s*[.:º°]?\s*|\bn?[º°]\s*)?\b(\d{1,4})(?:\s*(bis|ter|quater)\b|([a-z])\b(?![./º°])|\s+([abd])(?![\w./]))?(?![\dº°])")


def plain(text: str | None) -> str:
    """Lower case without accents; letters without a plain base stay."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFD", text.casefold())
    return re.sub(r"\s", " ", "".join(c for c in folded if unicodedata.category(c) not in ("Mn", "Cf")))


def locality(text: str | None) -> tuple[str, str]:
    """(name, postcode) of a city field."""
    folded = _CEDEX.sub(" ", plain(text))
    code = _POSTCODE.search(folded)
    return " ".join(re.findall(r"[^\W\d_]+", _POSTCODE.sub(" ", folded))), code[1] if code else ""


def near(a: str, b: str) -> bool:
    """Spellings of one name: at most one slip in a short word, two in a longer one."""
    shorter = min(len(a), len(b))
    return edit_distance(a, b, 2) <= (2 if shorter >= 7 else 1 if shorter >= 4 else 0)


def street(words: list[str]) -> tuple[str, list[str], list[str]] | None:
    """(type, qualifiers, name words) of the words of a street; None without a name."""
    kind = ""
    tokens = [w for w in words if w.strip(".-/'")]
    bare = [w.strip(".-/'") for w in tokens]
    if len(bare) > 1 and bare[0] in LEADING:
        kind, tokens, bare = LEADING[bare[0]], tokens[1:], bare[1:]
    elif len(bare) > 1 and bare[-1] in TRAILING and not (bare[-1] in COMPOUND and (bare[0] in ("alte", "alt", "sankt") or len(bare) == 2 and bare[-1] == "str")):
        kind, tokens, bare = TRAILING[bare[-1]], tokens[:-1], bare[:-1]
    elif len(bare) > 1 and bare[-1] in COMPOUND:
        kind, tokens, bare = COMPOUND[bare[-1]], tokens[:-1], bare[:-1]
    elif m := _COMPOUND.match(tokens[-1] if tokens else ""):
        kind, bare = COMPOUND[m[2].strip(".")], [*bare[:-1], m[1].strip("-")]
    parts = [p for w in bare for p in re.split(r"[-'’/.]+", w) if p]
    marks, name = [], []
    for i, p in enumerate(parts):
        if p in QUALIFIER and i < len(parts) - 1:
            marks.append({"san": "saint", "sankt": "saint"}.get(QUALIFIER[p], QUALIFIER[p]))
        elif p not in LINKS:
            name.append(p)
    return (kind, sorted(marks), name) if name else None


def readings(address: str | None, city: str | None) -> list[tuple]:
    """Ways to read an address: (number, type, qualifiers, name words, unit, locality, postcode).

    One reading, unless the locality stands undelimited at the end; then one for each number of words it may have.
    No reading without a street and a number.
    """
    text = _CEDEX.sub(" ", plain(address)).replace("c/", "c ")
    town, code = locality(city)
    unit = "".join(re.findall(r"\w", m[0])) if (m := _UNIT.search(text)) else ""
    text = _UNIT.sub(" , ", text)
    inside = ""
    if m := _POSTCODE.search(text):
        rest = re.match(r"[^,\d]*", text[m.end() :])[0]
        inside, code = " ".join(re.findall(r"[^\W\d_]+", rest)), m[1]
        text = f"{text[: m.start()]} , {text[m.end() + len(rest) :]}"
    m = _NUMBER.search(text)
    if not m:
        return []
    number = f"{int(m[1])}{m[2] or m[3] or m[4] or ''}"
    before, after = text[: m.start()], text[m.end() :]
    pieces = [p.split() for p in [*before.split(","), *after.split(",")]]
    pieces = [p for p in pieces if any(re.search(r"[^\W\d_]{2}", w) for w in p)]
    name = lambda words: " ".join(re.findall(r"[^\W\d_]+", " ".join(words)))
    if not pieces:
        return []
    if not town and inside:
        town = inside
    if town:
        others = [p for p in pieces if not near(name(p), town)] or pieces
        main = next((p for p in others if p[0].strip(".") in LEADING or p[-1].strip(".") in TRAILING or _COMPOUND.match(p[-1])), others[0])
        size = len(town.split())
        for k in (size, size + 1, size - 1):
            if 0 < k < len(main) and near(name(main[-k:]), town):
                main = main[:-k]
                break
        found = street(main)
        return [(number, *found, unit, town, code)] if found else []
    if len(pieces) > 1:
        found = street(pieces[0])
        return [(number, *found, unit, name(pieces[1]), code)] if found else []
    main, result = pieces[0], []
    for k in range(0, min(6, len(main))):
        if found := street(main[: len(main) - k]):
            result.append((number, *found, unit, name(main[len(main) - k :]) if k else "", code))
    return result


_READING = T.ArrayType(
    T.StructType(
        [T.StructField("number", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("marks", T.ArrayType(T.StringType())),
         T.StructField("name", T.ArrayType(T.StringType())), T.StructField("unit", T.StringType()), T.StructField("town", T.StringType()), T.StructField("code", T.StringType())]
    )
)
_ARROW = pa.list_(
    pa.struct([("number", pa.string()), ("kind", pa.string()), ("marks", pa.list_(pa.string())), ("name", pa.list_(pa.string())), ("unit", pa.string()), ("town", pa.string()), ("code", pa.string())])
)


def _read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for address, city in batches:
        yield pa.array([readings(a, c) for a, c in zip(address.to_pylist(), city.to_pylist())], _ARROW)


def word_keys(word: str) -> set[str]:
    """Deletion neighbourhood of a word: two words at most one slip apart (in long ones, one at either end) share a key."""
    keys = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) < 9 else set()
    if len(word) > 7:  # words of 8 letters have both kinds, as a slip may change the length
        head, tail = word[:6], word[-6:]
        keys |= {f"^{head[:5]}", f"{tail[1:]}$"}
        for i in range(6):
            keys |= {f"^{head[:i]}{head[i + 1 :]}", f"{tail[:i]}{tail[i + 1 :]}$"}
    return keys


def _keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([sorted(set().union(*map(word_keys, words))) if words else [] for words in batch.to_pylist()], pa.list_(pa.string()))


def same_street(a: tuple, b: tuple) -> bool:
    """Whether (type, qualifiers, name words) mean one street: an optimal assignment of the name words leaves nothing apart."""
    (kind_a, marks_a, words_a), (kind_b, marks_b, words_b) = a, b
    if kind_a and kind_b and kind_a != kind_b or marks_a != marks_b:
        return False
    if "".join(words_a) == "".join(words_b):
        return True
    if len(words_a) != len(words_b):
        return near("".join(words_a), "".join(words_b))
    costs = [[0.0 if x == y else 1.0 if near(x, y) else 9.0 for y in words_b] for x in words_a]
    return assigned(costs) <= max(1, len(words_a) - 1)


def _same(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for left, right in batches:
        pairs = zip(left.to_pylist(), right.to_pylist())
        pick = lambda x: (x["kind"], x["marks"], x["name"])
        yield pa.array([same_street(pick(x), pick(y)) for x, y in pairs], pa.bool_())


def main_spelling(names: DataFrame, ratio: int = 4) -> DataFrame:
    """(town, main): each locality name with the much more frequent name it is a slip of, or itself.

    names: (town, n). Candidates come from the deletion neighbourhood of the names.
    """
    keyed = names.where("town <> ''").select("town", "n", F.explode(F.arrow_udf(_keys, "array<string>")(F.array(F.replace("town", F.lit(" "), F.lit(""))))).alias("k"))
    other = keyed.select(F.col("town").alias("other"), F.col("n").alias("m"), "k")
    check = F.arrow_udf(_near, "boolean")
    better = (
        keyed.join(other, "k").where((F.col("m") >= ratio * F.col("n")) & (F.col("town") != F.col("other"))).select("town", "other", "m").distinct()
        .where(check("town", "other")).groupBy("town").agg(F.max_by("other", F.struct("m", "other")).alias("main"))
    )
    return names.where("town <> ''").join(better, "town", "left").select("town", F.coalesce("main", "town").alias("main"))


def _near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([near(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def same_places(
    rows: DataFrame, key: str = "client_id", address: str = "client_address", city: str = "client_city", veto_units: bool = False
) -> DataFrame:
    """(key_small, key_large): different keys whose address and city denote one building.

    Same street (type and qualifiers equal as far as given, name words equal up to slips), same house number with
    suffix, same locality up to slips. Postcodes never veto; units do only with veto_units. Rows without street or number, and
    null or empty addresses, denote no place. A locality missing from field and address is taken from the postcode where
    rows with that postcode agree on one, else from the only locality that has this street and number, else the
    row denotes no place. A key with several addresses is linked by each. Repeated rows change nothing. Other columns are ignored.

    Equal readings are collapsed before anything is paired, so copies of an address, however many, are compared once; keys are paired
    only in the last join, which returns every pair, as asked for.
    """
    marked = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))
    parsed = rows.select(clean_id(key).alias("key"), F.col(address).alias("address"), F.col(city).alias("city")).where("key is not null")
    parsed = parsed.withColumn("written", F.unhex(F.md5(F.concat(marked("address"), F.lit("\n"), marked("city"))))).distinct()
    writers = parsed.select("key", "written")
    read = parsed.groupBy("written").agg(F.first(F.struct("address", "city")).alias("a")).select("written", F.arrow_udf(_read, _READING)("a.address", "a.city").alias("ways"))
    read = checkpointed(read.select("written", F.size("ways").alias("ways"), F.inline("ways")))
    sure = read.where("ways = 1 and town <> ''").join(writers, "written").groupBy("town").agg(F.count("*").alias("n"))
    towns = main_spelling(sure).join(sure, "town")
    towns = towns.join(towns.groupBy("main").agg(F.sum("n").alias("weight")), "main").select("town", "main", "weight")
    best = Window.partitionBy("written").orderBy(F.desc_nulls_last("weight"), F.size("name"), "town")
    located = read.join(towns, "town", "left").withColumn("rank", F.row_number().over(best)).where("rank = 1")
    codes = located.where("code <> '' and main is not null").groupBy("code").agg(F.min("main").alias("low"), F.max("main").alias("high")).where("low = high").select("code", F.col("low").alias("by_code"))
    located = located.join(codes, "code", "left").withColumn("place", F.coalesce("main", "by_code"))
    shape = ["number", "place", "kind", "marks", "name", *(["unit"] if veto_units else [])]
    located = checkpointed(located.select("written", *shape, F.xxhash64(*shape).alias("form")))
    forms = located.drop("written").dropDuplicates(["form"])
    owners = located.select("written", "form").join(writers, "written").select("key", "form").distinct()

    indexed = forms.select("form", "number", "place", F.struct("kind", "marks", "name").alias("street"), *(["unit"] if veto_units else []),
                           F.explode(F.arrow_udf(_keys, "array<string>")("name")).alias("k"))
    a = indexed.select([F.col(c).alias(f"a_{c}") for c in indexed.columns])
    b = indexed.select([F.col(c).alias(f"b_{c}") for c in indexed.columns])
    same = F.arrow_udf(_same, "boolean")

    def verified(pairs: DataFrame) -> DataFrame:
        if veto_units:
            pairs = pairs.where("a_unit = '' or b_unit = '' or a_unit = b_unit")
        return pairs.dropDuplicates(["a_form", "b_form"]).where(same("a_street", "b_street"))

    known = verified(a.join(b, (F.col("a_number") == F.col("b_number")) & (F.col("a_place") == F.col("b_place")) & (F.col("a_k") == F.col("b_k")) & (F.col("a_form") < F.col("b_form"))))
    loose = verified(a.where("a_place is null").join(b.where("b_place is not null"), (F.col("a_number") == F.col("b_number")) & (F.col("a_k") == F.col("b_k"))))
    only = loose.groupBy("a_form").agg(F.countDistinct("b_place").alias("places")).where("places = 1").select("a_form")
    edges = known.select("a_form", "b_form").unionByName(loose.join(only, "a_form", "left_semi").select("a_form", "b_form"))
    alike = forms.where("place is not null").select(F.col("form").alias("a_form"), F.col("form").alias("b_form"))
    links = edges.unionByName(alike)
    x = owners.select(F.col("key").alias("x"), F.col("form").alias("a_form"))
    y = owners.select(F.col("key").alias("y"), F.col("form").alias("b_form"))
    pairs = links.join(x, "a_form").join(y, "b_form").where("x <> y")
    return pairs.select(F.least("x", "y").alias(f"{key}_small"), F.greatest("x", "y").alias(f"{key}_large")).distinct()
