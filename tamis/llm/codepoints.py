"""One consistent form for text that looks the same but consists of different characters.

Distinct texts are exploded to positioned code points, which are joined with a broadcast table of
decompositions and look-alikes; combining marks are ordered by class, recomposed, and the texts rebuilt.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters that share their shape with a Latin letter, after accents are taken off.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗаесѕіјорухԁһԛԝвкмнтѵ", "ABESIJKMHOPCTYX3aecsijopyxdhqwbkmhtv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυκχτ", "ABEZHIKMNOPTYXoavipukxt"))
# Small letters whose shape equals the Latin one only as a small capital or loosely.
#: They count as look-alikes beside Latin letters, but a word of such letters alone is foreign.
LOOSE = set("вкмнтзвЗανυκχτ")

#: Compatibility forms that only change the look of a letter or sign.
FORMS = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
WIDTH, ACCENT, INVISIBLE, BLANK, FOREIGN = "width", "accent", "invisible", "blank", "foreign"
REASONS = (WIDTH, ACCENT, INVISIBLE, BLANK, FOREIGN)
_JOINERS = ("‌", "‍")
_FILLERS = "͏ᅟᅠ឴឵᠎ㅤﾠ"


def _form(ch: str) -> str | None:
    """The plain characters behind a width, ligature, font or positional form or a duplicate sign; None for others."""
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return None
    if parts[0].startswith("<"):
        letterlike = unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl"
        if parts[0] not in FORMS or parts[0] == "<compat>" and not letterlike:
            return None
        plain = unicodedata.normalize("NFKC", ch)
        return plain.replace("‐", "-") if parts[0] == "<noBreak>" else plain
    plain = unicodedata.normalize("NFC", ch)
    return plain if plain != ch and len(plain) == 1 else None


@cache
def character_rows() -> list[tuple]:
    """(cp, reason, parts): what a character stands for; parts are (character, combining class).

    Built by rule from the character database; its size is bounded by that of the code space.
    """
    rows = []
    for c in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or 0x2F800 <= c <= 0x2FA1F or 0x20000 <= c < 0xE0000:
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co"):
            continue
        reason, plain = None, ch
        if category in ("Zs", "Zl", "Zp") or c == 0x85:
            reason, plain = BLANK, " "
        elif category == "Cf" and not 0x600 <= c <= 0x8E2 or ch in _FILLERS or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            reason, plain = INVISIBLE, ""
        elif (form := _form(ch)) is not None:
            reason, plain = WIDTH, form
        parts = [(x, unicodedata.combining(x)) for x in unicodedata.normalize("NFD", plain)]
        if reason or [x for x, _ in parts] != [ch] or unicodedata.combining(ch):
            rows.append((c, reason, parts))
    rows.extend((c, BLANK, [(" ", 0)]) for c in (9, 10, 11, 12, 13))
    return rows


@cache
def composed_rows() -> list[tuple[str, str]]:
    """(cluster, composed): every base with its marks in order that has one composed character."""
    rows = []
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if not 0xAC00 <= c <= 0xD7A3 and unicodedata.normalize("NFC", ch) == ch and (plain := unicodedata.normalize("NFD", ch)) != ch:
            rows.append((plain, ch))
    return rows


def character_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(character_rows(), "cp int, reason string, parts array<struct<ch:string,ccc:int>>")


def shape_table(spark: SparkSession) -> DataFrame:
    """(base, latin, cyrillic, greek, loose): the letters of the same shape in the three scripts."""
    back_c = {v: k for k, v in reversed(CYRILLIC.items()) if k not in LOOSE}
    back_g = {v: k for k, v in reversed(GREEK.items()) if k not in LOOSE}
    rows = [(k, v, k, None, k in LOOSE) for k, v in CYRILLIC.items()] + [(k, v, None, k, k in LOOSE) for k, v in GREEK.items()]
    rows += [(x, x, back_c.get(x), back_g.get(x), False) for x in sorted({*back_c, *back_g})]
    return spark.createDataFrame(rows, "base string, latin string, cyrillic string, greek string, loose boolean")


@cache
def _recompose():
    """Canonical composition of a cluster that has no single composed character."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([x and unicodedata.normalize("NFC", x) for x in batch.to_pylist()], pa.string())

    return run


def consistent_texts(texts: DataFrame) -> DataFrame:
    """(key, consistent, reasons) for each (key, text): the text in one consistent form and why it changed.

    key must be unique. Reasons, sorted: width (width, ligature, font and positional forms, duplicate signs),
    accent (accents written apart), invisible, blank, foreign (letters of another script of the same shape
    within a word, or a word of such letters only among Latin words). Accents, case and ordinary punctuation stay. A word
    truly written in another script stays as it is, as do wide forms and wide blanks beside ideographs and
    joiners in scripts that need them. Null gives null; empty text stays empty. A text is rebuilt as a whole.

    One shuffle, by key; every later step works within a text and reuses that partitioning.
    """
    spark = texts.sparkSession
    keyed = texts.select("key", "text").where("text <> ''")
    # A word is a run of letters, marks and invisible characters; everything else stands between words.
    pieces = keyed.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{Cf}]+|[^\p{L}\p{M}\p{Cf}]+"), F.lit(0))).alias("piece", "content"))
    # By number, as a text grows thirtyfold here and sizes before say little about the tasks after.
    chars = (
        pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        .select("key", "piece", F.posexplode(F.regexp_extract_all("content", F.lit("(?s)."), F.lit(0))).alias("at", "ch"))
        .join(F.broadcast(character_table(spark)), F.expr("ascii(ch)") == F.col("cp"), "left")
    )
    of_text, of_piece = Window.partitionBy("key"), Window.partitionBy("key", "piece")
    upto = Window.partitionBy("key").orderBy("piece", "at").rowsBetween(Window.unboundedPreceding, 0)
    chars = (
        chars.withColumn("cjk", F.max(F.col("ch").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")).over(of_text))
        .withColumn("west", F.max(F.col("ch").rlike(r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]")).over(of_piece))
        .withColumn("segment", F.sum(F.col("ch").isin("(", ")", "（", "）", "[", "]", "/").cast("int")).over(upto))
    )
    kept = F.col("cjk") & ((F.col("reason") == WIDTH) | (F.col("ch") == "　")) | ~F.col("west") & F.col("ch").isin(*_JOINERS)
    chars = chars.withColumn("kept", F.coalesce(kept, F.lit(False)))
    itself = F.array(F.struct(F.col("ch"), F.lit(0).alias("ccc")))
    chars = chars.withColumn("parts", F.when(F.col("parts").isNull() | F.col("kept"), itself).otherwise(F.col("parts"))).withColumn("reason", F.when(~F.col("kept"), F.col("reason")))
    # An invisible character keeps a row without a character, so that its reason is not lost.
    marks = chars.select("key", "piece", "segment", "at", "reason", F.posexplode_outer("parts").alias("k", "part")).select(
        "key", "piece", "segment", "at", F.coalesce("k", F.lit(0)).alias("k"), "reason", F.col("part.ch").alias("ch"), F.coalesce("part.ccc", F.lit(0)).alias("ccc")
    )
    shaped = marks.join(F.broadcast(shape_table(spark)), F.col("ch") == F.col("base"), "left")
    letter = lambda script: F.col("ch").rlike(r"\p{Is%s}" % script) & F.col("ch").rlike(r"\p{L}")
    scripts = {"latin": letter("Latin"), "cyrillic": letter("Cyrillic"), "greek": letter("Greek")}
    for name, is_in in scripts.items():
        shaped = shaped.withColumn(f"n_{name}", F.count_if(is_in).over(of_piece))
        shaped = shaped.withColumn(f"to_{name}", F.min(F.when(F.col("ch").rlike(r"\p{L}"), is_in | F.col(name).isNotNull())).over(of_piece))
    strict = F.min(F.when(F.col("ch").rlike(r"\p{L}"), F.coalesce(~F.col("loose"), F.lit(False)) & F.col("latin").isNotNull())).over(of_piece)
    shaped = shaped.withColumn("n_foreign", F.col("n_cyrillic") + F.col("n_greek")).withColumn("shapes_only", (F.col("n_latin") == 0) & (F.col("n_foreign") > 0) & strict)
    of_segment = Window.partitionBy("key", "segment")
    latin_around = F.count_if(F.col("n_latin") > 0).over(of_segment) > 0
    truly_foreign = F.count_if((F.col("n_foreign") > 0) & (F.col("n_latin") == 0) & ~F.col("shapes_only")).over(of_segment) > 0
    mixed = (F.col("n_latin") > 0) & (F.col("n_foreign") > 0)
    target = (
        F.when(F.col("shapes_only") & latin_around & ~truly_foreign, "latin")
        .when(mixed & F.col("to_latin") & ((F.col("n_latin") >= F.col("n_foreign")) | ~(F.col("to_cyrillic") | F.col("to_greek"))), "latin")
        .when(mixed & F.col("to_cyrillic") & (F.col("n_greek") == 0), "cyrillic")
        .when(mixed & F.col("to_greek") & (F.col("n_cyrillic") == 0), "greek")
        .when(mixed & F.col("to_latin"), "latin")
    )
    decided = shaped.withColumn("target", target)
    chosen = F.when(F.col("target") == "latin", F.col("latin")).when(F.col("target") == "cyrillic", F.col("cyrillic")).when(F.col("target") == "greek", F.col("greek"))
    decided = decided.withColumn("out", F.coalesce(chosen, F.col("ch"))).withColumn(
        "why", F.when(F.col("out") != F.col("ch"), F.lit(FOREIGN))
    )
    in_order = Window.partitionBy("key").orderBy("piece", "at", "k").rowsBetween(Window.unboundedPreceding, 0)
    clustered = decided.withColumn("cluster_no", F.sum(((F.col("ccc") == 0) & F.col("out").isNotNull()).cast("int")).over(in_order))
    clusters = clustered.groupBy("key", "cluster_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("ccc", "piece", "at", "k", "out")))), lambda x: x["out"]
            ),
            "",
        ).alias("cluster"),
        F.min("ccc").alias("least"),
        F.countDistinct(F.when(F.col("out").isNotNull(), F.struct("piece", "at"))).alias("sources"),
        F.collect_set("reason").alias("reasons"),
        F.collect_set("why").alias("whys"),
    )
    composed = clusters.join(F.broadcast(spark.createDataFrame(composed_rows(), "cluster string, composed string")), "cluster", "left")
    several = F.char_length("cluster") > 1
    final = F.when(several, F.coalesce("composed", F.arrow_udf(_recompose(), "string")(F.when(several & F.col("composed").isNull(), F.col("cluster"))))).otherwise(F.col("cluster"))
    composed = composed.withColumn("final", final)
    apart = F.when((F.col("sources") > 1) & (F.char_length("final") < F.char_length("cluster")), F.lit(ACCENT))
    rebuilt = composed.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_no", "final"))), lambda x: x["final"]), "").alias("consistent"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("reasons", "whys", F.array_compact(F.array(apart))))))).alias("reasons"),
    )
    plain = texts.where("text is null or text = ''").select("key", F.col("text").alias("consistent"), F.array().cast("array<string>").alias("reasons"))
    return rebuilt.unionByName(plain)


def consistent_names(rows: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(key, text, consistent, reasons) of every row whose text is not null.

    Plain ASCII text without control characters is consistent as it stands. All other texts are made
    consistent once per distinct text and joined back by digest; a text that holds a third of all rows is one
    text there and is split by the adaptive skew join on the way back.
    """
    named = rows.select(F.col(key).alias("id_"), F.col(column).alias("text")).where("text is not null")
    plain = F.col("text").rlike(r"^[\x20-\x7E]*$")
    odd = named.where(~plain).withColumn("key", F.unhex(F.md5("text")))
    fixed = consistent_texts(odd.groupBy("key").agg(F.first("text").alias("text")))
    changed = odd.join(fixed, "key").select("id_", "text", "consistent", "reasons")
    same = named.where(plain).select("id_", "text", F.col("text").alias("consistent"), F.array().cast("array<string>").alias("reasons"))
    return changed.unionByName(same).withColumnRenamed("id_", key)
