"""Queries of the string measures over the names of clients and listed parties, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.phonetics import phonetic
from tamis.functions.similarity import similarities
from tamis.functions.text import without_accents
from tamis.session import table

HEAD = 4


def _latin(c: str) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, "[^A-Za-z ]", "")))


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(client_name, listed_name): distinct names of both sides with the same first letters.

    Pairs are many more than names, so the names are spread over a stated number of partitions, which adaptive execution does not merge.
    """
    ours = table(spark, d, "client_entities").select(_latin("client_last_name").alias("client_name")).where(F.length("client_name") >= HEAD).distinct()
    theirs = table(spark, d, "watchlist_entities").select(_latin("primary_name").alias("listed_name")).where(F.length("listed_name") >= HEAD).distinct()
    head = lambda c: F.substring(c, 1, HEAD).alias("head")
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ours, theirs = ours.select("*", head("client_name")).repartition(parts, "head"), theirs.select("*", head("listed_name")).repartition(parts, "head")
    return ours.join(theirs, "head").drop("head")


def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Jaro, Jaro-Winkler and word-sorted similarity of client and listed names that begin alike."""
    pairs = _name_pairs(spark, d).withColumn("s", similarities(F.col("client_name"), F.col("listed_name"), ("jaro", "jaro_winkler", "token_sort")))
    return pairs.select("client_name", "listed_name", *(F.round(f"s.{m}", 6).alias(m) for m in ("jaro", "jaro_winkler", "token_sort")))


def name_edit_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Edit similarity with swaps, and of word sets, of client and listed names that begin alike."""
    pairs = _name_pairs(spark, d).withColumn("s", similarities(F.col("client_name"), F.col("listed_name"), ("edit", "token_set")))
    return pairs.select("client_name", "listed_name", F.round("s.edit", 6).alias("edit"), F.round("s.token_set", 6).alias("token_set"))


def blocking_keys_phonetic(spark: SparkSession, d: str) -> DataFrame:
    """Both phonetic codes of the first word of every distinct last name of a client."""
    names = table(spark, d, "client_entities").select("client_last_name").where("client_last_name is not null").distinct()
    codes = names.withColumn("code", phonetic(without_accents("client_last_name")))
    return codes.select("client_last_name", F.col("code.primary").alias("primary_code"), F.col("code.secondary").alias("secondary_code"))


QUERIES = {f.__name__: f for f in (name_similarities, name_edit_similarities, blocking_keys_phonetic)}


def _winkler(a: str, b: str) -> str:
    same = " + ".join(f"(left({a}, {k}) = left({b}, {k}) AND length({a}) >= {k} AND length({b}) >= {k})::int" for k in range(1, 5))
    return f"(100 * jaro_similarity({a}, {b}) + ({same}) * 0.1 * (100 - 100 * jaro_similarity({a}, {b})))"


_LATIN = "upper(trim(regexp_replace({0}, '[^A-Za-z ]', '', 'g')))"
_SORTED = r"array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"
SQL = {
    "name_similarities": f"""WITH c AS (SELECT DISTINCT {_LATIN.format('client_last_name')} AS client_name FROM client_entities),
        w AS (SELECT DISTINCT {_LATIN.format('primary_name')} AS listed_name FROM watchlist_entities),
        p AS (SELECT client_name, listed_name, {_SORTED.format('client_name')} AS x, {_SORTED.format('listed_name')} AS y
              FROM c JOIN w ON left(client_name, {HEAD}) = left(listed_name, {HEAD}) AND length(client_name) >= {HEAD} AND length(listed_name) >= {HEAD})
        SELECT client_name, listed_name, round(100 * jaro_similarity(client_name, listed_name), 6) AS jaro, round({_winkler('client_name', 'listed_name')}, 6) AS jaro_winkler,
               round({_winkler('x', 'y')}, 6) AS token_sort FROM p""",
}
