"""How rare the words of names are, counted over the listed corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import words_of


def document_frequency(rows: DataFrame, name: Column | str, key: str, least: int = 3, top: int = 20_000) -> DataFrame:
    """(token, df): in how many records a word occurs, for words in at least `least`, the `top` most frequent.

    The limit is the size of the table that is kept; ties are by token. Words are counted before the shuffle.
    """
    tokens = rows.select(F.col(key).alias("key"), F.explode(words_of(name)).alias("token")).distinct()
    return tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least).orderBy(F.desc("df"), "token").limit(top)


def rarity_profile(rows: DataFrame, frequencies: DataFrame, total: int, key: str, name: Column | str) -> DataFrame:
    """(key, idf_sum, most_common, least_common, common): rarity of the words of each name; an unknown word is rarer than all known."""
    floor = frequencies.agg(F.greatest(F.lit(1), F.min("df") - 1).alias("floor"))
    tokens = rows.select(F.col(key), F.explode(words_of(name)).alias("token"))
    known = tokens.join(frequencies, "token", "left").join(F.broadcast(floor)).withColumn("df", F.coalesce("df", "floor"))
    common = max(25, int(total * 0.0025))
    return known.groupBy(key).agg(
        F.round(F.sum(F.log(F.lit(total) / F.col("df"))), 6).alias("idf_sum"), F.max("df").alias("most_common"), F.min("df").alias("least_common"),
        F.bool_and(F.col("df") >= common).alias("common"),
    )
