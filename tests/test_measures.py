"""String measures on their own and by name."""

import random

from tamis.functions import similarity
from tamis.functions.similarity import edit_distance, similarities
from tamis.plans import kernels
from test_engine import slow_distance


def test_only_the_named_measures(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), (None, "A")], "a string, b string").repartition(1)
    every, some = df.select(similarities(df.a, df.b).alias("s")).collect(), df.select(similarities(df.a, df.b, ("token_set", "edit")).alias("s")).collect()
    assert some[0].s.asDict() == {k: every[0].s[k] for k in ("token_set", "edit")} and some[1].s is None


def test_distance_by_bits():
    """Without a bound no cell of the table is visited on its own."""
    r = random.Random(5)
    for most in (3, 8, 40, 90):
        for _ in range(150):
            a, b = ("".join(r.choices("abcd", k=r.randrange(most))) for _ in "xy")
            assert edit_distance(a, b) == slow_distance(a, b)
    assert similarity._bit_distance("ab", "ba") == 1 and similarity._bit_distance("ca", "abc") == 3


def test_name_pairs_are_spread(spark, data):
    """Names are few and their pairs many: adaptive execution must not put all of them into one task."""
    assert kernels._name_pairs(spark, data).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
