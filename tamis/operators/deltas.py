"""Comparison of two deliveries by key and checksum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta_status(old: DataFrame, new: DataFrame, key: str, checksum: str = "entity_checksum") -> DataFrame:
    """(key, status): ADDED, REMOVED, MODIFIED or UNCHANGED for every key of either side. Only key and checksum are read."""
    o = old.select(key, F.col(checksum).alias("was"), F.lit(True).alias("in_old"))
    n = new.select(key, F.col(checksum).alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("MODIFIED")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def delta_summary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return delta_status(old, new, key).groupBy("status").agg(F.count("*").alias("entities"))


def added_removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): keys of one side only, by two anti-joins."""
    added = new.select(key).join(old.select(key), key, "left_anti").withColumn("change", F.lit("ADDED"))
    return added.unionByName(old.select(key).join(new.select(key), key, "left_anti").withColumn("change", F.lit("REMOVED")))


def changed_rows(old: DataFrame, new: DataFrame, checksum: str = "entity_checksum") -> DataFrame:
    """Rows of new whose checksum does not occur in old, whatever their key."""
    return new.join(old.select(checksum).distinct(), checksum, "left_anti")


def field_differences(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], checksum: str = "entity_checksum") -> DataFrame:
    """(key, field, old_value, new_value) of every field that differs; rows of equal checksum are not compared."""
    o = old.select(key, F.col(checksum).alias("was"), *(F.col(f).cast("string").alias(f"old_{f}") for f in fields))
    n = new.select(key, F.col(checksum).alias("now"), *(F.col(f).cast("string").alias(f"new_{f}") for f in fields))
    both = o.join(n, key).where(~F.col("was").eqNullSafe(F.col("now")))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"new_{f}").alias("new_value")) for f in fields))
    return both.select(key, F.inline(cells)).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
