"""Flows around screening: variant mining, name parsing, equivalences, digests and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import normal_term


def single_divergence(a: Column, b: Column) -> Column:
    """struct<position, left, right> of the only word in which two names of equally many words differ; null otherwise."""
    x, y = F.split(a, " "), F.split(b, " ")
    marked = F.zip_with(x, y, lambda p, q: F.struct(p.alias("left"), q.alias("right")))
    indexed = F.transform(marked, lambda m, i: F.struct(i.alias("position"), m["left"].alias("left"), m["right"].alias("right")))
    differing = F.filter(indexed, lambda m: ~m["left"].eqNullSafe(m["right"]))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 1) & (F.size(differing) == 1), F.get(differing, F.lit(0)))


def mined_variants(pairs: DataFrame, a: str, b: str, evidence: str, least: int = 2, kept: int = 5) -> DataFrame:
    """(low, high, occurrences, evidence): words that stand for one another in confirmed pairs, with some of the pairs they occur in.

    The pair of words is unordered; occurrences count all pairs, evidence keeps the first `kept` by name as a sample for the reader.
    """
    d = single_divergence(normal_term(a), normal_term(b))
    found = pairs.select(F.col(evidence).alias("evidence"), d.alias("d")).where("d is not null and d.left <> '' and d.right <> ''")
    words = found.select("evidence", F.least("d.left", "d.right").alias("low"), F.greatest("d.left", "d.right").alias("high"))
    return words.groupBy("low", "high").agg(F.count("*").alias("occurrences"), F.array_join(F.slice(F.array_sort(F.collect_set("evidence")), 1, kept), ",").alias("evidence")).where(F.col("occurrences") >= least)


def mined_variants_by_name(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, evidence: str, least: int = 2, kept: int = 5) -> DataFrame:
    """mined_variants of left joined with right, where rows of equal names are counted before they are joined.

    left: a, evidence and the columns `on`; right: b and `on`. Of the evidence of one name the first `kept` suffice for the first `kept` of all.
    """
    first = Window.partitionBy(a, *on).orderBy(F.col(evidence).asc_nulls_last())
    sample = left.select(a, *on, evidence).distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= kept).groupBy(a, *on).agg(F.collect_set(evidence).alias("evidence"))
    ours = left.groupBy(a, *on).agg(F.count("*").alias("n")).join(sample, [a, *on])
    theirs = right.groupBy(b, *on).agg(F.count("*").alias("m"))
    d = single_divergence(normal_term(a), normal_term(b))
    found = ours.join(theirs, on).select("n", "m", "evidence", d.alias("d")).where("d is not null and d.left <> '' and d.right <> ''")
    words = found.select(F.least("d.left", "d.right").alias("low"), F.greatest("d.left", "d.right").alias("high"), (F.col("n") * F.col("m")).alias("times"), "evidence")
    first_of_all = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), 1, kept)
    return words.groupBy("low", "high").agg(F.sum("times").alias("occurrences"), F.array_join(first_of_all, ",").alias("evidence")).where(F.col("occurrences") >= least)


def parsed_name(name: Column) -> Column:
    """struct<family, given>: before and after a comma, else the block of capitals and the rest, else the last word and what precedes it."""
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    comma = name.contains(",")
    capitals = F.trim(F.regexp_extract(name, r"((?:^| )(?:\p{Lu}[\p{Lu}'’-]+)(?: \p{Lu}[\p{Lu}'’-]+)*)(?= |$)", 1))
    mixed = name.rlike(r"\p{Ll}") & (capitals != "")
    rest = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), name, F.lit(" ")), F.concat(F.lit(" "), capitals, F.lit(" ")), F.lit(" ")), r"\s+", " "))
    family = F.when(comma, F.trim(F.substring_index(name, ",", 1))).when(mixed, capitals).otherwise(F.substring_index(name, " ", -1))
    given = F.when(comma, F.trim(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))).when(mixed, rest)
    given = given.otherwise(F.trim(F.regexp_extract(name, r"^(.*) [^ ]*$", 1)))
    return F.struct(family.alias("family"), given.alias("given"))


def canonical_words(rows: DataFrame, key: str, name: str, equivalences: DataFrame) -> DataFrame:
    """(key, canonical): names with every word replaced by the class it belongs to.

    equivalences: (term, class_id), single words in normal form, unique by term. Words travel with their position and are joined by term.
    """
    words = rows.select(F.col(key), F.posexplode(F.split(normal_term(name), " ")).alias("at", "term"))
    joined = words.join(equivalences, "term", "left").withColumn("word", F.coalesce(F.concat(F.lit("#"), F.col("class_id").cast("string")), "term"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("canonical"))


def digests(events: DataFrame, recipients: Column, at: str, width: str = "1 day") -> DataFrame:
    """One digest for each recipient, window and kind; recipients is an array."""
    return events.select(F.explode(recipients).alias("recipient"), F.window(at, width)["start"].alias("start"), "event_type").groupBy("recipient", "start", "event_type").agg(F.count("*").alias("events"))


def escalations(alerts: DataFrame, now: Column, soon: int) -> DataFrame:
    """Open alerts that are overdue or fall due within `soon` days, with the days left."""
    left = F.datediff("due_at", now)
    return alerts.where(F.col("status").isin("OPEN", "IN_PROGRESS", "PENDING_VALIDATION") & (left <= soon)).select("alert_id", "priority", left.alias("days_left"), F.when(left < 0, "OVERDUE").otherwise("DUE_SOON").alias("reason"))
