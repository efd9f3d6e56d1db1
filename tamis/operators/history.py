"""History of changing attributes as a type-two dimension.

merge_history() closes the open version of each key and attribute whose value
differs from an arriving one and inserts the new version. A batch may bring many
changes of a key; all of them are merged in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import clean_id

#: Width of the slices in which a key's changes are compared. A key changes at most once
#: per instant, so a slice is bounded by time, however large the share of a busy key is.
SLICE = "day"
STAMP = "yyyy-MM-dd HH:mm:ss"


def journal_changes(journal: DataFrame) -> DataFrame:
    """The counting rows of a change journal: one per (entity_id, field, changed_at), the one with the highest id.

    Rows without entity, field or time cannot be placed and do not count. A null value is a value.
    The aggregation works before its shuffle, so repeated rows of a busy entity cost little.
    """
    return (
        journal.select(
            clean_id("entity_id").alias("entity_id"),
            "field",
            "changed_at",
            F.struct("id", "old_value", "new_value").alias("row"),
        )
        .where("entity_id is not null and field is not null and changed_at is not null")
        .groupBy("entity_id", "field", "changed_at")
        .agg(F.max("row").alias("row"))
        .select("entity_id", "field", "changed_at", "row.old_value", "row.new_value")
    )


def merge_history(changes: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(entity_id, field, version_no, value, valid_from, valid_to): all versions after merging changes into current.

    changes: (entity_id, field, changed_at, old_value, new_value), at most one row per instant, as
    journal_changes() gives. current: a result of this function or None; changes must be later than its
    open versions. A key unknown to current starts with version 1, which holds the old_value of its
    first change and is valid from ever (null). Null and empty text are different values. valid_to is
    null for the open version. Empty inputs give no rows.

    Hashes of the values are compared, never the texts. Within a slice (entity, field, day) neighbours are
    compared by a window; across slices by a window over one summary per slice. So no task ever gets
    all changes of a busy key at once.
    """
    key = ["entity_id", "field"]
    digest = lambda c: F.xxhash64(c.isNull(), c)
    arriving = changes.select(
        *key, F.date_trunc(SLICE, "changed_at").alias("slice"), "changed_at", F.col("new_value").alias("value"),
        digest(F.col("new_value")).alias("digest"), "old_value", digest(F.col("old_value")).alias("old_digest"),
    )
    inner = Window.partitionBy(*key, "slice").orderBy("changed_at")
    marked = arriving.withColumn("before", F.lag(F.struct("digest")).over(inner)).withColumn("head", F.row_number().over(inner) == 1)
    differs = ~F.col("head") & (F.col("digest") != F.col("before.digest"))
    slices = marked.groupBy(*key, "slice").agg(
        F.min_by("digest", F.when(F.col("head"), 0)).alias("first_digest"),
        F.min_by(F.struct("old_value", "old_digest"), F.when(F.col("head"), 0)).alias("opening"),
        F.max_by("digest", "changed_at").alias("last_digest"),
        F.min("changed_at").alias("first_at"),
        F.min(F.when(differs, F.col("changed_at"))).alias("next_inner"),
        F.count_if(differs).alias("inner_changes"),
    )
    outer = Window.partitionBy(*key).orderBy("slice")
    if current is None:
        opened = slices.withColumn("open_digest", F.lit(None).cast("bigint")).withColumn("open_version", F.lit(0))
    else:
        open_rows = current.where("valid_to is null").select(
            *key, digest(F.col("value")).alias("open_digest"), F.col("version_no").alias("open_version")
        )
        opened = slices.join(open_rows, key, "left").withColumn("open_version", F.coalesce("open_version", F.lit(0)))
    summary = (
        opened.withColumn("slice_no", F.row_number().over(outer))
        .withColumn(
            "previous",
            F.coalesce(F.lag("last_digest").over(outer), F.col("open_digest"), F.col("opening.old_digest")),
        )
        .withColumn("head_changes", F.col("first_digest") != F.col("previous"))
        .withColumn("changes", F.col("inner_changes") + F.col("head_changes").cast("int"))
        .withColumn("starts", F.when(F.col("head_changes"), F.col("first_at")).otherwise(F.col("next_inner")))
        .withColumn("following", F.first("starts", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("known", F.col("open_version") > 0)
        .withColumn("base", F.coalesce(F.sum("changes").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                    + F.when(F.col("known"), F.col("open_version")).otherwise(1))
    )
    begun = (
        marked.join(summary.select(*key, "slice", "head_changes", "base", "following"), [*key, "slice"])
        .where(F.when(F.col("head"), F.col("head_changes")).otherwise(F.col("digest") != F.col("before.digest")))
    )
    versions = begun.select(
        *key,
        (F.col("base") + F.row_number().over(inner)).cast("int").alias("version_no"),
        "value",
        F.col("changed_at").alias("valid_from"),
        F.coalesce(F.lead("changed_at").over(inner), F.col("following")).alias("valid_to"),
    )
    moment = changes.schema["changed_at"].dataType
    first_slices = summary.where("slice_no = 1")
    first_end = F.coalesce("starts", "following")
    initial = first_slices.where(~F.col("known")).select(
        *key, F.lit(1).alias("version_no"), F.col("opening.old_value").alias("value"),
        F.lit(None).cast(moment).alias("valid_from"), first_end.alias("valid_to"),
    )
    if current is None:
        return initial.unionByName(versions)
    closing = first_slices.where("known").select(*key, first_end.alias("closed_at"))
    kept = current.join(closing, key, "left").withColumn(
        "valid_to", F.when(F.col("valid_to").isNull(), F.col("closed_at")).otherwise(F.col("valid_to"))
    )
    return kept.select(*versions.columns).unionByName(initial).unionByName(versions)


def opening_versions(changes: DataFrame) -> DataFrame:
    """The history before any change: per entity and field one open version, which holds the old value of the first change.

    To be merged with the changes as `current` of merge_history(). Reduced before the shuffle, so a busy key costs little.
    """
    first = changes.groupBy("entity_id", "field").agg(F.min_by(F.struct("old_value"), "changed_at").alias("opening"))
    never = F.lit(None).cast(changes.schema["changed_at"].dataType)
    return first.select("entity_id", "field", F.lit(1).alias("version_no"), F.col("opening.old_value").alias("value"), never.alias("valid_from"), never.alias("valid_to"))


def stamped(history: DataFrame) -> DataFrame:
    """The history with its times as text, '' where there is none."""
    text = lambda c: F.coalesce(F.date_format(c, STAMP), F.lit("")).alias(c)
    return history.select("entity_id", "field", "version_no", "value", text("valid_from"), text("valid_to"))
