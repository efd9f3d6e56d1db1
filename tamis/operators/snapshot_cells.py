"""What changed between consecutive full snapshots.

Every record of a delivery becomes signed cells: +1 in the comparison that ends
with its delivery, -1 in the one that begins with it. One cell carries the
presence of the key, one each compared field. Cells that occur on both sides
cancel; what is left says what happened, without a join of the two sides.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import clean_id

#: Deliveries of these states never became part of the history.
REFUSED = ("ERROR", "REJECTED")
PRESENCE = ""


def delivery_chain(snapshots: DataFrame, prefix: str = "WATCHLIST_") -> DataFrame:
    """(snapshot_id, delivery_no, next_snapshot_id) of the accepted deliveries of each file_type.

    Ties in uploaded_at are ordered by snapshot_id; deliveries without a time come first.
    """
    order = Window.partitionBy("file_type").orderBy("uploaded_at", "snapshot_id")
    return (
        snapshots.where(F.col("file_type").startswith(prefix) & ~F.coalesce(F.col("status"), F.lit("")).isin(*REFUSED))
        .select("file_type", clean_id("snapshot_id").alias("snapshot_id"), "uploaded_at")
        .select(
            "snapshot_id",
            F.row_number().over(order).alias("delivery_no"),
            F.lead("snapshot_id").over(order).alias("next_snapshot_id"),
        )
    )


def snapshot_changes(
    records: DataFrame,
    chain: DataFrame,
    fields: Mapping[str, Column],
    key: str = "entity_id",
    version: str = "id",
) -> DataFrame:
    """(snapshot_id, key, change_kind, changed_fields) of each delivery against the one before.

    records: every row of every delivery; of several rows of a key in a delivery
    the one with the highest `version` counts (nulls lowest). fields: name of a
    compared field -> its value as a string; null is a value. Rows without key or
    delivery are no records. Columns of records other than the named are ignored,
    so clashing names do no harm. Empty inputs give no rows.

    The first aggregation reduces repeated rows before its shuffle, so a key that
    holds a third of all rows costs no more than another; afterwards a comparison
    has at most two cells per key and field. The second shuffle serves both the
    sum of the cells and the classification.
    """
    rows = records.select(
        clean_id("snapshot_id").alias("snapshot_id"),
        clean_id(key).alias("key"),
        F.struct(F.col(version).alias("version"), *(v.cast("string").alias(k) for k, v in fields.items())).alias("row"),
    ).where("key is not null and snapshot_id is not null")
    last = rows.join(chain, "snapshot_id").groupBy("snapshot_id", "delivery_no", "next_snapshot_id", "key").agg(F.max("row").alias("row"))
    sides = last.select(
        "key",
        "row",
        F.explode(
            F.array(
                F.struct(F.when(F.col("delivery_no") > 1, F.col("snapshot_id")).alias("pair"), F.lit(1).alias("sign")),
                F.struct(F.col("next_snapshot_id").alias("pair"), F.lit(-1).alias("sign")),
            )
        ).alias("side"),
    ).where("side.pair is not null")
    cells = sides.select(
        F.col("side.pair").alias("pair"),
        "key",
        F.col("side.sign").alias("sign"),
        F.explode(
            F.array(
                F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value")),
                *(F.struct(F.lit(k).alias("field"), F.col("row")[k].alias("value")) for k in fields),
            )
        ).alias("cell"),
    ).select("pair", "key", "sign", "cell.field", "cell.value")
    sums = cells.repartition("pair", "key").groupBy("pair", "key", "field", "value").agg(F.sum("sign").alias("balance"))
    left = sums.where("balance <> 0")  # a key present on both sides without any change leaves nothing
    kinds = left.groupBy("pair", "key").agg(
        F.coalesce(F.sum(F.when(F.col("field") == PRESENCE, F.col("balance"))), F.lit(0)).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("fields"),
    )
    return kinds.select(
        F.col("pair").alias("snapshot_id"),
        F.col("key").alias(key),
        F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed").alias("change_kind"),
        F.when(F.col("presence") == 0, F.concat_ws(",", "fields")).alias("changed_fields"),
    )
