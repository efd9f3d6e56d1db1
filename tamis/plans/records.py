"""Queries p2, p4 and p6 over the delivered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.history import journal_changes, merge_history, opening_versions, stamped
from tamis.operators.nested import SHAPES, node_table, text_items
from tamis.operators.snapshot_cells import delivery_chain, snapshot_changes
from tamis.session import checkpointed, clean_id, table

#: Kinds of nodes that have children.
PARENTS = ("object", "array")


def _fields(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and changed entities of each accepted delivery against the one before."""
    chain = delivery_chain(table(spark, d, "snapshots"))
    fields = {"entity_checksum": F.lower("entity_checksum")}
    changes = snapshot_changes(table(spark, d, "watchlist_entities"), chain, fields)
    return changes.select("snapshot_id", "entity_id", "change_kind")


def p2_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which of the descriptive fields differ, by comparison and combination of fields."""
    chain = delivery_chain(table(spark, d, "snapshots"))
    fields = _fields("primary_name", "place_of_birth", "address", "city", "country", "designation", "official_reference")
    changes = snapshot_changes(table(spark, d, "watchlist_entities"), chain, fields)
    return changes.groupBy("snapshot_id", "change_kind", F.coalesce("changed_fields", F.lit("")).alias("changed_fields")).agg(F.count("*").alias("entities"))


def _ready(spark: SparkSession, d: str) -> DataFrame:
    ready = table(spark, d, "snapshots").where("status = 'READY'").select(clean_id("snapshot_id").alias("ready_id"))
    entities = table(spark, d, "watchlist_entities")
    return entities.join(ready, clean_id(entities["snapshot_id"]) == ready["ready_id"], "left_semi")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Text items of the nested columns of all rows in production."""
    return text_items(_ready(spark, d).select("id", "aliases", "countries", "individual_name_parsed"))


def p4_node_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the nested columns with its interval labels, over all deliveries, counted by kind, member and depth."""
    nodes = node_table(table(spark, d, "watchlist_entities"), ["aliases", "countries", "individual_name_parsed"])
    return nodes.groupBy("column", "kind", F.coalesce("name", F.lit("")).alias("member"), "depth").agg(
        F.count("*").alias("nodes"), F.countDistinct("id").alias("rows"), F.max(F.col("post") - F.col("pre")).alias("largest")
    )


def p4_linked_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Objects, lists and values of the nested columns as tables of their own, parents and children linked by their intervals, counted by kind."""
    nodes = checkpointed(node_table(table(spark, d, "watchlist_entities"), ["aliases", "countries", "individual_name_parsed"]))
    links = None
    for kind in PARENTS:
        parent = nodes.where(F.col("kind") == kind).select("id", "column", F.col("pre").alias("p_pre"), F.col("post").alias("p_post"), (F.col("depth") + 1).alias("depth"), F.lit(kind).alias("parent_kind"))
        found = nodes.select("id", "column", "depth", "pre", "post", F.col("kind").alias("child_kind")).join(parent, ["id", "column", "depth"]).where("pre > p_pre and post <= p_post")
        links = found if links is None else links.unionByName(found)
    return links.groupBy("column", "parent_kind", "child_kind").agg(F.count("*").alias("links"), F.countDistinct("id").alias("rows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every field of every entity with its period: the changes merged into the opening versions."""
    changes = journal_changes(table(spark, d, "watchlist_entity_changes"))
    history = merge_history(changes, opening_versions(changes))
    return stamped(history).select("entity_id", "field", "version_no", "valid_from", "valid_to")


def p6_merged_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same history with values, merged in two batches: the journal up to a moment, then the rest."""
    changes = journal_changes(table(spark, d, "watchlist_entity_changes"))
    cut = F.lit("2024-06-01").cast("timestamp_ntz")
    first = merge_history(changes.where(F.col("changed_at") < cut))
    return stamped(merge_history(changes.where(F.col("changed_at") >= cut), first))


QUERIES = {f.__name__: f for f in (p2_found, p2_changed_fields, p4_found, p4_node_tables, p4_linked_nodes, p6_found, p6_merged_batches)}

_TRIM = r"nullif(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
_CHAIN = f"""
chain AS (
  SELECT {_TRIM.format('snapshot_id')} AS sid, file_type,
         row_number() OVER (PARTITION BY file_type ORDER BY uploaded_at NULLS FIRST, snapshot_id) AS n
  FROM snapshots WHERE file_type LIKE 'WATCHLIST_%' AND coalesce(status, '') NOT IN ('ERROR', 'REJECTED')
),
kept AS (
  SELECT * FROM (
    SELECT w.*, c.file_type, c.n, c.sid, {_TRIM.format('w.entity_id')} AS eid,
           row_number() OVER (PARTITION BY c.sid, {_TRIM.format('w.entity_id')} ORDER BY id DESC) AS latest
    FROM watchlist_entities w JOIN chain c ON {_TRIM.format('w.snapshot_id')} = c.sid
  ) WHERE latest = 1 AND eid IS NOT NULL
)"""
_OLD_NEW = "FROM kept b FULL JOIN (SELECT * REPLACE (n + 1 AS n) FROM kept) a ON a.file_type = b.file_type AND a.n = b.n AND a.eid = b.eid"
_P2_FIELDS = ("primary_name", "place_of_birth", "address", "city", "country", "designation", "official_reference")
_HISTORY = f"""
rows AS (
  SELECT * FROM (
    SELECT {_TRIM.format('entity_id')} AS entity_id, field, changed_at, old_value, new_value,
           row_number() OVER (PARTITION BY {_TRIM.format('entity_id')}, field, changed_at ORDER BY id DESC) AS latest
    FROM watchlist_entity_changes WHERE field IS NOT NULL AND changed_at IS NOT NULL
  ) WHERE latest = 1 AND entity_id IS NOT NULL
),
ordered AS (
  SELECT *, row_number() OVER w AS n, lag(new_value) OVER w AS before FROM rows
  WINDOW w AS (PARTITION BY entity_id, field ORDER BY changed_at)
),
begun AS (
  SELECT entity_id, field, new_value AS value, changed_at FROM ordered
  WHERE new_value IS DISTINCT FROM CASE WHEN n = 1 THEN old_value ELSE before END
  UNION ALL SELECT entity_id, field, old_value, NULL FROM ordered WHERE n = 1
),
history AS (
  SELECT entity_id, field, CAST(row_number() OVER w AS INTEGER) AS version_no, value,
         coalesce(strftime(changed_at, '%Y-%m-%d %H:%M:%S'), '') AS valid_from,
         coalesce(strftime(lead(changed_at) OVER w, '%Y-%m-%d %H:%M:%S'), '') AS valid_to
  FROM begun WINDOW w AS (PARTITION BY entity_id, field ORDER BY changed_at NULLS FIRST)
)"""



def _items_sql(column: str, shape: dict) -> str:
    """Text items of one nested column of the rows in production."""
    branches, inside = "|".join(shape["branches"]), "|".join(shape["inside"])
    step = r"(\[[0-9]+\]" + (rf"|\.({inside})" if inside else "") + ")*"
    pattern = rf"^\${step}(\.({branches}){step}){'?' if shape['plain'] else ''}$"
    inner = f"json_extract_string({column}::JSON, '$')"
    document = f"CASE WHEN json_valid({column}) THEN CASE WHEN json_type({column}::JSON) = 'VARCHAR' AND json_valid({inner}) THEN {inner} ELSE {column} END END"
    return f"""SELECT id, '{column}' || CASE WHEN b = '' THEN '' ELSE '.' || b END AS branch, CAST(row_number() OVER (PARTITION BY id, b ORDER BY node) AS INTEGER) AS item_no, item_value FROM (
        SELECT r.id, t.id AS node, regexp_extract(t.fullkey, '({branches})') AS b, json_extract_string(t.atom, '$') AS item_value
        FROM (SELECT id, CAST({document} AS JSON) AS doc FROM ready) r, json_tree(r.doc) t WHERE t.type = 'VARCHAR' AND regexp_matches(t.fullkey, '{pattern}')) WHERE trim(item_value) <> ''"""


SQL = {
    "p4_found": f"WITH ready AS (SELECT * FROM watchlist_entities WHERE {_TRIM.format('snapshot_id')} IN (SELECT {_TRIM.format('snapshot_id')} FROM snapshots WHERE status = 'READY')) "
    + " UNION ALL ".join(_items_sql(c, shape) for c, shape in SHAPES.items()),
    "p2_found": f"""WITH {_CHAIN}
        SELECT c.sid AS snapshot_id, coalesce(b.eid, a.eid) AS entity_id,
               CASE WHEN a.eid IS NULL THEN 'added' WHEN b.eid IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        {_OLD_NEW} JOIN chain c ON c.file_type = coalesce(b.file_type, a.file_type) AND c.n = coalesce(b.n, a.n)
        WHERE c.n > 1 AND (a.eid IS NULL OR b.eid IS NULL OR lower(a.entity_checksum) IS DISTINCT FROM lower(b.entity_checksum))""",
    "p2_changed_fields": f"""WITH {_CHAIN}, diff AS (
          SELECT c.sid AS snapshot_id,
                 CASE WHEN a.eid IS NULL THEN 'added' WHEN b.eid IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
                 CASE WHEN a.eid IS NULL OR b.eid IS NULL THEN '' ELSE concat_ws(',', {', '.join(
                     f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in sorted(_P2_FIELDS))}) END AS changed_fields
          {_OLD_NEW} JOIN chain c ON c.file_type = coalesce(b.file_type, a.file_type) AND c.n = coalesce(b.n, a.n)
          WHERE c.n > 1)
        SELECT snapshot_id, change_kind, changed_fields, count(*) AS entities FROM diff
        WHERE change_kind <> 'changed' OR changed_fields <> '' GROUP BY ALL""",
    "p6_found": f"WITH {_HISTORY} SELECT entity_id, field, version_no, valid_from, valid_to FROM history",
    "p6_merged_batches": f"WITH {_HISTORY} SELECT * FROM history",
}
