"""Deeply nested JSON as flat tables.

A depth-first walk gives every node of a document two numbers: its place in
pre-order and, in the same count, the last place within it. A node lies inside
another exactly if its interval lies inside the other's; so parent and child
tables are linked without paths, and the links need no shuffle, because the
nodes of a document stay in its row until they are emitted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_FIELDS = ("pre", "post", "parent", "depth", "kind", "name", "value")
_NODES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in NODE_FIELDS[:4] else T.StringType()) for n in NODE_FIELDS]))
_ARROW = pa.list_(pa.struct([(n, pa.int32() if n in NODE_FIELDS[:4] else pa.string()) for n in NODE_FIELDS]))
#: JSON that is delivered as text inside JSON is opened at most so often.
ENVELOPES = 8


def _refuse(word: str) -> None:
    raise ValueError(word)


class _Members(list):
    """The members of an object in their order; a repeated name stays repeated."""


_DECODER = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_Members)


def _decoded(text: str) -> object:
    """The value of a JSON text, opening JSON delivered inside a JSON string; raises ValueError or RecursionError."""
    value = _DECODER.decode(text.strip())
    for _ in range(ENVELOPES):
        if not isinstance(value, str) or value.lstrip()[:1] not in ("{", "[", '"'):
            break
        try:
            value = _DECODER.decode(value.strip())
        except (ValueError, RecursionError):
            break
    return value


def labelled(text: str | None) -> list[tuple] | None:
    """The nodes of a JSON text in pre-order; None if the text is null or not valid JSON.

    The walk keeps its own stack, so depth is limited by memory only.
    """
    if text is None:
        return None
    try:
        root = _decoded(text)
    except (ValueError, RecursionError):
        return None
    nodes: list[list] = []
    stack: list[tuple] = [(root, None, -1, 0)]
    while stack:
        value, name, parent, depth = stack.pop()
        if value is stack:  # the mark of an end: everything since lies inside `parent`
            nodes[parent][1] = len(nodes) - 1
            continue
        here = len(nodes)
        if isinstance(value, _Members):
            nodes.append([here, here, parent, depth, "object", name, None])
            stack.append((stack, None, here, 0))
            stack.extend((v, k, here, depth + 1) for k, v in reversed(value))
        elif isinstance(value, list):
            nodes.append([here, here, parent, depth, "array", name, None])
            stack.append((stack, None, here, 0))
            stack.extend((v, None, here, depth + 1) for v in reversed(value))
        elif isinstance(value, str):
            nodes.append([here, here, parent, depth, "string", name, value.encode("utf-8", "replace").decode()])
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number"
            nodes.append([here, here, parent, depth, kind, name, None if value is None else json.dumps(value)])
    return [tuple(x) for x in nodes]


@F.arrow_udf(_NODES)
def _nodes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([labelled(x) for x in batch.to_pylist()], _ARROW)


def interval_nodes(c: Column | str) -> Column:
    """Array of labelled nodes of a JSON text; null for null and for text that is not valid JSON."""
    return _nodes(c)


def node_table(rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(key, column, pre, post, parent, depth, kind, name, value): all nodes of the JSON columns."""
    trees = rows.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), interval_nodes(c).alias("nodes")) for c in columns))).alias("t"))
    return trees.select(key, "t.column", F.inline("t.nodes"))


#: What is an item, by column: branches are members of the outermost object (of each element of an outermost array).
#: plain: whether text outside any branch counts, under the column's own name. inside: members of an object that are items.
SHAPES: Mapping[str, dict] = {
    "aliases": {"branches": ("high_priority", "low_priority"), "plain": True, "inside": ("name", "variants")},
    "countries": {"branches": ("citizenship", "residence", "birth_country", "jurisdiction_country"), "plain": False, "inside": ("code",)},
    "individual_name_parsed": {"branches": ("first_name", "last_name", "maiden_name"), "plain": False, "inside": ()},
}


def text_items(rows: DataFrame, columns: Mapping[str, dict] = SHAPES, key: str = "id") -> DataFrame:
    """(key, branch, item_no, item_value): one row per non-blank text item of the JSON columns.

    An item belongs to the branch whose interval contains it. Members of objects below a branch are
    items only where the shape names them; whatever lies in another member is none. item_no counts
    in pre-order, hence in order of appearance. Null, empty and broken JSON give no rows; an item's
    text is returned whole and untrimmed. Several nodes of one branch (an array of objects) count on.

    Branch, owner and item are found by interval containment inside the row's node array: no shuffle.
    """
    parts = []
    for name, shape in columns.items():
        parts.append(_items_of(rows.select(F.col(key).alias("key"), interval_nodes(name).alias("nodes")), name, shape))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumnRenamed("key", key)


def _within(node: Column, owner: Column) -> Column:
    return (node["pre"] >= owner["pre"]) & (node["post"] <= owner["post"])


def _items_of(trees: DataFrame, name: str, shape: dict) -> DataFrame:
    """(key, branch, item_no, item_value) from (key, nodes)."""
    known = [*shape["branches"], *shape["inside"]]
    blank = r"^[\s\p{Z}\x{200B}\x{FEFF}]*$"
    marked = trees.where("size(nodes) > 0").select(
        "key",
        "nodes",
        F.filter("nodes", lambda n: n["name"].isin(*shape["branches"])).alias("owners"),
        F.filter("nodes", lambda n: n["name"].isNotNull() & ~n["name"].isin(*known)).alias("hidden"),
    )
    items = marked.select(
        "key",
        "owners",
        F.filter(
            "nodes",
            lambda n: (n["kind"] == "string") & ~n["value"].rlike(blank) & ~F.exists("hidden", lambda h: _within(n, h)),
        ).alias("items"),
    ).where("size(items) > 0")

    def of_branch(branch: str) -> Column:
        return F.filter("items", lambda n: F.exists("owners", lambda o: (o["name"] == branch) & _within(n, o)))

    lists = [F.struct(F.lit(f"{name}.{b}").alias("branch"), of_branch(b).alias("of")) for b in shape["branches"]]
    if shape["plain"]:
        free = F.filter("items", lambda n: ~F.exists("owners", lambda o: _within(n, o)))
        lists.append(F.struct(F.lit(name).alias("branch"), free.alias("of")))
    return (
        items.select("key", F.explode(F.array(*lists)).alias("b"))
        .select("key", F.col("b.branch").alias("branch"), F.posexplode("b.of").alias("at", "item"))
        .select("key", "branch", (F.col("at") + 1).cast("int").alias("item_no"), F.col("item.value").alias("item_value"))
    )
