"""Mixing sources to target weights.

Weights descend a tree (domain, language, source). Every node divides its budget among its children by
weight; a child that cannot use its part leaves the rest to its siblings, and only what all children
together cannot use goes back to the ancestors. Each leaf then takes a prefix, in tokens, of the
endless row of its seeded epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tokens import VOCABULARY, token_count
from tamis.session import checkpointed

SEED = 17
#: Slices of a leaf by seeded hash; a running sum is taken within a slice and over the slices' sums.
SLICES = 4096
#: Weights below this are none.
_LEAST = 1e-12


def share_out(nodes: DataFrame, group: list[str], budget: str = "budget", weight: str = "weight", capacity: str = "capacity") -> DataFrame:
    """nodes with `allotted`: the budget of each group divided among its rows by weight, none above its capacity.

    Exact water filling: rows in order of capacity per weight are full until the level at which the rest of the
    budget, divided by the rest of the weight, lies below. If the capacities do not suffice, all rows are full.
    """
    full = Window.partitionBy(*group).orderBy(F.col(capacity) / F.greatest(F.col(weight), F.lit(_LEAST)), F.xxhash64(*nodes.columns))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))) / F.sum(weight).over(full.rowsBetween(0, Window.unboundedFollowing))
    ratio = F.col(capacity) / F.greatest(F.col(weight), F.lit(_LEAST))
    marked = nodes.where(F.col(weight) > _LEAST).withColumn("level_", level).withColumn("order_", F.row_number().over(full))
    # The first row that is not full sets the level of all after it.
    first_open = F.min(F.when(ratio > F.col("level_"), F.struct("order_", "level_"))).over(Window.partitionBy(*group))
    result = marked.withColumn("open_", first_open["level_"])
    part = F.least(F.col(capacity), F.greatest(F.col("open_"), F.lit(0.0)) * F.col(weight))
    return result.withColumn("allotted", F.when(F.col("open_").isNull(), F.col(capacity)).otherwise(part)).drop("level_", "order_", "open_")


def leaf_budgets(leaves: DataFrame, total: Column | None = None, levels: tuple[str, ...] = ("domain", "lang", "source")) -> DataFrame:
    """(mix_name, *levels, max_repeats, weight, capacity, allotted): the tokens each leaf contributes.

    leaves: (mix_name, *levels, max_repeats, weight, capacity), weights of a mix adding to one or less. total: tokens
    of a mix (a column over mix_name); None for the largest total at which every leaf that has any tokens has its full weight,
    so that no share is distorted. The leaves are as many as pairs of language and source, not documents.
    """
    able = leaves.where(F.col("capacity") > 0).groupBy("mix_name")
    if total is None:
        # A mix without the leaves that do not exist: their weight is shared by the others in proportion.
        totals = able.agg((F.min(F.col("capacity") / F.col("weight")) * F.sum("weight")).alias("budget"))
    else:
        totals = able.agg(F.count("*").alias("n")).select("mix_name", total.cast("double").alias("budget"))
    given, at = totals, ["mix_name"]
    for level in levels:
        children = leaves.groupBy(*at, level).agg(F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"))
        shared = share_out(children.join(given, at), at)
        at = [*at, level]
        given = shared.select(*at, F.col("allotted").alias("budget"))
    return leaves.join(given, at).withColumnRenamed("budget", "allotted")


def sized_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokens) of every document with a source and at least one token."""
    sized = documents.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.lower(F.coalesce(F.col(lang), F.lit("und"))).alias("lang"), F.col(text).alias("text")
    ).where("source is not null and text <> ''")
    return sized.select("doc_id", "source", "lang", token_count("text", path).alias("tokens")).where("tokens > 0")


def mixture(documents: DataFrame, targets: DataFrame, total: Column | None = None, domains: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """(mix_name, source, lang, doc_id, tokens, times): the documents of each mix and how often each is used.

    documents: (doc_id, source, lang, tokens), doc_id unique. targets: (mix_name, source_name, target_share,
    max_repeats). domains: optional (source, domain); without it all sources are one domain. A source's share is
    spread over its languages as its tokens are. Every document of a leaf is used k or k + 1 times, k + 1 for a prefix in
    seeded order, and never more than max_repeats times (null or below 1 as 1). A source without documents gets
    nothing; its share is redistributed. Null sources and documents without tokens take no part, a null language counts as 'und';
    other columns are ignored. A source's tokens differ from its budget by at most
    half of one document where its leaves end. Empty tables give no rows.

    Token sums are kept by leaf and slice; a running sum is taken over at most SLICES sums of a leaf, and only inside the one slice
    in which a mix ends is a running sum over documents needed. So a source with a third of all rows is never in one task.
    """
    where = ["source", "lang"]
    wanted = targets.select(
        "mix_name", F.col("source_name").alias("source"), F.col("target_share").cast("double").alias("share"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"),
    ).where("mix_name is not null and source is not null and share > 0").groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    placed = documents.select("doc_id", *where, "tokens").where("source is not null and tokens > 0").fillna("und", ["lang"])
    placed = placed.withColumn("rank", F.xxhash64(F.lit(seed), "doc_id")).withColumn("slice", F.pmod("rank", F.lit(SLICES)))
    slices = placed.groupBy(*where, "slice").agg(F.sum("tokens").alias("slice_tokens"))
    slices = checkpointed(slices)  # the texts are tokenized before this, once for the sums
    supply = slices.groupBy(*where).agg(F.sum("slice_tokens").alias("tokens"))
    of_source = supply.withColumn("part", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("source")))
    leaves = wanted.join(of_source, "source", "left").select(
        "mix_name", "source", F.coalesce("lang", F.lit("")).alias("lang"), "max_repeats", (F.col("share") * F.coalesce("part", F.lit(1.0))).alias("weight"),
        (F.coalesce("tokens", F.lit(0)) * F.col("max_repeats")).cast("double").alias("capacity"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    if domains is None:
        leaves = leaves.withColumn("domain", F.lit(""))
    else:
        leaves = leaves.join(domains.select("source", F.col("domain").alias("domain")).dropDuplicates(["source"]), "source", "left").withColumn("domain", F.coalesce("domain", F.lit("")))
    budgets = leaf_budgets(leaves, total).where("allotted > 0 and tokens > 0").select(
        "mix_name", *where, "max_repeats",
        F.least(F.floor(F.col("allotted") / F.col("tokens") + 1e-9), F.col("max_repeats")).alias("epochs"), F.col("allotted"), F.col("tokens").alias("leaf_tokens"),
    )
    budgets = budgets.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("allotted") - F.col("epochs") * F.col("leaf_tokens")).otherwise(F.lit(0.0)))
    running = Window.partitionBy("mix_name", *where).orderBy("slice")
    ends = (
        slices.join(budgets, where)
        .withColumn("before", F.coalesce(F.sum("slice_tokens").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("mix_name", *where, "slice", "before", "slice_tokens", "rest", "epochs")
    )
    chosen = placed.join(ends, [*where, "slice"])
    whole = F.col("before") + F.col("slice_tokens") <= F.col("rest")
    none = F.col("before") >= F.col("rest")
    split = chosen.where(~whole & ~none)
    inner = Window.partitionBy("mix_name", *where, "slice").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # Where the leaves of a source end, their documents compete for what the source still needs, in the order
    # of their middle relative to their leaf's budget: roundings of the leaves cancel instead of adding up.
    middle = F.col("before") + F.sum("tokens").over(inner) - F.col("tokens") / 2
    of_source = ["mix_name", "source"]
    settled = ends.where(whole).groupBy(*of_source).agg(F.sum("slice_tokens").alias("settled"))
    needs = budgets.groupBy(*of_source).agg(F.sum("rest").alias("wanted")).join(settled, of_source, "left")
    needs = needs.select(*of_source, (F.col("wanted") - F.coalesce("settled", F.lit(0))).alias("need"))
    merged = Window.partitionBy(*of_source).orderBy("at", "rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = split.withColumn("at", middle / F.col("rest")).join(needs, of_source)
    split = split.withColumn("more", (F.sum("tokens").over(merged) - F.col("tokens") / 2 <= F.col("need")).cast("int")).drop("at", "need")
    sure = chosen.where(whole | none).withColumn("more", F.when(whole, 1).otherwise(0))
    return (
        sure.unionByName(split)
        .withColumn("times", (F.col("epochs") + F.col("more")).cast("int"))
        .where("times > 0")
        .select("mix_name", *where, "doc_id", "tokens", "times")
    )


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source_name, target_share, actual_share, tokens, documents, most_times) of every target."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    of_mix = got.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    return (
        targets.select("mix_name", F.col("source_name").alias("source"), "target_share")
        .join(got, ["mix_name", "source"], "left")
        .join(of_mix, "mix_name", "left")
        .select(
            "mix_name", F.col("source").alias("source_name"), "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("mix_tokens")).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"),
        )
    )
