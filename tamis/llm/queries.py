"""Queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.addresses import same_places
from tamis.llm.codepoints import CYRILLIC, GREEK, LOOSE, consistent_names
from tamis.llm.leakage import leaked_items
from tamis.llm.mixing import actual_shares, mixture, sized_documents
from tamis.llm.resolution import MATCH, same_persons
from tamis.llm.splitting import split_documents
from tamis.llm.variants import name_variants
from tamis.session import checkpointed, table

NAMES = {"client_entities": "client_company_name", "watchlist_entities": "primary_name"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids of one universe that mean one party."""
    return name_variants(table(spark, d, "client_entities"), table(spark, d, "watchlist_entities"))


def p3_consistent_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name of both tables in its consistent form."""
    parts = [consistent_names(table(spark, d, t), c).withColumn("table_name", F.lit(t)) for t, c in NAMES.items()]
    both = parts[0].unionByName(parts[1])
    return both.select("table_name", "id", "text", "consistent", F.concat_ws(",", "reasons").alias("reasons"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name needed other characters."""
    return p3_consistent_names(spark, d).where("reasons <> ''").select("table_name", "id")


def p5_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair of a client and a listed individual with its marginal probability."""
    pairs = same_persons(table(spark, d, "client_entities"), table(spark, d, "watchlist_entities"))
    return pairs.select("client_id", "entity_id", F.round("probability", 4).alias("confidence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Clients and listed individuals who are the same person."""
    pairs = same_persons(table(spark, d, "client_entities"), table(spark, d, "watchlist_entities"))
    return pairs.where(F.col("probability") >= MATCH).select("client_id", "entity_id").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clients whose address and city denote the same building."""
    pairs = same_places(table(spark, d, "exemple_clients_complet"))
    return pairs.select(F.col("client_id_small").alias("client_small"), F.col("client_id_large").alias("client_large"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they contain."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item, in how many documents it occurs."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents")).join(items, "item_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with the times each is used."""
    sized = checkpointed(sized_documents(table(spark, d, "documents")))
    return mixture(sized, table(spark, d, "mixture_targets"))


def p9_tree(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of the mixes down a tree of domains, languages and sources, for a total of half of all tokens: sources that cannot give
    their part leave the rest to siblings, then to other domains. A domain is the first word of the sources' names."""
    sized = checkpointed(sized_documents(table(spark, d, "documents")))
    domains = sized.select("source", F.split_part("source", F.lit("_"), F.lit(1)).alias("domain")).distinct()
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    targets = table(spark, d, "mixture_targets")
    return actual_shares(mixture(sized, targets, F.lit(total / 2), domains), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the mixes."""
    return actual_shares(p9_mixture(spark, d), table(spark, d, "mixture_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the oversized documents under every profile."""
    return split_documents(table(spark, d, "documents"), table(spark, d, "split_limits"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_consistent_names, p5_found, p5_confidences, p7_found, p8_found, p8_leaked_items, p9_mixture, p9_tree, p9_shares, p10_pieces)}
_STRICT = "".join(c for c in [*CYRILLIC, *GREEK] if c not in LOOSE)
_NAMES_SQL = "SELECT 'client_entities' AS table_name, id, client_company_name AS n FROM client_entities UNION ALL SELECT 'watchlist_entities', id, primary_name FROM watchlist_entities"


def _grams(table_name: str, key: str, text: str) -> str:
    """Runs of twelve words of every text, as a SQL query."""
    words = f"regexp_extract_all(replace(lower(strip_accents({text})), 'ß', 'ss'), '[\\p{{L}}\\p{{Nd}}]+')"
    return f"""SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram
        FROM (SELECT {key}, {words} AS w FROM {table_name}) WHERE len(w) >= 12"""


SQL: dict[str, str] = {
    "p3_found": rf"""WITH names AS ({_NAMES_SQL}) SELECT table_name, id FROM names
        WHERE regexp_matches(n, '[\x{{FF01}}-\x{{FF5E}}\x{{FB00}}-\x{{FB06}}\x{{212A}}]') AND NOT regexp_matches(n, '\p{{Han}}') OR n <> nfc_normalize(n)
          OR regexp_matches(n, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]|[\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}]')
          OR regexp_matches(n, '\p{{Latin}}[\p{{M}}\p{{Cf}}]*[\p{{Cyrillic}}\p{{Greek}}]|[\p{{Cyrillic}}\p{{Greek}}][\p{{M}}\p{{Cf}}]*\p{{Latin}}')
          OR len(list_filter(string_split_regex(n, '[()]'), lambda s: regexp_matches(s, '\p{{Latin}}') AND regexp_matches(s, '[{_STRICT}]') AND NOT regexp_matches(regexp_replace(s, '[{_STRICT}]', '', 'g'), '[\p{{Cyrillic}}\p{{Greek}}]'))) > 0""",
    "p8_found": f"WITH d AS ({_grams('documents', 'doc_id', 'text')}), i AS ({_grams('eval_items', 'item_id', 'passage')}) SELECT DISTINCT doc_id, item_id FROM d JOIN (SELECT DISTINCT * FROM i) USING (gram)",
}
SQL["p8_leaked_items"] = f"WITH found AS ({SQL['p8_found']}) SELECT item_id, count(*) AS documents, any_value(suite) AS suite FROM found JOIN eval_items USING (item_id) GROUP BY item_id"
