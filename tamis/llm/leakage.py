"""Evaluation passages inside training texts.

A text contains `window` consecutive words of a passage exactly if it contains one of the
passage's windows of that many words, and then every shingle of that window. So the rarest shingle
of each window is a necessary prefix of it: texts are joined by that shingle alone, and each
candidate is verified word by word over the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.words import portions
from tamis.session import checkpointed

WINDOW = 12
SHINGLE = 5
#: Bits of the filter that tells which shingles of a text can matter. It has this size whatever
#: the items are: with more items it lets more pass, never less than all that match.
FILTER_BITS = 1 << 23
_FOLD = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def item_windows(items: DataFrame, key: str = "item_id", text: str = "passage", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, gram, shingles): the windows of each passage, gram being its words joined by blanks."""
    names = ["item_id", "gram", "shingles"]
    schema = pa.schema([("item_id", pa.int64()), ("gram", pa.string()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for chosen, words in portions(texts):
                first, grams = words.runs(window)
                at, hashes = words.runs(shingle)
                place = np.full(len(words.hash), -1, np.int64)
                place[at] = np.arange(len(at))
                values = hashes.view(np.int64)
                rows = [
                    (keys[chosen[words.text[i]]], " ".join(words.span(i, i + window)), values[place[i : i + window - shingle + 1]].tolist())
                    for i in first.tolist()
                ]
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    source = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(run, "item_id bigint, gram string, shingles array<bigint>").select(*names)


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A bit array with the bits of all shingles set; what reaches the driver is at most its fixed size."""
    bit = hashes.select((F.pmod(F.col("shingle"), F.lit(FILTER_BITS)) + 1).alias("bit"))
    maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, content in maps:
        begin = (bucket - 1) * _FOLD // 8
        bits[begin : begin + _FOLD // 8] = np.frombuffer(content, np.uint8)
    return bits


def _passing(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = np.mod(values, FILTER_BITS)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def leaked_items(
    documents: DataFrame, items: DataFrame, document_key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", passage: str = "passage", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_id, item_id): every document that contains at least `window` consecutive words of an item's passage.

    Case, accents, punctuation and white space do not matter; zero-width characters separate words.
    Whole texts are searched. Null and empty texts and passages of fewer words than the window give
    nothing; repeated rows give one row. Other columns are ignored. Rarity is counted over all documents.

    The documents are read twice (rarity, then candidates) and never shuffled: only shingles that pass a
    filter of fixed size leave the Python worker. Candidates of one shingle are split by adaptive skew joins.
    """
    spark = documents.sparkSession
    windows = item_windows(items, item_key, passage, window, shingle)
    everything = spark.sparkContext.broadcast(_filter_of(windows.select(F.explode("shingles").alias("shingle"))))
    source = documents.select(F.col(document_key).cast("bigint").alias("k"), F.col(text).alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in portions(batch.column(1).to_pylist()):
                at, hashes = words.runs(shingle)
                values = hashes.view(np.int64)
                hit = _passing(values, everything.value)
                pairs = np.unique(np.stack((words.text[at[hit]], values[hit])), axis=1)
                found, documents_with = np.unique(pairs[1], return_counts=True)
                if len(found):
                    yield pa.record_batch([pa.array(found), pa.array(documents_with)], names=["shingle", "n"])

    rarity = source.mapInArrow(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    placed = windows.select("item_id", "gram", F.posexplode("shingles").alias("offset", "shingle"))
    prefixes = (
        placed.join(rarity, "shingle", "left")
        .groupBy("item_id", "gram")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest"))
        .where("rarest.n > 0")  # a window with a shingle that no document has occurs nowhere
        .select("item_id", "gram", "rarest.offset", "rarest.shingle")
    )
    prefixes = checkpointed(prefixes)
    necessary = spark.sparkContext.broadcast(_filter_of(prefixes.select("shingle")))
    reach = window - shingle
    schema = pa.schema([("doc_id", pa.int64()), ("shingle", pa.int64()), ("lead", pa.int32()), ("span", pa.list_(pa.string()))])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for chosen, words in portions(texts):
                at, hashes = words.runs(shingle)
                values = hashes.view(np.int64)
                hit = np.flatnonzero(_passing(values, necessary.value))
                rows = []
                for h in hit.tolist():
                    i = int(at[h])
                    place, total = int(words.at[i]), int(words.count[words.text[i]])
                    lead = min(place, reach)
                    rows.append((keys[chosen[words.text[i]]], int(values[h]), lead, words.span(i - lead, i + min(total - place, window))))
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    near = source.mapInArrow(candidates, "doc_id bigint, shingle bigint, lead int, span array<string>")
    begin = F.col("lead") - F.col("offset")
    return (
        near.join(prefixes, "shingle")
        .where((begin >= 0) & (begin + window <= F.size("span")))
        .where(F.array_join(F.slice("span", begin + 1, window), " ") == F.col("gram"))
        .select("doc_id", "item_id")
        .distinct()
    )
