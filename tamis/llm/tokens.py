"""Sizes of texts in tokens of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory of the vocabulary files; the same on every executor.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies cut a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a vocabulary file, and the length in bytes of each token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty text."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoding(path)[0].encode_ordinary
        for batch in batches:
            yield pa.array([len(encode(t)) if (t := x.as_py()) else 0 for x in batch], pa.int64())

    return F.arrow_udf(count, "bigint")(text)
