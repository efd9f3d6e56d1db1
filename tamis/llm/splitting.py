"""Oversized texts in pieces of at most a number of tokens, cut at natural places.

A text is tokenized once. Prefix sums of the tokens' lengths place every token in the text; the
natural places, sorted, are matched to tokens, and each cut is found by binary search: the last
natural place within the limit. The next piece begins at a natural place at least `overlap` tokens
back. Where a stretch has no natural place, it is cut hard between two characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.tokens import VOCABULARY, encoding

#: Ranks of natural places, the best first. Each pattern ends where a text may be cut.
PLACES = {
    "paragraph": re.compile(rb"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)[\r\n]*"),
    "line": re.compile(rb"\r\n|\r|\n"),
    "sentence": re.compile(rb"[.!?]+[\"')\]]*(?=\s)|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe2\x80\xa6)+(?:\xe2\x80[\x9d\x99]|\xe3\x80[\x8d\x8f]|\xef\xbc\x89)*"),
    "word": re.compile(rb"(?<=\S)(?=\s)|\xe3\x80\x81|\xef\xbc[\x8c\x9b\x9a]"),
}
HARD = "hard"
#: A better place is preferred while the piece is filled to at least this part.
FILL = 0.5


class _Text:
    """A tokenized text with its natural places as numbers of tokens before them."""

    def __init__(self, text: str, path: str):
        self.encode, lengths = encoding(path)[0].encode_ordinary, encoding(path)[1]
        self.text, self.bytes = text, text.encode("utf-8", "replace")
        self.ends = np.concatenate(([0], np.cumsum(lengths[np.fromiter(self.encode(text), np.int64)])))
        self.tokens = len(self.ends) - 1
        raw = np.frombuffer(self.bytes, np.uint8)
        self.whole = np.ones(len(self.ends), bool)  # tokens that begin a character
        self.whole[:-1] = (raw[self.ends[:-1]] & 0xC0) != 0x80
        self.at: dict[str, np.ndarray] | None = None
        self.all = np.zeros(0, np.int64)

    def places(self) -> dict[str, np.ndarray]:
        if self.at is None:
            self.at = {}
            for name, pattern in PLACES.items():
                found = np.unique(np.fromiter((m.end() for m in pattern.finditer(self.bytes)), np.int64))
                token = np.searchsorted(self.ends, found)
                self.at[name] = token[(self.ends[np.minimum(token, self.tokens)] == found) & (token > 0) & (token < self.tokens)]
            self.all = np.unique(np.concatenate(list(self.at.values())))
        return self.at

    def between(self, a: int, b: int) -> str:
        return self.bytes[self.ends[a] : self.ends[b]].decode("utf-8", "replace")

    def last(self, low: int, high: int, floor: int) -> tuple[int, str]:
        """The best place p with max(low, floor) < p <= high; better ranks than words must fill the piece to FILL."""
        for name, tokens in self.places().items():
            k = np.searchsorted(tokens, high, side="right") - 1
            if k >= 0 and tokens[k] > max(floor, low + (FILL * (high - low) if name != "word" else 0)):
                return int(tokens[k]), name
        whole = np.flatnonzero(self.whole[low + 1 : high + 1])
        return (low + 1 + int(whole[-1]), HARD) if len(whole) else (self.next_whole(high), HARD)

    def next_whole(self, high: int) -> int:
        """The first place after high between two characters: a single character larger than the limit stays whole."""
        return high + 1 + int(np.argmax(self.whole[high + 1 :]))


def pieces(text: str, limit: int, overlap: int, path: str = VOCABULARY, parsed: _Text | None = None):
    """(start token, end token, tokens, cut, text) of each piece of a text beyond the limit; nothing for others.

    tokens is what the piece alone has at most. A piece that begins or ends inside a word is tokenized
    again, as its tokens may differ there, and shortened until it fits.
    """
    t = parsed or _Text(text, path)
    if t.tokens <= limit:
        return
    begin, hard_begin, covered, covered_hard = 0, False, 0, False
    while True:
        if t.tokens - begin <= limit and not hard_begin:
            yield begin, t.tokens, t.tokens - begin, "end", t.between(begin, t.tokens)
            return
        room = limit
        while True:
            end, cut = (t.tokens, "end") if t.tokens - begin <= room else t.last(begin, begin + room, covered)
            content = t.between(begin, end)
            size = len(t.encode(content)) if hard_begin or cut == HARD else end - begin
            if size <= limit or room <= 1:
                break
            room = min(room - 1, end - begin - 1) if end - begin > 1 else 0
            if room < 1:
                break
        if end <= covered:  # nothing new fits behind the overlap: go on without it
            begin, hard_begin = covered, covered_hard
            continue
        yield begin, end, size, cut, content
        if end == t.tokens:
            return
        covered, covered_hard = end, cut == HARD
        following, hard_begin = end, cut == HARD
        if overlap:
            back = end - overlap
            if back > begin:
                places = t.places() and t.all
                k = int(np.searchsorted(places, back, side="right")) - 1
                if k >= 0 and places[k] > begin and back - places[k] <= overlap:
                    following, hard_begin = int(places[k]), False
                else:
                    whole = np.flatnonzero(t.whole[begin + 1 : back + 1])
                    if len(whole):
                        following, hard_begin = begin + 1 + int(whole[-1]), True
        begin = following


def split_documents(
    documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY
) -> DataFrame:
    """(profile_name, doc_id, piece_no, start_token, end_token, n_tokens, cut, piece): pieces of oversized texts.

    limits: (profile_name, max_tokens, overlap_tokens), a few rows. Only texts beyond max_tokens of a profile
    appear under it; null and empty texts never do. Every piece has at most max_tokens tokens by itself and the
    pieces cover the text without a gap: piece i+1 begins at or before the end of piece i, at least
    overlap_tokens back (more by less than one word at a natural place) and exactly at its end if there is no overlap or
    nothing new would fit behind it.
    A single character that has more tokens than the limit stays whole. A profile without a limit or with a
    limit below 1 is ignored; an overlap that is null counts as 0, one as large as the limit as half of it.
    Repeated documents give repeated pieces. No shuffle: a text is tokenized once for all profiles where it lies.
    """
    profiles = [
        (n, m, min(max(o or 0, 0), m // 2) if (o or 0) >= m else max(o or 0, 0))
        for n, m, o in limits.select("profile_name", "max_tokens", "overlap_tokens").where("max_tokens >= 1").distinct().collect()
    ]
    least = min((m for _, m, _ in profiles), default=None)
    names = ("profile_name", "doc_id", "piece_no", "start_token", "end_token", "n_tokens", "cut", "piece")
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                content = t.as_py()
                if not content or least is None or len(content.encode("utf-8", "replace")) <= least:
                    continue  # a token has at least one byte
                parsed, doc = _Text(content, path), k.as_py()
                for name, limit, overlap in profiles:
                    for no, (a, b, n, cut, piece) in enumerate(pieces(content, limit, overlap, path, parsed), 1):
                        rows.append((name, doc, no, a, b, n, cut, piece))
                        size += len(piece)
                    if size > 1 << 22:
                        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], schema=schema)

    ddl = "profile_name string, doc_id bigint, piece_no int, start_token bigint, end_token bigint, n_tokens int, cut string, piece string"
    return documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, ddl)
