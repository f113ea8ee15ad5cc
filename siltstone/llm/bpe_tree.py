"""Byte-level BPE as a monoid tree reduction (operator 1).

A text is cut into halves until a leaf of `leaf_chars` code points; leaves are encoded; neighbours are joined by
re-encoding a window around their border.  The window grows, doubling, until it ends at *safe cuts* on both sides.

Safe cut: a place between a character that is not white space and one that is.  No match of the pattern holds
white space after other characters, so every match ends at such a place whatever stands around it, and no
alternative looks past it except to see white space.  So for a safe cut p of any text x:
    encode(x) == encode(x[:p]) + encode(x[p:])
and tokens outside a window between two safe cuts are the same before and after the join.  A text without white
space has no safe cut; then the window grows to the whole of both halves, which is still right.

Decoding is the same reduction with concatenation of bytes as its operation.

Null text counts as the empty text, which has no ids.  Rows are independent, so ties, repeated rows, empty tables
and clashing extra columns need no rule: only `doc_id` and `text` are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, map_arrow, whole_text

#: U+001C to U+001F are white space for Python but not for the tokenizer's regular expressions.
SAFE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")


class BpeTree:
    """Encoder and decoder over a vocabulary of byte strings and ranks.

    leaf_chars: code points of a leaf.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = 2048):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars = leaf_chars

    @classmethod
    def from_file(cls, path: str, pattern: str, **bounds) -> BpeTree:
        """Ranks from a file with one base64 byte string and its rank a line."""
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern, **bounds)

    def direct(self, text: str) -> array:
        return array("I", self.core.encode_ordinary(text))

    def encode(self, text: str) -> array:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, begin: int, end: int) -> array:
        if end - begin <= self.leaf_chars:
            return self.direct(text[begin:end])
        middle = (begin + end) // 2
        return self.join(text, begin, middle, end, self._encode(text, begin, middle), self._encode(text, middle, end))

    def join(self, text: str, begin: int, middle: int, end: int, left: array, right: array) -> array:
        """The ids of text[begin:end] from those of its halves."""
        low, high = self._safe_before(text, begin, middle), self._safe_after(text, middle, end)
        stale_left, stale_right = len(self.direct(text[low:middle])), len(self.direct(text[middle:high]))
        return left[: len(left) - stale_left] + self.direct(text[low:high]) + right[stale_right:]

    @staticmethod
    def _safe_before(text: str, begin: int, middle: int) -> int:
        width = 16
        while middle - width > begin:
            cuts = [m.start() for m in SAFE.finditer(text[middle - width - 1 : middle])]
            if cuts:
                return middle - width - 1 + cuts[-1]
            width *= 2
        return max((m.start() + begin for m in SAFE.finditer(text[begin:middle])), default=begin)

    @staticmethod
    def _safe_after(text: str, middle: int, end: int) -> int:
        """From one character past the border, so that the cut is inside the right half and safe there too."""
        width = 16
        while middle + width < end:
            cut = SAFE.search(text[middle : middle + width])
            if cut:
                return middle + cut.start()
            width *= 2
        cut = SAFE.search(text[middle:end])
        return middle + cut.start() if cut else end

    def decode(self, ids: array, leaf_ids: int = 4096) -> bytes:
        if len(ids) <= leaf_ids:
            return self.core.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf_ids) + self.decode(ids[middle:], leaf_ids)


def little_endian(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, leaf_chars: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, ids binary (little-endian unsigned 32-bit).  `vocabulary`: path of a rank file on every executor."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BpeTree.from_file(vocabulary, pattern, leaf_chars=leaf_chars)
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [little_endian(tree.encode(x)) for x in batch.column(1).to_pylist()]])

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")), run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row of `encode_texts`: doc_id, bytes binary."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BpeTree.from_file(vocabulary, pattern)
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [tree.decode(array("I", x)) for x in batch.column(1).to_pylist()]])

    return map_arrow(encoded, run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, leaf_chars: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes, then decodes the ids, in one pass over each text.

    Per row: doc_id, n_tokens long, ids_sha256, decoded_sha256 (lowercase hex).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BpeTree.from_file(vocabulary, pattern, leaf_chars=leaf_chars)
        last, found = None, (0, "", "")
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py()
                # Repeated rows that stand side by side, as mixing leaves them, are encoded once.
                if text != last:
                    ids = tree.encode(text)
                    last, found = text, (len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest())
                out.append(found)
            yield batch_of(schema, [batch.column(0), *(list(c) for c in (zip(*out, strict=True) if out else ([], [], [])))])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
