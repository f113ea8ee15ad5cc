"""SimHash near-dedup: a byte-position inverted index with count filtering (operator 12).

1. A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles, repeats included.
2. Equal fingerprints are one node, so copies never meet each other below.
3. Fingerprints that differ in at most four of 64 bits differ in at most four of eight bytes, so they share at least four
   positional bytes.  The inverted index lists fingerprints by three positional bytes at a time: POSITIONS holds 20 sets
   of three positions of which every four positions contain one, so each such pair shares a list, and a list of N
   fingerprints' index holds N / 2**24 of them where single bytes would give N / 256.
4. A list is worked off in blocks, each pair of blocks a group of its own (`in_blocks`), so that no task holds more than
   two blocks of a hot list.  A group tallies the positional bytes that a pair shares, keeps pairs with the guaranteed
   number of matches, verifies their distance, and returns a spanning forest of the links, never all pairs.
5. Forests joined over all lists give the components.

Words are runs of bytes other than ASCII white space, after A-Z are lower-cased.  Defined cases: a text of one to
`words` - 1 words has one shingle, all its words; a text without words (null too) has fingerprint zero, linked like any
other.  Rows with null or repeated doc_ids and repeated rows are rows like all others; a component whose rows have no
doc_id has a null component_id.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, map_arrow, task_count, whole_text
from siltstone.llm.components import components
from siltstone.llm.near_join import forest, group_starts, grouped, in_blocks

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BYTES = 8


def covering_triples() -> list[tuple[int, int, int]]:
    """Sets of three of the eight positions such that every four positions contain one: Turan's construction over three classes."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for c in classes for t in combinations(c, 3)]
    for k, c in enumerate(classes):
        found += [tuple(sorted((*pair, other))) for pair in combinations(c, 2) for other in classes[(k + 1) % 3]]
    return found


POSITIONS = covering_triples()


@dataclass(frozen=True)
class Settings:
    """words: words of a shingle.  distance: bits in which linked fingerprints may differ, four at most.  block: fingerprints of a block."""

    words: int = 4
    seed: int = 42
    distance: int = 4
    block: int = 2048

    def __post_init__(self) -> None:
        if not 0 <= self.distance <= 4:
            raise ValueError("the index guarantees four shared bytes, so distance is 0 to 4")

    def least_matches(self) -> int:
        """Positional bytes that two linked fingerprints share at least."""
        return BYTES - self.distance


def shingle_hashes(raw: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of `words` words, joined by spaces, as unsigned integers."""
    found = raw.translate(LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, width = b" ".join(found), min(words, len(found))
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - width + 1].tolist()
    shingles = map(joined.__getitem__, map(slice, starts, ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; zero without hashes."""
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[a : a + 65_536]).astype("<u8", copy=False).view(np.uint8).reshape(-1, BYTES)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


_PRINTED = pa.schema([("doc_id", pa.int64()), ("node", pa.int64())])


def fingerprints(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, node: the fingerprint of each row's whole text, its 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(x.as_py(), settings.words, settings.seed)) for x in batch.column(1)]
            yield batch_of(_PRINTED, [batch.column(0), np.array(prints, dtype=np.uint64).view(np.int64)])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).cast("binary").alias("raw"))
    return map_arrow(rows, run, "doc_id long, node long")


def as_hex(node: str | Column = "node") -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(node)), 16, "0")


def postings(nodes: DataFrame) -> DataFrame:
    """node, key: a row for each fingerprint and list; a key is the number of the position set and its three bytes."""
    byte = [F.shiftright("node", 8 * k).bitwiseAND(255) for k in range(BYTES)]
    keys = [F.lit(n << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c] for n, (a, b, c) in enumerate(POSITIONS)]
    return nodes.select("node", F.explode(F.array(*(k.cast("long") for k in keys))).alias("key"))


def linked(a: np.ndarray | np.uint64, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Pairs that share the guaranteed number of positional bytes and lie within the distance."""
    differ = np.atleast_1d(np.bitwise_xor(a, b))
    hit = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= settings.least_matches()
    hit[hit] = np.bitwise_count(differ[hit]) <= settings.distance
    return hit


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def links(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """u, v: edges whose components are those of all links between different fingerprints."""
    rows = postings(nodes)
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = in_blocks(rows, "key", sizes, settings.block).select("key", "a", "b", "node")
    dealt = dealt.repartition(task_count(nodes.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b", "node")
    few = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            node = table.column("node").to_numpy()
            bits, starts = node.view(np.uint64), group_starts(table, 3)
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            u, v = [], []
            # Small groups all at once, by distance in the table; the others one by one.
            small = sizes[group] <= few
            for offset in range(1, min(few, len(node))):
                at = np.flatnonzero(small[:-offset] & (group[:-offset] == group[offset:]))
                at = at[linked(bits[at], bits[at + offset], settings)] if len(at) else at
                u.append(at)
                v.append(at + offset)
            for k in np.flatnonzero(sizes > few):
                part = bits[starts[k] : starts[k + 1]]
                edges = np.array(forest(len(part), lambda i, left, p=part: linked(p[i], p[left], settings)), dtype=np.int64).reshape(-1, 2)
                u.append(starts[k] + edges[:, 0])
                v.append(starts[k] + edges[:, 1])
            if u:
                yield batch_of(_EDGE, [node[np.concatenate(u)], node[np.concatenate(v)]])

    return map_arrow(dealt, run, "u long, v long").distinct()


def near_groups(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, node (its fingerprint), component_id (the least doc_id that links reach, its own included)."""
    rows = cut(fingerprints(docs, settings, id_column, text_column))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = nodes.join(components(links(nodes.select("node"), settings)), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "node", "component_id")
