"""Near-duplicate join on word n-grams by a MinHash LSH forest with exact verification (operator 8).

1. Equal texts are one node (a 64-bit hash); everything below is per node, so copies never meet each other.
2. A node has one label in each of `trees` trees: the tree's number and `label` minimum hashes of BITS bits in one
   integer, the first hash above the others.  Sorted labels are the tries of all trees, and a prefix is a label shifted
   right.
3. Nodes meet on the longest prefix first.  Nodes under one trie node form a bucket, which is worked off in blocks of
   `block` nodes, each pair of blocks a group of its own and groups in the order of the trie, so a hot bucket is dealt over many
   tasks and none holds more than two blocks.  A group compares signatures and returns a spanning forest of the pairs
   that may reach the threshold, never all pairs.
4. Recall is measured on the pairs met: a pair of similarity s meets at depth d with the chance 1 - (1 - s**d)**trees, so
   the pairs met stand for the sum of their inverse chances.  While they are a smaller share of it than `recall`, all
   prefixes are shortened by a hash and their buckets worked off.  At the longest prefix under which even pairs at the
   threshold reach the recall, `depth()`, it always ends.
5. Forests joined over all buckets give clusters.  A cluster is verified in blocks in the same way, on the whole sets
   of n-gram hashes: each node gets its number of verified links, and a forest of them.
6. Forests joined over all groups give the classes.

Every pair that met in a bucket is in one cluster and is verified there; work in a cluster of g different texts grows
as g squared, its rows as g * (g / block).  Nothing is capped.

Words are runs of characters other than ASCII white space.  Defined cases: a text of one to n - 1 words has one n-gram,
all its words; a text without words (null too) has no n-gram and is only like its equals.  Rows with null or repeated
doc_id are rows like others; class_id is the least doc_id of the class (null if all are null).  An empty table gives
no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, map_arrow, nested, splitmix, staged, task_count, whole_text
from siltstone.llm.components import components
from siltstone.operators.dedup import minimum_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash in a label: other hashes agree on them once in 512, which lengthens no bucket worth mention.
BITS = 9


@dataclass(frozen=True)
class Settings:
    """words: words of an n-gram.  threshold: percent of Jaccard similarity.  slack: standard errors by which a signature may fall short."""

    words: int = 5
    threshold: int = 80
    recall: float = 0.99999
    trees: int = 32
    label: int = 6
    block: int = 512
    slack: float = 6.0
    seed: int = 17

    def depth(self) -> int:
        """Longest prefix at which pairs at the threshold reach the recall, at least one hash."""
        t = self.threshold / 100
        return next((d for d in range(self.label, 1, -1) if 1 - (1 - t**d) ** self.trees >= self.recall), 1)

    def least_equal(self) -> float:
        """Share of equal signature bytes below which a pair is no candidate."""
        t, n = self.threshold / 100, self.trees * self.label
        return t - self.slack * (t * (1 - t) / n) ** 0.5


class WordHashes(dict):
    def __init__(self, entries: int = 400_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> int:
        if len(self) >= self.entries:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def ngrams(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    found = np.fromiter(map(hashes.__getitem__, WORD.findall(text)), dtype=np.uint64)
    if not len(found):
        return found
    width = min(words, len(found))
    with np.errstate(over="ignore"):
        total = found[: len(found) - width + 1].copy()
        for k in range(1, width):
            total = total * FACTOR + found[k : len(found) - width + 1 + k]
    return np.unique(splitmix(total + np.uint64(width)))


_SIGNED = pa.schema([("node", pa.int64()), ("signature", pa.binary()), ("labels", pa.list_(pa.int64()))])


def signatures(rows: DataFrame, settings: Settings) -> DataFrame:
    """node, signature (a byte of each hash), labels (one a tree); texts without n-grams have no row."""
    if settings.label * BITS + settings.trees.bit_length() > 63:
        raise ValueError("a label has 63 bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(settings.seed)
        n = settings.trees * settings.label
        factors, offsets = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)
        place, hashes = np.uint64(BITS) * np.arange(settings.label - 1, -1, -1, dtype=np.uint64), WordHashes()
        tree = np.arange(settings.trees, dtype=np.uint64) << np.uint64(settings.label * BITS)
        for batch in batches:
            nodes, signed, labels = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = ngrams(text.as_py(), settings.words, hashes)
                if len(grams):
                    least = minimum_hashes(grams, factors, offsets)
                    # Minima are small numbers, so their bits are mixed first.
                    parts = (splitmix(least) >> np.uint64(64 - BITS)).reshape(settings.trees, settings.label)
                    nodes.append(node)
                    signed.append((least & 0xFF).astype(np.uint8).tobytes())
                    labels.append((tree + (parts << place).sum(axis=1, dtype=np.uint64)).view(np.int64))
            yield batch_of(_SIGNED, [nodes, signed, labels])

    return map_arrow(rows, run, "node long, signature binary, labels array<long>")


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """Deals the rows of each key over pairs of blocks: adds `a`, `b` (blocks of the pair) and `side` (the row's own block)."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select("*", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b")).drop("size", "blocks", "other")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, many small ones at a time: tables whose first `keys` columns never straddle two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in range(keys)]
            same = np.ones(batch.num_rows, dtype=bool)
            for k in range(keys):
                same &= np.asarray(batch.column(k)) == last[k]
            first = int(np.argmin(same)) if not same.all() else batch.num_rows
            if first < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, first)] if first else held)
                held = []
            else:
                held.append(batch)
                continue
            batch = batch.slice(first)
        # Rows before the last group's start are whole groups.
        last = [batch.column(k)[-1].as_py() for k in range(keys)]
        same = np.ones(batch.num_rows, dtype=bool)
        for k in range(keys):
            same &= np.asarray(batch.column(k)) == last[k]
        start = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: int) -> np.ndarray:
    """Row numbers at which groups begin, with the number of rows at the end."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in range(keys):
        values = table.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def forest(n: int, neighbours) -> list[tuple[int, int]]:
    """Edges of a spanning forest; neighbours(i, open rows) gives a mask over the open rows."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = neighbours(i, left)
            found = left[hit]
            left = left[~hit]
            edges.extend((int(i), int(j)) for j in found)
            queue.extend(found)
    return edges


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("same", pa.int32())])


def candidate_forest(signed: DataFrame, settings: Settings, depth: int) -> DataFrame:
    """u, v, same (equal bytes of their signatures): spanning forests, by bucket, of the pairs whose signatures may reach the threshold."""
    rows = signed.select("node", F.explode("labels").alias("label")).select("node", F.shiftright("label", BITS * (settings.label - depth)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = in_blocks(rows, "key", sizes, settings.block).join(signed.select("node", "signature"), "node").select("key", "a", "b", "node", "signature")
    dealt = dealt.repartition(task_count(signed.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b", "node")
    least, few = settings.least_equal(), 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            nodes = table.column("node").to_numpy()
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
            starts = group_starts(table, 3)
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            u, v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            small = sizes[group] <= few
            for offset in range(1, min(few, len(nodes))):
                at = np.flatnonzero(small[:-offset] & (group[:-offset] == group[offset:]))
                hit = at[(signature[at] == signature[at + offset]).mean(axis=1) >= least]
                u.append(hit)
                v.append(hit + offset)
            for k in np.flatnonzero(sizes > few):
                part = signature[starts[k] : starts[k + 1]]
                edges = np.array(forest(len(part), lambda i, left, p=part: (p[left] == p[i]).mean(axis=1) >= least), dtype=np.int64).reshape(-1, 2)
                u.append(starts[k] + edges[:, 0])
                v.append(starts[k] + edges[:, 1])
            u, v = np.concatenate(u), np.concatenate(v)
            yield batch_of(_EDGE, [nodes[u], nodes[v], (signature[u] == signature[v]).sum(axis=1).astype(np.int32)])

    found = map_arrow(dealt, run, "u long, v long, same int")
    return found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("same").alias("same"))


def measured_recall(edges: DataFrame, settings: Settings, depth: int) -> float | None:
    """Share that the pairs met at a depth make up of those at the threshold or above, by inverse chances; null without pairs."""
    similarity = F.greatest(F.col("same") / (settings.trees * settings.label), F.lit(settings.threshold / 100))
    chance = 1 - F.pow(1 - F.pow(similarity, depth), settings.trees)
    found, every = edges.agg(F.count("*"), F.sum(1 / chance)).first()
    return found / every if found else None


def candidate_clusters(signed: DataFrame, settings: Settings) -> tuple[DataFrame, list[tuple[int, float | None]]]:
    """node, cluster of the nodes that met another, and (depth, measured recall) of every round."""
    rounds = []
    for depth in range(settings.label, 0, -1):
        # Buckets of a shorter prefix hold those of a longer one, so the last round's forests join all that met.
        edges = cut(candidate_forest(signed, settings, depth))
        rounds.append((depth, measured_recall(edges, settings, depth)))
        if depth <= settings.depth() or (rounds[-1][1] or 0.0) >= settings.recall:
            break
    roots = components(edges.select("u", "v"))
    heads = roots.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()
    return cut(roots.select("node", F.col("root").alias("cluster")).unionByName(heads)), rounds


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays, by products of 0/1 matrices over the n-grams that two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    column, owner = number[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, columns):
        low, high = np.searchsorted(column, [a, a + columns])
        matrix = np.zeros((n, min(columns, width - a)), dtype=np.float32)
        matrix[owner[low:high], column[low:high] - a] = 1
        total += matrix @ matrix.T
    return total


_LINK = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def verified(texts: DataFrame, clusters: DataFrame, settings: Settings) -> DataFrame:
    """node, links, root: a row for each node and group it is verified in; root is the least node of its part in the group."""
    schema = pa.schema([("cluster", pa.int64()), ("node", pa.int64()), ("grams", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield batch_of(schema, [batch.column(0), batch.column(1), [ngrams(x.as_py(), settings.words, hashes).tobytes() for x in batch.column(2)]])

    members = map_arrow(texts.join(clusters, "node").select("cluster", "node", "text"), sets, "cluster long, node long, grams binary")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    dealt = in_blocks(members, "cluster", sizes, settings.block).select("cluster", "a", "b", "node", "side", "grams")
    dealt = dealt.repartition(task_count(texts.sparkSession), "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            starts = group_starts(table, 3)
            nodes, sides = table.column("node").to_numpy(), table.column("side").to_numpy()
            own = table.column("a").to_numpy() == table.column("b").to_numpy()
            grams = table.column("grams")
            links, roots = np.zeros(len(nodes), dtype=np.int64), nodes.copy()
            for k in range(len(starts) - 1):
                a, b = starts[k], starts[k + 1]
                if b - a < 2:
                    continue
                held = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in grams.slice(a, b - a)]
                size = np.array([len(x) for x in held], dtype=np.float64)
                both = shared_counts(held)
                near = 100 * both >= settings.threshold * (size[:, None] + size - both)
                np.fill_diagonal(near, False)
                if not own[a]:
                    near &= sides[a:b, None] != sides[a:b]
                links[a:b] = near.sum(axis=1)
                root = np.arange(b - a)
                for i, j in forest(b - a, lambda i, left, m=near: m[i, left]):
                    root[j] = root[i]
                # Rows are in the order of nodes, and a tree of the forest starts at its least row.
                roots[a:b] = nodes[a:b][root]
            yield batch_of(_LINK, [nodes, links, roots])

    return map_arrow(dealt, run, "node long, links long, root long")


def node_of(text_column: str = "text"):
    return F.xxhash64(whole_text(text_column))


def near_classes(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """node, class_node, n_links: one row per different text; n_links counts different texts at the threshold or above."""
    rows = docs.select(node_of(text_column).alias("node"), whole_text(text_column).alias("text"))
    signed = signatures(rows, settings).groupBy("node").agg(F.first("signature").alias("signature"), F.first("labels").alias("labels"))
    signed, _ = staged(signed, "near-signatures")
    clusters, _ = candidate_clusters(signed, settings)
    # A partial aggregate leaves one row per text and input task before texts are dealt out.
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))
    found = cut(verified(texts, clusters, settings))
    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = rows.select("node").distinct()
    return nodes.join(parts, "node", "left").join(links, "node", "left").select("node", F.coalesce("root", "node").alias("class_node"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_documents(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links, n_copies (rows with the same text)."""
    classes = cut(near_classes(docs, settings, id_column, text_column))
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), node_of(text_column).alias("node"))
    copies = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    named = classes.join(copies, "node")
    class_ids = named.groupBy("class_node").agg(F.min("least").alias("class_id"))
    named = named.join(class_ids, "class_node").select("node", "class_id", "n_links", "n_copies")
    return ids.join(named, "node").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one row of each class: the one with the least doc_id (null last), then the least text hash."""
    classes = cut(near_classes(docs, settings, id_column, text_column))
    marked = docs.select(nested(docs), F.col(id_column).alias("id"), node_of(text_column).alias("own"))
    order = F.struct(F.col(id_column).isNull().alias("absent"), F.col(id_column).alias("id"), node_of(text_column).alias("node"))
    best = docs.select(node_of(text_column).alias("node"), order.alias("rank")).groupBy("node").agg(F.min("rank").alias("rank")).join(classes, "node")
    winners = best.groupBy("class_node").agg(F.min("rank").alias("rank")).select(F.col("rank.node").alias("winner"), F.col("rank.id").alias("winner_id"))
    kept = marked.join(winners, (F.col("own") == F.col("winner")) & F.col("id").eqNullSafe(F.col("winner_id")), "left_semi")
    # Rows repeated with the same id and text: one of them stays.
    return kept.dropDuplicates(["id", "own"]).select("row.*")
