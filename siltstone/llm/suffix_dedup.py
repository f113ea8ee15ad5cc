"""Removal of repeated byte strings by prefix doubling over sampled positions (operator 2).

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller document, or same document and
earlier start).  Ranking all positions by doubling would sort every byte of the corpus in each round; a sampled set of
positions settles the same question:

1. Sampling.  Each window of `length` bytes chooses the `gram`-byte string in it with the least hash (all of them, in a
   tie).  The choice depends on the window's bytes only, so equal windows choose alike: if a string repeats, some
   chosen position repeats with it.  About 2 / (length - gram + 2) of all positions are chosen.
2. Rank pairs.  The windows that choose a position start at distances `near` to `far` before it.  A cell is a range of
   distances, at first all of them.  A cell's core is what all its windows share, its reach what any of the position's own ones touches.  Spark sorts rows by the
   pair (rank of the core, rank of the reach) and by place.  A row with a core of its own is unique and out.  Rows with
   equal pairs are equal throughout: the first stays as their representative, for every other the whole reach is
   covered.  A core with one pair left is settled.
3. Growing offsets.  Representatives with equal cores and different reaches agree on a part of their windows.  Their
   cells are split in `split` parts, whose cores are longer, and the rows are ranked again by the pairs of the grown
   offset: 32, 87, 98 and 100 bytes by default.  Rows go on until they are unique or settled; at a cell of one window
   the core has reached the threshold, is its own reach, and every row is one or the other.
4. Covered reaches are joined per document into spans.

Ranks are 64-bit polynomial hashes, of the core and of the reach by different bases; rows count as equal if both agree.
Each round takes one sort over ranges of (core, reach, document), cut where a sample of its rows says, so a string that a third of all
documents hold is dealt over many tasks; the runs at task borders are settled by an aggregate.

Defined cases: null text is the empty text; texts under `length` bytes lose nothing.  Rows are identified by doc_id
and a hash of their text: rows alike in both are one document and get the same result; among rows with one doc_id the
smaller text hash is earlier; null doc_id is before all others.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, delete_path, map_arrow, splitmix, staged, task_count, whole_text

CORE_BASE, REACH_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Stands for a null doc_id, before all others.
NO_ID = -(2**63)
SLICE = 1 << 18


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    split: int = 5

    @property
    def back(self) -> int:
        """Most bytes of a window before its chosen gram."""
        return self.length - self.gram


class Powers:
    """Powers of a base and its inverse, grown on demand; hashes of substrings of a byte array."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.values = splitmix(np.arange(1, 257) ^ (base & 0xFFFF))

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.append(np.uint64(1), np.full(n, self.base, dtype=np.uint64)), dtype=np.uint64)
                self.down = np.cumprod(np.append(np.uint64(1), np.full(n, self.inverse, dtype=np.uint64)), dtype=np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """sums[b] - sums[a], times the inverse power of a, is the hash of raw[a:b]."""
        self.grow(len(raw))
        with np.errstate(over="ignore"):
            return np.append(np.uint64(0), np.cumsum(self.values[raw] * self.up[: len(raw)], dtype=np.uint64))

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[end] - sums[begin]) * self.down[begin]


def sliding(values: np.ndarray, width: int, function) -> np.ndarray:
    """function over each run of `width` values, by doubling; len(values) - width + 1 results."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = function(out[:-step], out[step:])
        have += step
    return out


def chosen(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, powers: Powers, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen positions in texts raw[begins[k]:ends[k]], their gram hashes, and the distances near and far of the windows that choose them."""
    sums = powers.sums(raw)
    at = np.arange(len(raw) - s.gram + 1)
    grams = splitmix(powers.hashes(sums, at, at + s.gram))
    per_window = s.back + 1
    least = sliding(grams, per_window, np.minimum)
    # Windows that cross texts choose nothing: 0 is under every hash but with a chance of 2**-64.
    valid = np.zeros(len(raw) + 1, dtype=np.int64)
    long_ = ends - begins >= s.length
    np.add.at(valid, begins[long_], 1)
    np.add.at(valid, ends[long_] - s.length + 1, -1)
    least = np.where(np.cumsum(valid)[: len(least)] > 0, least, np.uint64(0))
    # A position is chosen if the greatest of the minima of its windows is its own hash.
    pad = np.zeros(per_window - 1, dtype=np.uint64)
    greatest = sliding(np.concatenate([pad, least, pad]), per_window, np.maximum)
    position = np.flatnonzero((greatest[: len(grams)] == grams) & (grams > 0))
    # Its windows are one run of equal minima: the last run that begins at or before it and has its hash.
    starts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    last = np.append(starts[1:], len(least)) - 1
    run = np.searchsorted(starts, position, side="right") - 1
    while len(open_ := np.flatnonzero(least[starts[run]] != grams[position])):
        run[open_] -= 1
    return position, grams[position], position - np.minimum(last[run], position), np.minimum(position - starts[run], s.back)


_CHOSEN = pa.schema([("core", pa.int64()), ("reach", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32()), ("span", pa.int32())])
#: span holds near and far, as near * FAR + far.
CHOSEN = "core long, reach long, doc long, row_hash long, pos int, span int"
FAR = 1 << 15


def split_points(sample: DataFrame, tasks: int) -> np.ndarray:
    """Sorted (core, reach, doc) at which a sort is cut into tasks, from a sample of its rows; at most some 40 rows a task come to the driver.

    A range exchange of Spark's own would run the whole step before it once more to find them.
    """
    held = cut(sample.select("core", "reach", "doc"))
    share = min(1.0, 40 * tasks / max(held.count(), 1))
    rows = np.array(sorted(tuple(r) for r in held.sample(share, 1).collect()), dtype=np.int64).reshape(-1, 3)
    return rows[np.unique(np.arange(1, tasks) * len(rows) // tasks)] if len(rows) else rows


def part_of(keys: tuple[np.ndarray, np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    """How many split points are not past each (core, reach, doc)."""
    low, high = np.searchsorted(points[:, 0], keys[0], "left"), np.searchsorted(points[:, 0], keys[0], "right")
    tied = np.flatnonzero(low < high)
    if len(tied):
        # Points come before rows that are alike; the number of points before a row in their common order is its part.
        n = len(points)
        both = [np.concatenate([points[:, k], keys[k][tied]]) for k in range(3)]
        order = np.lexsort((np.arange(n + len(tied)) >= n, *both[::-1]))
        passed = np.cumsum(order < n)
        part = np.empty(n + len(tied), dtype=np.int64)
        part[order] = passed
        low[tied] = part[n:]
    return low.astype(np.int32)


def chosen_positions(rows: DataFrame, s: Settings, points: np.ndarray) -> DataFrame:
    """A row per chosen position: rank of its gram, rank of its reach, its place, the distances of its windows, and its part by `points`."""
    schema = _CHOSEN.append(pa.field("part", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, reaches = Powers(CORE_BASE), Powers(REACH_BASE)
        for batch in batches:
            docs, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raws = [x.as_py().encode("utf-8", "surrogatepass") for x in batch.column(2)]
            k = 0
            while k < len(raws):
                first, total = k, 0
                while k < len(raws) and (k == first or total + len(raws[k]) <= SLICE):
                    total += len(raws[k])
                    k += 1
                sizes = np.array([len(x) for x in raws[first:k]])
                if sizes.max() < s.length:
                    continue
                raw = np.frombuffer(b"".join(raws[first:k]), dtype=np.uint8)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                position, gram, near, far = chosen(raw, begins, ends, cores, s)
                text = np.searchsorted(ends, position, side="right")
                span = near * FAR + far
                reach = splitmix(reaches.hashes(reaches.sums(raw), position - far, position - near + s.length) ^ splitmix(span))
                keys = (gram.view(np.int64), reach.view(np.int64), docs[first + text])
                yield batch_of(schema, [*keys, hashes[first + text], (position - begins[text]).astype(np.int32), span.astype(np.int32), part_of(keys, points)])

    return map_arrow(rows, run, CHOSEN + ", part int")


def _ranking(schema: pa.Schema):
    """Streams rows sorted by (core, reach, doc, row_hash, pos); adds `kind`.  State: the last row and the core's first representative.

    kind 0: covered; 1: to settle with other tasks; 2: representative under a core with several; 3: a core at a task's border.
    """
    out_schema = schema.append(pa.field("kind", pa.int32()))

    def rows(table: pa.RecordBatch, at: np.ndarray, kind: int) -> pa.RecordBatch:
        taken = table.take(pa.array(at))
        # A covered row needs its place only; equal ranks take no room in the written table.
        none = pa.array(np.zeros(len(at), dtype=np.int64))
        ranks = [none, none] if kind == 0 else taken.columns[:2]
        return pa.RecordBatch.from_arrays([*ranks, *taken.columns[2:], pa.array(np.full(len(at), kind, dtype=np.int32))], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_core, waiting, tail = None, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = [np.asarray(c) for c in batch.columns[:5]]
            same = np.ones((5, n), dtype=bool)
            for k, v in enumerate(values):
                same[k, 1:] = v[1:] == v[:-1]
                same[k, 0] = last is not None and v[0] == last[k]
            same = np.logical_and.accumulate(same, axis=0)
            new_core, new_reach, repeated = ~same[0], ~same[1], same[4]
            if first_core is None:
                first_core = values[0][0]
                yield rows(batch, np.array([0]), 3)
            at_border = values[0] == first_core
            # A task's first row of a pair may have an earlier one elsewhere; the pair's other rows have it here.
            yield rows(batch, np.flatnonzero(at_border & new_reach), 1)
            yield rows(batch, np.flatnonzero(~new_reach & ~repeated), 0)
            # A second reach under a core makes both it and the core's first one representatives.
            heads = np.flatnonzero(new_core)
            more = np.flatnonzero(new_reach & ~new_core & ~at_border)
            head = np.searchsorted(heads, more, side="right") - 1
            if (head < 0).any() and waiting is not None:
                yield waiting
                waiting = None
            yield rows(batch, np.union1d(more, heads[np.unique(head[head >= 0])]), 2)
            if len(heads):
                h = heads[-1]
                waiting = None if at_border[h] or (len(more) and more[-1] > h) else rows(batch, np.array([h]), 2)
            last = [v[-1] for v in values]
            tail = batch.slice(n - 1)
        if last is not None:
            yield rows(tail, np.array([0]), 3)
            if waiting is not None:
                yield pa.RecordBatch.from_arrays([*waiting.columns[:-1], pa.array([1], pa.int32())], schema=out_schema)

    return run


def rank_table(rows: DataFrame, schema: pa.Schema, ddl: str, tasks: int) -> tuple[DataFrame, str]:
    """One round's sort of rank pairs, written; `rows` has a part below `tasks`."""
    dealt = rows.repartitionById(tasks, "part").sortWithinPartitions("core", "reach", "doc", "row_hash", "pos").drop("part")
    return staged(map_arrow(dealt, _ranking(schema), ddl + ", kind int"), "repeat-ranks")


def covered_reach(rows: DataFrame, s: Settings) -> DataFrame:
    """doc, row_hash, begin, end: what the windows of a row's cell touch, from pos, span, low and high."""
    near, far = F.shiftright("span", FAR.bit_length() - 1), F.col("span").bitwiseAND(FAR - 1)
    begin, end = F.col("pos") - F.least(F.col("high"), far), F.col("pos") - F.greatest(F.col("low"), near) + s.length
    return rows.select("doc", "row_hash", begin.alias("begin"), end.alias("end"))


def ranked(found: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """From a round's table: covered spans, and the representatives that stay open (doc, row_hash, pos, span, low, high)."""
    # Two rows a task, whatever the data hold; every core of kind 1 is among them.
    border = F.broadcast(found.where("kind = 3").select("core").distinct())
    several = found.where("kind = 2").drop("kind")
    open_rows = found.where("kind = 1").drop("kind").unionByName(several.join(border, "core", "left_semi"))
    place = F.struct("doc", "row_hash", "pos", "span", "low", "high")
    firsts = open_rows.groupBy("core", "reach").agg(F.min(place).alias("first"))
    later = open_rows.join(firsts, ["core", "reach"]).where(place != F.col("first"))
    covered = covered_reach(found.where("kind = 0"), s).unionByName(covered_reach(later, s))
    many = firsts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    more = firsts.join(F.broadcast(many), "core").select("first.*")
    return covered, several.join(border, "core", "left_anti").select("doc", "row_hash", "pos", "span", "low", "high").unionByName(more)


_REACH = pa.schema([("doc", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), ("bytes", pa.binary())])


def reach_bytes(rows: DataFrame, left: DataFrame, s: Settings) -> DataFrame:
    """doc, row_hash, pos, span, bytes: the whole reach of each open representative."""
    per_doc = left.groupBy("doc", "row_hash").agg(F.collect_set(F.struct("pos", "span")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row_hash, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for x in at:
                    near, far = divmod(x["span"], FAR)
                    out.append((doc, row_hash, x["pos"], x["span"], raw[x["pos"] - far : x["pos"] - near + s.length]))
            if out:
                yield batch_of(_REACH, list(zip(*out, strict=True)))

    joined = rows.join(per_doc, ["doc", "row_hash"]).select("doc", "row_hash", "text", "at")
    return map_arrow(joined, run, "doc long, row_hash long, pos int, span int, bytes binary").distinct()


_CELL = pa.schema([*_CHOSEN, ("low", pa.int32()), ("high", pa.int32())])
CELL = CHOSEN + ", low int, high int"


def cell_rows(open_rows: DataFrame, held: DataFrame, width: int, s: Settings, points: np.ndarray) -> DataFrame:
    """Rank pairs of the open cells' parts of `width` distances; a part without a window of its own has no row."""

    schema = _CELL.append(pa.field("part", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, reaches = Powers(CORE_BASE), Powers(REACH_BASE)
        for batch in batches:
            doc, row_hash, pos, low, high, span = (np.asarray(batch.column(k)) for k in range(6))
            parts = batch.column(6).to_pylist()
            sizes = np.array([len(x) for x in parts], dtype=np.int64)
            raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
            core_sums, reach_sums = cores.sums(raw), reaches.sums(raw)
            near, far = np.divmod(span.astype(np.int64), FAR)
            anchor = np.cumsum(sizes) - sizes + far
            for k in range(s.split):
                a = low.astype(np.int64) + k * width
                b = np.minimum(a + width - 1, high)
                nearest, farthest = np.maximum(a, near), np.minimum(b, far)
                at = np.flatnonzero((a <= b) & (nearest <= farthest))
                a, b, nearest, farthest, here = a[at], b[at], nearest[at], farthest[at], anchor[at]
                core = splitmix(cores.hashes(core_sums, here - a, here - b + s.length) ^ splitmix(a * FAR + b))
                reach = splitmix(reaches.hashes(reach_sums, here - farthest, here - nearest + s.length) ^ splitmix(nearest * FAR + farthest))
                keys = (core.view(np.int64), reach.view(np.int64), doc[at])
                yield batch_of(schema, [*keys, row_hash[at], pos[at], span[at], a.astype(np.int32), b.astype(np.int32), part_of(keys, points)])

    joined = open_rows.join(held, ["doc", "row_hash", "pos"]).select("doc", "row_hash", "pos", "low", "high", "span", "bytes")
    return map_arrow(joined, run, CELL + ", part int")


def merged(texts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each text joined: text, begin, end of every maximal span, in order."""
    order = np.lexsort((begins, texts))
    text, begin, end = texts[order].astype(np.int64), begins[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(text):
        return text, begin, end
    # Texts are laid side by side with a gap, so that one running maximum serves all.
    shift = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.append(True, begin[1:] + shift[1:] > reach[:-1]))
    final = np.append(first[1:], len(text)) - 1
    return text[first], begin[first], reach[final] - shift[first]


def batch_spans(spans: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Joined spans of each row of a column of lists of structs; null has none."""
    flat = spans.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(spans), 0))
    text, begin, end = merged(np.repeat(np.arange(len(spans)), sizes), np.asarray(flat.field(0)), np.asarray(flat.field(1)))
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(spans))]
    for k, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
        out[k].append((a, b))
    return out


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    text = whole_text(text_column)
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def repeated_spans(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc (NO_ID for null), row_hash, spans array<struct<begin, end>>: byte spans covered by earlier strings, not yet joined; only documents with some.

    Tables of the rounds go once the spans are written.
    """
    spark, tasks = docs.sparkSession, task_count(docs.sparkSession)
    rows, no_points = identified(docs, id_column, text_column), np.zeros((0, 3), dtype=np.int64)
    share = min(1.0, max(0.01, 50 * tasks / max(rows.count(), 1)))
    points = split_points(chosen_positions(rows.sample(share, 1), settings, no_points), tasks)
    found, path = rank_table(chosen_positions(rows, settings, points), _CHOSEN, CHOSEN, tasks)
    width, used = settings.back + 1, [path]
    covered, left = ranked(found.withColumns({"low": F.lit(0), "high": F.lit(settings.back)}), settings)
    left = cut(left.distinct())
    held, path = staged(reach_bytes(rows, left, settings), "repeat-reaches")
    used.append(path)
    while width > 1 and (n := left.count()):
        width, cells = -(-width // settings.split), left.select("doc", "row_hash", "pos", "low", "high")
        points = split_points(cell_rows(cells.sample(min(1.0, max(0.01, 200 * tasks / n)), 1), held, width, settings, no_points), tasks)
        found, path = rank_table(cell_rows(cells, held, width, settings, points), _CELL, CELL, tasks)
        used.append(path)
        more, left = ranked(found, settings)
        covered = covered.unionByName(more)
        left = cut(left.distinct())
    # A document's own spans, as many as its bytes at most.
    per_doc = covered.groupBy("doc", "row_hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    out, _ = staged(per_doc, "repeat-spans")
    for folder in used:
        delete_path(spark, folder)
    return out


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, spans (null where nothing goes): one row per row of `docs`."""
    rows = identified(docs, id_column, text_column)
    joined = rows.join(spans, ["doc", "row_hash"], "left")
    return joined.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "spans")


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for begin, end in spans:
        out.append(raw[at:begin])
        at = end
    return b"".join([*out, raw[at:]])
