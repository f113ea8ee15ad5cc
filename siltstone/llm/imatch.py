"""I-Match document fingerprints (operator 4).

Terms are words between white space, lowered.  The lexicon holds the terms whose inverse document frequency,
ln(documents / document frequency), lies within a band.  A text's distinct lexicon terms are sorted (by their 64-bit
hash) and hashed, once for each of several random subsets of the lexicon; a term belongs to a subset by a hash of both.
Subsets come at several rates, from half of the lexicon to one term in 256, so that likeness is graded: large subsets
tell equal texts, small ones still agree when half of a text is another.  A subset that meets no term of the text has
an empty signature.  Likeness is the number of equal signatures over the number of subsets that are not empty in both;
a text without any lexicon term is marked by the hash of the whole text instead and is like its equals only.

Bounds: a lexicon term occurs in at least a share exp(-high) of all documents, so there are at most
(mean distinct terms of a document) x exp(high) of them, however many documents there are.  Up to `most_terms` go to all
tasks, as 8-byte hashes with a byte a subset; beyond, terms of texts meet the lexicon in a join, with the same prints.

Defined cases: null text is the empty text.  Documents are ordered by doc_id, null first, then by text; repeated rows
stand side by side.  A single row is its own next document.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, map_arrow, splitmix, staged, task_count, whole_text

#: Rates of the subsets, 1 in so many terms.
RATES = (2, 2, 8, 8, *[32] * 4, *[128] * 16, *[256] * 40)


class Terms(dict):
    """Word -> 64-bit hash of the lowered word, remembered for up to `entries` words."""

    def __init__(self, entries: int = 400_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> int:
        if len(self) >= self.entries:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return found

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's terms."""
        return np.unique(np.fromiter(map(self.__getitem__, set(text.split())), dtype=np.uint64))


#: Terms that a task counts before it hands them on; Spark adds them up within the task.
MOST_COUNTED = 250_000

#: Terms that a task holds: 8 bytes and a byte a subset each, 144 MB.
MOST_TERMS = 2_000_000


def lexicon(docs: DataFrame, low: float = 3.0, high: float = 6.2, text_column: str = "text", most_terms: int = MOST_TERMS) -> np.ndarray:
    """Sorted hashes of the terms of lexicon_table, which are counted before they come to the driver: over `most_terms` is an error."""
    found = lexicon_table(docs, low, high, text_column)
    if (n := found.count()) > most_terms:
        raise ValueError(f"{n} terms have an inverse document frequency up to {high}; {most_terms} may be held by every task")
    return sorted_terms(found)


def sorted_terms(found: DataFrame) -> np.ndarray:
    return np.sort(found.toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))


def lexicon_table(docs: DataFrame, low: float = 3.0, high: float = 6.2, text_column: str = "text") -> DataFrame:
    """term: hashes of the terms whose inverse document frequency is in [low, high], over all documents."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen = Terms(), Counter()

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(seen.keys(), dtype=np.uint64, count=len(seen)).view(np.int64)
            out = batch_of(schema, [keys, np.fromiter(seen.values(), dtype=np.int64, count=len(seen))])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update({terms[w] for w in set(text.as_py().split())})
                if len(seen) > MOST_COUNTED:
                    yield flush()
        if seen:
            yield flush()

    n_docs = docs.count()
    counts = map_arrow(docs.select(whole_text(text_column).alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    idf = F.log(F.lit(float(max(n_docs, 1))) / F.col("n"))
    return cut(counts.where((idf >= low) & (idf <= high)).select("term"))


def members(words: np.ndarray) -> np.ndarray:
    """Which subset (row) holds which term (column)."""
    keys = np.arange(1, len(RATES) + 1, dtype=np.uint64)
    return np.stack([splitmix(words ^ splitmix(k)) % np.uint64(r) == 0 for k, r in zip(keys, RATES, strict=True)]) if len(words) else np.zeros((len(RATES), 0), dtype=bool)


def mark(text: str) -> str:
    """What stands for a text without lexicon terms."""
    return "=" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def signed(held: np.ndarray, member: np.ndarray) -> str | None:
    """Signatures of 8 hex digits with dots between them, empty ones as nothing; null where no subset holds a term."""
    # The members of all subsets, one subset after the other, each in the order of terms.
    subset, term = np.nonzero(member)
    if not len(subset):
        return None
    raw = held[term].tobytes()
    ends = (np.cumsum(np.bincount(subset, minlength=len(RATES))) * held.itemsize).tolist()
    return ".".join(xxhash.xxh32_hexdigest(raw[a:b]) if b > a else "" for a, b in zip([0, *ends], ends, strict=False))


@dataclass
class Fingerprinter:
    """Fingerprints of texts under one lexicon."""

    words: np.ndarray

    def __post_init__(self) -> None:
        self.terms = Terms()
        self.member = members(self.words)

    def __call__(self, text: str) -> str:
        """The signatures of a text; `=` and its hash without lexicon terms."""
        mine = self.terms.of(text)
        at = np.searchsorted(self.words, mine)
        hit = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == mine)] if len(self.words) else at[:0]
        return signed(self.words[hit], self.member[:, hit]) or mark(text)


def likeness(a: str, b: str) -> float:
    """Share of equal signatures among the subsets that are not empty in both; 0 to 1."""
    if a == b:
        return 1.0
    if a[:1] == "=" or b[:1] == "=":
        return 0.0
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_rows(docs: DataFrame, words: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row per row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(words)
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [make(x) for x in batch.column(1).to_pylist()]])

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")), run, "doc_id long, fingerprint string")


def range_number(points: list[int], low: int, high: int) -> Column:
    """Number of points up to doc_id, by halving: as many comparisons a row as the logarithm of the points."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col("doc_id") >= F.lit(points[middle]).cast("long"), range_number(points, middle + 1, high)).otherwise(range_number(points, low, middle))


def in_parts(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows with a part, the range of their doc_id (null is in the first), and each range's first row once more, at the end of the range before it.

    Ranges are cut at sampled doc_ids; a row's range is a function of its doc_id alone, so nothing hangs on how an
    exchange is made or reused.  The first row of all ends the last range.  `guest` marks the added rows.
    """
    share = min(1.0, 100 * tasks / max(rows.count(), 1))
    sampled = sorted({r[0] for r in rows.select("doc_id").where("doc_id is not null").sample(share, 1).collect()})
    # At most some 100 sampled ids a task come to the driver, and a split point a task goes to the rows.
    points = sorted({sampled[k * len(sampled) // tasks] for k in range(1, tasks)}) if sampled else []
    part = F.coalesce(range_number(points, 0, len(points)), F.lit(0))
    placed = rows.select(part.alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    # One narrow row a range; then the least text of the few rows that share a range's least doc_id.
    ranges = cut(placed.groupBy("part").agg(F.max(F.col("doc_id").isNull()).alias("absent"), F.min("doc_id").alias("least")))
    order = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(order), F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = ranges.select(F.col("part").alias("own"), F.when(~F.col("absent"), F.col("least")).alias("head"), before.alias("previous"))
    first = placed.join(F.broadcast(heads), (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")))
    firsts = first.groupBy("previous", "doc_id").agg(F.min("text").alias("text"))
    return placed.unionByName(firsts.select(F.col("previous").alias("part"), F.lit(1).alias("guest"), "doc_id", "text"))


def compare_with_next(docs: DataFrame, words: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and its likeness to both that and the next document's.

    Ranges of doc_id are streamed in order, holding two texts at a time; the first row of the next range stands at the
    end of each (see in_parts), so one exchange settles every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, before = Fingerprinter(words), None
        for batch in batches:
            out = []
            for part, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                print_ = make(text)
                if before is not None and before[0] == part:
                    _, last_doc, last_text, last_print = before
                    other = edited(last_text, text)
                    other_print = make(other)
                    out.append((last_doc, len(last_text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), last_print, other_print, likeness(last_print, other_print), likeness(last_print, print_)))
                before = None if guest else (part, doc, text, print_)
            if out:
                yield batch_of(_ROW, list(zip(*out, strict=True)))

    return map_arrow(ordered(docs, id_column, text_column), run, ROW)


def ordered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """part, guest, doc_id, text in the order of documents; see in_parts."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    tasks = task_count(docs.sparkSession)
    return in_parts(rows, tasks).repartitionById(tasks, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")


def compare_by_join(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of compare_with_next under a lexicon that no task could hold: texts' terms meet it in a semi-join.

    The texts of a row (its own, the edited and the next one) are written as their distinct terms' hashes.
    """
    kinds = ("own", "edited", "next")
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), *((f"{k}_mark", pa.string()) for k in kinds), *((f"{k}_terms", pa.list_(pa.int64())) for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, before, n = Terms(), None, 0
        for batch in batches:
            out = []
            for part, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                mine = hashes.of(text).view(np.int64)
                if before is not None and before[0] == part:
                    _, last_doc, last_text, last_terms = before
                    other = edited(last_text, text)
                    # A range is one task's, so its rows can be numbered there.
                    out.append(((part << 40) + n, last_doc, len(last_text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), mark(last_text), mark(other), mark(text), last_terms, hashes.of(other).view(np.int64), mine))
                    n += 1
                n, before = (0, None) if guest else (n, (part, doc, text, mine))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    rows, _ = staged(map_arrow(ordered(docs, id_column, text_column), run, "key long, doc_id long, n_chars long, edited_sha256 string, own_mark string, edited_mark string, next_mark string, own_terms array<long>, edited_terms array<long>, next_terms array<long>"), "imatch-terms")
    each = [rows.select("key", F.lit(k).alias("kind"), F.explode(f"{k}_terms").alias("term")) for k in kinds]
    held = each[0].unionByName(each[1]).unionByName(each[2]).join(terms, "term", "left_semi")
    # As many terms as a text has, at most.
    held = held.groupBy("key").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in kinds))
    joined = rows.drop(*(f"{k}_terms" for k in kinds)).join(held, "key", "left").select("doc_id", "n_chars", "edited_sha256", *(f"{k}_mark" for k in kinds), *kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n_chars, sha, *rest in zip(*(batch.column(k).to_pylist() for k in range(6)), *(batch.column(k) for k in range(6, 9)), strict=True):
                prints = []
                for hashed, found in zip(rest[:3], rest[3:], strict=True):
                    words = np.sort(np.array(found.as_py() or [], dtype=np.int64).view(np.uint64))
                    prints.append(signed(words, members(words)) or hashed)
                out.append((doc, n_chars, sha, *prints[:2], likeness(prints[0], prints[1]), likeness(prints[0], prints[2])))
            if out:
                yield batch_of(_ROW, list(zip(*out, strict=True)))

    return map_arrow(joined, compare, ROW)


def compared(docs: DataFrame, low: float = 3.0, high: float = 6.2, most_terms: int = MOST_TERMS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """compare_with_next under the lexicon of the documents themselves; beyond `most_terms`, by compare_by_join."""
    terms = lexicon_table(docs, low, high, text_column)
    if terms.count() > most_terms:
        return compare_by_join(docs, terms, id_column, text_column)
    return compare_with_next(docs, sorted_terms(terms), id_column, text_column)
