"""Phrase collocation mining by hashed bucket counts and Apriori pruning (operator 11).

1. Pass 1 counts words exactly and every pair of neighbours in a table of 2**bits hash buckets.  A pair can only be frequent
   if its bucket is, so the table becomes a bitmap of 2**bits / 8 bytes, a size that does not grow with the data, and is
   broadcast.  With more different pairs than buckets it lets more through, and the exact counts have more to do.
2. Pass 2 counts exactly the pairs whose words are both frequent (Apriori, a bitmap of the frequent words) and whose bucket
   is, and counts the triples of such pairs in buckets.  Pass 3 counts the triples whose two pairs are frequent and whose
   bucket is.  Every filter only lets too much through, so the exact counts decide.
3. Tasks count in tables of their own and deal out one row a phrase or one block of buckets; counts of a bucket stop at
   the least frequency, which is enough to tell and fits a byte.
4. Parts of a candidate are looked up by one join, scores are exact decimals, and the best of a language are found in
   rounds over salted groups, so that a language with most of the rows is spread over all tasks.

All buckets and counts are a language's own.  Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into
pieces, and those at spaces and tabs into words; phrases never leave a piece.

Defined cases: null text is empty; null lang is `und`; empty texts and pieces have no words; repeated rows count each, and
doc_id is not read.  A table without frequent phrases gives no rows.  A text's longest piece has to fit a task's memory.
Counts of a phrase may reach 10**15, at which scores still fit a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, delete_path, map_arrow, shuffles_dropped, splitmix, staged, task_count, whole_text

#: Characters that end a piece, and those between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
WORD, BLANK, END = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[list(BLANKS)], CLASS[list(PIECE_ENDS)] = BLANK, END
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BITS = 16


@dataclass(frozen=True)
class Settings:
    """least: least frequency of a candidate.  bits: 2**bits buckets.  covered: percent of a candidate's frequency at which a longer one stands for it."""

    least: int = 10
    bits: int = 26
    covered: int = 50
    top: int = 2000
    slice_bytes: int = 2 << 20
    held: int = 300_000

    def __post_init__(self) -> None:
        if not 1 <= self.least <= 255 or not BLOCK_BITS <= self.bits <= 32:
            raise ValueError("least is 1 to 255, bits 16 to 32")


def words_of(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of each word in the list of different words, that list, and the piece of each word."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.int64), [], np.zeros(0, dtype=np.int64)
    raw = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    kind, bounds = CLASS[raw], np.unique(offsets - offsets[0])
    inside = kind == WORD
    starts_here, ends_here = inside.copy(), inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here[:-1] &= ~inside[1:]
    # A text's border parts words too.
    inner = bounds[1:-1]
    starts_here[inner], ends_here[inner - 1] = inside[inner], inside[inner - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    piece = np.searchsorted(np.flatnonzero(kind == END), starts) + np.searchsorted(bounds, starts, side="right")
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw[inside])])
    encoded = flat.dictionary_encode()
    return np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary.to_pylist(), piece


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def longer_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all words but the last, and the last one's."""
    with np.errstate(over="ignore"):
        return splitmix(first * FACTOR + last)


def buckets(hashes: np.ndarray, lang: str, bits: int) -> np.ndarray:
    return (splitmix(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))) >> np.uint64(64 - bits)).astype(np.int64)


def is_set(bitmap: bytes, bucket: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bitmap, dtype=np.uint8)[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def packed_counts(counts: np.ndarray) -> bytes:
    """A block of bucket counts: places (two bytes each) and counts of those that are not zero, or all counts where that is shorter."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 3 * len(at) >= len(counts) else at.astype("<u2").tobytes() + counts[at].tobytes()


def add_packed(total: np.ndarray, raw: memoryview | bytes) -> None:
    """Adds a block of packed_counts; only one of all counts has their number of bytes, which three does not divide."""
    if len(raw) == len(total):
        total += np.frombuffer(raw, dtype=np.uint8)
    else:
        n = len(raw) // 3
        total[np.frombuffer(raw, dtype="<u2", count=n)] += np.frombuffer(raw, dtype=np.uint8, offset=2 * n)


#: A row is a phrase with its count (block is null), or a block of bucket counts (lang and phrase are null).
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
_FOUND_SQL = "lang string, phrase binary, n long, block int, counts binary"


class Tally:
    """Counts of one task: phrases in a dictionary that is handed on when it is full, buckets in one array."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.phrases: dict[tuple[str, bytes], int] = {}
        self.table: np.ndarray | None = None

    def add_phrases(self, lang: str, phrases: list[bytes], counts: np.ndarray) -> None:
        held = self.phrases
        for phrase, n in zip(phrases, counts.tolist(), strict=True):
            key = (lang, phrase)
            held[key] = held.get(key, 0) + n

    def add_buckets(self, bucket: np.ndarray) -> None:
        if self.table is None:
            self.table = np.zeros(1 << self.settings.bits, dtype=np.uint8)
        at, n = np.unique(bucket, return_counts=True)
        self.table[at] = np.minimum(self.table[at] + n, self.settings.least)

    def given(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """The phrases held, if over `most`."""
        if len(self.phrases) > most:
            items, self.phrases = list(self.phrases.items()), {}
            for a in range(0, len(items), 50_000):
                part = items[a : a + 50_000]
                yield batch_of(_FOUND, [[k[0] for k, _ in part], [k[1] for k, _ in part], [n for _, n in part], [None] * len(part), [None] * len(part)])

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if self.table is not None:
            for block, counts in enumerate(self.table.reshape(-1, 1 << BLOCK_BITS)):
                if counts.any():
                    yield batch_of(_FOUND, [[None], [None], [None], [block], [packed_counts(counts)]])


def counting_pass(docs: DataFrame, size: int, settings: Settings, words: bytes | None, shorter: bytes | None, own: bytes | None) -> tuple[DataFrame, str]:
    """One pass over the texts: exact counts of phrases of `size` words, and bucket counts of those of one word more, up to three.

    The table's folder is the caller's to delete.  Bitmaps: `words` of frequent words, `shorter` of frequent phrases of one word less, `own` of the frequent buckets.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({"words": words, "shorter": shorter, "own": own})

    def one(lang: str, texts: pa.LargeBinaryArray, tally: Tally) -> None:
        ids, different, piece = words_of(texts)
        if not different:
            return
        maps, hashes, n, bits = sent.value, word_hashes(different), len(different), settings.bits
        if size == 1:
            tally.add_phrases(lang, different, np.bincount(ids, minlength=n))
        # Pairs of neighbours, as one number each; `at` is the row of their first word.
        at = np.flatnonzero(piece[1:] == piece[:-1])
        if maps["words"] is not None:
            frequent = is_set(maps["words"], buckets(hashes, lang, bits))
            at = at[frequent[ids[at]] & frequent[ids[at + 1]]]
        if size == 1:
            tally.add_buckets(buckets(longer_hash(hashes[ids[at]], hashes[ids[at + 1]]), lang, bits))
            return
        pairs, pair_of = np.unique(ids[at] * n + ids[at + 1], return_inverse=True)
        pair_hash = longer_hash(hashes[pairs // n], hashes[pairs % n])
        pair_bucket = buckets(pair_hash, lang, bits)
        kept = is_set(maps["own"] if size == 2 else maps["shorter"], pair_bucket)
        if size == 2:
            count = np.bincount(pair_of, minlength=len(pairs))[kept]
            tally.add_phrases(lang, joined(different, pairs[kept] // n, pairs[kept] % n), count)
        # Triples: a pair that stays, followed by one that starts at its second word.
        stays = kept[pair_of]
        at, pair_of = at[stays], pair_of[stays]
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        first, last = pair_of[follows], ids[at[follows] + 2]
        triples, triple_of = np.unique(first * n + last, return_inverse=True)
        bucket = buckets(longer_hash(pair_hash[triples // n], hashes[triples % n]), lang, bits)
        if size == 2:
            tally.add_buckets(bucket[triple_of])
            return
        kept = is_set(maps["own"], bucket)
        two = pairs[triples[kept] // n]
        tally.add_phrases(lang, joined(different, two // n, two % n, triples[kept] % n), np.bincount(triple_of, minlength=len(triples))[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(settings)
        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1).cast(pa.large_binary())
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for part in slices(texts.filter(pc.equal(langs.indices, k)), settings.slice_bytes):
                    one(lang, part, tally)
                    yield from tally.given(settings.held)
        yield from tally.given()
        yield from tally.blocks()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("raw"))
    return staged(map_arrow(rows, run, _FOUND_SQL), f"phrases-{size}")


def joined(words: list[bytes], *parts: np.ndarray) -> list[bytes]:
    """Phrases of the numbered words, joined by a space."""
    table = pa.array(words, type=pa.large_binary())
    return pc.binary_join_element_wise(*(table.take(pa.array(p)) for p in parts), pa.scalar(b" ", type=pa.large_binary())).to_pylist()


def slices(texts: pa.LargeBinaryArray, limit: int) -> Iterator[pa.LargeBinaryArray]:
    """Runs of texts of about `limit` bytes.  A longer text is cut where pieces end, since no phrase crosses there."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield texts.slice(start, k - start)
            start, total = k, 0
        if n > limit:
            raw, a = texts[k].as_py(), 0
            while a < len(raw):
                b = min(a + limit, len(raw))
                while b < len(raw) and CLASS[raw[b]] != END:
                    b += 1
                yield pa.array([raw[a:b]], type=pa.large_binary())
                a = b
            start, total = k + 1, 0
        else:
            total += n
    if start < len(texts):
        yield texts.slice(start)


_BITS = pa.schema([("block", pa.int32()), ("bits", pa.binary())])


def bitmap(found: DataFrame, settings: Settings) -> bytes:
    """The buckets whose counts reach the least frequency, as 2**bits / 8 bytes on the driver.

    Blocks are added up as a stream over sorted rows, one block at a time.
    """
    rows = found.where("block is not null").select("block", "counts").repartition(min(task_count(found.sparkSession), 1 << settings.bits - BLOCK_BITS), "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        done = lambda: batch_of(_BITS, [[held], [np.packbits(total >= settings.least, bitorder="little").tobytes()]])
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != held:
                    if held is not None:
                        yield done()
                    held, total = block, np.zeros(1 << BLOCK_BITS, dtype=np.uint32)
                add_packed(total, memoryview(counts.as_buffer()))
        if held is not None:
            yield done()

    out = bytearray(1 << settings.bits - 3)
    width = 1 << BLOCK_BITS - 3
    with shuffles_dropped(found.sparkSession):
        for r in map_arrow(rows, run, "block int, bits binary").collect():
            out[r.block * width : (r.block + 1) * width] = r.bits
    return bytes(out)


def bitmap_of(phrases: DataFrame, settings: Settings) -> bytes:
    """The buckets of given phrases (lang, phrase), as a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(settings)
        for batch in batches:
            by_lang: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.split(b" "))
            for lang, split in by_lang.items():
                total = word_hashes([w[0] for w in split])
                for k in range(1, len(split[0])):
                    total = longer_hash(total, word_hashes([w[k] for w in split]))
                tally.add_buckets(buckets(total, lang, settings.bits))
        if tally.table is not None:
            tally.table[tally.table > 0] = settings.least
        yield from tally.blocks()

    return bitmap(map_arrow(phrases.select("lang", "phrase"), run, _FOUND_SQL), settings)


def frequent(found: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of the phrases that reach the least frequency."""
    return cut(found.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least))


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut, the least k first; phrases have two or three words."""
    word = F.split(F.col("phrase").cast("string"), " ")
    part = lambda k, side, first, n: F.struct(F.lit(f"{side}{k}").alias("slot"), F.array_join(F.slice(word, first, n), " ").cast("binary").alias("part"))
    two, three = [part(1, "l", 1, 1), part(1, "r", 2, 1)], [part(1, "l", 1, 1), part(1, "r", 2, 2), part(2, "l", 1, 2), part(2, "r", 3, 1)]
    rows = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.when(F.size(word) == 2, F.array(*two)).otherwise(F.array(*three))).alias("x"))
    rows = rows.select("lang", "phrase", "a", "x.slot", "x.part").join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    slots = rows.groupBy("lang", "phrase").agg(F.first("a").alias("a"), *(F.max(F.when(F.col("slot") == s, F.col("f"))).alias(s) for s in ("l1", "r1", "l2", "r2")))
    slots = slots.withColumn("s1", cut_score("a", "l1", "r1")).withColumn("s2", F.when(F.col("l2").isNotNull(), cut_score("a", "l2", "r2")))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    return slots.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each lang with their rank: groups of a lang are salted, and fewer salts each round."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for salts in (256, 16):
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        rows = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    least = settings.least
    found, path = counting_pass(docs, 1, settings, None, None, None)
    words = frequent(found, least)
    totals = cut(found.where("block is null").groupBy("lang").agg(F.sum("n").alias("n")))
    word_map, next_map = bitmap_of(words, settings), bitmap(found, settings)
    delete_path(docs.sparkSession, path)
    found, path = counting_pass(docs, 2, settings, word_map, None, next_map)
    pairs = frequent(found, least)
    pair_map, next_map = bitmap_of(pairs, settings), bitmap(found, settings)
    delete_path(docs.sparkSession, path)
    found, path = counting_pass(docs, 3, settings, word_map, pair_map, next_map)
    triples = frequent(found, least)
    delete_path(docs.sparkSession, path)
    word = F.split(F.col("phrase").cast("string"), " ")
    inner = F.array(*(F.array_join(F.slice(word, k, 2), " ").cast("binary") for k in (1, 2)))
    longer = triples.select("lang", F.col("f").alias("of"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    left = pairs.join(longer, ["lang", "phrase"], "left").where(F.col("of").isNull() | (100 * F.col("of") < settings.covered * F.col("f"))).drop("of")
    best = best_of(scored(left.unionByName(triples), words.unionByName(pairs)), settings.top)
    return best.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
