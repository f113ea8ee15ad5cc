"""Token-id shards with a minimal perfect hash index (operator 5).

write_ids   range-partitions documents by id and streams each task's ids into shard files.
build_index deals keys over buckets by hash; each bucket gets a minimal perfect hash function, levels of bit arrays
            in the manner of published "BBHash", and parallel arrays: fingerprint, shard, offset, length.
lookup      finds keys through the index, constant time a key, and reads their ids from the shards, in shard order.

Shard file: 16 bytes (magic "SILTIDS1", bytes per id as 32-bit, zero as 32-bit), then raw little-endian ids.
Files get a name of their own for each task attempt; only names in the committed entries or index table are ever
read, so a lost or repeated task leaves at most an unread file.

Key: (doc_id, occurrence); occurrence counts rows with the same doc_id from 0, in the order of their texts, so
repeated rows stay apart.  A null doc_id is a key of its own, before all others.  Null text is the empty text, whose
document holds the end id only.  Other columns are not read; an empty table gives no shards and an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, map_arrow, new_folder, splitmix, staged, task_count, whole_text

MAGIC = b"SILTIDS1"
HEAD = 16
_ENTRY = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("key_hash", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
ENTRY = "doc_id long, occurrence long, key_hash long, part int, seq int, path string, offset long, n_tokens long"


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def key_hash(doc_id: int | None, occurrence: int) -> int:
    """Signed 64-bit hash of a key."""
    raw = struct.pack("<?qq", doc_id is None, doc_id or 0, occurrence)
    return int.from_bytes(xxhash.xxh3_64_digest(raw), "little", signed=True)


class ChunkEncoder:
    """Texts -> their ids as bytes, by chunks between ASCII white space, each different one of a slice encoded once.

    Right for tokenizers whose normaliser and splitter drop white space, never look past it, and part letters and digits
    from other characters, and whose special strings hold no white space and end in none of CLOSING.  Arrow splits the
    texts, numbers their different pieces and gathers the ids; the pieces are encoded in few calls, a mark of its own id
    between them.
    """

    #: A chunk's end of these, after an ASCII letter or digit, is a piece of its own, so that a word is encoded once.
    CLOSING = r"^(?P<head>.*[0-9A-Za-z])(?P<tail>[.,;:!?%*$&#]+)$"

    def __init__(self, tokenizer_path: str, dtype: str, pieces: int = 50_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype, self.pieces = np.dtype(dtype), pieces
        # A rare character that is one id by itself; without one, pieces are encoded one by one.
        self.mark, self.mark_id = next(((c, ids[0]) for c in "~^`" if len(ids := self.ids(c)) == 1), (None, None))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def encoded(self, pieces: pa.StringArray, link: str | None) -> pa.BinaryArray:
        """Ids of each piece; `link` holds the mark, which no piece holds.  Without a link, or if it did not stay apart, one by one."""
        if link is not None:
            ids = self.ids(link.join(pieces.to_pylist()))
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) == len(pieces) - 1:
                ends = np.concatenate([[0], at - np.arange(len(at)), [len(ids) - len(at)]]) * self.dtype.itemsize
                return pa.BinaryArray.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.delete(ids, at))])
        return pa.array([self.ids(x).tobytes() for x in pieces.to_pylist()], pa.binary())

    def of_pieces(self, pieces: pa.StringArray) -> pa.Array:
        """Ids of different pieces."""
        at = np.arange(len(pieces))
        marked = np.ones(len(pieces), dtype=bool) if self.mark is None else np.asarray(pc.match_substring(pieces, self.mark))
        # ASCII letters part from the mark without a space.
        words = ~marked & np.asarray(pc.ascii_is_alpha(pieces))
        order, found = [], []
        for part, link in ((at[words], self.mark), (at[~marked & ~words], f" {self.mark} "), (at[marked], None)):
            for k in range(0, len(part), self.pieces):
                order.append(part[k : k + self.pieces])
                found.append(self.encoded(pieces.take(pa.array(order[-1])), link))
        if not found:
            return pa.array([], pa.binary())
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(order))))

    def of_chunks(self, chunks: pa.StringArray) -> pa.Array:
        """Ids of different chunks."""
        split = pc.extract_regex(chunks, self.CLOSING)
        whole = np.asarray(split.is_null())
        heads, tails = pc.if_else(split.is_null(), chunks, split.field("head")), pc.if_else(split.is_null(), "", split.field("tail"))
        numbered = pa.concat_arrays([heads, tails]).dictionary_encode()
        ids, index = self.of_pieces(numbered.dictionary), numbered.indices
        first, second = ids.take(index.slice(0, len(chunks))), ids.take(index.slice(len(chunks)))
        return first if whole.all() else pc.binary_join_element_wise(first, second, pa.scalar(b"", pa.binary()))

    def __call__(self, texts: pa.StringArray) -> list[memoryview]:
        """Ids of each text; no nulls."""
        rows = pc.ascii_split_whitespace(texts)
        numbered = rows.flatten().dictionary_encode()
        ids = self.of_chunks(numbered.dictionary).take(numbered.indices)
        if not len(ids):
            return [memoryview(b"")] * len(texts)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
        at = ends[rows.offsets.to_numpy() - rows.offsets[0].as_py()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def slices(texts: pa.StringArray, size: int = 24_000_000) -> Iterator[pa.StringArray]:
    """Texts in order, in arrays of at most `size` bytes or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def chunk_encoder(tokenizer_path: str, dtype: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer."""
    key = (tokenizer_path, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(tokenizer_path, dtype)
    return _ENCODERS[key]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, vocabulary: int = 65_536, shard_ids: int = 1 << 26, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes shards under `folder`, ids in ascending doc_id order; returns the committed entries, one per document.

    Ids take 2 bytes where the vocabulary allows it.  A file is closed after `shard_ids` ids.
    """
    dtype = "<u2" if vocabulary <= 65_536 else "<u4"
    size = int(dtype[-1])
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_encoder(tokenizer_path, dtype), np.array([end_id], dtype=dtype).tobytes()
        store, root = open_store(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        seq, held, file, name = -1, shard_ids, None, ""
        last, occurrence = object(), 0
        try:
            for batch in batches:
                rows = []
                encoded = (ids for part in slices(batch.column(1)) for ids in encoder(part))
                for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    if held >= shard_ids:
                        if file is not None:
                            file.close()
                        seq, held, name = seq + 1, 0, f"ids-{part:06d}-{seq + 1:04d}-{attempt}.bin"
                        file = store.open_output_stream(f"{root}/{name}")
                        file.write(MAGIC + struct.pack("<II", size, 0))
                    occurrence = occurrence + 1 if doc == last else 0
                    last = doc
                    file.write(ids)
                    file.write(end)
                    n = len(ids) // size + 1
                    rows.append((doc, occurrence, key_hash(doc, occurrence), part, seq, name, held, n))
                    held += n
                if rows:
                    yield batch_of(_ENTRY, list(zip(*rows, strict=True)))
        finally:
            if file is not None:
                file.close()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    dealt = rows.repartitionByRange(task_count(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return staged(map_arrow(dealt, run, ENTRY), "id-entries")[0]


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: bit arrays by level, then ranks of set bits."""

    sizes: list[int]
    bits: list[np.ndarray]
    ranks: list[np.ndarray]
    rest: np.ndarray

    GAMMA = 2.0
    LEVELS = 48

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64.  Keys that collide on every level go to a sorted rest."""
        sizes, bits, ranks, before, left = [], [], [], 0, keys
        while len(left) and len(sizes) < cls.LEVELS:
            size = max(64, int(cls.GAMMA * len(left)))
            slot = cls.slots(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            ranks.append(before + np.cumsum(alone) - alone)
            before += int(alone.sum())
            left = left[~alone[slot]]
        return cls(sizes, bits, ranks, np.sort(left))

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (splitmix(keys ^ splitmix(np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some keys that are not in the set; the fingerprint tells the others."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            slot = self.slots(keys[open_], level, size)
            hit = self.bits[level][slot]
            out[open_[hit]] = self.ranks[level][slot[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            before = sum(int(b.sum()) for b in self.bits)
            out[open_[found]] = before + at[found]
        return out

    def to_bytes(self) -> bytes:
        """Ranks are left out; they follow from the bits."""
        head = struct.pack("<II", len(self.sizes), len(self.rest)) + np.array(self.sizes, dtype="<u8").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.bits) + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        levels, n_rest = struct.unpack_from("<II", raw)
        at = 8 + 8 * levels
        sizes = np.frombuffer(raw, "<u8", levels, 8).astype(int).tolist()
        bits, ranks, before = [], [], 0
        for size in sizes:
            n = (size + 7) // 8
            alone = np.unpackbits(np.frombuffer(raw, np.uint8, n, at), count=size).astype(bool)
            bits.append(alone)
            ranks.append(before + np.cumsum(alone) - alone)
            before += int(alone.sum())
            at += n
        return cls(sizes, bits, ranks, np.frombuffer(raw, "<u8", n_rest, at)), at + 8 * n_rest


_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of another hash of the key than those that place it."""
    return (splitmix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class IdStore:
    """Committed shards and index: `shards` has shard, path, base (ids before it), n_tokens; `index` has bucket, path."""

    folder: str
    shards: DataFrame
    index: DataFrame
    buckets: int


def build_index(entries: DataFrame, folder: str, bucket_keys: int = 1 << 19) -> IdStore:
    """Numbers the shards in id order and writes one index file per bucket of about `bucket_keys` keys."""
    # One row a shard file, so the window's single task holds file names, not documents.
    by_file = entries.groupBy("part", "seq", "path").agg(F.sum("n_tokens").alias("n_tokens"))
    order = Window.orderBy("part", "seq")
    shards = by_file.select((F.row_number().over(order) - 1).cast("long").alias("shard"), "path", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "n_tokens")
    shards, _ = staged(shards, "id-shards")
    n_keys = entries.count()
    buckets = max(1, -(-n_keys // bucket_keys))
    keyed = entries.join(shards.select("shard", "path"), "path").select(F.pmod("key_hash", F.lit(buckets)).cast("int").alias("bucket"), "key_hash", "shard", "offset", "n_tokens")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key_hash"].to_numpy().view(np.uint64)
        perfect = PerfectHash.build(keys)
        slots = np.zeros(len(keys), dtype=_SLOT)
        at = perfect(keys)
        for name, values in (("fingerprint", fingerprint(keys)), ("shard", pdf["shard"]), ("offset", pdf["offset"]), ("n_tokens", pdf["n_tokens"])):
            slots[name][at] = values
        bucket = int(pdf["bucket"].iloc[0])
        store, root = open_store(folder)
        name = f"index-{bucket:06d}-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{root}/{name}") as file:
            file.write(perfect.to_bytes() + slots.tobytes())
        return pd.DataFrame({"bucket": [bucket], "path": [name], "n_keys": [len(keys)]})

    index, _ = staged(keyed.groupBy("bucket").applyInPandas(build, "bucket int, path string, n_keys long"), "id-index")
    return IdStore(folder, shards, index, buckets)


def lookup(ids: IdStore, keys: DataFrame, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Per row of `keys` (doc_id, occurrence) that the index holds: doc_id, occurrence, start long, n_tokens long, and ids array<int>, or with `digest` its value as long.

    A key that was never written is found with probability 2**-32, by its fingerprint.
    """
    folder, buckets = ids.folder, ids.buckets
    found_schema = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])

    hashed_schema = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("key_hash", pa.int64()), ("bucket", pa.int32())])

    def hash_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [key_hash(d, o) for d, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch_of(hashed_schema, [batch.column(0), batch.column(1), hashes, [h % buckets for h in hashes]])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        held, perfect, slots = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if paths[a] != held:
                    held = paths[a]
                    with store.open_input_file(f"{root}/{held}") as file:
                        raw = file.read()
                    perfect, at = PerfectHash.from_bytes(raw)
                    slots = np.frombuffer(raw, _SLOT, offset=at)
                keys = batch.column(2).slice(a, b - a).to_numpy().view(np.uint64)
                slot = perfect(keys)
                hit = np.flatnonzero((slot >= 0) & (slots["fingerprint"][np.maximum(slot, 0)] == fingerprint(keys)))
                row = slots[slot[hit]]
                take = pa.array(a + hit)
                yield batch_of(found_schema, [batch.column(0).take(take), batch.column(1).take(take), row["shard"].astype(np.int64), row["offset"].astype(np.int64), row["n_tokens"].astype(np.int64)])

    value = ("ids_digest", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
    read_schema = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), value])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        held, file, size = None, None, 0
        for batch in batches:
            values = []
            for path, offset, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if path != held:
                    if file is not None:
                        file.close()
                    held, file = path, store.open_input_file(f"{root}/{path}")
                    head = file.read(HEAD)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{path} is no shard of ids")
                    size = struct.unpack_from("<I", head, 8)[0]
                file.seek(HEAD + offset * size)
                found = np.frombuffer(file.read(n * size), f"<u{size}")
                values.append(digest(found) if digest else found.astype(np.int32))
            start = np.asarray(batch.column(5)) + np.asarray(batch.column(3))
            yield batch_of(read_schema, [batch.column(0), batch.column(1), start, batch.column(4), values])
        if file is not None:
            file.close()

    hashed = map_arrow(keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("long")), hash_keys, "doc_id long, occurrence long, key_hash long, bucket int")
    routed = hashed.join(ids.index.select("bucket", "path"), "bucket").select("doc_id", "occurrence", "key_hash", "path")
    slots = map_arrow(routed.repartition(task_count(keys.sparkSession), "path").sortWithinPartitions("path"), probe, "doc_id long, occurrence long, shard long, offset long, n_tokens long")
    placed = slots.join(ids.shards.select("shard", "path", "base"), "shard").select("doc_id", "occurrence", "path", "offset", "n_tokens", "base")
    placed = placed.repartition(task_count(keys.sparkSession), "path").sortWithinPartitions("path", "offset")
    return map_arrow(placed, read, "doc_id long, occurrence long, start long, n_tokens long, " + ("ids_digest long" if digest else "ids array<int>"))


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_and_index(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **parameters) -> tuple[IdStore, DataFrame]:
    """The store and its entries.  Without `folder`, one in the shared work folder that goes when the interpreter ends."""
    folder = folder or new_folder(docs.sparkSession, "ids")
    entries = write_ids(docs, tokenizer_path, end_id, folder, **parameters)
    return build_index(entries, folder), entries
