"""Line dedup by range-partitioned line hashes (operator 7).

Each line of at least `least_chars` code points, stripped of ASCII white space and with A-Z lowered, gives a row
(128-bit hash, document, position).  Rows are range-partitioned by (hash, document) and sorted by hash, document
descending, position: the first document of a run is the largest, which keeps its lines.  A task streams its rows
with a constant state.  Because documents are part of the range key, a line that a third of all documents share is
dealt over many tasks; the runs at the borders of a task are settled afterwards by a summary of two rows a task.

The result has one row per input row with a compressed bitmap of the lines to keep, and no text.

Defined cases: null or empty text is one empty line.  Rows that share a doc_id are one document when documents are
counted, and null is one document, smaller than all others; yet each row keeps its own bitmap, told apart by
`row_hash`, a hash of its text.  Rows alike in both are alike in result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, cut, map_arrow, nested, task_count, whole_text

STRIPPED = b" \t\n\x0b\x0c\r"
LINE_ROW = "h1 long, h2 long, doc_id long, row_hash long, pos int"
_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())])
#: kind 0: line to drop; 1: line of a run that may go on in another task; 2: summary of such a run.
_FOUND = pa.schema([*_LINE, ("kind", pa.int32()), ("docs", pa.int64())])


def line_key(line: bytes) -> bytes:
    """bytes.lower() touches A-Z only, so UTF-8 stays whole."""
    return line.strip(STRIPPED).lower()


def long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars)


def line_rows(rows: DataFrame, least_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row, pos = [], [], []
            for i, text in enumerate(batch.column(2)):
                for k, line in enumerate(text.as_py().encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, least_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        pos.append(k)
            pairs = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            take = pa.array(row, pa.int64())
            yield batch_of(_LINE, [pairs[:, 0], pairs[:, 1], batch.column(0).take(take), batch.column(1).take(take), pos])

    return map_arrow(rows, run, LINE_ROW)


def _stream(least_docs: int):
    """Settles sorted rows of one task.  State: the open run's hash, its documents so far, and at most least_docs - 1 documents' undecided rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_run, run_key, docs, last_doc, largest, waiting = True, None, 0, None, None, []
        out: list[tuple] = []

        def close() -> None:
            # A first or last run may go on in a neighbouring task.
            out.append((*run_key, largest, 0, 0, 2, docs))

        for batch in batches:
            for h1, h2, doc, row_hash, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != run_key:
                    if run_key is not None and first_run:
                        close()
                        first_run = False
                    run_key, docs, last_doc, largest, waiting = (h1, h2), 1, doc, doc, []
                elif doc != last_doc:
                    docs, last_doc = docs + 1, doc
                row = (h1, h2, doc, row_hash, pos)
                if first_run:
                    out.append((*row, 1, 0))
                elif docs < least_docs:
                    waiting.append(row)
                else:
                    # Rows of the largest document stay.
                    out.extend((*x, 0, 0) for x in waiting if x[2] != largest)
                    waiting = [x for x in waiting if x[2] == largest]
                    if doc != largest:
                        out.append((*row, 0, 0))
                if len(out) >= 50_000:
                    yield batch_of(_FOUND, list(zip(*out, strict=True)))
                    out.clear()
        if run_key is not None:
            out.extend((*x, 1, 0) for x in waiting)
            close()
        if out:
            yield batch_of(_FOUND, list(zip(*out, strict=True)))

    return run


def dropped_lines(rows: DataFrame, least_chars: int, least_docs: int, tasks: int) -> DataFrame:
    """doc_id, row_hash, pos of each line to drop."""
    lines = line_rows(rows, least_chars)
    dealt = lines.repartitionByRange(tasks, "h1", "h2", F.col("doc_id").desc_nulls_last()).sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "row_hash", "pos")
    found = cut(map_arrow(dealt, _stream(least_docs), LINE_ROW + ", kind int, docs long"))
    # Two rows a task at most: their number follows the tasks, not the data, so they may be broadcast.
    runs = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc_id").alias("largest")).where(F.col("all_docs") >= least_docs)
    open_rows = found.where("kind = 1").join(F.broadcast(runs), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    return found.where("kind = 0").select("doc_id", "row_hash", "pos").unionByName(open_rows.select("doc_id", "row_hash", "pos"))


def pack_keep(n_lines: int, dropped) -> bytes:
    """zlib-compressed bits, one a line, first line first; 1 means keep."""
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[np.asarray(dropped, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_keep(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row_hash, text: the rows that bitmaps are joined to."""
    text = whole_text(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, row_hash, n_lines long, n_dropped long, keep binary (see pack_keep)."""
    rows = identified(docs, id_column, text_column)
    drops = dropped_lines(rows, least_chars, least_docs, task_count(docs.sparkSession))
    # A document's own lines bound the list.
    drops = drops.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("dropped"))
    drops = drops.withColumnsRenamed({"doc_id": "drop_id", "row_hash": "drop_hash"})
    n_lines = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    heads = rows.select("doc_id", "row_hash", n_lines.alias("n_lines")).distinct()
    joined = heads.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("row_hash") == F.col("drop_hash")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped = batch.column(2).to_pylist(), [x or [] for x in batch.column(3).to_pylist()]
            yield batch_of(schema, [batch.column(0), batch.column(1), batch.column(2), [len(x) for x in dropped], [pack_keep(a, b) for a, b in zip(n, dropped, strict=True)]])

    return map_arrow(joined.select("doc_id", "row_hash", "n_lines", "dropped"), run, "doc_id long, row_hash long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str, n_lines: int, keep: bytes) -> str:
    return "\n".join(x for x, k in zip(text.split("\n"), unpack_keep(n_lines, keep), strict=True) if k)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row (a struct of all columns of `docs`, whatever their names), n_lines, n_dropped, keep: one row per row of `docs`."""
    rows = docs.select(nested(docs), F.col(id_column).cast("long").alias("row_id"), F.xxhash64(whole_text(text_column)).alias("text_hash"))
    keys = bitmaps.select(F.col("doc_id").alias("key_id"), F.col("row_hash").alias("key_hash"), "n_lines", "n_dropped", "keep")
    return rows.join(keys, F.col("row_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash"))).select("row", "n_lines", "n_dropped", "keep")


def lines_dropped(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """`docs` with the kept lines as text and, if it has that column, their code points as size; null text stays null."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs, id_column, text_column), id_column, text_column)
    names, at, schema = docs.columns, docs.columns.index(text_column), docs.schema
    size_at = names.index(size_column) if size_column in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at].to_pylist()
            for k in np.flatnonzero(np.asarray(batch.column(2)) > 0):
                texts[k] = kept_text(texts[k], batch.column(1)[k].as_py(), batch.column(3)[k].as_py())
            columns[at] = pa.array(texts, columns[at].type)
            if size_at is not None:
                columns[size_at] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)
