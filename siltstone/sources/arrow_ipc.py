"""Arrow IPC shards as a Spark data source, read, written and streamed into (O-07, O-13)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: The list of a folder's committed files; a folder that others wrote has none.
COMMITTED = "_committed.json"


#: A stream's lists, one a micro-batch; they are the rows of its manifest too.
BATCHES = "manifest"


def read_json(store: pyarrow.fs.FileSystem, path: str) -> dict:
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


def write_json(store: pyarrow.fs.FileSystem, path: str, content: dict) -> None:
    """By a rename, so that no one reads half of it."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/_draft-{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(draft) as file:
        file.write(json.dumps(content, sort_keys=True).encode())
    store.move(draft, path)


def batch_lists(path: str) -> list[str]:
    """Paths of a stream's lists, in the order of batches."""
    store, root = located(path)
    found = store.get_file_info(pyarrow.fs.FileSelector(f"{root}/{BATCHES}", allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.startswith("batch-"))


def committed(path: str) -> list[str] | None:
    """Names of the committed files, null where the folder has no list."""
    store, root = located(path)
    lists = [f"{root}/{COMMITTED}"] if store.get_file_info(f"{root}/{COMMITTED}").type == pyarrow.fs.FileType.File else []
    lists += batch_lists(path)
    return [name for x in lists for name in read_json(store, x)["files"]] if lists else None


def arrow_files(path: str) -> list[str]:
    """The committed files of a folder; without a list, its .arrow files at any depth, sorted, without hidden ones."""
    store, root = located(path)
    names = committed(path)
    if names is not None:
        return [f"{root}/{name}" for name in sorted(names)]
    found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".arrow") and not any(part[:1] in "._" for part in f.path[len(root) :].split("/") if part))


#: Name of the column that option row_no adds: a row's place in the table, over files in the order of their names.
ROW = "row_no"


def batch_rows(path: str) -> dict[str, list[int]]:
    """Rows of every record batch by file, from the committed lists; batches of files that other writers left are read for it."""
    store, root = located(path)
    lists = [x for x in [f"{root}/{COMMITTED}"] if store.get_file_info(x).type == pyarrow.fs.FileType.File] + batch_lists(path)
    known = {}
    for held in (read_json(store, x) for x in lists):
        known |= {f"{root}/{name}": rows for name, rows in zip(held["files"], held.get("rows", []), strict=False)}
    found = {}
    for file in arrow_files(path):
        if file in known:
            found[file] = known[file]
            continue
        with store.open_input_file(file) as source, pa.ipc.open_file(source) as reader:
            found[file] = [reader.get_batch(k).num_rows for k in range(reader.num_record_batches)]
    return found


class ArrowBatches(InputPartition):
    """Record batches `first` to `last` of a file; `start` is the place of the first one's first row."""

    def __init__(self, file: str, first: int, last: int, start: int):
        self.file, self.first, self.last, self.start = file, first, last, start


class ArrowReader(DataSourceReader):
    """Reads the columns of the schema only; comparisons of row_no with numbers decide which record batches are opened.

    Without row_no a task reads a file; with it, a task reads a record batch.
    """

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns
        self.low, self.high, self.rows = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != (ROW,) or not isinstance(value, int | tuple | list):
                yield f
            elif isinstance(f, EqualTo):
                self._only([value])
            elif isinstance(f, In):
                self._only(value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                high = value + isinstance(f, LessThanOrEqual)
                self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def _only(self, rows) -> None:
        rows = {r for r in rows if r is not None}
        self.rows = rows if self.rows is None else self.rows & rows

    def _wanted(self, start: int, end: int) -> bool:
        if end <= self.low or (self.high is not None and start >= self.high):
            return False
        return self.rows is None or any(start <= r < end for r in self.rows)

    def partitions(self) -> list[InputPartition]:
        if ROW not in self.columns:
            return [ArrowBatches(file, 0, -1, 0) for file in arrow_files(self.path)]
        found, start = [], 0
        for file, rows in batch_rows(self.path).items():
            for k, n in enumerate(rows):
                if n and self._wanted(start, start + n):
                    found.append(ArrowBatches(file, k, k, start))
                start += n
        return found

    def read(self, partition: ArrowBatches | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            # What Spark reads where nothing is left to read.
            return
        store, _ = located(self.path)
        own = [c for c in self.columns if c != ROW]
        with store.open_input_file(partition.file) as file:
            names = pa.ipc.open_file(file).schema.names
            # Buffers of other columns are not read.
            options = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in own])
            with pa.ipc.open_file(file, options=options) as reader:
                start = partition.start
                for k in range(partition.first, (partition.last if partition.last >= 0 else reader.num_record_batches - 1) + 1):
                    batch = reader.get_batch(k)
                    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in own}
                    place = pa.array(np.arange(start, start + batch.num_rows, dtype=np.int64))
                    start += batch.num_rows
                    batch = pa.RecordBatch.from_arrays([place if c == ROW else columns[c] for c in self.columns], names=self.columns)
                    yield batch.filter(pa.array(self._mask(place))) if ROW in self.columns else batch

    def _mask(self, place: pa.Array) -> np.ndarray:
        row = place.to_numpy()
        keep = row >= self.low
        if self.high is not None:
            keep &= row < self.high
        return keep if self.rows is None else keep & np.isin(row, list(self.rows))


class Written(WriterCommitMessage):
    def __init__(self, rows: dict[str, list[int]]):
        self.files, self.rows = list(rows), rows


class ArrowWriter(DataSourceArrowWriter):
    """One file per task and shard, names with an id of the attempt.

    The driver's commit writes the list of the successful attempts' files, by a rename; only listed files are ever read.
    Overwriting replaces the list, then removes the files of the old one; appending adds to it.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        attempt, rows, held, sink, writer = uuid.uuid4().hex, {}, None, None, None
        for batch in batches:
            at = batch.schema.get_field_index("shard_index")
            shards = batch.column(at).to_pylist() if at >= 0 else [0] * batch.num_rows
            start = 0
            for k in range(1, batch.num_rows + 1):
                if k < batch.num_rows and shards[k] == shards[start]:
                    continue
                if shards[start] != held:
                    if writer is not None:
                        writer.close()
                        sink.close()
                    held = shards[start]
                    name = f"shard_{held:05d}-{attempt}.arrow"
                    rows[name] = []
                    sink = store.open_output_stream(f"{root}/{name}")
                    writer = pa.ipc.new_file(sink, batch.schema)
                writer.write_batch(batch.slice(start, k - start))
                rows[name].append(k - start)
                start = k
        if writer is not None:
            writer.close()
            sink.close()
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        fresh, old = [file for message in messages if message is not None for file in message.files], committed(self.path) or []
        names = fresh if self.overwrite else [*old, *fresh]
        rows = {} if self.overwrite or not old else {file.rpartition("/")[2]: n for file, n in batch_rows(self.path).items()}
        rows |= {name: n for message in messages if message is not None for name, n in message.rows.items()}
        write_json(store, f"{root}/{COMMITTED}", {"files": sorted(names), "rows": [rows[name] for name in sorted(names)]})
        for name in set(old).difference(names):
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        for message in messages:
            for file in message.files if message is not None else []:
                store.delete_file(f"{root}/{file}")


class Streamed(WriterCommitMessage):
    def __init__(self, rows: dict[str, list[int]], real_tokens: int):
        self.files, self.rows, self.real_tokens = list(rows), rows, real_tokens


class ArrowStreamWriter(DataSourceStreamArrowWriter):
    """A file a task and micro-batch, and one list a batch with its files and sums, under the batch's number.

    A batch that is repeated after a failure writes its list again, which replaces the earlier one and its files, so every
    row is read once.  What a killed task leaves is in no list.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Streamed:
        store, root = located(self.path)
        name, sink, writer, rows, real = f"stream-{uuid.uuid4().hex}.arrow", None, None, [], 0
        for batch in batches:
            if writer is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows.append(batch.num_rows)
            at = batch.schema.get_field_index("attention_mask")
            real += int(np.asarray(batch.column(at).flatten()).sum()) if at >= 0 else 0
        if writer is None:
            return Streamed({}, 0)
        writer.close()
        sink.close()
        return Streamed({name: rows}, real)

    def commit(self, messages: list[Streamed | None], batchId: int) -> None:
        store, root = located(self.path)
        store.create_dir(f"{root}/{BATCHES}", recursive=True)
        place, done = f"{root}/{BATCHES}/batch-{batchId:012d}.json", [m for m in messages if m is not None]
        old = read_json(store, place)["files"] if store.get_file_info(place).type == pyarrow.fs.FileType.File else []
        rows = {name: n for m in done for name, n in m.rows.items()}
        write_json(store, place, {"batch": batchId, "files": sorted(rows), "rows": [rows[name] for name in sorted(rows)], "num_sequences": sum(map(sum, rows.values())), "total_tokens_real": sum(m.real_tokens for m in done)})
        for name in old:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Streamed | None], batchId: int) -> None:
        store, root = located(self.path)
        for message in messages:
            for name in message.files if message is not None else []:
                store.delete_file(f"{root}/{name}")


class ArrowShards(DataSource):
    """spark.read.format("arrow_shards").option("path", folder).load()

    Option columns names those to read, with commas between; option row_no adds their place in the table.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self) -> StructType:
        files = arrow_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .arrow file under {self.options['path']}")
        store, _ = located(self.options["path"])
        with store.open_input_file(files[0]) as file, pa.ipc.open_file(file) as reader:
            found = from_arrow_schema(reader.schema)
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if wanted:
            found = StructType([found[c] for c in wanted])
        return found.add(ROW, "long", False) if self.options.get(ROW, "false").lower() == "true" else found

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> ArrowStreamWriter:
        return ArrowStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which then hands filters down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowShards)
