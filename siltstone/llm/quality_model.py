"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network (operator 3).

Word vectors: each word bucket has a fixed sparse index vector of +1 and -1; a word's vector is the sum of the index
vectors of its neighbours within two places, over all documents.  Words are hashed into `buckets` buckets, so the table
has buckets x dims numbers whatever the corpus holds: that is the proven bound under which it goes to the driver and
back to the tasks.  Sums are whole numbers, so the table does not depend on the partitioning.

Pooling: mean of unit vectors, the mean with smoothed inverse frequency as weight, both over all words of the whole
text; beside them the logarithm of the number of words, the share of distinct words and the shares of words that
come again one to four places on.  Network: dims -> hidden (tanh) -> 1 in numpy with Adam, from a fixed
seed, on at most `max_train_rows` labelled rows, those with the smallest hash of doc_id; a temperature fitted on a
fold left out of the training divides the logit.

Defined cases: null text is the empty text, scored from a zero vector; rows with a null label or doc_id teach nothing;
with no label, or labels of one class, every score is the labels' mean (0.5 without any).  A null doc_id is scored and
is not held out.  Repeated rows get equal scores.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, map_arrow, whole_text

TOKEN = re.compile(r"\w+|[^\w\s]+")
SMOOTHING = 1e-3
#: Distances at which a word is compared with a later one, for the features of repetition.
LAGS = 4


@dataclass(frozen=True)
class Space:
    """Shape of the word-vector table."""

    buckets: int = 1 << 15
    dims: int = 32
    nonzero: int = 2
    window: int = 2
    seed: int = 11

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of the nonzero entries, buckets x nonzero."""
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, self.dims, (self.buckets, self.nonzero)), rng.choice([-1.0, 1.0], (self.buckets, self.nonzero))


class Buckets(dict):
    """Word -> bucket, remembered for up to `entries` words."""

    def __init__(self, n: int, entries: int = 500_000):
        super().__init__()
        self.n, self.entries = n, entries

    def __missing__(self, word: str) -> int:
        if len(self) >= self.entries:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.n
        return bucket

    def of(self, text: str) -> list[int]:
        return list(map(self.__getitem__, TOKEN.findall(text)))


def word_table(docs: DataFrame, space: Space, text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors (buckets x dims, float32) and word counts, from all documents."""
    columns = [f"v{k}" for k in range(space.dims)]
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *((c, pa.int64()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = space.index_vectors()
        buckets = Buckets(space.buckets)
        total, count = np.zeros(space.buckets * space.dims), np.zeros(space.buckets, dtype=np.int64)
        held: list[int] = []

        def take(ids: np.ndarray) -> None:
            nonlocal total, count
            count += np.bincount(ids[ids >= 0], minlength=space.buckets)
            for offset in range(1, space.window + 1):
                first, second = ids[:-offset], ids[offset:]
                both = (first >= 0) & (second >= 0)
                for word, context in ((first[both], second[both]), (second[both], first[both])):
                    for k in range(space.nonzero):
                        total += np.bincount(word * space.dims + places[context, k], signs[context, k], len(total))

        # Documents are kept apart by as many blanks as the window is wide.
        blanks = [-1] * space.window
        for batch in batches:
            for text in batch.column(0):
                held += buckets.of(text.as_py())
                held += blanks
                if len(held) >= 400_000:
                    take(np.array(held, dtype=np.int64))
                    held.clear()
        if held:
            take(np.array(held, dtype=np.int64))
        used = np.flatnonzero(count)
        table = total.reshape(space.buckets, space.dims)[used].astype(np.int64)
        for a in range(0, len(used), 4096):
            yield batch_of(schema, [used[a : a + 4096].astype(np.int32), count[used[a : a + 4096]], *table[a : a + 4096].T.copy()])

    parts = map_arrow(docs.select(whole_text(text_column).alias("text")), run, "bucket int, n long, " + ", ".join(f"{c} long" for c in columns))
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toPandas()
    table, count = np.zeros((space.buckets, space.dims)), np.zeros(space.buckets)
    table[rows["bucket"]] = rows[columns]
    count[rows["bucket"]] = rows["n"]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norm, 1e-9)).astype(np.float32), count


class Pooler:
    """Documents' feature rows from the word table."""

    def __init__(self, table: np.ndarray, count: np.ndarray):
        share = count / max(count.sum(), 1)
        self.table, self.weight = table, (SMOOTHING / (SMOOTHING + share)).astype(np.float32)
        self.buckets = Buckets(len(table))
        self.width = 2 * table.shape[1] + 2 + LAGS

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float64)
        dims = self.table.shape[1]
        for i, text in enumerate(texts):
            ids = np.array(self.buckets.of(text), dtype=np.int64)
            if len(ids):
                n = np.bincount(ids)
                seen = np.flatnonzero(n)
                rows, n = self.table[seen].astype(np.float64), n[seen]
                weight = n * self.weight[seen]
                out[i, :dims] = n @ rows / len(ids)
                out[i, dims : 2 * dims] = weight @ rows / weight.sum()
                out[i, 2 * dims] = np.log1p(len(ids))
                out[i, 2 * dims + 1] = len(seen) / len(ids)
                for lag in range(1, min(LAGS, len(ids) - 1) + 1):
                    out[i, 2 * dims + 1 + lag] = (ids[lag:] == ids[:-lag]).mean()
        return out


@dataclass
class Network:
    """Two layers over standardised features; `constant` replaces them where there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, hidden: int = 32, steps: int = 1500, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the rows outside `calibration`, then the temperature that minimises log loss on it."""
    if len(y) == 0 or y.min() == y.max():
        return Network(*[np.zeros(1)] * 5, 0.0, constant=float(y.mean()) if len(y) else 0.5)
    if len(set(y[~calibration])) < 2 or len(set(y[calibration])) < 2:
        calibration = np.zeros(len(y), dtype=bool)
    tx, ty = x[~calibration], y[~calibration].astype(float)
    rng = np.random.default_rng(seed)
    net = Network(tx.mean(0), tx.std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (tx - net.mean) / net.scale
    held = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    for step in range(1, steps + 1):
        take = rng.integers(0, len(ty), min(batch, len(ty)))
        a, t = z[take], ty[take]
        h = np.tanh(a @ held[0] + held[1])
        g = (1 / (1 + np.exp(-np.clip(h @ held[2] + held[3], -60, 60))) - t) / len(t)
        gh = np.outer(g, held[2]) * (1 - h * h)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, grad in enumerate((a.T @ gh + decay * held[0], gh.sum(0), h.T @ g + decay * held[2], np.array([g.sum()]))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            held[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(held[3][0])
    if calibration.any():
        logit, t = net.logit(x[calibration]), y[calibration]
        grid = np.geomspace(0.25, 8, 81)
        loss = [np.logaddexp(0, np.where(t == 1, -logit, logit) / k).mean() for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(id_column: str | Column = "doc_id", folds: int = 5) -> Column:
    """The rows whose crc32 of the id as text is 0 modulo `folds`; their labels are never learned."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, space: Space = Space(), max_train_rows: int = 20_000, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> tuple[Pooler, Network]:
    """Word vectors from all documents; network from at most `max_train_rows` labelled rows outside the held-out fold."""
    pooler = Pooler(*word_table(docs, space, text_column))
    usable = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    chosen = usable.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_train_rows)
    # At most max_train_rows narrow rows, so they may be broadcast.
    rows = docs.select(F.col(id_column).alias("_id"), whole_text(text_column).alias("text")).join(F.broadcast(chosen), "_id")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [batch.column(0), batch.column(1), list(pooler(batch.column(2).to_pylist()))])

    found = map_arrow(rows.select(F.col("_id").cast("long").alias("doc_id"), "_label", "text"), run, "doc_id long, label int, x array<double>").toPandas()
    found = found.assign(key=[np.asarray(x).tobytes() for x in found["x"]]).sort_values(["doc_id", "label", "key"])
    x = np.array(found["x"].to_list(), dtype=float) if len(found) else np.zeros((0, pooler.width))
    folds = np.array([zlib.crc32(str(i).encode()) % 5 == 1 for i in found["doc_id"]], dtype=bool)
    return pooler, fit(x, found["label"].to_numpy(), folds)


def score(docs: DataFrame, pooler: Pooler, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score: the calibrated probability of label 1, one row per row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [batch.column(0), network(pooler(batch.column(1).to_pylist()))])

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")), run, "doc_id long, score double")


def keep_good(docs: DataFrame, pooler: Pooler, network: Network, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """`docs` without the rows whose score is under `threshold`; columns as before, the text judged in place."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_column)
        for batch in batches:
            keep = network(pooler([x or "" for x in batch.column(at).to_pylist()])) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
