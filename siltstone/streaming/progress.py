"""Progress of a streaming build (O-63): tokens, rate and time left of every micro-batch, as a table of JSON rows."""

from __future__ import annotations

import json

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "siltstone_tokens"
COLUMNS = "run string, batch long, at string, tokens long, total_tokens long, seconds double, tokens_per_second double, seconds_left double, share double"


def counted(rows: DataFrame, tokens: Column) -> DataFrame:
    """The rows, with their tokens summed up on the way."""
    return rows.observe(OBSERVED, F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))


class Progress(StreamingQueryListener):
    """Writes a row a micro-batch of every query that `counted` takes part in.

    The rate is that of all batches so far; time left and share follow from `target_tokens`, null without one.  A row is
    named by run and batch, so a repeated event replaces its row.
    """

    def __init__(self, path: str, target_tokens: int | None = None):
        self.path, self.target = path, target_tokens
        self.sums: dict[str, tuple[int, float]] = {}

    def onQueryStarted(self, event) -> None:
        return

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.sums.pop(str(event.runId), None)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = progress.observedMetrics.get(OBSERVED)
        if observed is None:
            return
        run, tokens, seconds = str(progress.runId), int(observed["tokens"] or 0), progress.batchDuration / 1000
        total, spent = self.sums.get(run, (0, 0.0))
        total, spent = total + tokens, spent + seconds
        self.sums[run] = (total, spent)
        rate = total / spent if spent else 0.0
        left = max(self.target - total, 0) / rate if self.target is not None and rate else None
        row = {"run": run, "batch": progress.batchId, "at": progress.timestamp, "tokens": tokens, "total_tokens": total, "seconds": seconds, "tokens_per_second": rate, "seconds_left": left, "share": total / self.target if self.target else None}
        store, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{run}-{progress.batchId:012d}.json") as file:
            file.write(json.dumps(row).encode())


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).json(path)
