"""The figures of a build, counted while it runs (O-16, O-40, O-46, O-56): no table is read once more for a statistic.

`observe` puts aggregates beside the rows on their way, and the figures are there when the step's own action has ended.
A shuffle task that is run again after it had ended, when an executor is lost, counts twice; aggregates of the written
tables are exact.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import filters, shards


class BuildReport:
    """Give every step's rows to one of the methods, run the build, then read `figures`."""

    def __init__(self) -> None:
        self.parts: dict[str, Observation] = {}

    def _observed(self, rows: DataFrame, part: str, **figures: Column) -> DataFrame:
        if part in self.parts:
            raise ValueError(f"{part} is counted already")
        self.parts[part] = Observation()
        return rows.observe(self.parts[part], *(F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in figures.items()))

    def filtered(self, rows: DataFrame, reason: str = "reason") -> DataFrame:
        """Rows with a reason column, null where they pass: counts by outcome."""
        seen = F.col(reason)
        known = sorted({r for names in filters.REASON_NAMES.values() for r in names} | {"unknown_source"})
        counts = {f"reason_{r}": F.count_if(seen == r) for r in known}
        return self._observed(rows, "filter", total_seen=F.count("*"), total_passed=F.count_if(seen.isNull()), reason_other=F.count_if(seen.isNotNull() & ~seen.isin(*known)), **counts)

    def unique(self, rows: DataFrame) -> DataFrame:
        """First rows of each content."""
        return self._observed(rows, "dedup", unique=F.count("*"))

    def packed(self, rows: DataFrame) -> DataFrame:
        """Packed records with their attention mask and document starts."""
        real = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
        return self._observed(rows, "packing", total_sequences=F.count("*"), total_docs_packed=F.sum(F.size("doc_starts")), total_tokens_packed=F.sum(real), total_tokens_padded=F.sum(F.size("attention_mask")))

    def figures(self) -> dict[str, dict[str, float]]:
        """All figures by step; waits for steps that have not run.  Reasons that no row has are left out."""
        found = {part: {k: v for k, v in o.get.items() if v or not k.startswith("reason_")} for part, o in self.parts.items()}
        if "filter" in found:
            f = found["filter"]
            f["pass_rate"] = f["total_passed"] / f["total_seen"] if f["total_seen"] else 0.0
            if "dedup" in found:
                d = found["dedup"]
                d |= {"total_seen": f["total_passed"], "duplicates_found": f["total_passed"] - d["unique"]}
                d["dedup_rate"] = d["duplicates_found"] / d["total_seen"] if d["total_seen"] else 0.0
        if "packing" in found:
            p = found["packing"]
            padded, n = p.pop("total_tokens_padded"), p["total_sequences"]
            p["total_padding_tokens"] = padded - p["total_tokens_packed"]
            p |= {"padding_ratio": p["total_padding_tokens"] / padded if padded else 0.0, "avg_docs_per_seq": p["total_docs_packed"] / n if n else 0.0}
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """step, name, value: a row a figure."""
        rows = [(step, name, float(value)) for step, part in self.figures().items() for name, value in part.items()]
        return spark.createDataFrame(rows, "step string, name string, value double")

    def append(self, spark: SparkSession, path: str, created_at: str) -> None:
        """Adds the report as a JSON line to a log folder."""
        shards.append_log(spark, {"created_at": created_at, **self.figures()}, path)


def read_log(spark: SparkSession, path: str) -> list[dict]:
    """The reports of a log folder; one a build, so few."""
    return [json.loads(r.value) for r in spark.read.text(path).collect()]
