"""A language model trained in Spark (O-26): naive Bayes over hashed character trigrams, with calibrated confidence.

Training is one pass over the labelled rows: a task adds up its trigrams by language and bucket, and the sums of all tasks,
at most `buckets` a language whatever the input, become weights on the driver.  Weights are whole thousandths of natural
logarithms, so scores are exact sums that do not depend on the order of rows.  A second pass over held-out rows chooses
the temperature that makes the confidence most likely right.  Whole texts are read.

Defined cases: rows without a text or a language teach nothing; a text of under 20 code points without the white space at
its ends is `unknown` with confidence 0; equal scores go to the first language by name; with no labelled rows every text
is `unknown`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multipliers of a trigram's three code points; their sum modulo the buckets is its bucket.
FACTORS = (7_919, 104_729, 1_299_709)
SCALE = 1_000
#: Temperatures from which calibration chooses.
TEMPERATURES = tuple(float(2**k) for k in range(-2, 11))
LEAST_CHARS = 20
UNKNOWN = ("unknown", 0.0)


def trigram_buckets(text: str, buckets: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    return (points[:-2] * FACTORS[0] + points[1:-1] * FACTORS[1] + points[2:] * FACTORS[2]) % buckets


@dataclass(frozen=True)
class LanguageModel:
    """languages by name; prior and weights (bucket x language) in thousandths of logarithms; temperature of the confidence."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def scores(self, text: str) -> np.ndarray:
        return self.prior + self.weights[trigram_buckets(text, len(self.weights))].sum(axis=0)

    def detect(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or len(text.strip()) < LEAST_CHARS:
            return UNKNOWN
        scores = self.scores(text)
        best = int(np.argmax(scores))
        return self.languages[best], float(1 / np.exp((scores - scores[best]) / (SCALE * self.temperature)).sum())

    def __call__(self, text: Column) -> Column:
        """struct<lang, confidence>, by Arrow batches: a detector for the filters.  It runs on every row it gets."""
        detect = self.detect

        @F.arrow_udf("lang string, confidence double")
        def run(texts: pa.Array) -> pa.Array:
            found = [detect(x) for x in texts.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "confidence"])

        return run(text)


def _trigram_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, n from (lang, text): a task's sums by language, dealt out when `held` languages are full."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    held = 256

    def given(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in tables and len(tables) >= held:
                    yield from given(tables)
                    tables = {}
                table = tables.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                np.add.at(table, trigram_buckets(text.as_py(), buckets), 1)
        yield from given(tables)

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, held_out: Column, lang_column: str = "lang", text_column: str = "text", buckets: int = 16_384, most_languages: int = 1_000) -> LanguageModel:
    """A model of the languages that the rows outside `held_out` name, calibrated on those inside.

    The driver and every worker hold `buckets` whole numbers a language, so more than `most_languages` are an error.
    """
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")).where("lang is not null and text is not null")
    learned = rows.where("not held_out")
    sizes = sorted(tuple(r) for r in learned.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect())
    if len(sizes) > most_languages:
        raise ValueError(f"a model has {most_languages} languages at most")
    languages = tuple(lang for lang, _ in sizes)
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((buckets, len(languages)), dtype=np.int64)
    for lang, bucket, n in _trigram_counts(learned.select("lang", "text"), buckets).toLocalIterator():
        counts[bucket, place[lang]] = n
    docs_each = np.array([n for _, n in sizes], dtype=np.float64)
    prior = np.rint(SCALE * np.log(docs_each / max(docs_each.sum(), 1))).astype(np.int64)
    weights = np.rint(SCALE * np.log((counts + 1) / (counts.sum(axis=0) + buckets))).astype(np.int64)
    model = LanguageModel(languages, prior, weights)
    return LanguageModel(languages, prior, weights, calibrated(rows.where("held_out").select("lang", "text"), model)) if languages else model


def calibrated(rows: DataFrame, model: LanguageModel) -> float:
    """The temperature under which the languages of the rows are most likely; the least of equals, 1 without rows.

    A row of a language that the model has not learned teaches nothing.
    """
    schema = "temperature double, loss double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, loss, n = {lang: k for k, lang in enumerate(model.languages)}, np.zeros(len(TEMPERATURES)), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang in place:
                    scores = model.scores(text.as_py()).astype(np.float64)
                    ahead = (scores - scores[place[lang]]) / SCALE
                    loss += [np.logaddexp.reduce(ahead / t) for t in TEMPERATURES]
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(TEMPERATURES), pa.array(loss), pa.array([n] * len(TEMPERATURES))], names=["temperature", "loss", "n"])

    found = rows.mapInArrow(run, schema).groupBy("temperature").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).where("n > 0")
    best = found.orderBy("loss", "temperature").first()
    return best.temperature if best else 1.0


def confusion(docs: DataFrame, detect: Callable[[Column], Column], lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """lang, lid, n: rows by their own language and the one detected."""
    rows = docs.select(F.col(lang_column).alias("lang"), detect(F.col(text_column))["lang"].alias("lid"))
    return rows.groupBy("lang", "lid").agg(F.count("*").alias("n"))
