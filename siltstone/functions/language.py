"""Language identification (O-26): the rule by ASCII share and English stop words, and a hook for models (O-65)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import bound, ratio, strip

#: Fixed value: code points of a text that a language model reads.
MODEL_CHARACTERS = 5_000

#: The English words that the rule counts, each once.
STOP_WORDS = ("the", "and", "is", "of", "to", "in", "that", "with", "for", "as", "this", "are", "from", "at", "by", "an", "be", "have", "not", "or", "it", "you", "which", "on", "we", "can", "if", "code", "file", "data")


def ascii_ratio(text: Column) -> Column:
    """As many bytes as code points means ASCII only, and needs no scan by pattern."""
    mixed = ratio(F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", "")), F.length(text))
    return F.when((F.length(text) > 0) & (F.octet_length(text) == F.length(text)), F.lit(1.0)).otherwise(mixed)


def stop_words(text: Column) -> Column:
    """Distinct stop words among whole words of the first 2,000 code points; words end at other word characters only."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, 2000)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in STOP_WORDS))))


def language(text: Column) -> Column:
    """struct<lang, confidence>."""
    answer = lambda lang, p: F.struct(F.lit(lang).alias("lang"), F.lit(p).alias("confidence"))

    def judged(signs: Column) -> Column:
        share, found = signs["share"], signs["found"]
        return (
            F.when(share < 0.60, answer("unknown", 0.1))
            .when((share > 0.90) & (found >= 3), answer("en", 0.95))
            .when((share > 0.85) & (found >= 1), answer("en", 0.88))
            .when(share > 0.75, answer("en", 0.75))
            .otherwise(answer("unknown", 0.4))
        )

    signs = F.struct(ascii_ratio(text).alias("share"), stop_words(text).alias("found"))
    return F.when(F.coalesce(F.length(strip(text)), F.lit(0)) < 20, answer("unknown", 0.0)).otherwise(bound(signs, judged))


def model_language(detect: Callable[[str], tuple[str, float]]) -> Callable[[Column], Column]:
    """A detector function as a column function, by Arrow batches.  Filter by cheap rules first: it runs on every row it gets.

    A model takes one line: it gets the text's first MODEL_CHARACTERS code points with line ends as spaces, which is cut
    before Python sees it.  Texts under 20 code points without white space at the ends are unknown and do not reach it.
    """

    @F.pandas_udf("lang string, confidence double")
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect(x) if isinstance(x, str) else ("unknown", 0.0) for x in lines], columns=["lang", "confidence"])

    line = lambda text: F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, MODEL_CHARACTERS)
    return lambda text: run(F.when(F.length(strip(text)) >= 20, line(text)))


def is_english(detected: Column, least: float) -> Column:
    return (detected["lang"] == "en") & (detected["confidence"] >= least)


def is_foreign(detected: Column, least: float) -> Column:
    """Not English; the detector's answer is read twice and made once."""
    return bound(detected, lambda d: ~is_english(d, least))
