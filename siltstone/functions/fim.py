"""Fill-in-the-middle rewriting of code (O-32), with hashes of (key, seed) for the random choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import lines

#: The sentinel tokens in the order they are written.
PREFIX, SUFFIX, MIDDLE = "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"


def draw(key: Column, salt: str) -> Column:
    """A number of 32 bits from (key, salt), the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("long")


def split_line(n: Column, key: Column, seed: int) -> Column:
    """Lines before the middle: 1 to n - 2."""
    return (1 + draw(key, f"{seed}:split") % F.greatest(n - 2, F.lit(1))).cast("int")


def middle_lines(n: Column, split: Column, key: Column, seed: int) -> Column:
    """Lines of the middle: 1 to the least of 5 and n - split - 1."""
    return (1 + draw(key, f"{seed}:middle") % F.greatest(F.least(F.lit(5), n - split - 1), F.lit(1))).cast("int")


def fim_parts(text: Column, key: Column, seed: int = 42) -> Column:
    """struct<prefix, middle, suffix>; null for texts of fewer than 3 lines."""
    rows = lines(text)
    n = F.size(rows)
    s = split_line(n, key, seed)
    m = middle_lines(n, s, key, seed)
    join = lambda first, count: F.array_join(F.slice(rows, first, count), "\n")
    return F.when(n >= 3, F.struct(join(F.lit(1), s).alias("prefix"), join(s + 1, m).alias("middle"), join(s + m + 1, F.greatest(n - s - m, F.lit(0))).alias("suffix")))


def fim_text(text: Column, key: Column, seed: int = 42) -> Column:
    """Prefix, suffix, middle, each after its sentinel; short texts unchanged."""
    p = fim_parts(text, key, seed)
    return F.when(p.isNull(), text).otherwise(F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"]))


def maybe_fim(text: Column, source: Column, key: Column, rate: float = 0.5, seed: int = 42, code_sources: tuple[str, ...] = ("code",), compat: bool = False) -> Column:
    """FIM for a share of the rows of code sources; `compat` leaves all rows as they are."""
    if compat:
        return text
    chosen = source.isin(*code_sources) & (draw(key, f"{seed}:fim") < int(rate * 2**32))
    return F.when(chosen, fim_text(text, key, seed)).otherwise(text)
