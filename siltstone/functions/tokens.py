"""Tokenizers as column functions (O-31, O-66, O-67): bytes by default, any encoder by hook."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tokenizer:
    """encode: text -> ids without specials; eos and pad are appended by the engine.  A pad of None or 0 means eos."""

    encode: Callable[[str], list[int] | np.ndarray]
    eos: int
    pad: int | None = None

    @property
    def padding(self) -> int:
        return self.pad or self.eos

    def encode_col(self, text: Column, add_eos: bool = True) -> Column:
        """array<int>, null text as the empty text, by Arrow batches."""
        encode, tail = self.encode, np.array([self.eos] if add_eos else [], dtype=np.int32)

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            rows = [part for x in texts.to_pylist() for part in (np.asarray(encode(x or ""), dtype=np.int32), tail)]
            ends = np.cumsum([0, *(len(a) + len(b) for a, b in zip(rows[::2], rows[1::2], strict=True))], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)))

        return run(text)


def _utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32)


#: Fixed values of the byte tokenizer: ids 0 to 255, end 256, padding 257, FIM sentinels 258 to 260.
BYTES = Tokenizer(_utf8, eos=256, pad=257)


def byte_token_count(text: Column, add_eos: bool = True) -> Column:
    """Length of the byte encoding without making it."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + int(add_eos)).cast("long")
