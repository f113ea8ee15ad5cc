"""Collocations against counting in plain Python; the query's SQL is compared in test_pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import phrases
from tests.llm import awkward

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, covered=50):
    """rows: (lang, text)."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    hidden = {(lang, w[i : i + 2]) for (lang, w), a in found.items() if len(w) == 3 for i in (0, 1) if 100 * a >= covered * found.get((lang, w[i : i + 2]), 10**9)}
    rated = []
    for (lang, w), a in found.items():
        if (lang, w) not in hidden:
            cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            rated.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rated):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def sentences(seed=1):
    rng, words = random.Random(seed), ["the", "Of", "new", "york", "ÉTÉ", "été", "x y", "a'b", "😀", "big", "apple", "pie"]
    rows = []
    for k in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r", "!", "?:"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", None, "de", ""]), text + rng.choice([" New York", "new  york city", ""])))
    return [*rows, (None, None), ("en", ""), ("en", " . "), ("fr", "eins zwei drei " * 40), ("fr", None)]


@pytest.mark.parametrize(("bits", "slice_bytes", "held", "top"), [(24, 4 << 20, 500_000, 2000), (16, 50, 3, 7)])
def test_equals_plain_counting(spark, bits, slice_bytes, held, top):
    """Few buckets, small slices and full dictionaries change nothing."""
    rows = sentences()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    settings = phrases.Settings(bits=bits, slice_bytes=slice_bytes, held=held, top=top)
    expected = brute(rows, 10, top)
    assert collected(phrases.collocations(docs, settings)) == expected
    assert {r[0] for r in expected} >= {"en", "und", "de", "fr"} and any(" " in r[2].replace(" ", "", 1) for r in expected)


def test_awkward_and_empty_rows(spark):
    docs = awkward.documents(spark)
    settings = phrases.Settings(least=3, top=500)
    assert collected(phrases.collocations(docs, settings)) == brute([(r[2], r[1]) for r in awkward.rows()], 3, 500)
    assert phrases.collocations(awkward.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        phrases.Settings(least=0)


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 999_999_999_999_937, 999_999_999_999_989, 999_999_999_999_961
    row = spark.createDataFrame([(a, left, right), (10, 11, 12)], "a long, l long, r long").select(phrases.cut_score("a", "l", "r").alias("s")).collect()
    assert [x.s for x in row] == [1_000_000 * a * a // (left * right), 1_000_000 * 100 // 132]


def test_words_and_slices():
    texts = pa.array([b"One two,three", b"", b"x", b"y  Z.\tz"], type=pa.large_binary())
    ids, words, piece = phrases.words_of(texts)
    assert [words[k] for k in ids] == [b"one", b"two", b"three", b"x", b"y", b"z", b"z"]
    assert [piece[k + 1] == piece[k] for k in range(6)] == [True, False, False, False, True, False]
    cut = list(phrases.slices(pa.array([b"a b. c d. e f", b"", b"g", b"h. i"], type=pa.large_binary()), 5))
    assert b"|".join(b"|".join(p.to_pylist()) for p in cut).replace(b"|", b"") == b"a b. c d. e fgh. i" and len(cut) == 3


def test_blocks_of_counts_add_up():
    for share in (0.01, 0.9):
        rng = np.random.default_rng(3)
        counts = np.where(rng.random(1 << 16) < share, rng.integers(1, 10, 1 << 16), 0).astype(np.uint8)
        total, raw = np.ones(1 << 16, dtype=np.uint32), phrases.packed_counts(counts)
        phrases.add_packed(total, raw)
        assert (total == counts + 1).all() and (len(raw) < 1 << 16) == (share < 0.1)
