import hashlib

import numpy as np
import pytest
import xxhash

from siltstone.llm import imatch
from tests.llm import awkward


def test_edited_texts_and_order(spark):
    rows = awkward.unique_rows()
    words = imatch.lexicon(awkward.unique(spark), low=0.5, high=5.0)
    found = {r.doc_id: r for r in imatch.compare_with_next(awkward.unique(spark), words).collect()}
    make = imatch.Fingerprinter(words)
    assert len(found) == len(rows)
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        other = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = found[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert r.fingerprint == make(text) and r.edited_fingerprint == make(other)
        assert r.near_edited == imatch.likeness(make(text), make(other)) and r.near_next == imatch.likeness(make(text), make(following))


def test_lexicon_is_the_band_of_all_documents(spark):
    counts: dict[str, int] = {}
    rows = awkward.unique_rows()
    for _, text in rows:
        for word in {w.lower() for w in text.split()}:
            counts[word] = counts.get(word, 0) + 1
    terms = imatch.Terms()
    expected = sorted(terms[w] for w, n in counts.items() if 0.5 <= np.log(len(rows) / n) <= 3.0)
    assert imatch.lexicon(awkward.unique(spark), low=0.5, high=3.0).tolist() == expected


def test_fingerprints_equal_their_definition(spark):
    """Every subset's signature from plain sets, and likeness by counting."""
    docs, rows = awkward.unique(spark), awkward.unique_rows()
    words = set(imatch.lexicon(docs, low=0.5, high=5.0).tolist())
    mix = lambda x: int(imatch.splitmix(np.uint64(x)))

    def naive(text):
        held = sorted({xxhash.xxh3_64_intdigest(w.lower().encode()) for w in text.split()} & words)
        out = []
        for k, rate in enumerate(imatch.RATES, 1):
            chosen = [h for h in held if mix(h ^ mix(k)) % rate == 0]
            out.append(xxhash.xxh32_hexdigest(b"".join(h.to_bytes(8, "little") for h in chosen)) if chosen else "")
        return ".".join(out) if any(out) else "=" + xxhash.xxh3_128_hexdigest(text.encode())

    found = {r.doc_id: r for r in imatch.compare_with_next(docs, np.array(sorted(words), dtype=np.uint64)).collect()}
    prints = [naive(text) for _, text in rows]
    for k, (doc, _) in enumerate(rows):
        a, b = prints[k], prints[(k + 1) % len(rows)]
        assert found[doc].fingerprint == a
        pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=False) if x or y]
        assert found[doc].near_next == (1.0 if a == b else 0.0 if "=" in (a[:1], b[:1]) else sum(x == y for x, y in pairs) / len(pairs))


def test_too_large_a_lexicon_is_an_error(spark):
    with pytest.raises(ValueError, match="terms"):
        imatch.lexicon(awkward.unique(spark), low=0.5, high=5.0, most_terms=3)


def test_likeness_follows_shared_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = imatch.compare_with_next(docs, imatch.lexicon(docs)).toPandas()
    assert found["near_edited"].mean() > 20 * found["near_next"].mean()
    assert imatch.likeness("a..c", "a..d") == 0.5 and imatch.likeness("=x", "=x") == 1.0 and imatch.likeness("=x", "a..") == 0.0


def test_awkward_rows(spark):
    found = imatch.compare_with_next(awkward.documents(spark), imatch.lexicon(awkward.documents(spark)))
    assert found.count() == len(awkward.rows())
    assert imatch.compare_with_next(awkward.empty(spark), imatch.lexicon(awkward.empty(spark))).count() == 0
    one = awkward.unique(spark).where("doc_id = 20")
    assert one.count() == 1 and imatch.compare_with_next(one, imatch.lexicon(one)).first().near_next == 1.0
    prints = imatch.fingerprint_rows(awkward.unique(spark).where("doc_id in (10, 57, 58)"), np.zeros(0, dtype=np.uint64)).collect()
    assert len({r.fingerprint for r in prints}) == 1


@pytest.mark.parametrize(("low", "high"), [(0.5, 5.0), (3.0, 6.2)])
def test_a_lexicon_beyond_the_bound_gives_the_same_prints(spark, low, high):
    docs = awkward.documents(spark)
    held = imatch.compared(docs, low, high).collect()
    joined = imatch.compared(docs, low, high, most_terms=0).collect()
    assert len(held) == len(awkward.rows()) and sorted(map(str, held)) == sorted(map(str, joined))
    assert imatch.compared(awkward.empty(spark), low, high, most_terms=-1).count() == 0


def test_a_range_is_found_by_halving(spark):
    points = [3, 10, 11, 400, 10**12]
    rows = spark.createDataFrame([(x,) for x in (None, -5, 2, 3, 9, 10, 11, 12, 400, 10**12, 10**13)], "doc_id long")
    found = {r.doc_id: r.n for r in rows.select("doc_id", imatch.range_number(points, 0, len(points)).alias("n")).collect()}
    assert found == {x: sum(p <= x for p in points) if x is not None else 0 for x in found}


def test_counts_handed_on_early_give_the_same_lexicon(spark, monkeypatch):
    whole = imatch.lexicon(awkward.unique(spark), low=0.5, high=5.0).tolist()
    monkeypatch.setattr(imatch, "MOST_COUNTED", 3)
    assert len(whole) > 3 and imatch.lexicon(awkward.unique(spark), low=0.5, high=5.0).tolist() == whole
