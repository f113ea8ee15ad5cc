"""SimHash near-dedup against plain Python over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from siltstone.llm import queries, simhash
from tests.llm import awkward

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reached(rows):
    """rows: (id, fingerprint); the least id of each row's component."""
    prints = sorted({f for _, f in rows})
    links = {f: [g for g in prints if (f ^ g).bit_count() <= 4] for f in prints}
    found = {}
    for f in prints:
        if f not in found:
            seen, todo = {f}, [f]
            while todo:
                new = [g for g in links[todo.pop()] if g not in seen]
                seen.update(new)
                todo += new
            ids = [d for d, g in rows if g in seen and d is not None]
            found.update(dict.fromkeys(seen, min(ids, default=None)))
    return [(d, f, found[f]) for d, f in rows]


def test_every_four_positions_hold_a_listed_triple():
    assert len(simhash.POSITIONS) == 20 == len(set(simhash.POSITIONS))
    assert all(any(set(t) <= set(four) for t in simhash.POSITIONS) for four in combinations(range(8), 4))
    with pytest.raises(ValueError):
        simhash.Settings(distance=5)


@pytest.mark.parametrize("block", [2048, 5])
def test_groups_equal_all_pairs(spark, block):
    """Also with fingerprints zero, one of them linked to a text of its own."""
    rows = awkward.rows()
    found = simhash.near_groups(awkward.documents(spark), simhash.Settings(block=block)).collect()
    expected = least_reached([(r[0], fingerprint(r[1] or "")) for r in rows])
    assert sorted(((r.doc_id, r.node % 2**64, r.component_id) for r in found), key=str) == sorted(expected, key=str)
    assert simhash.near_groups(awkward.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_no_link_is_lost(spark, block):
    """Chains of fingerprints with up to four bits between neighbours, in any bytes, and a dense group in a hot list."""
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(5):
            prints.add(f)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << bit
    hot = rng.getrandbits(64)
    prints |= {hot ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(x),) for x in np.array(prints, dtype=np.uint64).view(np.int64)], "node long").repartition(3)
    edges = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(nodes, simhash.Settings(block=block)).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        u, v = root(u), root(v)
        parent[max(u, v)] = min(u, v)
    assert [(f, f, root(f)) for f in prints] == least_reached([(f, f) for f in prints])


def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = least_reached([(r.doc_id, fingerprint(r.text or "")) for r in docs])
    found = queries.op12_simhash(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((d, f"{f:016x}", c) for d, f, c in expected)
