"""The prefix trie against walking it in plain Python; the query's SQL is compared in test_pipeline."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from siltstone.llm import queries, trie



def rebuilt(rows):
    """rows: (conv_id, turn, role, text) with different turns in a conversation."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children.get(node, [])), sum(x not in children for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def conversations(seed=3):
    """Shared beginnings, gaps in the ids (so that bases are absent), null turns, roles and texts, and negative ids."""
    rng, rows = random.Random(seed), []
    for c in [*range(-7, 60), 1001, 1003, 2**40 + 1]:
        if rng.random() < 0.25:
            continue
        start = rng.choice([None, 0, -3])
        for k in range(rng.randint(1, 14)):
            turn = start if k == 0 else k + 1
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if k > 1 else "user", rng.choice(["hi", "é" * k, None, "", "long " * 50])))
    return rows


def test_query_equals_walking(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    expected = brute(rebuilt(rows))
    assert collected(queries.op13_trie(spark, str(tmp_path))) == expected
    # Some conversation has no turn at all, and ends at the root.
    assert expected[0][1] == 0 and any(not t for t in rebuilt(rows).values()) and max(r[3] for r in expected if r[1]) > 5


def plain(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = trie.numbered(table)
    return trie.trie(turns, turns.select("conv_id"))


def test_one_conversation_holds_most_turns_over_many_ranges(spark):
    """A long conversation crosses ranges; another repeats 150 of its turns.  Rounds grow with the logarithm of the depth."""
    say = lambda k: (k, "user" if k % 2 else "assistant", f"turn {k % 7}")
    rows = [(5, *say(k)) for k in range(300)] + [(9, *say(k)) for k in range(150)] + [(2, 0, "user", "other")]
    nodes, rounds = plain(spark, rows)
    convs = {c: [(r, t) for x, _, r, t in rows if x == c] for c in (2, 5, 9)}
    assert collected(nodes) == brute(convs)
    assert rounds == 9


def test_hot_first_turn_and_copies(spark):
    rows = [(c, k, "user", "hello" if k == 0 else f"{c % 40}-{k}") for c in range(400) for k in range(3)]
    convs = {c: [("user", "hello"), ("user", f"{c % 40}-1"), ("user", f"{c % 40}-2")] for c in range(400)}
    assert collected(plain(spark, rows)[0]) == brute(convs)


def test_ends_in_chunks(spark):
    rows = [(d, 0, 0, c) for c in range(1000) for d in (0, 1) if c % 3 or d]
    ends = spark.createDataFrame(rows, "depth long, d1 long, d2 long, conv_id long").repartition(3)
    found = {r.depth: r.ends_sha256 for r in trie.end_hashes(ends, chunk=7).collect()}
    assert found == {d: hashlib.sha256(",".join(str(c) for c in range(1000) if c % 3 or d).encode()).hexdigest() for d in (0, 1)}


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", "b"), (None, 0, "user", "lost"), (2, None, "", ""), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    found = collected(plain(spark, rows)[0])
    # Turns of one number have an order of their own, the same in both conversations.
    assert [(r[0], r[1], r[3], r[4]) for r in found] == [(1, d, 2, int(d < 4)) for d in range(5)]
    nodes, rounds = plain(spark, [])
    assert nodes.count() == 0 and rounds == 0
    extra = spark.createDataFrame([(1, 0, "user", "x", 7, 8, "d")], "conv_id long, turn long, role string, text string, depth int, d1 int, part string").select("*", F.lit(1).alias("m1"))
    turns = trie.numbered(extra)
    assert trie.trie(turns, turns.select("conv_id"))[0].count() == 2
