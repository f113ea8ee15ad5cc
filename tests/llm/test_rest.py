"""Mixing, near join, secrets, rules and components against their definitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import near_join, quality_rules, secret_scan, source_mix
from siltstone.llm.components import components
from tests.llm import awkward
from tests.oracle import in_order


def mixed(spark, target, budget=None, docs=None):
    docs = awkward.documents(spark) if docs is None else docs
    copies, table = source_mix.plan(docs, target, budget=budget, seed=3)
    return docs, copies, {r.mix_source: r for r in table.collect()}


@pytest.mark.parametrize(("target", "budget"), [(source_mix.Target(entropy=0.95), None), (source_mix.Target(repetition=1.5), None), (source_mix.Target(entropy=0.99), 9_000)])
def test_mix_meets_weights(spark, target, budget):
    docs, copies, table = mixed(spark, target, budget)
    rows = copies.select("mix_source", "mix_n", "mix_copies", source_mix.place(3, F.lit(0), F.col("mix_id"), F.col("mix_text")).alias("p"), "row.doc_id", "row.text").collect()
    assert len(rows) == docs.count()
    total = {s: sum(r.mix_n for r in rows if r.mix_source == s) for s in table}
    a = next(iter(table.values())).mix_exponent
    z = sum(t**a for t in total.values() if t)
    weight = {s: t**a / z if t else 0.0 for s, t in total.items()}
    assert all(abs(table[s].mix_weight - weight[s]) < 1e-9 for s in table)
    if target.entropy:
        assert -sum(w * math.log(w) for w in weight.values()) >= target.entropy * math.log(len(weight)) - 1e-6
    else:
        repeats = [weight[s] / total[s] for s in weight]
        assert max(repeats) / min(repeats) <= 1.5 + 1e-6
    longest = {s: max(r.mix_n for r in rows if r.mix_source == s) for s in table}
    budget = budget or max(total[s] / weight[s] for s in total)
    for s in table:
        given = sum(r.mix_n * r.mix_copies for r in rows if r.mix_source == s)
        # The document that crosses the line is taken, with rows alike.
        assert weight[s] * budget - 2 <= given <= weight[s] * budget + 2 * longest[s] + 2
        copies_ = {r.mix_copies for r in rows if r.mix_source == s}
        assert copies_ <= {table[s].mix_passes, table[s].mix_passes + 1}


def test_partial_pass_is_a_prefix_of_the_permutation(spark):
    docs, copies, table = mixed(spark, source_mix.Target(entropy=0.99), 9_000)
    for s, t in table.items():
        here = source_mix.place(3, F.lit(t.mix_passes), F.col("mix_id"), F.col("mix_text"))
        rows = sorted((r.p, r.mix_n, r.mix_copies) for r in copies.where(F.col("mix_source") == s).select(here.alias("p"), "mix_n", "mix_copies").collect())
        taken, sums = [c > t.mix_passes for _, _, c in rows], 0
        for (place, n, _), extra in zip(rows, taken, strict=True):
            same_place_before = sum(x[1] for x in rows if x[0] < place)
            assert extra == (t.mix_quota > 0 and same_place_before < t.mix_quota)
            sums += n


def test_realised_rows_and_columns(spark):
    docs, copies, _ = mixed(spark, source_mix.Target(entropy=0.95))
    rows = source_mix.realise(copies, seed=3)
    assert rows.count() == copies.agg(F.sum("mix_copies")).first()[0] >= docs.count()
    assert copies.agg(F.min("mix_copies")).first()[0] >= 1
    assert rows.select("row.*").columns == docs.columns and rows.select("row.mix_n").distinct().first()[0] == "m"
    copies, _ = source_mix.plan(awkward.empty(spark), source_mix.Target(entropy=0.95))
    assert source_mix.realise(copies).count() == 0
    with pytest.raises(ValueError):
        source_mix.Target()


def jaccard_classes(rows, words=5, threshold=80):
    texts = sorted({t for _, t in rows})
    sets = []
    for t in texts:
        w = near_join.WORD.findall(t)
        sets.append({tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    links = {t: set() for t in texts}
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                links[texts[i]].add(texts[j])
                links[texts[j]].add(texts[i])
    ids, out = {}, {}
    for d, t in rows:
        ids.setdefault(t, []).append(d)
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        named = [d for x in seen for d in ids[x] if d is not None]
        out[t] = (min(named) if named else None, len(links[t]))
    return sorted(((d, *out[t]) for d, t in rows), key=str)


@pytest.mark.parametrize("block", [512, 3])
def test_near_join_equals_all_pairs(spark, block):
    found = near_join.near_documents(awkward.documents(spark), near_join.Settings(block=block)).collect()
    expected = jaccard_classes([(r[0], r[1] or "") for r in awkward.rows()])
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str) == expected
    assert any(x[2] > 5 for x in expected)


def test_near_join_keeps_one_of_each_class(spark):
    docs = awkward.documents(spark)
    kept = near_join.keep_one(docs)
    expected = {c for _, c, _ in jaccard_classes([(r[0], r[1] or "") for r in awkward.rows()])}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected
    assert near_join.keep_one(awkward.empty(spark)).count() == 0 and near_join.near_documents(awkward.empty(spark)).count() == 0


def test_forest_depth_reaches_the_recall():
    s = near_join.Settings()
    chance = lambda d: 1 - (1 - 0.8**d) ** s.trees
    assert chance(s.depth()) >= s.recall and (s.depth() == s.label or chance(s.depth() + 1) < s.recall)


@pytest.mark.parametrize(("edits", "depth"), [(1, 6), (None, 5)])
def test_prefixes_are_shortened_until_the_recall_is_measured(spark, edits, depth):
    """Pairs far above the threshold meet on the whole label; pairs near it need shorter prefixes."""
    rng, s = random.Random(1), near_join.Settings()
    docs = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        # 46 to 48 further words leave 196 of 242 to 244 n-grams in common: a similarity of 0.80 to 0.81.
        other = [*words, *(f"v{rng.randrange(10**6)}" for _ in range(46 + k % 3))] if edits is None else ["edited", *words[1:]]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = docs.select(near_join.node_of().alias("node"), "text")
    _, rounds = near_join.candidate_clusters(near_join.signatures(rows, s), s)
    assert rounds[0][0] == s.label and rounds[-1][0] == depth and rounds[-1][1] >= s.recall
    assert {r.n_links for r in near_join.near_documents(docs, s).collect()} == {1}


def test_a_hot_node_of_many_edges(spark):
    found = components(spark.range(1, 3000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")))
    assert found.where("root = 0").count() == 2999 == found.count()


@pytest.mark.parametrize("hot_degree", [1_000, 2])
def test_components(spark, hot_degree):
    rng, n = random.Random(4), 200
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500 + k) for k in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), hot_degree).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_secrets(spark):
    forest = secret_scan.train()
    rows = secret_scan.example_findings(1500, seed=123)
    score = forest(np.array([secret_scan.features(b, v, a, forest.dictionary) for b, v, a, _ in rows]))
    label = np.array([r[3] for r in rows])
    assert ((score >= 0.5) == label).mean() > 0.97
    secret = "0f3a9c27d1e84b5566aa90cc12ef7b3d44e1a802"
    texts = [(1, f'the token = "{secret}" is here'), (2, f"commit {secret} was merged"), (3, "no such thing"), (4, None), (5, "password = changemechangemexxxxxxxx"), (None, f'api_key: "{secret}"')]
    found = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), forest).collect()}
    assert [found[k].n_secrets for k in (1, 2, 3, 4, 5, None)] == [1, 0, 0, 0, 0, 1]
    assert texts[0][1][found[1].secrets[0].begin : found[1].secrets[0].end] == secret
    assert secret_scan.scan(awkward.documents(spark), forest).count() == len(awkward.rows())
    assert secret_scan.scan(awkward.empty(spark), forest).count() == 0


def rules_by_hand(text):
    words = near_join.WORD.findall(text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(grams)
    twice = {k for k, g in enumerate(grams) if times[g] > 1}
    lines = [x for x in text.split("\n") if near_join.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len({k + j for k in twice for j in range(8)})


def test_quality_rules(spark):
    extra = ["a b c d e f g h i " * 6, "# $ % " * 30, "x y\nx y\n\n \n x y", "A LOUD TEXT!! " * 10, "1 2 3 4 5 6 7 8 9 10 " * 5]
    extra += ["again and again " * 30_000, "x" * 300_000, "line\n" * 40_000]
    rows = [*awkward.unique_rows(), *((1000 + k, t) for k, t in enumerate(extra)), (5000, None)]
    assert max(len(t or "") for _, t in rows) > 400_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    for k, t in rows:
        r, expected = found[k], rules_by_hand(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, k
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_verdicts(awkward.empty(spark)).count() == 0
    assert quality_rules.quality_verdicts(awkward.documents(spark)).count() == len(awkward.rows())


def test_order_of_rules_does_not_change_the_verdict(spark):
    figures = quality_rules.base_figures(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    rules = list(quality_rules.RULES)
    forward = figures.select("doc_id", quality_rules.verdict(rules).alias("k")).collect()
    backward = figures.select("doc_id", quality_rules.verdict(rules[::-1]).alias("k")).collect()
    assert in_order(map(tuple, forward), ["a", "b"]) == in_order(map(tuple, backward), ["a", "b"])
    plan = quality_rules.plan_cascade(figures)
    assert [m.worth for m in plan] == sorted((m.worth for m in plan), reverse=True) and {m.rule.name for m in plan} == {r.name for r in rules}
    figures.unpersist()
