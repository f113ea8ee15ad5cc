import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import quality_model as qm
from tests.llm import awkward

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    pooler, network = qm.train(docs, labels)
    scored = qm.score(docs, pooler, network).withColumn("held", qm.held_out()).join(labels, "doc_id").toPandas()
    held = scored[scored["held"]]
    assert set(held["doc_id"]) == {i for i in scored["doc_id"] if zlib.crc32(str(i).encode()) % 5 == 0}
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.98
    assert (good >= 0.3).mean() > 0.98 and (bad < 0.3).mean() > 0.9
    near = np.abs(held["score"] - 0.5) < 0.5
    assert abs(held["score"][near].mean() - held["quality"][near].mean()) < 0.05


def test_scores_do_not_depend_on_partitions(spark):
    docs = awkward.documents(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    runs = []
    for n in (1, 5):
        pooler, network = qm.train(docs.repartition(n), labels)
        runs.append(sorted((r.doc_id or -1, round(r.score, 12)) for r in qm.score(docs, pooler, network).collect()))
    assert runs[0] == runs[1] and all(0 <= s <= 1 for _, s in runs[0])


def test_nothing_to_learn(spark):
    docs = awkward.documents(spark)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in qm.score(docs, *qm.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    assert {r.score for r in qm.score(docs, *qm.train(docs, one)).collect()} == {1.0}
    empty = awkward.empty(spark)
    assert qm.score(empty, *qm.train(empty, one)).count() == 0


def test_filter_keeps_columns(spark):
    docs = awkward.documents(spark)
    pooler, network = qm.train(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    kept = qm.keep_good(docs, pooler, network, 0.0)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count()
    assert docs.select(F.count_if(qm.held_out())).first()[0] == sum(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in awkward.rows())


def naive_vectors(texts, space):
    """Word by word and neighbour by neighbour."""
    places, signs = space.index_vectors()
    table, count = np.zeros((space.buckets, space.dims)), np.zeros(space.buckets)
    for text in texts:
        ids = [zlib.crc32(w.encode()) % space.buckets for w in re.findall(r"\w+|[^\w\s]+", text)]
        for k, word in enumerate(ids):
            count[word] += 1
            for j in range(max(k - space.window, 0), min(k + space.window + 1, len(ids))):
                if j != k:
                    for place, sign in zip(places[ids[j]], signs[ids[j]], strict=True):
                        table[word, place] += sign
    return table, count


def test_word_table_and_pooling_equal_their_definitions(spark):
    space = qm.Space(buckets=512, dims=8)
    texts = [t for _, t in awkward.unique_rows() if len(t) < 20_000]
    raw, count = naive_vectors(texts, space)
    unit = np.array([v / max(math.sqrt(float(v @ v)), 1e-9) for v in raw])
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    table, seen = qm.word_table(docs, space)
    assert (seen == count).all() and np.allclose(table, unit, atol=1e-6)
    pooled = qm.Pooler(table, seen)(texts)
    total = count.sum()
    for row, text in zip(pooled, texts, strict=True):
        ids = [zlib.crc32(w.encode()) % space.buckets for w in re.findall(r"\w+|[^\w\s]+", text)]
        if not ids:
            assert not row.any()
            continue
        weight = [1e-3 / (1e-3 + count[i] / total) for i in ids]
        mean = sum(unit[i] for i in ids) / len(ids)
        weighted = sum(w * unit[i] for w, i in zip(weight, ids, strict=True)) / sum(weight)
        again = [sum(a == b for a, b in zip(ids, ids[lag:], strict=False)) / (len(ids) - lag) if len(ids) > lag else 0.0 for lag in range(1, 5)]
        assert np.allclose(row, [*mean, *weighted, math.log1p(len(ids)), len(set(ids)) / len(ids), *again], atol=1e-5)


def test_network_and_temperature_equal_their_definitions():
    """The forward pass unit by unit, and the temperature by trying the whole grid on the fold left out."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.8 * rng.normal(size=400) > 0).astype(int)
    left_out = np.arange(400) % 4 == 0
    net = qm.fit(x, y, left_out, hidden=6, steps=300)

    def logit(row):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(6)]
        return sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2

    assert np.allclose(net.mean, x[~left_out].mean(0)) and np.allclose(net.scale, x[~left_out].std(0) + 1e-6)
    logits = [logit(row) for row in x]
    assert np.allclose(net(x), [1 / (1 + math.exp(-v / net.temperature)) for v in logits])
    loss = lambda t: sum(math.log1p(math.exp(-v / t)) if label else math.log1p(math.exp(v / t)) for v, label, out in zip(logits, y, left_out, strict=True) if out)
    assert net.temperature == min(np.geomspace(0.25, 8, 81), key=loss)
    right = ((net(x) > 0.5) == y)[left_out].mean()
    assert right > 0.7


def test_training_takes_the_step_that_adam_defines():
    """One step from the same start, with gradients by finite differences of the loss."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), np.arange(40) % 2
    none, one = (qm.fit(x, y, np.zeros(40, dtype=bool), hidden=2, steps=n, batch=10**6, decay=0.0) for n in (0, 1))
    start = np.random.default_rng(5)
    w1, w2 = start.normal(0, 3**-0.5, (3, 2)), start.normal(0, 2**-0.5, 2)
    assert np.allclose(none.w1, w1) and np.allclose(none.w2, w2)
    take = start.integers(0, 40, 40)
    z, t = ((x - x.mean(0)) / (x.std(0) + 1e-6))[take], y[take]
    loss = lambda p: np.mean(np.logaddexp(0, np.where(t == 1, -1, 1) * (np.tanh(z @ p[:6].reshape(3, 2) + p[6:8]) @ p[8:10] + p[10])))
    begin = np.concatenate([w1.ravel(), np.zeros(2), w2, np.zeros(1)])
    slope = np.array([(loss(begin + 1e-6 * e) - loss(begin - 1e-6 * e)) / 2e-6 for e in np.eye(11)])
    # Adam's first step is the rate times the gradient's sign; here the rate has fallen to that of the last of one step.
    rate = 3e-3 * min(1.0, 2 * (1 - 1 / 2))
    moved = np.concatenate([one.w1.ravel(), one.b1, one.w2, [one.b2]]) - begin
    clear = np.abs(slope) > 1e-4
    assert clear.sum() > 5 and np.allclose(moved[clear], -rate * np.sign(slope[clear]), rtol=1e-2)
