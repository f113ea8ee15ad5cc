import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.tokens import BYTES, Tokenizer
from siltstone.operators import dedup, evaluation, filters, mixture, packing, shards, shared, windows
from siltstone.plans import corpus, queries


def reason_of(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


BODY = "some words here\n" * 10


@pytest.mark.parametrize(
    ("body", "size", "path", "expected"),
    [
        (BODY, 99, "a.py", "too_small"),
        (BODY, 100, "a.py", None),
        (BODY, 0, "a.py", "too_small"),
        (BODY, None, "a.py", None),
        (BODY, 1_000_000, "a.py", None),
        (BODY, 1_000_001, "a.py", "too_large"),
        (BODY, 500, "pkg/api_pb2.py", "generated_file"),
        (BODY, 500, "a/Cargo.lock", "lockfile"),
        (BODY, 500, "package.json", "data_file"),
        ("a" * 24 + "\n" * 3 + "-" * 73, 500, "a.py", "low_alphanumeric_ratio"),
        ("a" * 25 + "\n" * 3 + "-" * 72, 500, "a.py", None),
        ("abc\nabc", 500, "a.py", "too_few_lines"),
        ("abc\nabc\nabc", 500, "a.py", None),
        ("ab\n" * 9_999 + "a", 500, "a.py", None),
        ("ab\n" * 10_000 + "a", 500, "a.py", "too_many_lines"),
        (("x" * 1_001 + "\n") * 2 + "a", 500, "a.py", None),
        (("x" * 1_001 + "\n") * 3 + "a", 500, "a.py", "lines_too_long"),
    ],
)
def test_code_filter(spark, body, size, path, expected):
    row = spark.createDataFrame([(body, size, path)], "t string, s long, p string")
    assert row.select(filters.code_reason(F.col("t"), F.col("p"), F.col("s")).alias("r")).first().r == expected


PHRASES = "accept cookies we use cookies cookie settings "


@pytest.mark.parametrize(
    ("body", "quality", "expected"),
    [
        ("a" * 199, None, "web_too_short"),
        ("a" * 200, None, None),
        ("a" * 200_001, None, "web_too_long"),
        (PHRASES + "a" * 350, None, "web_boilerplate"),
        (PHRASES + "a" * (4_000 - len(PHRASES)), None, None),
        ("a" * 200, 0.0, "web_low_quality"),
        ("a" * 200, 1.0, None),
        ("é" * 50 + "a" * 150, None, "non_english_web"),
        (None, None, "web_too_short"),
    ],
)
def test_web_filter(spark, body, quality, expected):
    row = spark.createDataFrame([(body, quality)], "t string, q double")
    assert row.select(filters.web_reason(F.col("t"), F.col("q"), filters.WebLimits(least_quality=1.0)).alias("r")).first().r == expected


LINE = "the words of a line that is long enough to count for the filter here"


@pytest.mark.parametrize(
    ("body", "expected"),
    [("\n".join([LINE] * 5), None), ("\n".join([LINE] * 6), "doc_boilerplate"), ("x" * 99 + "-" * 101, "doc_low_alnum"), ("x" * 500_001, "doc_too_long"), ("é" * 50 + "a" * 150, "non_english_doc")],
)
def test_doc_filter(spark, body, expected):
    assert reason_of(spark, filters.doc_reason(F.col("t")), t=body) == expected


PROSE = "the sum of terms and a limit is shown with care for all of them in this part "


@pytest.mark.parametrize(
    ("tail", "expected"),
    [
        ("$" * 5, None),
        ("$ " * 7, "math_broken_latex"),
        ("$ " * 8, None),
        ("$ " * 7 + "\\$", "math_broken_latex"),
        ("\\begin{a} " * 3, "math_unmatched_env"),
        ("\\end{a} " * 5, None),
        ("-" * 10, None),
        ("-" * 11, "math_ocr_artifact"),
        (" " * 11, "math_ocr_artifact"),
        ("\r" * 11, "math_ocr_artifact"),
        ("\n" * 11, None),
        ("||||", None),
        ("|||||", "math_ocr_artifact"),
        ("é" * 9, None),
        ("é" * 10, "math_ocr_artifact"),
        ("\x01\x01", None),
        ("\x01\x01\x01", "math_ocr_artifact"),
        ("\n" + "\n".join(["same"] * 6), "math_repeated_content"),
    ],
)
def test_math_filter(spark, tail, expected):
    assert reason_of(spark, filters.math_reason(F.col("t")), t=PROSE * 2 + "end" + tail) == expected


def test_math_guard_counts_content_lines(spark):
    line = PROSE + "x"
    assert reason_of(spark, filters.math_reason(F.col("t")), t="\n".join([line] * 5 + [""])) is None


@pytest.mark.parametrize(("body", "name", "expected"), [("a" * 49, "f", "vault_too_short"), ("a" * 50, "f", None), ("a" * 50, "  ", "vault_no_identifier"), ("a" * 50, None, "vault_no_identifier"), ("-" * 50, "f", "vault_low_alnum")])
def test_function_filter(spark, body, name, expected):
    row = spark.createDataFrame([(body, name)], "t string, n string")
    assert row.select(filters.function_reason(F.col("t"), F.col("n")).alias("r")).first().r == expected


def test_known_funnel(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    web = dict(filters.filter_stats(docs.select(filters.web_reason(F.col("text")).alias("reason"))).collect())
    assert web == {"pass": 916, "web_low_alnum": 52, "web_too_short": 32}
    assert dedup.dedup_stats(docs).first().duplicates_found == 73


def test_unknown_kind_gives_no_rows(spark):
    assert filters.filtered(spark.createDataFrame([("a",)], "text string"), "nothing").count() == 0


def test_exact_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(4, "Foo  bar"), (2, " foo bar\n"), (3, "foo\tBAR"), (5, "foo　bar"), (9, "other"), (1, "")], "id long, text string")
    assert {r.id for r in dedup.exact_duplicates_dropped(rows, "id").collect()} == {1, 2, 9}
    assert dedup.exact_duplicates_dropped(rows, "id", normalize=False).count() == 6
    assert {(r.id, r.size) for r in dedup.exact_firsts(rows.withColumn("size", F.length("text")), "id", ["size"]).collect()} == {(1, 0), (2, 9), (9, 5)}
    assert dedup.dedup_stats(rows.where("id < 9 and id > 1")).first().duplicates_found == 3


def test_hash_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "A  B")], "id long, text string")
    dedup.save_hashes(dedup.content_hashes(rows.where("id < 3")), str(tmp_path / "h"))
    seen = dedup.load_hashes(spark, str(tmp_path / "h"))
    assert seen.count() == 2 and dedup.without_seen(rows, seen).count() == 0


def test_band_parameters():
    assert dedup.best_bands(128, 0.7) == (14, 9)


def test_near_dedup_equals_first_come_processing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    texts = []
    for k in range(60):
        body = list(base[k % 6])
        for _ in range(rng.randrange(4)):
            body[rng.randrange(40)] = rng.choice(words)
        texts.append((k, " ".join(body)))
    rows = spark.createDataFrame([*texts, (100, None), (101, "abc")], "id long, text string")
    from siltstone.functions import text as tx

    bands = {r.key: r.bands for r in dedup.band_hashes(rows.select(F.col("id").alias("key"), tx.normalized(F.coalesce("text", F.lit(""))).alias("body"))).collect()}
    seen, kept = set(), set()
    for k in sorted(bands):
        if not seen & set(bands[k]):
            kept.add(k)
            seen |= set(bands[k])
    assert {r.id for r in dedup.near_duplicates_dropped(rows, "id").collect()} == kept
    assert 100 in kept and 101 in kept and len(kept) < 40


def test_mixture_of_the_fixture(spark):
    rows = [("A", 1, 30), ("A", 2, 40), ("A", 3, 50), ("B", 4, 10), ("B", 5, 10), ("C", 6, 10)]
    docs = spark.createDataFrame(rows, "source string, id long, tokens long")
    table = mixture.targets(spark, {"A": 0.6, "B": 0.4}, 100)
    taken = mixture.mix(docs, table, "id")
    assert {r.id for r in taken.collect()} == {1, 2, 3, 4, 5}
    report = {r.source: r for r in mixture.mixture_report(taken, table).collect()}
    assert report["A"].actual_tokens == 120 and report["B"].completion == 0.5
    assert {r.key for r in mixture.mix_replay(docs, {"A": 0.6, "B": 0.4}, 100, "id").collect()} == {1, 2, 3, 4, 5}
    assert mixture.mix(docs.limit(0), table, "id").count() == 0


def test_proportions_and_trial_target(spark):
    table = mixture.targets(spark, {"A": 0.5, "B": 1.5}, 10)
    assert {r.source: r.proportion for r in mixture.renormalized(table).collect()} == {"A": 0.25, "B": 0.75}
    assert mixture.trial_target(10**9, 100, 5) == 250_000


def test_next_fit_of_the_fixture():
    assert packing.next_fit(np.array([3, 5, 8, 2, 7, 12, 4]), 8).tolist() == [0, 0, 1, 2, 3, 4, 5]


def test_packed_dataset_equals_a_row_by_row_packer(spark):
    rng = random.Random(8)
    texts = [(k, "x" * rng.choice([0, 3, 4, 7, 8, 15, 16, 30])) for k in range(60)]
    records, held = [], []
    for _, t in texts:
        ids = [*t.encode(), 256]
        if len(ids) < 5:
            continue
        if len(ids) > 16:
            ids = [*ids[:15], 256]
        if len(held) + len(ids) > 16:
            records.append(held)
            held = []
        held = held + ids
        if len(held) == 16:
            records.append(held)
            held = []
    records += [held] if held else []
    found = packing.packed_dataset(spark.createDataFrame(texts, "id long, text string"), BYTES, "id", 16).orderBy("seq").collect()
    assert [r.input_ids for r in found] == [x + [257] * (16 - len(x)) for x in records if x]
    assert [r.labels for r in found] == [x + [-100] * (16 - len(x)) for x in records if x]
    assert all(sum(r.attention_mask) == len(x) for r, x in zip(found, [x for x in records if x], strict=True))
    assert all(r.doc_starts[0] == 0 for r in found)


def test_padding_id():
    assert Tokenizer(list, eos=7, pad=0).padding == 7 and Tokenizer(list, eos=7).padding == 7 and BYTES.padding == 257


def test_windows(spark):
    record = spark.createDataFrame([(1, list(range(10)), list(range(10)))], "id long, input_ids array<int>, labels array<int>")
    assert [len(r.input_ids) for r in windows.token_windows(record, 4).orderBy("window").collect()] == [4, 4, 2]
    padded = windows.token_windows(record, 4, ("input_ids", "labels"), pad={"input_ids": 0, "labels": -100}).orderBy("window").collect()
    assert padded[2].input_ids == [8, 9, 0, 0] and padded[2].labels == [8, 9, -100, -100]
    assert windows.window_at(4, 6, 3) == (1, 1) and windows.window_at(-1, 6, 3) == (1, 2)
    with pytest.raises(IndexError):
        windows.window_at(6, 6, 3)
    with pytest.raises(ValueError):
        windows.token_windows(record, 0)


def test_row_numbers_are_consecutive(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    found = [r.n for r in windows.row_numbers(rows, ["k"], "n").orderBy("k").collect()]
    assert found == list(range(1000))


def test_row_numbers_with_a_payload(spark):
    rows = spark.range(300_000).select(F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    found = windows.row_numbers(rows, ["k"], "n").select("n", "k").toPandas().sort_values("k")
    assert found["n"].tolist() == list(range(300_000))


def test_running_sums_of_hot_and_clustered_keys(spark):
    rng = random.Random(5)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 5}", k if k < 900 else 10**12 + k, rng.randrange(9)) for k in range(1000)]
    sums, expected = {}, {}
    for source, key, n in sorted(rows, key=lambda r: r[1]):
        expected[key] = sums.get(source, 0)
        sums[source] = sums.get(source, 0) + n
    table = spark.createDataFrame(rows, "source string, key long, n int").repartition(5)
    assert {r.key: r.before for r in windows.running_sum(table, "n", ["key"], "before", ["source"]).collect()} == expected
    assert windows.running_sum(table.limit(0), "n", ["key"], "before").count() == 0
    kept = windows.skip_and_limit(table, "key", 2, 3).collect()
    assert sorted((str(r.source), r.key) for r in kept) == sorted((str(s), key) for s in {r[0] for r in rows} for key in sorted(r[1] for r in rows if r[0] == s)[2:5])


def test_batches_leave_out_the_rest(spark):
    found = windows.shuffled_batches(spark.range(10).toDF("id"), "id", 4).groupBy("batch_no").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 4), (1, 4)]
    assert windows.shuffled_batches(spark.range(3).toDF("id"), "id", 4).count() == 0


def test_shards(spark, tmp_path):
    assert shards.sequences_per_shard(4096) == 1067 and shards.sequences_per_shard(16) == 2000
    rows = shards.shard_assignment(spark.range(5).select(F.col("id").alias("seq_no"), F.lit(3).alias("real_tokens")), 2, 115)
    assert {r.shard_name for r in rows.collect()} == {"shard_00115", "shard_00116", "shard_00117"}
    listed = shards.manifest_rows(rows, 4)
    assert shards.manifest_totals(listed).first().num_shards == 118 and [s.num_sequences for s in listed.orderBy("shard_index").collect()] == [2, 2, 1]
    path = str(tmp_path / "manifest")
    assert shards.next_shard(spark, path, 7) == 7
    shards.write_manifest(listed, path, "2020-01-01")
    assert shards.next_shard(spark, path) == 118
    assert spark.read.json(f"{path}/shards").count() == 3 and spark.read.json(f"{path}/totals").first().total_sequences == 5
    for _ in range(2):
        shards.write_shards(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    shards.append_log(spark, {"a": 1}, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().a == 1


def test_long_chains_of_near_copies_settle(spark, monkeypatch):
    """Each row shares a band with the next one only, so that rounds are as many as half the rows."""
    monkeypatch.setattr(dedup, "band_hashes", lambda rows: rows.select("key", F.array(F.col("key"), F.col("key") + 1).alias("bands")))
    rows = spark.createDataFrame([(k, "x") for k in range(14)], "id long, text string")
    assert {r.key for r in dedup.near_duplicate_keys(rows, "id").collect()} == {1, 3, 5, 7, 9, 11, 13}


def test_perplexity_without_tokens_is_infinite(spark):
    empty = spark.createDataFrame([("", 1.0, 5), ("a", 1.0, 1)], "text string, loss double, tokens long")
    assert evaluation.perplexity(empty).first().perplexity == float("inf")


def test_steps_and_retention(spark):
    assert evaluation.training_steps(10**9, 1024, 8, 8, 1) == 15_259
    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "name string, modified int")
    assert {r.name for r in evaluation.newest(files, 2).collect()} == {"b", "c"}


def sequential(sizes, length, used=0, seq=0):
    """Next-fit one document at a time: the sequences, then records closed and the fill at the end."""
    out = []
    for n in sizes:
        if used and used + n > length:
            seq, used = seq + 1, 0
        out.append(seq)
        used += n
        if used >= length:
            seq, used = seq + 1, 0
    return out, seq, used


def test_fill_maps_compose_to_the_sequential_packer():
    rng = random.Random(1)
    for _ in range(400):
        length, n = rng.choice([1, 2, 5, 8, 16]), rng.randint(0, 30)
        sizes = np.array([min(rng.randint(rng.choice([0, 1]), rng.choice([3, length, length + 4])), length) for _ in range(n)], dtype=np.int64)
        at = rng.randint(0, n)
        whole = packing.FillMap.of(sizes[:at], length).then(packing.FillMap.of(sizes[at:], length))
        for fill in range(length):
            assert packing.filled(fill, *whole.steps()) == sequential(sizes.tolist(), length, fill)[1:]


@pytest.mark.parametrize("length", [64, 7])
def test_a_stream_over_ranges_packs_as_one(spark, length):
    """Ranges end within records, on full ones and within long runs of small documents; a document may be longer than a record."""
    rng = random.Random(3)
    sizes = [rng.choice([1, 1, 2, 3, 10, length - 1, length, length + 50]) for _ in range(3000)] + [1] * 2000
    keys = rng.sample(range(10**6), len(sizes))
    docs = spark.createDataFrame(list(zip(sorted(keys), sizes, strict=True)), "k long, tokens long").repartition(7)
    found = [r.seq_no for r in packing.stream_sequences(docs, "k", length).orderBy("key").collect()]
    assert found == sequential([min(s, length) for s in sizes], length)[0]
    assert packing.assign_sequences(docs, "k", length).orderBy("key").select("seq").first().seq == 0
    assert packing.stream_sequences(docs.limit(0), "k", length).count() == 0


def test_stream_records_and_their_limit(spark):
    texts = [(k, "ab" * (k % 9)) for k in range(200)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(5)
    sizes = [(k, len(t) + 1) for k, t in texts if len(t) + 1 >= 5]
    place = sequential([min(n, 16) for _, n in sizes], 16)[0]
    rows = packing.packed_stream(docs, BYTES, "id", 16).orderBy("seq").collect()
    assert [r.seq for r in rows] == sorted(set(place))
    for r in rows:
        held = [list(texts[k][1].encode())[: min(n, 16) - 1] + [256] for (k, n), s in zip(sizes, place, strict=True) if s == r.seq]
        ids = [x for part in held for x in part]
        assert r.input_ids == ids + [257] * (16 - len(ids)) and len(r.doc_starts) == len(held) and sum(r.attention_mask) == len(ids)
    some = packing.packed_stream(docs, BYTES, "id", 16, most_records=9).orderBy("seq").collect()
    assert [tuple(r) for r in some] == [tuple(r) for r in rows[:9]]
    other = Tokenizer(lambda t: list(t.encode()), eos=256, pad=257)
    assert [tuple(r) for r in packing.packed_stream(docs, other, "id", 16).orderBy("seq").collect()] == [tuple(r) for r in rows]


def test_intermediate_data_goes_with_its_scope(spark):
    files = lambda: {str(p) for p in Path(shared.work_folder(spark).removeprefix("file://")).rglob("*") if p.is_file()}
    before = files()
    with shared.work_scope():
        docs, plan = queries.production_plan(spark, "/root/testdata/sf0.001")
        assert corpus.packed_shards(corpus.curated(docs, plan, "doc_id"), plan, order_key="doc_id").count() > 0
        kept, _ = shared.staged(spark.range(5), "test")
        assert kept.count() == 5 and files() > before
    assert files() == before
    table = shared.cut(spark.range(3))
    assert files() > before
    shared.drop(table)
    assert files() == before
