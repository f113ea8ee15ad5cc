import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import shards
from siltstone.plans import corpus
from siltstone.sources import arrow_ipc, config, loaders, schemas
from siltstone.streaming import corpus_stream

SF = "/root/testdata/sf0.001"


def test_code_files(spark):
    file = lambda path, lang, content, size, vendor: (path, lang, content, size, vendor, "mit")
    rows = [
        ("r1", (False, 5), [file("a.py", "Python", "x", 7, False), file("b.py", "Python", "x", 7, True), file("c.hs", "Haskell", "x", 7, False), file("d.py", "Python", "", 7, None), file("e.py", None, "x", None, None)]),
        ("r2", (True, 5), [file("a.py", "Python", "x", 7, False)]),
        ("r3", None, [file("a.py", "Go", "y", None, None)]),
        ("r4", None, None),
    ]
    found = loaders.code_files(spark.createDataFrame(rows, schemas.REPOS)).collect()
    assert sorted((r.repo_path, r.file_path, r.size_bytes, r.stars) for r in found) == [("r1", "a.py", 7, 5), ("r3", "a.py", 0, 0)]
    docs = loaders.documentation_files(spark.createDataFrame([("r2", (True, 1), [file("README", None, "x", None, True), file("x/LICENSE.md", None, "x", 1, False), file(None, None, "x", 1, False)])], schemas.REPOS)).collect()
    assert [(r.file_path, r.size_bytes) for r in docs] == [("README", 0)]


def test_functions(spark):
    rows = [("code", "doc", "f", "Python", "p"), ("code", None, "", "Go", None), ("", "d", "f", "Go", None), ("x", None, "f", "Haskell", None)]
    table = spark.createDataFrame(rows, schemas.FUNCTIONS)
    assert sorted(r.text for r in loaders.functions(table).collect()) == ['# Function: f\n"""doc"""\ncode', "code"]
    assert loaders.functions(table, languages=[]).count() == 3


def test_math_metadata_defaults_to_an_empty_map(spark):
    assert loaders.math_pages(spark.createDataFrame([("t", "u", None)], schemas.MATH)).first().metadata == {}


def test_arrow_shards_round_trip(spark, tmp_path):
    arrow_ipc.register(spark)
    rows = loaders.synthetic_records(spark, 20, 8, 50)
    assert rows.select(F.min(F.array_min("input_ids")), F.max(F.array_max("input_ids"))).first()[0] >= 1
    placed = shards.shard_assignment(rows, 6).withColumn("real_tokens", F.lit(8))
    shards.write_shards(placed, str(tmp_path / "a"), "arrow")
    back = loaders.read_shards(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, ((r.seq_no, tuple(r.input_ids)) for r in back.collect()))) == sorted((r.seq_no, tuple(r.input_ids)) for r in rows.collect())
    assert loaders.record_at(back, -1).first().seq_no == 19
    shards.write_shards(placed, str(tmp_path / "p"))
    assert loaders.read_shards(spark, str(tmp_path / "p")).count() == 20


def test_an_arrow_sink_written_again(spark, tmp_path):
    rows = shards.shard_assignment(loaders.synthetic_records(spark, 20, 8, 50), 6)
    path = str(tmp_path / "a")
    for _ in range(2):
        shards.write_shards(rows, path, "arrow")
    assert loaders.read_shards(spark, path).count() == 20
    # What a killed attempt leaves is not listed, so it is not read.
    left = next(p for p in (tmp_path / "a").glob("*.arrow"))
    (tmp_path / "a" / "shard_00000-killed.arrow").write_bytes(left.read_bytes())
    assert loaders.read_shards(spark, path).count() == 20
    rows.write.format("arrow_shards").mode("append").option("path", path).save()
    assert loaders.read_shards(spark, path).count() == 40
    shards.write_shards(rows.limit(5), path, "arrow")
    assert loaders.read_shards(spark, path).count() == 5


def test_shards_of_other_writers_and_fallback_folders(spark, tmp_path):
    shards.write_shards(shards.shard_assignment(loaders.synthetic_records(spark, 4, 8, 50), 6), str(tmp_path / "full"))
    (tmp_path / "empty").mkdir()
    assert loaders.read_shards(spark, str(tmp_path / "empty")) is None and loaders.read_shards(spark, str(tmp_path / "absent")) is None
    assert loaders.read_shards(spark, str(tmp_path / "empty"), str(tmp_path / "absent"), str(tmp_path / "full")).count() == 4


def test_labels_default_to_the_ids(spark):
    rows = spark.createDataFrame([([1, 2], None, 5)], "input_ids array<int>, labels array<int>, other int")
    assert loaders.with_labels(rows).first().labels == [1, 2] and loaders.with_labels(rows.drop("labels")).columns == ["input_ids", "labels"]


def test_config(tmp_path):
    (tmp_path / "configs").mkdir()
    data = {"datasets": {"a": {"target_proportion": 0.4}, "b": {"target_proportion": 0.6, "min_stars": 3}}, "training": {"x": 1}, "environments": {"local": {"x": 2}}}
    (tmp_path / "configs" / "d.json").write_text(json.dumps(data))
    with pytest.warns(UserWarning, match="min_stars"):
        assert config.load_dataset_config("d.json", tmp_path) == data
    assert config.load_config("d.json", tmp_path, "local")["training"] == {"x": 2}
    placed = config.resolved_paths({"storage": {"k8s": {"mount_path": "/m", "data_dir": "d"}, "processed_data": {"path": ""}}}, tmp_path, "k8s")
    assert placed["training"]["output_dir"] == "/m/checkpoints" and placed["storage"]["processed_data"]["path"] == "/m/d"
    assert config.resolved_paths({}, "/r", "local")["storage"]["processed_data"]["path"] == "/r/data/processed"
    with pytest.raises(ValueError):
        config.check_proportions({"a": {"target_proportion": 0.5}})
    with pytest.raises(FileNotFoundError):
        config.find("nothing.json", tmp_path)


def test_plan_from_documents_to_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("order_key"), "source", "text", F.lit("src/a.py").alias("file_path"), F.lit(None).cast("long").alias("size_bytes"))
    plan = corpus.CorpusPlan(kinds={"src0": "web", "src1": "docs"}, proportions={"src0": 0.5, "src1": 0.5}, total_tokens=8_000, length=512, group_rows=50, limit=20)
    kept = corpus.curated(docs, plan)
    assert kept.count() > 0 and {r.source for r in kept.select("source").distinct().collect()} == {"src0", "src1"}
    packed = corpus.packed_shards(kept, plan).orderBy("seq_no").collect()
    assert [r.seq_no for r in packed] == list(range(len(packed))) and all(len(r.input_ids) == 512 for r in packed)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = corpus_stream.curated_stream(corpus_stream.document_stream(spark, str(tmp_path / "in"), docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1))
    corpus_stream.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    batch = docs.where("1 = 1").select("doc_id", tx.content_hash(F.col("text")).alias("h"), F.col("text"))
    from siltstone.operators import filters

    expected = {r.h for r in batch.where(filters.web_reason(F.col("text")).isNull()).select("h").distinct().collect()}
    assert {r.content_hash for r in found.collect()} == expected and found.count() == len(expected)


def test_arrow_rows_open_what_they_need(spark, tmp_path):
    """Places over files and record batches, after appending and with a file that another writer left."""
    import pyarrow as pa

    path = str(tmp_path / "rows")
    rows = spark.range(25_000).select(F.col("id").alias("seq_no"), (F.col("id") % 7).cast("int").alias("label"), F.lit("wide " * 5).alias("text"), F.floor(F.col("id") / 12_000).cast("int").alias("shard_index"))
    shards.write_shards(rows, path, "arrow")
    load = lambda columns=None: loaders.arrow_rows(spark, path, columns)
    assert loaders.arrow_row_count(spark, path) == 25_000 and load().columns == ["seq_no", "label", "text", "shard_index", "row_no"]
    one = load(["label", "seq_no"]).where(F.col("row_no") == 11_999)
    assert one.columns == ["label", "seq_no", "row_no"] and one.rdd.getNumPartitions() == 1 and [tuple(r) for r in one.collect()] == [(11_999 % 7, 11_999, 11_999)]
    assert "PushedFilters: [EqualTo(row_no,11999)]" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    some = load(["seq_no"]).where((F.col("row_no") > 9_998) & (F.col("row_no") <= 12_001) & (F.col("seq_no") % 2 == 0))
    assert sorted(r.row_no for r in some.collect()) == [x for x in range(9_999, 12_002) if x % 2 == 0]
    assert load(["seq_no"]).where(F.col("row_no").isin(3, 24_999, 10**9)).count() == 2 and load(["seq_no"]).where("row_no < 0").count() == 0
    assert load(["seq_no"]).where("row_no = seq_no").count() == 25_000 and loaders.record_at(load(["seq_no"]), -1, "row_no", total=25_000).first().seq_no == 24_999
    rows.limit(10).write.format("arrow_shards").mode("append").option("path", path).save()
    assert loaders.arrow_row_count(spark, path) == 25_010 == load(["label"]).count()
    other = tmp_path / "other"
    other.mkdir()
    with pa.ipc.new_file(str(other / "a.arrow"), pa.schema([("x", pa.int64())])) as writer:
        for k in range(3):
            writer.write_batch(pa.record_batch([pa.array([10 * k, 10 * k + 1])], names=["x"]))
    found = loaders.arrow_rows(spark, str(other)).where(F.col("row_no").isin(2, 5))
    assert sorted((r.row_no, r.x) for r in found.collect()) == [(2, 10), (5, 21)] and found.rdd.getNumPartitions() == 2
