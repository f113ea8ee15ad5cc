from collections import defaultdict

from pyspark.sql import functions as F

from siltstone.llm import line_dedup as ld
from tests.llm import awkward


def brute(rows, least_chars=20, least_docs=3):
    """Kept texts by row; `rows`: (doc_id, text)."""
    holders = defaultdict(set)
    order = lambda d: float("-inf") if d is None else d
    key_of = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(order(doc))
    goes = {k: max(d) for k, d in holders.items() if len(k) >= least_chars and len(d) >= least_docs}
    return sorted((order(doc), "\n".join(x for x in (text or "").split("\n") if order(doc) >= goes.get(key_of(x), order(doc)))) for doc, text in rows)


def kept(docs):
    joined = ld.with_bitmaps(docs, ld.keep_bitmaps(docs)).collect()
    return sorted((float("-inf") if r.row.doc_id is None else r.row.doc_id, ld.kept_text(r.row.text or "", r.n_lines, r.keep)) for r in joined)


def test_equals_brute_force_on_awkward_rows(spark):
    docs = awkward.documents(spark)
    assert kept(docs) == brute([r[:2] for r in awkward.rows()])
    assert any(a != b for a, b in zip(kept(docs), sorted((float("-inf") if r[0] is None else r[0], r[1] or "") for r in awkward.rows()), strict=True))


def test_a_line_of_all_documents_over_many_tasks(spark):
    rows = [(k, f"a line that everyone holds\nown line number {k:09d}\nA LINE that everyone holds\nsecond common line, longer {k % 2}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        assert kept(docs) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_limits(spark):
    rows = [(k, "x" * 19 + "\n" + "é" * 20 + "\n" + "y" * 20) for k in range(3)] + [(7, "z" * 25), (8, "z" * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in ld.keep_bitmaps(docs).collect()}
    assert [found[k].n_dropped for k in (0, 1, 2, 7, 8)] == [2, 2, 0, 0, 0]
    assert ld.unpack_keep(3, found[0].keep).tolist() == [True, False, False]
    assert ld.keep_bitmaps(awkward.empty(spark)).count() == 0


def test_plan_reads_two_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert ld.keep_bitmaps(docs).agg(F.sum("n_dropped")).first()[0] > 0
