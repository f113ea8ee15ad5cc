import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import id_shards
from tests.llm import awkward

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_equal_the_library():
    encoder, encode, rng = id_shards.ChunkEncoder(PATH, "<u2", pieces=7), library(), random.Random(3)
    letters = [*"abé's.,!?;Aİß ́½²\n\t  \x1c\x85 #-_<>|’漢😀1̈ò ~^", "<|endoftext|>", "<|startoftext|>", "x" * 60]
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(10)]
        for text, ids in zip(texts, encoder(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == encode(text), repr(text)


def test_special_strings_are_special_ids():
    assert np.frombuffer(id_shards.ChunkEncoder(PATH, "<u2")(pa.array(["a <|endoftext|> b<|startoftext|>."]))[0], "<u2").tolist() == library()("a <|endoftext|> b<|startoftext|>.")
    assert 49407 in library()("a <|endoftext|> b")


def test_slices_keep_all_texts_in_order():
    texts = ["a" * k for k in (0, 5, 3, 30, 1, 1)]
    parts = list(id_shards.slices(pa.array(["-", *texts]).slice(1), 8))
    assert [x for part in parts for x in part.to_pylist()] == texts and len(parts) == 3 and list(id_shards.slices(pa.array([], pa.string()))) == []


def test_perfect_hash_is_minimal_and_survives_storage():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        perfect = id_shards.PerfectHash.build(keys)
        assert sorted(perfect(keys)) == list(range(len(keys)))
        back, _ = id_shards.PerfectHash.from_bytes(perfect.to_bytes())
        assert (back(keys) == perfect(keys)).all()
    stubborn = id_shards.PerfectHash([], [], [], keys[:100])
    assert sorted(stubborn(keys[:100])) == list(range(100))


def test_files_hold_all_ids_in_order(spark):
    encode = library()
    store, entries = id_shards.write_and_index(awkward.unique(spark), PATH, 2, vocabulary=49_408, shard_ids=5_000)
    found = {r.doc_id: r for r in id_shards.lookup(store, entries).collect()}
    start = 0
    for doc, text in awkward.unique_rows():
        ids = [*encode(text), 2]
        assert found[doc].ids == ids and found[doc].start == start and found[doc].n_tokens == len(ids)
        start += len(ids)
    assert store.shards.count() > 3
    digests = {r.doc_id: r.ids_digest for r in id_shards.lookup(store, entries, id_shards.crc32_of_ids).collect()}
    assert digests == {k: zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for k, r in found.items()}


def test_absent_keys_are_not_found(spark):
    store, _ = id_shards.write_and_index(awkward.unique(spark), PATH, 2)
    keys = spark.createDataFrame([(k, 0) for k in range(10**6, 10**6 + 200)] + [(5, 0), (5, 1)], "doc_id long, occurrence long")
    assert [(r.doc_id, r.occurrence) for r in id_shards.lookup(store, keys).collect()] == [(5, 0)]


def test_awkward_rows(spark):
    store, entries = id_shards.write_and_index(awkward.documents(spark), PATH, 2, vocabulary=100_000)
    found = id_shards.lookup(store, entries).collect()
    assert len(found) == len(awkward.rows()) == len({(r.doc_id, r.occurrence) for r in found})
    encode = library()
    assert sorted(map(str, (r.ids for r in found))) == sorted(str([*encode(r[1] or ""), 2]) for r in awkward.rows())
    store, entries = id_shards.write_and_index(awkward.empty(spark), PATH, 2)
    assert id_shards.lookup(store, entries).count() == 0
