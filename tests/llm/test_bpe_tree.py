import hashlib
import random

import public_tokenizers
import pytest

from siltstone.llm import bpe_tree
from tests.llm import awkward

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = list("ab'sl ve\n\t  re12é語 \x1c\x1d\x85!$  ́😀")


@pytest.fixture(scope="module")
def tree():
    return bpe_tree.BpeTree.from_file(PATH, public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_tree_equals_the_library_on_random_texts(tree, leaf):
    rng = random.Random(leaf)
    tree.leaf_chars = leaf
    for _ in range(1500):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        ids = tree.encode(text)
        assert ids.tolist() == tree.core.encode_ordinary(text), repr(text)
        assert tree.decode(ids, leaf) == text.encode()


def test_text_without_white_space_and_runs_of_it(tree):
    tree.leaf_chars = 50
    for text in ("abc" * 500, " " * 700, "\n" * 333 + "a", "a" + " " * 500, "'" * 400 + "ll"):
        assert tree.encode(text).tolist() == tree.core.encode_ordinary(text)


def test_round_trip_of_awkward_rows(spark):
    found = bpe_tree.round_trip(awkward.documents(spark), PATH, public_tokenizers.PATTERN, leaf_chars=100).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.decoded_sha256) for r in found if r.doc_id is not None) == sorted((False, r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in awkward.rows() if r[0] is not None)
    assert len(found) == len(awkward.rows()) and any(r.n_tokens == 0 for r in found)
    assert bpe_tree.round_trip(awkward.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_encoding_then_decoding_returns_the_bytes(spark):
    encoded = bpe_tree.encode_texts(awkward.unique(spark), PATH, public_tokenizers.PATTERN)
    found = {r.doc_id: bytes(r.bytes) for r in bpe_tree.decode_ids(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert found == {k: t.encode() for k, t in awkward.unique_rows()}
