"""Secrets that the scan must find whole, and look-alikes that it must leave."""

import random
import re
import string

import public_tokenizers
import pytest

from siltstone.llm import secret_scan

DICTIONARY = secret_scan.Dictionary.from_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
MIXED = string.ascii_letters + string.digits


def random_of(size, letters=MIXED, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(size))


def jwt(size, seed=2):
    return "eyJ" + random_of(33, seed=seed) + "." + random_of(size - 81, MIXED + "-_", seed + 1) + "." + random_of(43, MIXED + "-_", seed + 2)


@pytest.fixture(scope="module")
def found(spark):
    forest = secret_scan.train(dictionary=DICTIONARY)

    def scan(texts):
        rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), forest).collect()
        return [[texts[r.doc_id][x.begin : x.end] for x in r.secrets] for r in sorted(rows, key=lambda r: r.doc_id)]

    return scan


@pytest.mark.parametrize("secret", [jwt(822), random_of(201), random_of(3000, MIXED + "+/") + "==", random_of(150) + "." + random_of(400)], ids=["jwt", "201", "blob", "dotted"])
def test_long_assigned_values_are_found_whole(found, secret):
    assert found([f'the token = "{secret}" is here', f"password={secret}\nnext"]) == [[secret], [secret]]


PEM = "\n".join(random_of(64, MIXED + "+/", 20 + k) for k in range(25)) + "\n" + random_of(30, MIXED + "+/") + "=="
LETTERS = random_of(40, string.ascii_letters, 5)
#: Text with the secret in place of {}, and the secret.
BARE = {
    "aws": ("we logged {} by mistake", "AKIA" + random_of(16, string.ascii_uppercase + string.digits, 3)),
    "github": ("use {} to clone", "ghp_" + random_of(36, seed=4)),
    "jwt": ("then send {} again", jwt(822, 7)),
    "slack": ("see xyz, {} works", "xoxb-123456789012-" + random_of(24, seed=8)),
    "bearer": ("curl -H 'Authorization: Bearer {}' host", random_of(43, seed=6)),
    "bearer without digit": ("Authorization: Bearer {}", LETTERS),
    "basic": ("Authorization: Basic {}\nHost: a", random_of(30, seed=9) + "=="),
    "url": ("open postgres://admin:{}@db.host:5432/x now", random_of(14, seed=10)),
    "url without digit": ("open amqp://guest:{}@mq", random_of(18, string.ascii_letters, 11)),
    "url with a long user": ("at https://" + random_of(70, string.ascii_lowercase, 12) + ":{}@host/x", random_of(20, seed=13)),
    "pem": ("-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----\n", PEM),
    "pem in json": ('"private_key": "-----BEGIN PRIVATE KEY-----\\n{}\\n-----END PRIVATE KEY-----\\n"', PEM.replace("\n", "\\n")),
    "pem cut off": ("-----BEGIN EC PRIVATE KEY-----\n{}\nthe rest of it is prose", PEM[: 64 * 6 + 5]),
}


@pytest.mark.parametrize("name", BARE)
def test_secrets_without_an_assignment_are_found_whole(found, name):
    text, secret = BARE[name]
    assert found([text.replace("{}", secret)]) == [[secret]]


def test_look_alikes_of_the_bare_forms_are_left(found):
    texts = ["commit " + random_of(40, "0123456789abcdef") + " was merged", "a run " + random_of(30) + " in prose", "-" * 60, "the_name_of_some_handler_in_code", "key ghp_" + "x" * 36, "Authorization: Bearer your_token_here", "http://user:password@host", "the bearer of authentication certificates", "http://host:8080/path@x"]
    assert found(texts) == [[]] * len(texts)


def test_planted_tokens_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secret_scan.scan(docs, secret_scan.train(dictionary=DICTIONARY)).join(docs.select("doc_id", "text"), "doc_id").collect()
    planted = [(r.doc_id, m[1]) for r in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)]
    assert len(planted) >= 13 and sorted((r.doc_id, r.text[x.begin : x.end]) for r in rows for x in r.secrets) == sorted(planted)


def test_dictionary_signs():
    words = secret_scan.Dictionary(frozenset({"pass", "word", "password", "file"}))
    assert words.covered("mypasswordfile") == 12 and words.covered("pasword") == 4 and words.covered("") == 0
    assert words.likelihood("password") > words.likelihood("xqzvkjwp") and words.likelihood("12") == 0.0


def test_runs_without_a_digit_are_candidates():
    assert secret_scan.candidates(f"so {LETTERS} here") == [(3, 43)]


def test_a_run_around_a_key_is_judged_too():
    key, rest = BARE["aws"][1], random_of(40, MIXED + "+/", 30)
    text = f"{rest}/{key}/{rest} x"
    assert [text[a:b] for a, b in secret_scan.candidates(text)] == [rest + "/", key, "/" + rest]
