import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import fim, language, paths
from siltstone.functions import text as tx
from siltstone.functions.tokens import BYTES, byte_token_count

PIECES = ["the ", "and", " ", "\n", "\t", "é", "語", "　", "\x1c", "\x85", "9", "$", "\\$", "\\begin{", "\\end{", "|||||", "A", "!!", "cookie ", "_", "😀"]


def texts(n=150, seed=5):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "x" * 11, "-" * 10, "-" * 11, " " * 11, "\r" * 11, "\n" * 11] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id int, text string").coalesce(2)


def checked(rows, column, expected):
    found = dict(rows.select("id", column.alias("v")).collect())
    for k, t in enumerate(texts()):
        assert found[k] == expected(t), repr(t)


def repeated(t):
    kept = [x.strip() for x in t.split("\n") if x.strip()]
    return (len(kept) - len(set(kept))) / len(kept) if kept else 0.0


def test_text_features_equal_python(rows):
    t = F.col("text")
    checked(rows, tx.alnum_ratio(t), lambda x: sum(c.isalnum() for c in x) / len(x) if x else 0.0)
    checked(rows, tx.num_lines(t), lambda x: len(x.split("\n")))
    checked(rows, tx.max_line_length(t), lambda x: max(map(len, x.split("\n"))))
    checked(rows, tx.mean_line_length(t), lambda x: sum(map(len, x.split("\n"))) / len(x.split("\n")))
    checked(rows, tx.blank_line_ratio(t), lambda x: sum(not y.strip() for y in x.split("\n")) / len(x.split("\n")))
    checked(rows, tx.strip(t), str.strip)
    checked(rows, tx.content_hash(t), lambda x: hashlib.sha256(re.sub(r"\s+", " ", x.strip().lower()).encode()).hexdigest())
    checked(rows, tx.repeated_line_ratio(t), repeated)
    checked(rows, tx.unescaped_dollars(t), lambda x: x.count("$") - x.count("\\$"))
    checked(rows, tx.has_ocr_artifact(t), lambda x: bool(re.search(r"[^\x00-\x7F]{10,}|[\x00-\x08\x0e-\x1f]{3,}|(.)\1{10,}|[|]{5,}", x)))
    checked(rows, tx.token_estimate(t), lambda x: max(1, len(x) // 4))
    checked(rows, byte_token_count(t), lambda x: len(x.encode()) + 1)


def test_ngrams_are_sets_of_the_normalized_text(rows):
    found = rows.select("id", tx.letters(F.col("text")).alias("c")).select("id", tx.char_ngrams(F.col("c")).alias("g")).collect()
    for k, grams in found:
        body = re.sub(r"\s+", " ", texts()[k].strip().lower())
        assert len(grams) == len(set(grams)) and set(grams) == {body[i : i + 5] for i in range(len(body) - 4)}


@pytest.mark.parametrize(
    ("path", "generated", "lock", "data", "doc"),
    [
        ("pkg/api_pb2.py", True, False, False, False),
        ("src/app.min.js", True, False, False, False),
        ("web/dist/app.js", True, False, False, False),
        ("dist/app.js", False, False, False, False),
        ("a/Cargo.lock", False, True, True, False),
        ("package.json", False, False, True, False),
        ("tsconfig.json", False, False, False, False),
        (".github/workflows/ci.yml", False, False, False, False),
        ("docs/my_makefile_notes.yaml", False, False, False, True),
        (".json", False, False, False, False),
        ("..json", False, False, True, False),
        ("a.json/", False, False, True, False),
        ("name.", False, False, False, False),
        ("x/README", False, False, False, True),
        ("docs/a.py", False, False, False, True),
        ("x/LICENSE.md", False, False, False, False),
        ("SECURITY.txt", False, False, False, False),
        ("src/main.c", False, False, False, False),
        ("src/history.py", False, False, False, True),
    ],
)
def test_paths(spark, path, generated, lock, data, doc):
    p = F.lit(path)
    row = spark.range(1).select(paths.is_generated(p), paths.is_lock_file(p), paths.is_data_file(p), paths.is_documentation(p)).first()
    assert tuple(row) == (generated, lock, data, doc)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", ("unknown", 0.0)),
        (None, ("unknown", 0.0)),
        ("x" * 19 + "   ", ("unknown", 0.0)),
        ("x" * 59 + "é" * 41, ("unknown", 0.1)),
        ("the and of " + "x" * 40, ("en", 0.95)),
        ("the and of " + "x" * 79 + "é" * 10, ("en", 0.88)),
        ("x" * 100, ("en", 0.75)),
        ("x" * 75 + "é" * 25, ("unknown", 0.4)),
        ("x" * 2000 + " the and of is", ("en", 0.75)),
        ("the_and_of_is " + "x" * 30, ("en", 0.75)),
    ],
)
def test_language_rule(spark, text, expected):
    found = spark.createDataFrame([(text,)], "t string").select(language.language(F.col("t")).alias("a")).first().a
    assert (found.lang, found.confidence) == expected


def test_model_hook(spark):
    detect = language.model_language(lambda x: ("xx", 0.5))
    found = spark.createDataFrame([("long enough to be detected",), ("short",), (None,)], "t string").select(detect(F.col("t")).alias("a")).collect()
    assert [tuple(r.a) for r in found] == [("xx", 0.5), ("unknown", 0.0), ("unknown", 0.0)]


def test_fim(spark):
    bodies = ["a", "a\nb", "a\nb\nc"] + ["\n".join(f"l{k}" for k in range(n)) for n in range(4, 40)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, t string").select("id", "t", fim.fim_parts(F.col("t"), F.col("id")).alias("p"), fim.fim_text(F.col("t"), F.col("id")).alias("f")).collect()
    for r in rows:
        n = len(r.t.split("\n"))
        if n < 3:
            assert r.p is None and r.f == r.t
            continue
        prefix, middle, suffix = (x.split("\n") for x in r.p)
        assert "\n".join([*prefix, *middle, *suffix]) == r.t
        assert 1 <= len(prefix) <= n - 2 and 1 <= len(middle) <= min(5, n - len(prefix) - 1)
        assert r.f == f"<|fim_prefix|>{r.p.prefix}<|fim_suffix|>{r.p.suffix}<|fim_middle|>{r.p.middle}"
    assert tuple(rows[2].p) == ("a", "b", "c")
    chosen = spark.range(1000).select(fim.maybe_fim(F.lit("a\nb\nc"), F.lit("code"), F.col("id"), 0.5).alias("t"), fim.maybe_fim(F.lit("a\nb\nc"), F.lit("web"), F.col("id"), 0.5).alias("w"), fim.maybe_fim(F.lit("a\nb\nc"), F.lit("code"), F.col("id"), 0.5, compat=True).alias("c"))
    counts = chosen.agg(F.count_if(F.col("t").startswith("<|")), F.count_if(F.col("w").startswith("<|")), F.count_if(F.col("c").startswith("<|"))).first()
    assert 400 < counts[0] < 600 and counts[1] == 0 and counts[2] == 0


def test_byte_tokenizer(spark):
    found = spark.createDataFrame([("aé",), ("",), (None,)], "t string").select(BYTES.encode_col(F.col("t")).alias("ids")).collect()
    assert [r.ids for r in found] == [[97, 195, 169, 256], [256], [256]]
