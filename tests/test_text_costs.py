"""Text features that were slow equal the plain statement of their rule."""

import random
import re

from pyspark.sql import functions as F

from siltstone.functions import text as tx

ONE_PATTERN = r"[^\x00-\x7F]{10,}|[\x00-\x08\x0e-\x1f]{3,}|([^\n])\1{10,}|[|]{5,}"
PIECES = ["the ", "and", " ", "\n", "\t", "é", "語", "　", "\x1c", "\x00", "\x7f", "||", "aaaa", "ééé", "😀", "ИЖ", "İ", "ΑΣ ", " "]


def awkward(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "\x7f", "~", "!", "\x7f ", "|||||", "x" * 11, "é" * 9, "é" * 10] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate([*texts, None])), "id int, text string").coalesce(2)


def test_ocr_marks_equal_one_pattern_of_alternatives_without_it(spark):
    t = F.col("text")
    assert awkward(spark).where(~tx.has_ocr_artifact(t).eqNullSafe(t.rlike(ONE_PATTERN))).count() == 0
    plan = awkward(spark).select(tx.has_ocr_artifact(t).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "}|" not in plan and plan.count("RLIKE") == 3


def test_content_lines_equal_trimmed_lines(spark):
    t = F.col("text")
    plain = F.filter(F.transform(tx.lines(t), lambda x: F.btrim(x, F.lit(tx.WHITE_CHARACTERS))), lambda x: x != "")
    assert awkward(spark).where(~tx.content_lines(t).eqNullSafe(plain)).count() == 0
    share = tx.repeated_line_ratio(t) > 0.4
    assert awkward(spark).where(~tx.mostly_repeated(t, 5, 0.4).eqNullSafe((tx.num_lines(t) > 5) & share)).count() == 0


def test_ngrams_of_a_text_equal_slices(spark):
    t = F.col("text")
    df = awkward(spark)
    for body, grams in df.where("text is not null").select(tx.normalized(t), tx.text_ngrams(tx.normalized(t))).collect():
        assert len(grams) == len(set(grams)) and set(grams) == {body[k : k + 5] for k in range(len(body) - 4)}
    for raw, body in df.where("text is not null").select("text", tx.normalized(t)).collect():
        assert body == re.sub(r"\s+", " ", raw.lower().strip())


def test_white_class_holds_the_white_characters_only(spark):
    """Of all code points outside the surrogates; printable ASCII and Latin-1 are told by one table, without a range."""
    codes = [k for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    text = "".join(map(chr, codes))
    df = spark.createDataFrame([(text,)], "text string")
    left = df.select(F.regexp_replace("text", f"{tx.WHITE_CLASS}+", "")).first()[0]
    assert left == "".join(c for c in text if c not in tx.WHITE_CHARACTERS)
    assert tx.WHITE_CLASS.count("^") == 0 and all(rf"\x{k:02x}" in tx.WHITE_CLASS for k in (0x0B, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0))
