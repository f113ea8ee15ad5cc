"""The trained language model against a plain-Python twin; its queries are compared with SQL in test_queries."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.functions import language_model as lm
from siltstone.plans import queries

SYLLABLES = {"aa": ["ba", "na", "ko", "é"], "bb": ["sch", "ung", "ü", "ver"], "cc": ["ción", "el", "ña", "ba"]}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(words))


def rows():
    rng = random.Random(2)
    found = [(k, lang, text_of(rng, lang, rng.randint(1, 40))) for k, lang in enumerate(rng.choice(sorted(SYLLABLES)) for _ in range(150))]
    return [*found, (900, None, "no language " * 4), (901, "aa", None), (902, "aa", ""), (903, "bb", "x"), (905, "zz", "only held out " * 3), (906, "cc", "😀" * 30 + " long " * 3000)]


def twin(table, buckets):
    """The definition, one text after another: (detect, temperature)."""
    grams = lambda t: Counter((ord(a) * 7919 + ord(b) * 104729 + ord(c) * 1299709) % buckets for a, b, c in zip(t, t[1:], t[2:], strict=False))
    learn = [(lang, t) for k, lang, t in table if k % 5 and lang is not None and t is not None]
    langs = sorted({lang for lang, _ in learn})
    seen = {lang: sum((grams(t) for x, t in learn if x == lang), Counter()) for lang in langs}
    total = {lang: sum(seen[lang].values()) for lang in langs}
    prior = {lang: round(1000 * math.log(sum(x == lang for x, _ in learn) / len(learn))) for lang in langs}
    weight = lambda lang, b: round(1000 * math.log((seen[lang][b] + 1) / (total[lang] + buckets)))
    scores = lambda t: {lang: prior[lang] + sum(n * weight(lang, b) for b, n in grams(t).items()) for lang in langs}
    held = [(lang, scores(t)) for k, lang, t in table if k % 5 == 0 and lang in langs and t is not None]
    loss = lambda temp: sum(math.log(sum(math.exp(min((v - s[lang]) / 1000 / temp, 700)) for v in s.values())) for lang, s in held)
    temperature = min(lm.TEMPERATURES, key=lambda t: (loss(t), t))

    def detect(text):
        if text is None or len(text.strip()) < 20:
            return "unknown", 0.0
        s = scores(text)
        best = min(s, key=lambda lang: (-s[lang], lang))
        return best, 1 / sum(math.exp((v - s[best]) / 1000 / temperature) for v in s.values())

    return detect, temperature


@pytest.mark.parametrize("buckets", [16_384, 64])
def test_model_equals_its_definition(spark, buckets):
    """64 buckets make languages that are hard to tell apart, and a temperature of their own."""
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, lang string, text string").repartition(5)
    model = lm.trained(docs, F.col("doc_id") % 5 == 0, buckets=buckets)
    detect, temperature = twin(table, buckets)
    assert model.temperature == temperature and model.languages == ("aa", "bb", "cc")
    found = {r.doc_id: r.a for r in docs.select("doc_id", model(F.col("text")).alias("a")).collect()}
    for k, _, text in table:
        lang, confidence = detect(text)
        assert found[k].lang == lang and found[k].confidence == pytest.approx(confidence, abs=1e-9)
    assert {found[k].lang for k in (901, 902, 903)} == {"unknown"}


def test_model_without_rows_or_with_too_many_languages(spark):
    none = spark.createDataFrame([(1, None, "a text without a language")], "doc_id long, lang string, text string")
    model = lm.trained(none, F.lit(False))
    assert model.detect("a text that no model has learned") == ("unknown", 0.0)
    assert none.select(model(F.col("text")).alias("a")).first().a.lang == "unknown"
    with pytest.raises(ValueError):
        lm.trained(spark.createDataFrame([(k, str(k), "x" * 30) for k in range(4)], "doc_id long, lang string, text string"), F.lit(False), most_languages=3)


def test_foreign_documents_are_rejected(spark):
    folder = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.filter_by_model(spark, folder).collect()
    foreign = [r for r in found if r.web_reason == "non_english_web"]
    assert len(foreign) > 20 and all(lang[r.doc_id] != "en" for r in foreign) and any(r.doc_reason == "non_english_doc" for r in found)
    assert all(r.web_reason is not None for r in found if lang[r.doc_id] != "en")
