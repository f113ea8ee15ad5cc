"""Quality rules as a short-circuit cascade (operator 10), DataFrame functions only.

Base figures are computed for every document.  The verdict of the rules below them is a conjunction, so its value
does not depend on the order of the rules; their order decides the work.  `plan_cascade` runs each rule many times
over a sample in one job, takes its net seconds and its rejections, and orders by rejections per second; `verdict` nests the rules so
that a later rule is only evaluated where all earlier ones pass.

A word is a run of characters other than space, \\t, \\n, \\v, \\f, \\r.  Null text is the empty text: no word, so it
fails the base.  Rows are independent; ties, repeated rows and empty tables need no rule, and other columns stay out.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, whole_text

SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def window_hashes(words: Column) -> Column:
    """The hash of the WINDOW words from each word on, by doubling.  No lambda refers to another array: a filter that
    Catalyst pushes below this projection then costs a constant factor, not a scan for each element."""
    grams, width = words, 1
    while width < WINDOW:
        grams = F.zip_with(grams, shifted(grams, width), lambda a, b: F.xxhash64(a, b))
        width *= 2
    return F.slice(grams, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def ranked_windows(grams: Column) -> Column:
    """(hash, start) of all windows, sorted, so that equal windows stand side by side; empty where all differ."""
    ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), ranked).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))


def repeat_words(ranked: Column) -> Column:
    """Words inside windows found twice or more, from the column of ranked_windows."""
    nothing = F.lit(None).cast("struct<g:bigint,i:int>")
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    after = F.zip_with(ranked, shifted(ranked, 1), lambda x, y: F.struct(x["i"].alias("i"), same(x, y).alias("twice")))
    before = F.zip_with(ranked, F.concat(F.array(nothing), ranked), same)
    marked = F.zip_with(after, before, lambda x, b: F.when(x["twice"] | b, x["i"]))
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])


def base_figures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    # Projections of their own, so that words, lines and windows are made once a row, and other figures taken from them.
    rows = rows.select("*", F.filter(F.split("text", SPACE_RUN), lambda w: w != "").alias("_said"), F.split("text", "\n", -1).alias("_all"))
    lines = F.filter("_all", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    rows = rows.select("doc_id", "text", F.length(F.array_join("_said", "")).alias("_chars"), F.transform("_said", lambda w: F.xxhash64(w)).alias("_words"), F.size("_all").alias("n_lines"), lines.alias("_lines"))
    rows = rows.select("*", window_hashes(F.col("_words")).alias("_windows"))
    rows = rows.select("*", ranked_windows(F.col("_windows")).alias("_ranked"))
    figures = rows.select(
        "doc_id",
        "text",
        "n_lines",
        n.cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_ranked")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return figures.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Rule:
    """`fails` is a predicate over the columns of base_figures."""

    name: str
    fails: Callable[[], Column]


def symbol_share() -> Column:
    return 10 * F.col("n_symbols") > F.col("n_words")


def word_length() -> Column:
    return (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))


def duplicate_lines() -> Column:
    return 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")


def shouting() -> Column:
    """Over half of all letters are upper case."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return 2 * F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) > letters


def exclaiming() -> Column:
    return 2 * (F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit("")))) > F.col("n_words")


def lettered_words() -> Column:
    """Less than 7 in 10 words hold a letter."""
    return 10 * F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*")) < 7 * F.col("n_words")


RULES = (
    Rule("symbol_share", symbol_share),
    Rule("word_length", word_length),
    Rule("duplicate_lines", duplicate_lines),
    Rule("shouting", shouting),
    Rule("exclaiming", exclaiming),
    Rule("lettered_words", lettered_words),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def plan_cascade(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeats: int = 8, runs: int = 1) -> list[Measured]:
    """Rules by rejections per second on a sample of base_figures; rules that reject none go last, cheapest first.

    A job evaluates one rule `repeats` times on every row of the sample, so that the evaluations outweigh the job's own
    time; the time of the same job with an empty test is taken off.  The least of `runs` counts, after code generation.
    """
    sample = cut(sample).where(~F.col("base_failed"))
    copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def measured(test: Column) -> tuple[float, int]:
        job, taken = copies.agg(F.count_if(test)), []
        for _ in range(runs + 1):
            began = time.perf_counter()
            hits = job.first()[0]
            taken.append(time.perf_counter() - began)
        return min(taken[1:]), hits // repeats

    empty, _ = measured(F.col("_copy") < 0)
    found = []
    for rule in rules:
        seconds, rejected = measured(rule.fails())
        found.append(Measured(rule, max(seconds - empty, 0.0) / repeats, rejected))
    return sorted(found, key=lambda m: (-m.worth, m.seconds))


def verdict(rules: list[Rule]) -> Column:
    """True where the base and all rules pass; CASE stops at the first that fails."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        out = out.when(rule.fails(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base figures, base_failed, kept.  The order of the rules comes from about `sample_rows` rows."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    order = plan_cascade(base_figures(docs.sample(share, seed), id_column, text_column), rules)
    rows = base_figures(docs, id_column, text_column)
    return rows.withColumn("kept", verdict([m.rule for m in order])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same figures and verdict in DuckDB SQL.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select doc_id, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o || ' ' || lead(word, 5) over o || ' ' || lead(word, 6) over o || ' ' || lead(word, 7) over o as gram from u window o as (partition by doc_id order by i)),
r as (select doc_id, i from g where gram is not null qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct i + k) as n from r, (select unnest(range(8)) as k) group by doc_id),
f as (select w.doc_id, text, len(words)::bigint as n_words,
        length(array_to_string(words, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(c.n, 0)::bigint as n_repeat_words,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) as lettered
        from w left join c on w.doc_id is not distinct from c.doc_id),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
    or 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
    or 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(text, '[^\p{L}]+', '', 'g'))
    or 2 * (length(text) - length(replace(text, '!', ''))) > n_words
    or 10 * lettered < 7 * n_words) as kept
from b
"""
