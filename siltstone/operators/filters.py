"""Per-domain filters that report the first failing rule (O-35 to O-41).

A filter is one CASE column, `reason`: the name of the first rule that fails, null where all pass.  CASE stops at the
first match, so cheap rules come first and costly expressions run only where they are reached.  All limits are
inclusive on the passing side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import language, paths, text

Detector = Callable[[Column], Column]


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is true; a null test is a pass."""
    (name, test), *rest = rules
    out = F.when(test, F.lit(name))
    for name, test in rest:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


@dataclass(frozen=True)
class CodeLimits:
    least_bytes: int = 100
    most_bytes: int = 1_000_000
    least_alnum: float = 0.25
    least_lines: int = 3
    most_lines: int = 10_000
    line_length: int = 1_000
    long_lines: int = 2
    excluded_suffixes: tuple[str, ...] = ()


def code_reason(body: Column, path: Column, size_bytes: Column, limits: CodeLimits = CodeLimits()) -> Column:
    """Source files.  An absent size is the UTF-8 length of the text; a size of 0 is what a loader gives for a missing one."""
    size = F.coalesce(size_bytes, F.octet_length(body))
    path, body = F.coalesce(path, F.lit("")), F.coalesce(body, F.lit(""))
    n = text.num_lines(body)
    return first_failing(
        [
            ("too_small", size < limits.least_bytes),
            ("too_large", size > limits.most_bytes),
            ("generated_file", paths.is_generated(path)),
            ("lockfile", paths.is_lock_file(path)),
            ("data_file", paths.is_data_file(path)),
            ("excluded_extension", paths.has_excluded_suffix(path, limits.excluded_suffixes)),
            ("low_alphanumeric_ratio", text.alnum_ratio(body) < limits.least_alnum),
            ("too_few_lines", n < limits.least_lines),
            ("too_many_lines", n > limits.most_lines),
            ("lines_too_long", (text.max_line_length(body) > limits.line_length) & (text.long_lines(body, limits.line_length) > limits.long_lines)),
            ("empty", text.strip(body) == ""),
        ]
    )


@dataclass(frozen=True)
class DocLimits:
    least_chars: int = 200
    most_chars: int = 500_000
    least_alnum: float = 0.50
    confidence: float = 0.70
    repeated_lines: float = 0.4
    guard_lines: int = 5
    check_language: bool = True


def doc_reason(body: Column, limits: DocLimits = DocLimits(), detect: Detector | None = language.language) -> Column:
    """Documentation."""
    body = F.coalesce(body, F.lit(""))
    rules = [
        ("doc_too_short", F.length(body) < limits.least_chars),
        ("doc_too_long", F.length(body) > limits.most_chars),
        ("doc_low_alnum", text.alnum_ratio(body) < limits.least_alnum),
    ]
    if limits.check_language and detect is not None:
        rules.append(("non_english_doc", language.is_foreign(detect(body), limits.confidence)))
    # All lines count for the guard, content lines only for the ratio.
    rules.append(("doc_boilerplate", text.mostly_repeated(body, limits.guard_lines, limits.repeated_lines)))
    return first_failing(rules)


@dataclass(frozen=True)
class WebLimits:
    least_chars: int = 200
    most_chars: int = 200_000
    least_alnum: float = 0.60
    least_quality: float | None = None
    confidence: float = 0.70
    check_language: bool = True
    check_boilerplate: bool = True


def web_reason(body: Column, quality: Column | None = None, limits: WebLimits = WebLimits(), detect: Detector | None = language.language) -> Column:
    """Web text.  A null quality passes any threshold."""
    body = F.coalesce(body, F.lit(""))
    rules = [
        ("web_too_short", F.length(body) < limits.least_chars),
        ("web_too_long", F.length(body) > limits.most_chars),
        ("web_low_alnum", text.alnum_ratio(body) < limits.least_alnum),
    ]
    if limits.least_quality is not None and quality is not None:
        rules.append(("web_low_quality", F.coalesce(quality < limits.least_quality, F.lit(False))))
    if limits.check_language and detect is not None:
        rules.append(("non_english_web", language.is_foreign(detect(body), limits.confidence)))
    if limits.check_boilerplate:
        rules.append(("web_boilerplate", text.is_boilerplate(body)))
    return first_failing(rules)


@dataclass(frozen=True)
class MathLimits:
    least_chars: int = 100
    most_chars: int = 200_000
    repeated_lines: float = 0.3
    guard_lines: int = 5
    confidence: float = 0.60
    check_ocr: bool = True
    check_latex: bool = True
    check_language: bool = True


def math_reason(body: Column, limits: MathLimits = MathLimits(), detect: Detector | None = language.language) -> Column:
    """Mathematical text."""
    body = F.coalesce(body, F.lit(""))
    rules = [("math_too_short", F.length(body) < limits.least_chars), ("math_too_long", F.length(body) > limits.most_chars)]
    if limits.check_ocr:
        rules.append(("math_ocr_artifact", text.has_ocr_artifact(body)))
    if limits.check_latex:
        rules += [("math_broken_latex", text.has_broken_latex(body)), ("math_unmatched_env", text.has_unmatched_environment(body))]
    repeats = lambda found: (F.size(found) > limits.guard_lines) & (text.repeated_share(found) > limits.repeated_lines)
    rules.append(("math_repeated_content", text.bound(text.content_lines(body), repeats)))
    if limits.check_language and detect is not None:
        rules.append(("non_english_math", language.is_foreign(detect(body), limits.confidence)))
    return first_failing(rules)


@dataclass(frozen=True)
class FunctionLimits:
    least_chars: int = 50
    most_chars: int = 50_000
    least_alnum: float = 0.30


def function_reason(body: Column, identifier: Column, limits: FunctionLimits = FunctionLimits()) -> Column:
    """Functions.  A null or blank identifier fails."""
    body = F.coalesce(body, F.lit(""))
    return first_failing(
        [
            ("vault_too_short", F.length(body) < limits.least_chars),
            ("vault_too_long", F.length(body) > limits.most_chars),
            ("vault_low_alnum", text.alnum_ratio(body) < limits.least_alnum),
            ("vault_no_identifier", text.strip(F.coalesce(identifier, F.lit(""))) == ""),
        ]
    )


#: Source kind -> reason over a frame with the canonical columns (O-41, O-68).
REASONS: dict[str, Callable[[DataFrame], Column]] = {
    "code": lambda df: code_reason(F.col("text"), F.col("file_path"), F.col("size_bytes")),
    "docs": lambda df: doc_reason(F.col("text")),
    "web": lambda df: web_reason(F.col("text"), F.col("quality_score") if "quality_score" in df.columns else None),
    "math": lambda df: math_reason(F.col("text")),
    "functions": lambda df: function_reason(F.col("text"), F.col("identifier")),
}


#: Every reason that a kind's filter gives, in the order of its rules.
REASON_NAMES: dict[str, tuple[str, ...]] = {
    "code": ("too_small", "too_large", "generated_file", "lockfile", "data_file", "excluded_extension", "low_alphanumeric_ratio", "too_few_lines", "too_many_lines", "lines_too_long", "empty"),
    "docs": ("doc_too_short", "doc_too_long", "doc_low_alnum", "non_english_doc", "doc_boilerplate"),
    "web": ("web_too_short", "web_too_long", "web_low_alnum", "web_low_quality", "non_english_web", "web_boilerplate"),
    "math": ("math_too_short", "math_too_long", "math_ocr_artifact", "math_broken_latex", "math_unmatched_env", "math_repeated_content", "non_english_math"),
    "functions": ("vault_too_short", "vault_too_long", "vault_low_alnum", "vault_no_identifier"),
}


def filtered(df: DataFrame, kind: str) -> DataFrame:
    """Rows that pass; code rows get alnum_ratio and num_lines.  An unknown kind gives no rows."""
    if kind not in REASONS:
        return df.limit(0)
    kept = df.where(REASONS[kind](df).isNull())
    if kind == "code":
        kept = kept.withColumns({"alnum_ratio": text.alnum_ratio(F.col("text")), "num_lines": text.num_lines(F.col("text"))})
    return kept


def filter_stats(reasons: DataFrame) -> DataFrame:
    """reason, n: rows by outcome, `pass` for null, as an aggregate, since accumulators count retried tasks twice."""
    return reasons.groupBy(F.coalesce("reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


def pass_rate(reasons: DataFrame) -> DataFrame:
    """total_seen, total_passed, pass_rate."""
    seen, passed = F.count("*"), F.count_if(F.col("reason").isNull())
    return reasons.agg(seen.alias("total_seen"), passed.alias("total_passed"), F.coalesce(F.try_divide(passed.cast("double"), seen.cast("double")), F.lit(0.0)).alias("pass_rate"))
