"""Text features as Catalyst expressions (O-18, O-19, O-24, O-25, O-27 to O-30)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white-space characters of Unicode text as the filters understand them, 29 code points.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a class: single Latin-1 characters are one table, and the ranges are looked through from U+1680 on only.
WHITE_CLASS = rf"[[\u1680-\u3000&&[{WHITE}]]\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0]"
WHITE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Fixed value: phrases that mark web boilerplate; overlapping phrases count each.
BOILERPLATE_PHRASES = (
    "cookie",
    "privacy policy",
    "terms of service",
    "subscribe to newsletter",
    "sign up for",
    "click here to",
    "all rights reserved",
    "copyright ©",
    "accept cookies",
    "manage consent",
    "we use cookies",
    "cookie settings",
)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0.0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def strip(text: Column) -> Column:
    """Without white space at both ends, all 29 characters of it.

    Trimming by a set of characters lays out the whole text, so texts with printable ASCII at both ends do without.
    `text` is read several times.
    """
    clean = (text >= "!") & (text < "\x7f") & F.substring(text, -1, 1).between("!", "~")
    return F.when(clean, text).otherwise(F.btrim(text, F.lit(WHITE_CHARACTERS)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` reads it.

    Branches of a CASE share nothing in a plan, and a projection below them would compute the value for every row.
    """
    return F.transform(F.array(value), use)[0]


def alnum_ratio(text: Column) -> Column:
    """Letters and numbers over code points; 0.0 for empty text."""
    return ratio(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")), F.length(text))


def lines(text: Column) -> Column:
    """Split at \\n only, trailing empty lines kept."""
    return F.split(text, "\n", -1)


def num_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def max_line_length(text: Column) -> Column:
    return F.array_max(F.transform(lines(text), F.length))


def mean_line_length(text: Column) -> Column:
    """Line lengths sum to the text without its line ends."""
    n = num_lines(text)
    return ratio(F.length(text) - (n - 1), n)


def blank_line_ratio(text: Column) -> Column:
    return ratio(F.size(F.filter(lines(text), lambda x: ~x.rlike(f"[^{WHITE}]"))), num_lines(text))


def long_lines(text: Column, limit: int) -> Column:
    """How many lines are longer than `limit`."""
    return F.size(F.filter(lines(text), lambda x: F.length(x) > limit))


def normalized(text: Column) -> Column:
    """Stripped, lowered, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(text)), f"{WHITE_CLASS}+", " ")


def content_hash(text: Column, normalize: bool = True) -> Column:
    return F.sha2(normalized(text) if normalize else text, 256)


def letters(text: Column) -> Column:
    """The code points of the normalized text."""
    body = normalized(text)
    return F.when(body != "", F.split(body, "")).otherwise(F.array().cast("array<string>"))


def char_ngrams(letters: Column, n: int = 5) -> Column:
    """Distinct code-point n-grams from a column of `letters`; none if there are fewer than n."""
    return text_ngrams(F.array_join(letters, ""), n)


def text_ngrams(body: Column, n: int = 5) -> Column:
    """Distinct code-point n-grams of a text; none if it is shorter than n.

    One pass looks ahead at every place; places between the halves of a surrogate pair are no code points.
    """
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % n), F.lit(1)))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def boilerplate_phrases(text: Column) -> Column:
    """How many of the phrases the lowered text holds."""
    count = lambda low: sum((F.contains(low, F.lit(p)).cast("int") for p in BOILERPLATE_PHRASES[1:]), F.contains(low, F.lit(BOILERPLATE_PHRASES[0])).cast("int"))
    return bound(F.lower(text), count)


def is_boilerplate(text: Column) -> Column:
    """More than 3 phrases, and more than one per 1,000 characters (500-character units, 0.5 each)."""
    return bound(boilerplate_phrases(text), lambda n: many_phrases(n, text))


def many_phrases(n: Column, text: Column) -> Column:
    return (n > 3) & (n / F.greatest(F.length(text) / F.lit(500.0), F.lit(1.0)) > 0.5)


def content_lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return stripped_lines(lines(text))


def stripped_lines(found: Column) -> Column:
    """The same from an array of lines."""
    return F.array_remove(F.transform(found, strip), "")


def repeated_line_ratio(text: Column) -> Column:
    """Share of content lines that repeat an earlier one; 0.0 without any."""
    return bound(content_lines(text), repeated_share)


def mostly_repeated(text: Column, guard: int, share: float) -> Column:
    """More than `guard` lines of any kind, and over `share` of the content lines repeat an earlier one; lines are split once."""
    return bound(lines(text), lambda found: (F.size(found) > guard) & (bound(stripped_lines(found), repeated_share) > share))


def repeated_share(found: Column) -> Column:
    """The same from an array of content lines."""
    return ratio(F.size(found) - F.size(F.array_distinct(found)), F.size(found))


#: Marks of scanning errors.  Java's `.` leaves out more line ends than \n, so the repeated character is stated as a class.
OCR_PIPES, OCR_FOREIGN, OCR_CONTROL, OCR_REPEATED = "|||||", r"[^\x00-\x7F]{10}", r"[\x00-\x08\x0e-\x1f]{3}", r"([^\n])\1{10}"


def has_ocr_artifact(text: Column) -> Column:
    """Any of the marks.  One pattern of alternatives would try all of them at every character, which takes four times as long."""
    return F.contains(text, F.lit(OCR_PIPES)) | ((F.octet_length(text) > F.length(text)) & text.rlike(OCR_FOREIGN)) | text.rlike(OCR_CONTROL) | text.rlike(OCR_REPEATED)


def unescaped_dollars(text: Column) -> Column:
    return occurrences(text, "$") - occurrences(text, "\\$")


def has_broken_latex(text: Column) -> Column:
    """An odd number of unescaped dollar signs over 5."""
    return bound(unescaped_dollars(text), lambda n: (n % 2 != 0) & (n > 5))


def has_unmatched_environment(text: Column) -> Column:
    return bound(occurrences(text, "\\begin{"), lambda begins: (begins > 0) & (F.abs(begins - occurrences(text, "\\end{")) > 2))


def token_estimate(text: Column) -> Column:
    """A token per 4 code points, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
