"""Parsing and quality rules for raw response logs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality bits. Stored data depends on the numbers.
QUALITY_BITS = {
    "UNKNOWN_QUESTION": 1,
    "MISSING_CORRECT_ANSWER": 2,
    "MISSING_SKILL_TAG": 4,
    "NON_MONOTONIC_INPUT": 8,
    "DUPLICATE_EVENT": 16,
    "INVALID_RESPONSE": 32,
    "NEGATIVE_ELAPSED_TIME": 64,
    "EXTREME_ELAPSED_TIME": 128,
    "QUESTION_BEFORE_DEPLOYMENT": 256,
    "INVALID_TIMESTAMP": 512,
    "INVALID_SOLVING_ID": 1024,
    "INVALID_ELAPSED_TIME": 2048,
}
# Rows with any of these bits never reach the reference tables (1+2+4+16+32+512).
EXCLUDED_BITS = 567
VALID_ANSWERS = ("a", "b", "c", "d")
NO_TAGS = ("", "-1", "nan", "None", "null")
DAY_MS = 86_400_000.0


# Every character that counts as white space when stripping.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(c: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def parse_int(c: Column) -> Column:
    """Signed decimal integer with optional ``_`` between digits; anything else is null.

    The regular expression runs only on text that has an underscore."""
    text = trimmed(c)
    grouped = F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(F.contains(text, F.lit("_")), grouped).otherwise(text.try_cast("bigint"))


def normalize_answer(c: Column) -> Column:
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def tag_list(c: Column) -> Column:
    """Distinct non-negative tags in first-seen order."""
    tokens = F.transform(F.split(trimmed(c), ";"), trimmed)
    numbers = F.transform(F.filter(tokens, lambda t: t.rlike(r"^-?\d+$")), lambda t: t.cast("bigint"))
    kept = F.array_distinct(F.filter(numbers, lambda n: n >= 0))
    empty = F.array().cast("array<bigint>")
    return F.when(c.isNull() | trimmed(c).isin(*NO_TAGS), empty).otherwise(kept)


def tag_text(tags: Column) -> Column:
    return F.array_join(tags.cast("array<string>"), ";")


def only_tag(tags: Column) -> Column:
    """The tag when there is exactly one, else null."""
    return F.when(F.size(tags) == 1, F.get(tags, F.lit(0)))


def is_correct(known: Column, correct_answer: Column, user_answer: Column) -> Column:
    scorable = known & correct_answer.isNotNull() & user_answer.isin(*VALID_ANSWERS)
    return F.when(scorable, user_answer == correct_answer)


def bit(name: str, condition: Column) -> Column:
    return F.when(condition, F.lit(QUALITY_BITS[name])).otherwise(F.lit(0))


def has_bit(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(QUALITY_BITS[name])) != 0


def flag_names(flags: Column) -> Column:
    """Names of the set bits in bit order."""
    named = F.array(*[F.struct(F.lit(v).alias("bit"), F.lit(n).alias("name")) for n, v in QUALITY_BITS.items()])
    return F.transform(F.filter(named, lambda s: flags.bitwiseAND(s.bit) != 0), lambda s: s["name"])


def question_number(question_id: Column) -> Column:
    """The integer of ``q<integer>``; other ids raise."""
    number = F.when(question_id.rlike(r"^q\d+$"), F.substring(question_id, 2, 20).cast("bigint"))
    bad = F.raise_error(F.concat(F.lit("not a q<integer> id: "), F.coalesce(question_id, F.lit("null"))))
    return F.coalesce(number, bad.cast("bigint"))
