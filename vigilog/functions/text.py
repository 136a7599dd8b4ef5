"""Text helpers: stripping, capturing regex groups in one pass, CSV fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Unicode plus the four information separators.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
# (?U): \w \d \s \b follow Unicode.  (?d): only \n ends a line for '.'.
FLAGS = "(?Ud)"
_CUT = "\x1f"


def strip(text: Column) -> Column:
    """Drop undecodable characters, then whitespace of any kind at both ends."""
    clean = F.replace(text, F.lit("�"), F.lit(""))
    return F.regexp_replace(clean, f"(?U)^{SPACE}+|{SPACE}+$", "")


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def capture(text: Column, pattern: str, groups: int) -> Column:
    """Groups of ``pattern`` (anchored at the start only): element i is group i, NULL if no match.

    One regex pass writes the groups side by side and one split takes them
    apart; ``regexp_extract`` per group would match the line again each time.
    Lines that hold the separator themselves take the per-group way. Read the
    result with :func:`group`; a group that took no part in a match is ''.
    """
    anchored = f"{FLAGS}^{pattern}"
    joined = F.regexp_replace(
        text, anchored + r"[\s\S]*$", _CUT + _CUT.join(f"${i}" for i in range(1, groups + 1))
    )
    per_group = F.when(
        F.regexp_like(text, F.lit(anchored)),
        F.array(F.lit(""), *[F.regexp_extract(text, anchored, i) for i in range(1, groups + 1)]),
    )
    return F.when(F.contains(text, F.lit(_CUT)), per_group).otherwise(F.split(joined, _CUT, -1))


def group(captured: Column, index: int) -> Column:
    return F.get(captured, F.lit(index))


def first_match(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match anywhere in the text, NULL if there is none."""
    return empty_to_null(F.regexp_extract(text, FLAGS + pattern, index))


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line as an array; quoted fields lose their quotes."""
    tokens = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1)
    )
    unquoted = F.transform(
        tokens,
        lambda t: F.when(
            F.startswith(t, F.lit('"')),
            F.replace(F.regexp_replace(t, r'^"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"')),
        ).otherwise(t),
    )
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.split(line, ",", -1))


def digits_or_text(value: Column) -> Column:
    """A number where the text is all digits, else the text, as VARIANT for JSON output."""
    number = F.when(F.regexp_like(value, F.lit("^[0-9]+$")), value.try_cast("bigint"))
    return F.coalesce(number.cast("variant"), value.cast("variant"))


def stage(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once, however often and wherever it is used.

    A plain projection lets filters above it be rewritten in terms of its
    expression, which repeats an expensive regex for every reference. A
    one-element generator keeps later filters above the computed value.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
