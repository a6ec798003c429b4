"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text read as null. First the tokens of the record contract, then the usual
# missing-value spellings of CSV readers.
NULL_TOKENS = [
    "NULL", "null", "None", "NONE", "nan", "NaN", "",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "n/a",
]

# Placeholders that count as blank, compared upper-cased and stripped.
BLANK_WORDS = ["", "NULL", "NAN", "NONE"]
NOT_A_JUNCTION = ["", "NULL", "NO JUNCTION", "NAN", "NONE"]

_WHITESPACE = " \t\n\r\x0b\x0c"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_ZONE_SUFFIX = r"(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)$"

# Accepted spellings of a record's creation time, besides ISO-like text.
TIME_FORMATS = ["dd-MM-yyyy HH:mm:ssXXX", "dd/MM/yyyy HH:mm:ssXXX"]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WHITESPACE))


def null_if_token(sql: str) -> Column:
    """The text the SQL expression gives, or null for a missing-value spelling."""
    # One SQL text instead of a call per token: a plan has many of these columns.
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    return F.expr(f"CASE WHEN {sql} NOT IN ({tokens}) THEN {sql} END")


def present(c: Column) -> Column:
    """Stripped text, or null when it is blank or a placeholder."""
    text = strip(c)
    return F.when(~F.upper(text).isin(BLANK_WORDS), text)


def canonical(primary: Column, fallback: Column, default: str) -> Column:
    return F.coalesce(present(primary), present(fallback), F.lit(default))


def filled(c: Column, default: str) -> Column:
    return strip(F.coalesce(c, F.lit(default)))


def number(c: Column) -> Column:
    """Double from text; anything that is not a plain number becomes null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def with_offset(text: Column) -> Column:
    """Stripped time text with a UTC offset added where it has none."""
    return (
        F.when(text.rlike(r"\d{2}:\d{2}.*" + _ZONE_SUFFIX), text)
        .when(text.rlike(r"\d{1,2}:\d{2}"), F.concat(text, F.lit("Z")))
        .otherwise(F.concat(text, F.lit(" 00:00:00Z")))
    )


def instant(zoned: Column) -> Column:
    """Instant from text with an offset; unreadable text is null."""
    return F.coalesce(
        F.try_to_timestamp(zoned), *[F.try_to_timestamp(zoned, F.lit(f)) for f in TIME_FORMATS]
    )
