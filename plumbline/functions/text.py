"""Column expressions that read messy text: null tokens, numbers, dates, casing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of a missing value, compared after trimming and lower-casing.
NULL_TOKENS = (
    "", "n/a", "na", "null", "none", "nan", "?", "-", "--",
    "unknown", "pending", "pending...", "missing", "zero", "$ -", "free", "call for price", "0000-00-00",
)

# Characters and unit words that may surround a number.
NUMBER_SYMBOLS = "$,€£¥%"
UNIT_WORDS = r"usd|eur|gbp|sqft|sq\s*ft|mg/dl|kg|lbs|mmhg"

# Spark's cast also takes 12d, 0x1p3, Infinity and NaN; only plain and scientific notation count here.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

WHITESPACE = " \t\r\n\f\x0b"

# Accepted date notations, each behind a cheap test of its shape so that a value meets
# only the parser it can satisfy. The ISO and slashed year-first forms go through Spark's own cast.
ISO_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
YEAR_FIRST_SLASH_SHAPE = r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
DATE_FORMATS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
)


def trimmed(c: Column) -> Column:
    """``c`` without leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_token(c: Column) -> Column:
    """True where a text value only spells out that it is missing."""
    return F.lower(trimmed(c)).isin(*NULL_TOKENS)


def without_null_tokens(c: Column) -> Column:
    """``c`` with null tokens turned into null."""
    return F.when(~is_null_token(c), c)


def strip_number_text(c: Column) -> Column:
    """Text with currency signs, thousands commas, percent signs and unit words removed.

    A unit may follow the digits directly (``45kg``) or stand as a word (``3,144 SQ FT``).
    """
    bare = F.translate(c, NUMBER_SYMBOLS, "")
    unit = rf"(?i)(?<![A-Za-z_])(?:{UNIT_WORDS})\b"
    return trimmed(F.when(bare.rlike("[A-Za-z]"), F.regexp_replace(bare, unit, "")).otherwise(bare))


def to_number(c: Column, percent_as_fraction: bool = False) -> Column:
    """Double read from messy text, null where it is not a number.

    A percent sign is dropped without scaling unless ``percent_as_fraction`` is set.
    """
    # Matching and extracting in one step: the stripped text is computed once per value.
    matches = F.regexp_extract_all(strip_number_text(c), F.lit(NUMBER_PATTERN), F.lit(0))
    number = F.try_element_at(matches, F.lit(1)).try_cast("double")
    if percent_as_fraction:
        number = F.when(c.contains("%"), number / 100).otherwise(number)
    return number


def coerce_number(c: Column, dtype: str) -> Column:
    """A double from a column of any type, null where it is not a number (also for NaN)."""
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("double"))
    if dtype == "string":
        bare = trimmed(c)
        return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))
    if dtype == "boolean" or dtype in ("tinyint", "smallint", "int", "bigint") or dtype.startswith("decimal"):
        return c.cast("double")
    return F.lit(None).cast("double")


def to_timestamp(c: Column) -> Column:
    """Timestamp read from text in any of the accepted notations, null otherwise."""
    text = trimmed(c)
    # What stands where in every value of a shape; most values meet one pattern at most.
    fifth, fourth = F.substring(text, 5, 1), F.substring(text, 4, 1)
    parsed = F.when((fifth == "-") & text.rlike(ISO_SHAPE), text.try_cast("timestamp")).when(
        (fifth == "/") & text.rlike(YEAR_FIRST_SLASH_SHAPE), F.translate(text, "/", "-").try_cast("timestamp")
    )
    for (shape, pattern), likely in zip(DATE_FORMATS, (text.contains("/"), text.contains("-"), fourth == " ")):
        parsed = parsed.when(likely & text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    return parsed


def collapse_spaces(c: Column) -> Column:
    """Trimmed text with every run of whitespace turned into one space."""
    # A single space, as most texts have them, is left as it is.
    return F.regexp_replace(trimmed(c), r"\s{2,}|[\t\n\x0B\f\r]", " ")


def title_case(c: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case.

    ``initcap`` starts a word after a space only. So a marked space goes before every letter that
    follows another non-letter (``e-commerce``, ``o'brien``) and is taken out again.
    """
    mark = "\x01 "
    spread_out = F.regexp_replace(c, r"([^\p{L} ])(?=\p{L})", "$1" + mark)
    return F.replace(F.initcap(spread_out), F.lit(mark), F.lit(""))


def compact_number(c: Column) -> Column:
    """``1.2M``, ``3.4K`` or ``5.6``."""
    size = F.abs(c)
    return (
        F.when(size >= 1e6, F.format_string("%.1fM", c / 1e6))
        .when(size >= 1e3, F.format_string("%.1fK", c / 1e3))
        .otherwise(F.format_string("%.1f", c))
    )


def display(c: Column, dtype: str) -> Column:
    """A value as shown in a row listing: numbers rounded to 2, timestamps as dates."""
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return F.date_format(c, "yyyy-MM-dd")
    if dtype in ("double", "float"):
        return F.round(c, 2).cast("string")
    return c.cast("string")
