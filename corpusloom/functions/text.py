"""String, number and date expressions with fixed, engine-independent rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .hashing import as_col, hash_token

# Reserved category tokens.
MISSING_TOKEN = "__MISSING__"
RARE_TOKEN = "__RARE__"

# Longest text that is its own key.
KEY_LENGTH = 64

# A number as a whole cell; keeps Java-only spellings such as '1d' out.
NUMBER_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# A date, with or without a time of day. Bare years and integers do not count.
DATE_PATTERN = (
    r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})"
    r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
)
# Whitespace as Unicode defines it.
SPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def normalize_label(name: str, empty: str = "column") -> str:
    """Column-name form of `normalize_name`, for metadata on the driver."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", str(name).strip().lower()).strip("_") or empty


def fixed_point(c, digits: int) -> Column:
    """A double with so many digits after the point, rounded by its exact value and halves to even, as
    Python and C print it; `format_string` rounds the shortest decimals up, 0.825 to 0.83."""
    x = as_col(c).cast("double")
    half = float(f"5e-{digits + 1}")
    sign = F.when(x < 0, "-").otherwise("")
    text = F.call_function("format_number", x, F.lit(f"0.{'0' * digits}"))
    # the pattern takes some lone halves down
    return (F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
            .when(F.abs(x) == half, F.concat(sign, F.lit(f"{half:.{digits}f}"))).otherwise(text))


def normalize_name(c, empty: str = "column") -> Column:
    joined = F.regexp_replace(F.lower(as_col(c)), "[^0-9a-zA-Z]+", "_")
    return F.coalesce(F.nullif(F.btrim(joined, F.lit("_")), F.lit("")), F.lit(empty))


def name_tokens(c, count: int = 4) -> Column:
    """First `count` alphanumeric parts of the lower-cased name, padded with ''."""
    lower = F.lower(as_col(c))
    parts = F.filter(F.split(lower, "[^a-zA-Z0-9]+"), lambda p: p != "")
    fallback = F.array(F.coalesce(F.nullif(lower, F.lit("")), F.lit("column")))
    parts = F.when(F.size(parts) > 0, parts).otherwise(fallback)
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), count)), 1, count)


def tokenize_text(c, count: int = 16) -> Column:
    """Hashed ids of the first `count` whitespace tokens, padded with 0; null gives all zeros. A text is
    read as far as its `count`-th token."""
    raw = as_col(c).cast("string")
    gap = SPACE_CLASS[:-1] + "_]"
    head = F.regexp_extract(raw, f"^(?:{gap}*+{gap.replace('[', '[^', 1)}++){{0,{count}}}+", 0)
    parts = F.filter(F.split(F.regexp_replace(F.lower(head), "_", " "), SPACE_CLASS + "+"), lambda p: p != "")
    # a cell made of underscores only is kept as one token
    bare = F.regexp_replace(F.lower(raw), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    parts = F.when((F.size(parts) == 0) & (bare != ""), F.array(bare)).otherwise(parts)
    ids = F.transform(F.slice(parts, 1, count), hash_token)
    ids = F.coalesce(ids, F.array().cast("array<bigint>"))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), count)), 1, count)


def number_or_null(c, dtype: T.DataType | None = None) -> Column:
    """Double value, or null when the cell is not a number. NaN counts as null."""
    c = as_col(c)
    if dtype is not None and isinstance(dtype, (T.NumericType, T.BooleanType)):
        value = c.cast("double")
        return F.when(F.isnan(value), F.lit(None)).otherwise(value)
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def category(c) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(MISSING_TOKEN))


def value_key(c) -> Column:
    """What stands for a cell in value counts and lookups: the text itself, or its md5 when it is
    long, so that free text is not shuffled as a key. Long numbers stay as they are; a cell that looks
    like a key is digested too, so that it cannot equal one."""
    c = as_col(c)
    plain = (F.length(c) <= KEY_LENGTH) & ~c.startswith("md5:") | c.rlike(NUMBER_PATTERN)
    return F.when(plain, c).otherwise(F.concat(F.lit("md5:"), F.md5(c)))


def datetime_or_null(c) -> Column:
    """Timestamp for `yyyy-MM-dd`, `yyyy/MM/dd` and `MM/dd/yyyy`, each with an optional time."""
    text = as_col(c).cast("string")
    iso = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})", r"$3-$1-$2")
    iso = F.replace(iso, F.lit("/"), F.lit("-"))
    return F.when(text.rlike(DATE_PATTERN), iso.try_cast("timestamp_ntz"))
