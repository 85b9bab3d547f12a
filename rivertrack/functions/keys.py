"""Tag keys: ``149.500 007`` = frequency with three decimals, blank, code padded to three."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def tag_key(freq, code) -> Column:
    """One key on metadata and receiver side alike; NULL if either part is NULL."""
    freq, code = _col(freq), _col(code)
    key = F.concat_ws(
        " ", freq.cast("decimal(6,3)").cast("string"), F.format_string("%03d", code)
    )
    return F.when(freq.isNotNull() & code.isNotNull(), key)


def normalise_key(key) -> Column:
    """Pad the trailing code of an existing key to three digits, and its frequency to three
    decimals. Keys without a numeric code (``149.48 3?``) stay as they are."""
    key = _col(key)
    freq = F.regexp_extract(key, r"^(\d+\.\d+)\s+\d+$", 1)
    code = F.regexp_extract(key, r"(\d+)$", 1)
    # try_cast of '' is NULL, so a key of another shape falls through to itself
    return F.coalesce(tag_key(freq.try_cast("decimal(6,3)"), code.try_cast("int")), key)


def pad_two_digit_code(key) -> Column:
    """Pad a two-digit code inside an existing key; other keys are left alone."""
    key = _col(key)
    two = F.length(F.regexp_extract(key, r"\d+$", 0)) == 2
    return F.when(two, F.regexp_replace(key, r"(\s)(\d{2})$", "$10$2")).otherwise(key)
