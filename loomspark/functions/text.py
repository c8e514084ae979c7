"""Scalar functions: trimming, alias keys, identifiers, framed digests, first failures."""

from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import functions as F

#: The characters with Unicode property White_Space.
WHITE_SPACE = "\t\n\v\f\r\x20\x85\xa0                　"
_RUN = re.compile(f"[{WHITE_SPACE}]+")
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"


def trim_unicode(c):
    """Trims all Unicode white space (the built-in trims U+0020 only)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def alias_key(text: str | None) -> str | None:
    """White space collapsed, NFKC, collapsed again, full case fold; null if nothing is left."""
    if text is None:
        return None
    x = _RUN.sub(" ", text).strip(" ")
    x = _RUN.sub(" ", unicodedata.normalize("NFKC", x)).strip(" ").casefold()
    return x or None


def alias_key_column(c):
    """:func:`alias_key` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(alias_key, na_action="ignore")

    return run(c)


def uuid5(namespace: str, name):
    """Version-5 UUID of a string or binary column, as lower-case text."""
    raw = F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), name.cast("binary"))
    h = F.sha1(raw)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def framed_bytes(c):
    """Bytes behind their length in eight big-endian bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0")), c)


def framed(c):
    """A string as UTF-8 bytes behind its length in eight big-endian bytes."""
    return framed_bytes(c.cast("binary"))


def timestamp_ms(c):
    """Epoch milliseconds of a timestamp in the ledger's grammar, null if it isn't one."""
    # the parser's offsets end at 18 hours, the grammar's at 23:59: offsets are taken off here
    local = F.unix_millis(F.try_to_timestamp(F.concat(F.upper(F.substring(c, 1, 23)), F.lit("Z"))))
    minutes = F.substring(c, 25, 2).cast("int") * 60 + F.substring(c, 28, 2).cast("int")
    sign = F.when(F.substring(c, 24, 1) == "-", -1).otherwise(1)
    shift = F.when(F.length(c) == 29, sign * minutes).otherwise(0).cast("long") * 60_000
    return F.when(c.rlike(TIMESTAMP), local - shift)


def first_failure(*checks):
    """(failed condition, code) pairs -> code of the first that fails, null if none does.

    A null condition counts as failed."""
    out = None
    for bad, code in checks:
        bad = F.coalesce(bad, F.lit(True))
        out = F.when(bad, code) if out is None else out.when(bad, code)
    return out
