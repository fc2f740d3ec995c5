"""Cleaning, flagging and comparing of untrusted strings, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that are Python strings at a time.
AT_ONCE = 1 << 20
#: The longest kept field, the reasons of flags, the task prefix of embedded texts.
MAX_POINTS = 256
INVALID_UTF8 = "invalid UTF-8 replaced"
CONTROLS = "control or format characters removed"
TRUNCATED = "truncated to 256 runes"
SQL_LIKE = "SQL-like content"
MARKUP = "markup-like content"
TASK_PREFIX = "clustering: "

#: Fixed patterns, as both Java's and RE2's syntax read them.
SPACES = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
REMOVED = "[\\p{Cc}\\p{Cf}]"
SQL_PATTERN = (
    ";|--|/\\*|\\*/|['\"`]\\s*\\)?\\s*(?i:\\b(?:select|insert|update|delete|drop|union|exec|alter|create|truncate)\\b|or\\s+['\"\\d])"
)
MARKUP_PATTERN = "(?i)<\\s*/?\\s*script|javascript:"
#: Texts without any of these can't be changed or matched by the patterns above, which cost several times as much.
BEYOND_PLAIN = "[^ -~]"
SQL_CHARACTERS = "[-;/*'\"`]"
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _normalized(texts: pa.Array, form: str) -> Iterator[pa.Array]:
    """A few texts at a time: as Python strings a batch of long ones takes several times its bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield pa.array([None if s is None else unicodedata.normalize(form, s) for s in texts.slice(at, to - at).to_pylist()], pa.string())
        at = to


def _normalizer(form: str):
    @F.arrow_udf(T.StringType())  # not over an iterator: those of several columns would each be a pass of its own
    def normalize(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays(_normalized(texts, form)) if len(texts) else texts

    def apply(text: Column) -> Column:
        """Only texts that hold more than ASCII go to Python; in the others nothing can change."""
        return F.coalesce(normalize(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)

    return apply


_nfc, _nfkd = _normalizer("NFC"), _normalizer("NFKD")


def nfc(text: Column) -> Column:
    return _nfc(text)


def repair_utf8(raw: bytes) -> tuple[str, bool]:
    """Bytes as text, one replacement character for each run of invalid bytes; whether there was any."""
    try:
        return raw.decode("utf-8"), False
    except UnicodeDecodeError:  # one pass: invalid bytes become lone surrogates, which valid text can't hold
        return re.sub("[\udc80-\udcff]+", "\ufffd", raw.decode("utf-8", "surrogateescape")), True


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("repaired", T.BooleanType())]))
def repair(raw: pd.Series) -> pd.DataFrame:
    """Binary input as valid text, with whether it was repaired; NULL stays NULL."""
    fixed = [(None, False) if b is None else repair_utf8(bytes(b)) for b in raw]
    return pd.DataFrame(fixed, columns=["text", "repaired"])


def spaced(text: Column) -> Column:
    """Unicode white space as plain spaces."""
    return F.regexp_replace(text, SPACES, " ")


def uncontrolled(text: Column) -> Column:
    """Without control and format characters; apply after ``spaced``."""
    return F.regexp_replace(text, REMOVED, "")


def collapsed(text: Column) -> Column:
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, " +", " ")).otherwise(text))


def capped(text: Column, most: int = MAX_POINTS) -> Column:
    return F.when(F.char_length(text) > most, F.rtrim(F.substring(text, 1, most))).otherwise(text)


def uncapped(text: Column, normalize=nfc) -> Column:
    """Everything that sanitizing does before the cap on the length."""
    return collapsed(normalize(F.when(text.rlike(BEYOND_PLAIN), uncontrolled(spaced(text))).otherwise(text)))


def sanitize(text: Column) -> Column:
    return capped(uncapped(text))


def had_controls(text: Column) -> Column:
    return text.rlike(BEYOND_PLAIN) & spaced(text).rlike(REMOVED)


def sql_like(text: Column) -> Column:
    return text.rlike(SQL_CHARACTERS) & text.rlike(SQL_PATTERN)


def markup_like(text: Column) -> Column:
    return (text.contains("<") | text.contains(":")) & text.rlike(MARKUP_PATTERN)


def flags(field: str, raw: Column, full: Column, clean: Column, repaired: Column | None = None) -> Column:
    """The field's flags in their fixed order; ``full`` is the value before the cap."""
    tests = (
        (F.lit(False) if repaired is None else repaired, INVALID_UTF8),
        (had_controls(raw), CONTROLS),
        (F.char_length(full) > MAX_POINTS, TRUNCATED),
        (sql_like(clean), SQL_LIKE),
        (markup_like(clean), MARKUP),
    )
    found = [F.when(test, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))) for test, reason in tests]
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def identity(name: Column, brand: Column, category: Column) -> Column:
    """The text that stands for a product: blank parts are left out."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(" | ", F.when(name != "", name), part("brand", brand), part("category", category))


def prefixed(text: Column) -> Column:
    return F.concat(F.lit(TASK_PREFIX), text)


def accent_folded(text: Column) -> Column:
    """Lower case without combining marks."""
    return F.lower(F.regexp_replace(_nfkd(text), "\\p{Mn}", ""))


def match_key(text: Column) -> Column:
    """The loosest form of a name: letters and digits only, accents folded, lower case."""
    return F.lower(F.regexp_replace(_nfkd(text), "[^\\p{L}\\p{Nd}]", ""))


#: From strict to loose: what two names must share to count as the same.
LADDER = {
    "exact": lambda c: c,
    "collapsed": lambda c: F.lower(collapsed(c)),
    "folded": lambda c: accent_folded(collapsed(c)),
    "alphanumeric": match_key,
}


def same_folded(a: Column, b: Column) -> Column:
    """Equal but for case; NULL is the empty string."""
    return F.lower(F.coalesce(a, F.lit(""))) == F.lower(F.coalesce(b, F.lit("")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
