"""Text functions: normal form, percentages, data URLs, spreadsheet guard."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python takes for white space beyond the (?U)\s of Java.
SPACE = "[\\s\\x1c-\\x1f\\x85]"


def _fold(x: str | None) -> str | None:
    if x is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", x).split()).casefold() or None


def _ascii_digits(x: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if not c.isascii() and c.isdecimal() else c for c in x)


def _mapped(f: Callable[[str], str | None], x: pd.Series) -> pd.Series:
    """f of each text of a batch, called once for each distinct one."""
    known = {v: f(v) for v in x.dropna().unique()}
    return x.map(known) if known else x


@F.pandas_udf(StringType())
def fold_udf(x: pd.Series) -> pd.Series:
    """NFKC, one space for each run of white space, trimmed, case-folded; empty is null."""
    return _mapped(_fold, x)


@F.pandas_udf(StringType())
def fold_digits_udf(x: pd.Series, digits: pd.Series) -> pd.Series:
    """The same; where ``digits`` holds, all decimal digits as 0-9."""
    out = _mapped(_fold, x)
    return out.where(~digits, _mapped(_ascii_digits, out)) if digits.any() and out.notna().any() else out


@F.pandas_udf(StringType())
def compatible_udf(x: pd.Series) -> pd.Series:
    """NFKC and trimmed, case kept; empty stays empty."""
    return _mapped(lambda s: unicodedata.normalize("NFKC", s).strip(), x)


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.char_length(x)


def _or_udf(x: Column, fast: Column, udf, unicode: bool) -> Column:
    """The built-in form for ASCII rows. Only other rows' values reach Python: ASCII rows send it nulls."""
    if not unicode:
        return fast
    return F.when(is_ascii(x), fast).otherwise(udf(F.when(~is_ascii(x), x)))


def _folded(x: Column) -> Column:
    # a text of blanks alone is null before anything else is done to it
    return F.lower(F.btrim(F.regexp_replace(F.when(x.rlike("[^\\s\\x1c-\\x1f\\x85]"), x), SPACE + "+", " ")))


def normalise(x: Column, unicode: bool = True) -> Column:
    """The form in which texts are compared; blank is null. ``unicode=False`` promises ASCII and stays in the JVM.
    ``x`` is best a plain column, as it is written more than once."""
    return _or_udf(x, _folded(x), fold_udf, unicode)


def compatible(x: Column, unicode: bool = True) -> Column:
    fast = F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    return _or_udf(x, fast, compatible_udf, unicode)


def overflows(json_text: Column) -> Column:
    """Whether a JSON text has a number beyond a double outside its strings."""
    bare = F.regexp_replace(json_text, '"(?:[^"\\\\]|\\\\.)*+"', '""')
    huge = F.exists(F.regexp_extract_all(bare, F.lit("(-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1)), lambda n: F.abs(n.cast("double")) == F.lit(float("inf")))
    # only an exponent, or more than three hundred digits, can do it
    return F.when(json_text.rlike("[0-9][eE][+]?[0-9]{3}|[0-9]{300}"), F.coalesce(huge, F.lit(False))).otherwise(F.lit(False))


def percent(x: Column) -> Column:
    """Two decimals and a sign; n/a for null."""
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f%%", (x * 100).cast("double")))


def guarded(x: Column) -> Column:
    """A leading quote before what a spreadsheet would take for a formula."""
    return F.when(x.rlike("^[=+\\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def data_url(content: Column, name: Column) -> Column:
    """Binary content as a data URL; the type follows the name, image/png if unknown."""
    ending = F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))
    kind = F.when(ending.isin("jpg", "jpeg", "jpe"), "image/jpeg").when(ending == "gif", "image/gif").when(ending == "webp", "image/webp")
    kind = kind.when(ending == "bmp", "image/bmp").when(ending.isin("tif", "tiff"), "image/tiff").when(ending == "svg", "image/svg+xml")
    return F.concat(F.lit("data:"), kind.otherwise("image/png"), F.lit(";base64,"), F.base64(content))


def blob_sha1(content: Column) -> Column:
    """The SHA-1 that a git blob of this content has."""
    head = F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))
