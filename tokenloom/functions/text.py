"""Text columns: blank lines, normalisation and the units that pieces may not cross."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.tables import USER_SYMBOLS

# The characters that str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SPACE_MARK = "▁"
_DIGITS = "0-9０-９"
_MARKED = "|".join(s.replace("|", r"\|") for s in USER_SYMBOLS)

# A unit is a run of letters, one digit, a chat marker, a run of other characters, a lone space
# mark, or a newline. Pieces never cross units, so units can be counted and encoded on their own.
# The repeats are possessive: no unit needs backtracking, and runs of any length match without it.
UNIT = (
    rf"{SPACE_MARK}?[\p{{L}}\p{{M}}]++"
    rf"|[{_DIGITS}]"
    rf"|{_MARKED}"
    rf"|{SPACE_MARK}?(?:[^\p{{L}}\p{{M}}{_DIGITS}{SPACE_MARK}\n<]++|(?!{_MARKED})<)++"
    rf"|{SPACE_MARK}|\n"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(line: Column) -> Column:
    return strip(line) == ""


_TEXTS_AT_ONCE = 256


@F.arrow_udf(T.StringType())
def _compatibility_form(texts: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    for at in range(0, len(texts), _TEXTS_AT_ONCE):
        some = texts.slice(at, _TEXTS_AT_ONCE).to_pylist()
        folded = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in some]
        parts.append(pa.array(folded, pa.string()))
    return pa.concat_arrays(parts)


def normalize(text: Column, form: str = "identity") -> Column:
    """Collapse runs of spaces, drop them at the ends, and mark every word start.

    ``form="nfkc"`` first applies Unicode compatibility folding and turns all whitespace,
    newlines included, into spaces.
    """
    if form not in ("identity", "nfkc"):
        raise ValueError(f"unknown normalisation form: {form}")
    if form == "nfkc":
        text = _compatibility_form(text)
    body = F.btrim(text, F.lit(" "))
    marked = F.when(F.contains(body, F.lit("  ")), F.regexp_replace(body, " +", SPACE_MARK)).otherwise(
        F.replace(body, F.lit(" "), F.lit(SPACE_MARK))
    )
    return F.when(body == "", "").otherwise(F.concat(F.lit(SPACE_MARK), marked))


def units(text: Column, form: str = "identity") -> Column:
    """The units of a text, in order; concatenated they give the normalised text back."""
    return F.regexp_extract_all(normalize(text, form), F.lit(UNIT), F.lit(0))


def characters(text: Column) -> Column:
    """The code points of a text, one string each."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
