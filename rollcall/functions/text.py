"""Text canonical forms as Column expressions.

Rows in plain ASCII stay inside whole-stage codegen. Only other rows carry a value into the
Arrow UDFs; for ASCII rows their argument is NULL.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rollcall import fixed_values as fixed

# The characters that separate words: Unicode white space and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_NOT_WORD = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"


@F.pandas_udf(StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore"
    )


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each worked out once for a row.

    A filter on a plain new column is moved below it, and its expression evaluated there a second time; it is not moved
    below a generator.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return rows.select("*", made.alias("__once")).select(*rows.columns, *[F.col(f"__once.{name}").alias(name) for name in columns])


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def _only_other(value: Column, native: Column, udf) -> Column:
    plain = is_ascii(value)
    return F.when(plain, native).otherwise(udf(F.when(~plain, value)))


def folded(value: Column | str) -> Column:
    """NFKC, then full case folding."""
    value = col(value)
    return _only_other(value, F.lower(value), _nfkc_casefold)


def casefold(value: Column | str) -> Column:
    value = col(value)
    return _only_other(value, F.lower(value), _casefold)


def nfkc(value: Column | str) -> Column:
    value = col(value)
    return _only_other(value, value, _nfkc)


def unescape_html(value: Column | str) -> Column:
    """Decode character references; rows without ``&`` never reach Python."""
    value = col(value)
    has_reference = value.contains("&")
    return F.when(has_reference, _unescape(F.when(has_reference, value))).otherwise(value)


def strip(value: Column | str) -> Column:
    return F.regexp_replace(col(value), f"^{SPACE}+|{SPACE}+$", "")


def collapse(value: Column | str) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(col(value), f"{SPACE}+", " "))


def identity_text(value: Column | str) -> Column:
    """Identity form: folded, punctuation and underscores are blanks, blanks collapsed."""
    words = F.regexp_replace(folded(value), _NOT_WORD, " ")
    return collapse(F.translate(words, "_", " "))


def location_text(value: Column | str) -> Column:
    """Location form for hashing: folded and collapsed, punctuation kept."""
    return collapse(folded(value))


def location_display(values: Column | str) -> Column:
    """A list of places as one text; blanks dropped, repeats dropped, order kept."""
    parts = F.array_distinct(F.filter(F.transform(col(values), collapse), lambda p: p != ""))
    return F.coalesce(F.nullif(F.array_join(parts, "; "), F.lit("")), F.lit(fixed.UNSPECIFIED))


def closed_flag(json_value: Column | str) -> Column:
    """Read a closed flag kept as JSON text; NULL where it cannot be read.

    A missing value is open. Numbers are closed only when equal to 1. Strings are compared
    with the fixed words, white space around them ignored.
    """
    words = casefold(col(json_value))

    def read(text: Column) -> Column:
        def quoted(options) -> Column:
            pattern = "|".join(o for o in options if o)
            blank = "?" if "" in options else ""
            return text.rlike(rf'(?U)^"(?:\\[tnr]|\s)*(?:{pattern}){blank}(?:\\[tnr]|\s)*"$')

        return (
            F.when(text.isNull() | (text == "null"), F.lit(False))
            .when(quoted(fixed.CLOSED_WORDS), F.lit(True))
            .when(quoted(fixed.OPEN_WORDS), F.lit(False))
            .when(text.isin("true", "false"), text == "true")
            .when(text.rlike(r"^-?\d+$"), text == "1")
        )

    return let(F.trim(words), read)


def job_type(value: Column | str) -> Column:
    """Canonical job type label; aliases resolved, unknown labels kept."""

    def resolve(label: Column) -> Column:
        out = label
        for alias, name in fixed.JOB_TYPE_ALIASES.items():
            out = F.when(label == alias, F.lit(name)).otherwise(out)
        return out

    return let(F.translate(F.lower(strip(value)), "- ", "__"), resolve)
