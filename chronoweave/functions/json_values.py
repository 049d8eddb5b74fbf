"""Canonical form of JSON property values, so that equal values compare equal as strings."""

from __future__ import annotations

import json
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Values the JVM canonicalises itself: plain ASCII strings without escapes, and whole numbers.
_PLAIN_STRING = r'^ *"[\x20\x21\x23-\x5B\x5D-\x7E]*" *$'
_WHOLE_NUMBER = r"^(0|-?[1-9][0-9]{0,17})$"


def _reject(constant: str) -> None:
    raise ValueError(constant)


def _number(text: str) -> str:
    sign, digits, exponent = Decimal(text).as_tuple()
    whole = "".join(map(str, digits)).lstrip("0")
    if not whole:
        return "n0e0"
    short = whole.rstrip("0")
    return f"n{'-' if sign else ''}{short}e{exponent + len(whole) - len(short)}"


class _Number(str):
    """A JSON number, kept as its canonical text."""


def _parse(text: str) -> object:
    as_number = lambda t: _Number(_number(t))
    return json.loads(text, parse_float=as_number, parse_int=as_number, parse_constant=_reject)


def _nested(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_nested(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_nested, value)) + "]"
    return json.dumps(value)


@lru_cache(maxsize=100_000)
def canonical(text: str) -> str | None:
    """Canonical text of one value; None for JSON null. Text that is not JSON is a plain string."""
    try:
        value = _parse(text)
    except (ValueError, RecursionError):
        value = text
    if value is None:
        return None
    if isinstance(value, str) and not isinstance(value, _Number):
        return "s" + value.strip().casefold()
    return _nested(value)


@F.pandas_udf(StringType())
def _canonical_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical(v))


def canonical_value(value: Column) -> Column:
    """Canonical text of a JSON value: null for SQL null and JSON null, equal exactly for equal values.

    Numbers compare by amount, objects in any key order, top-level strings regardless of letter case and outer
    blanks. The common plain forms are handled by built-in functions; only the rest visits Python, in Arrow batches.
    """
    bare = F.trim(value)
    plain = value.rlike(_PLAIN_STRING)
    whole = value.rlike(_WHOLE_NUMBER)
    zeros = F.length(F.regexp_extract(value, "(0*)$", 1))
    number = F.when(value == "0", F.lit("n0e0")).otherwise(F.concat(F.lit("n"), F.rtrim(value, F.lit("0")), F.lit("e"), zeros.cast("string")))
    text = F.concat(F.lit("s"), F.lower(F.trim(bare.substr(F.lit(2), F.length(bare) - 2))))
    return F.when(plain, text).when(whole, number).otherwise(_canonical_batch(F.when(~plain & ~whole, value)))
