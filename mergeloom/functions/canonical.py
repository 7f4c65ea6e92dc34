"""Canonical JSON: keys by UTF-8 bytes at every level, no white space, numbers as doubles."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers that may be nested in one another.
MOST_NESTED = 32


class Uncanonical(ValueError):
    """A value that has no canonical form."""


def number(x: float) -> str:
    """The shortest decimal text that reads back as x; exponents from 1e21 up and below 1e-6."""
    if not math.isfinite(x):
        raise Uncanonical("numbers must be finite")
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, point = (whole + part), len(whole) + int(exponent or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    tail = f".{digits[1:]}" if n > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if e > 0 else '-'}{abs(e)}"


def _quoted(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


#: Control characters with an escape of their own.
_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
#: White space at the ends of a line: also what Unicode calls a separator, and the byte order mark.
_SPACE = r"[\s\x{00A0}\x{FEFF}\p{Z}]+"


def quoted(text: Column) -> Column:
    """A JSON text literal, as canonical texts have it."""
    plain = F.to_json(F.array(text))
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(_ESCAPES.get(chr(i), f"\\u{i:04x}")))
    return F.when(text.rlike(r"[\x00-\x1f]"), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.substring(plain, F.lit(2), F.length(plain) - 2))


def stripped(text: Column) -> Column:
    """text without the white space at its ends, of any kind."""
    return F.regexp_replace(text, rf"^{_SPACE}|{_SPACE}\z", "")


def canonical(value: object, level: int = 0) -> str:
    """The canonical text of a parsed JSON value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        try:
            return number(float(value))
        except OverflowError as e:
            raise Uncanonical("numbers must be finite") from e
    if isinstance(value, str):
        return _quoted(value)
    if level >= MOST_NESTED:
        raise Uncanonical(f"nested more than {MOST_NESTED} deep")
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, level + 1) for v in value) + "]"
    if isinstance(value, dict):
        fields = sorted(value.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
        return "{" + ",".join(f"{_quoted(k)}:{canonical(v, level + 1)}" for k, v in fields) + "}"
    raise Uncanonical(f"no JSON value: {type(value).__name__}")


def canonical_text(text: str | None) -> str | None:
    """text's canonical form; None where it is no JSON, or has none."""
    if text is None:
        return None
    try:
        return canonical(json.loads(text, parse_constant=lambda _: math.inf))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canon_json(text: pd.Series) -> pd.Series:
    """JSON text to its canonical form, null where it has none."""
    return text.map(canonical_text, na_action="ignore").astype(object)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _fields(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> dict | None:
        try:
            value = json.loads(t) if t is not None else None
            return {k: canonical(v, 1) for k, v in value.items()} if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            return None

    return text.map(one).astype(object)


def fields(text: Column) -> Column:
    """A record's JSON text to a map of its fields' canonical values; null for anything but a record."""
    return _fields(text)
