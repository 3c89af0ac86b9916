"""Null-safe casts and string cleaning with the reference's Python semantics.

Everything here is a native Catalyst expression, so it stays inside
whole-stage codegen; there is no Python on the row path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's float() grammar for finite numbers: digit groups may contain single
# underscores, an optional fraction and exponent, surrounding whitespace is
# already stripped.  Spark's own cast is looser ('1d' -> 1.0) and stricter
# ('1_000' -> NULL), so the text is checked against this first.
_DIGITS = r"[0-9](?:_?[0-9])*"
PY_FLOAT_RE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
PY_INFINITE = [sign + word for sign in ("", "+", "-") for word in ("inf", "infinity")]
# The white space of Unicode, whole: a list of characters to trim takes a fraction of the time of a pattern.
WHITE_SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """str.strip(): remove leading/trailing (Unicode) whitespace."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def safe_get(col, default) -> Column:
    """Value, or ``default`` when it is null or the empty string (SCL1)."""
    c = _c(col)
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(default)).otherwise(c)


def safe_str(col, default: str | None = "") -> Column:
    """Stripped string, ``default`` when null or blank (SCL3)."""
    s = py_strip(_c(col).cast("string"))
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def safe_str_upper(col, default: str = "") -> Column:
    """Upper-cased :func:`safe_str` (SCL4)."""
    return F.upper(safe_str(col, default))


def is_py_infinity(col) -> Column:
    """True when ``int(float(text))`` would raise OverflowError."""
    s = py_strip(_c(col).cast("string"))
    return F.coalesce(F.lower(s).isin(PY_INFINITE), F.lit(False))


def safe_int(col, default: int = -1) -> Column:
    """``int(float(str(v).strip()))`` truncating toward zero, else ``default`` (SCL2).

    Infinity also maps to ``default`` here; callers that must skip such rows
    test :func:`is_py_infinity` separately.
    """
    s = py_strip(_c(col).cast("string"))
    cleaned = F.replace(s, F.lit("_"), F.lit(""))
    value = F.when(s.rlike(PY_FLOAT_RE), cleaned.try_cast("double").try_cast("bigint"))
    return F.coalesce(value, F.lit(default).cast("bigint"))


def safe_float(col, default: float = 0.0) -> Column:
    """``float(v)`` with null/blank/bad -> ``default`` (DET9)."""
    s = py_strip(_c(col).cast("string"))
    cleaned = F.replace(s, F.lit("_"), F.lit(""))
    value = F.when(s.rlike(PY_FLOAT_RE), cleaned.try_cast("double"))
    return F.coalesce(value, F.lit(float(default)))


def normalize_timestamp(col) -> Column:
    """Timestamp text kept when it looks like a date, else 'UNKNOWN' (SCL5).

    The length test runs before stripping, as in the reference.
    """
    c = _c(col).cast("string")
    ok = (F.length(c) >= 10) & c.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return F.when(F.coalesce(ok, F.lit(False)), py_strip(c)).otherwise(F.lit("UNKNOWN"))


def present_in_order(values, element_type: str = "string") -> Column:
    """Array of the non-null ``values`` in argument order.

    Same result as ``array_compact(array(...))`` but built from ``concat`` of
    conditional one-element arrays: ``array_compact`` is a lambda filter
    internally, which disables whole-stage codegen for its whole projection.
    """
    empty = F.array().cast(f"array<{element_type}>")
    return F.concat(*[F.when(v.isNotNull(), F.array(v)).otherwise(empty) for v in values])
