"""Scalar functions of the graph and fingerprint stages (GRF1-2, FPR1-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.scalars import py_strip

EPOCH_ISO = "1970-01-01T00:00:00Z"
ISO_OUT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# ISO-8601 shapes Python's datetime.fromisoformat accepts (extended format).
_ISO_RE = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
           r"(?:[T ][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?)?"
           r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?$")

# Fixed values (must equal the reference): user-agent markers treated as
# generic/common by the fingerprint noise filter.
COMMON_USER_AGENT_MARKERS = ("mozilla/", "chrome/", "safari/", "edge/", "aegis-node/2.0")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def iso_utc_timestamp(col) -> Column:
    """Text re-rendered as ``yyyy-MM-ddTHH:mm:ssZ`` in UTC; unparsable -> 1970 (GRF1)."""
    c = _c(col).cast("string")
    parsed = F.when(c.rlike(_ISO_RE), F.regexp_replace(c, ",", ".").try_cast("timestamp"))
    return F.coalesce(F.date_format(parsed, ISO_OUT_FORMAT), F.lit(EPOCH_ISO))


def iso_to_seconds(col) -> Column:
    """Epoch seconds of a string produced by :func:`iso_utc_timestamp`."""
    return F.unix_seconds(_c(col).try_cast("timestamp"))


def normalize_headers(col) -> Column:
    """Trim, lower-case, drop blanks, sort (GRF2). Null array -> empty array."""
    cleaned = F.transform(F.coalesce(_c(col), F.array().cast("array<string>")),
                          lambda h: F.lower(py_strip(F.coalesce(h, F.lit("None")))))
    return F.sort_array(F.filter(cleaned, lambda h: h != ""))


def interval_bucket(col) -> Column:
    """Inter-arrival seconds -> coarse bucket label (FPR1)."""
    c = _c(col)
    return (F.when(c < 0, "unknown").when(c == 0, "zero").when(c <= 5, "1_5s")
            .when(c <= 30, "6_30s").when(c <= 120, "31_120s").otherwise("121s_plus"))


_SEP, _DQ = "\u0001", "\u0002"


def py_list_repr(headers) -> Column:
    """``str(list_of_str)`` as Python prints it, without a lambda.

    Elements are joined on a private separator and rewritten with a fixed
    chain of regex passes (all native, codegen-friendly):
    backslash / newline / CR / tab escapes; elements holding a single quote
    but no double quote are marked for double quotes; single quotes in the
    other elements are escaped; every element is wrapped in its quotes.
    Exact for strings without other control characters.
    """
    h = _c(headers)
    s = F.array_join(h, _SEP)
    s = F.regexp_replace(s, r"\\", r"\\\\")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    # element with ' and no " -> wrapped in the double-quote marker
    s = F.regexp_replace(s, f"(?<=^|{_SEP})([^{_SEP}\"]*'[^{_SEP}\"]*)(?={_SEP}|$)", f"{_DQ}$1{_DQ}")
    # remaining single quotes (outside marked elements) are escaped
    s = F.regexp_replace(s, f"'(?=[^{_SEP}{_DQ}]*({_SEP}|$))", r"\\'")
    # unmarked elements get single quotes
    s = F.regexp_replace(s, f"(?<=^|{_SEP})(?!{_DQ})([^{_SEP}]*)", "'$1'")
    s = F.regexp_replace(F.regexp_replace(s, _DQ, '"'), _SEP, ", ")
    return F.when(F.size(h) == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), s, F.lit("]")))


def fingerprint_key(headers, user_agent, bucket) -> Column:
    """SHA-256 hex of ``str(headers) + user_agent + bucket`` (FPR2)."""
    return F.sha2(F.concat(py_list_repr(headers), _c(user_agent), _c(bucket)), 256)


def is_common_user_agent(col, markers=COMMON_USER_AGENT_MARKERS) -> Column:
    """True when the lower-cased user agent contains a common marker (FPR3)."""
    lowered = F.lower(_c(col))
    out = F.lit(False)
    for marker in markers:
        out = out | F.contains(lowered, F.lit(marker))
    return out
