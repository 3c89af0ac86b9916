"""Column -> Column scalar functions (all native Spark expressions)."""

from vigil.functions.scalars import (  # noqa: F401
    py_strip, safe_get, safe_int, safe_str, safe_str_upper, is_py_infinity,
    normalize_timestamp, safe_float,
)
from vigil.functions.hardware import validate_hardware_id, MALICIOUS_KEYWORDS  # noqa: F401
from vigil.functions.graphfn import (  # noqa: F401
    iso_utc_timestamp, normalize_headers, interval_bucket, fingerprint_key,
    is_common_user_agent, COMMON_USER_AGENT_MARKERS,
)
