"""Single registry of queries and their oracles."""

from vigil.plans.oracle import ORACLE as _ORACLE
from vigil.plans.queries import QUERIES as _QUERIES

QUERIES = dict(_QUERIES)
ORACLE = {k: v for k, v in _ORACLE.items() if k in QUERIES}
