"""vigil: Spark-native telemetry analytics.

Raw node logs with drifting field names are normalized against a node
registry, scored by declarative detection rules, and turned into an
interaction graph, behavioural fingerprint clusters and a ranked command-node
attribution.  Every stage is a DataFrame -> DataFrame transform.
"""

__all__ = ["session"]
