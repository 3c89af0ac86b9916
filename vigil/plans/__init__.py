"""Query plans: registered queries, their DuckDB oracles, and the pipeline."""
