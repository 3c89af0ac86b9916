"""Sources and sinks: driver tables, JSON/CSV loaders, stage writers."""
