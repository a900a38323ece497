"""Named queries: derived views of the driver tables wired to operators, with DuckDB oracles."""
