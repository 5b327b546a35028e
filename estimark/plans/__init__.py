"""Plans: the registered queries (Spark side) and their DuckDB oracles."""
