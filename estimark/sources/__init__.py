"""Sources: Parquet tables, XML payloads, message logs, literal lookups."""
