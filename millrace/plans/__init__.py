"""The named queries and their equivalents in DuckDB's SQL."""
