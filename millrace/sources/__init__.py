"""Tables of a data folder, and reading and writing in Spark's file formats."""

from millrace.sources.tables import TABLES, table, tables

__all__ = ["TABLES", "table", "tables"]
