"""Registered queries over the test tables, each with its DuckDB equivalent where SQL can say it."""
