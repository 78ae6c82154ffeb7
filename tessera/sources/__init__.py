"""Reading and writing: declared schemas, tolerant headers, nested records, keyed overwrites, append-only logs, an answer cache."""
