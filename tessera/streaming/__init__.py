"""Incremental summaries of event streams. The work that this library repeats has no streams; this is the small part that catalogue upkeep needs."""
