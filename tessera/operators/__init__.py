"""DataFrame operators: joins with overlays, grouped summaries, rankings, retrieval, clustering, versioned edits."""
