"""Column functions: names and comments, samples and patterns, scores and statuses."""
