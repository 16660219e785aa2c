"""Column functions: paths, text, scores, token masks."""
