"""Structured Streaming adapters; additions to the batch operators, with the same results."""
