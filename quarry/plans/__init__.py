"""The query language: syntax, rewrites, and evaluation as one DataFrame plan."""
