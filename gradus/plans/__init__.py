"""Queries over the sample tables."""

from . import balancing, clusters, further, learning, queries, reducts  # noqa: F401  all register theirs
