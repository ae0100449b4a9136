"""Operators over frames: graph, vectors, path search, evaluation, formatting."""
