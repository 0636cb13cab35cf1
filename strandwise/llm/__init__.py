"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  The operators have general interfaces; the thin queries that
bind them to the tables of a scale-factor directory live in :mod:`strandwise.llm.queries`.
"""
