"""Queries over the provided tables, each with the SQL that gives the same rows."""

from __future__ import annotations


def all_queries():
    """(queries, sql), each by name."""
    from quillgraph.plans import assembly, files, graph, learning, parsing, ranking, tables, text  # noqa: F401
    from quillgraph.plans.registry import QUERIES, SQL

    return QUERIES, SQL
