"""Operators for training-data pipelines, their queries and the SQL that checks them."""


def llm_queries():
    """``(queries, checks)`` of this subpackage."""
    from voxtable.llm import queries
    return dict(queries.QUERIES), dict(queries.CHECKS)
