"""Whole jobs composed from the operators, and the registered queries."""


def all_queries():
    """``(queries, checks)`` after loading every module that registers some."""
    from voxtable.plans import registry
    from voxtable.plans import (  # noqa: F401
        catalogue_queries, evaluation_queries, prepare_queries, quality_queries, run_queries, sampling_queries,
        table_queries, volume_queries)
    return registry.QUERIES, registry.CHECKS
