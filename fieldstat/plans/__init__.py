"""Query catalogue: importing the modules registers every named query."""


def all_queries():
    from . import analysis, catalogue, resampling, statistics, trials  # noqa: F401

    return catalogue.QUERIES, catalogue.ORACLE
