"""All runnable queries, grouped by topic."""


def load():
    """(queries, checks) with every topic module registered."""
    from evidentia.registry import base, files, modelling, relational, statistics  # noqa: F401

    return base.QUERIES, base.ORACLES
