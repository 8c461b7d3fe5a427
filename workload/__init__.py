"""Registered queries: every operator over the given tables, with equivalent SQL where there is one."""

from workload.registry import ORACLES, QUERIES
from workload import (  # noqa: F401  (importing registers the queries)
    consistency,
    descriptors,
    footers,
    growing,
    names,
    packages,
    profiling,
    publishing,
    records,
    rules,
    schema,
    spelling,
    vocabulary,
)

__all__ = ["ORACLES", "QUERIES"]
