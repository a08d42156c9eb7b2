"""All queries over the engine's own operators, and their DuckDB twins."""

from . import corpus, evaluation, mining, operations, retrieval

MODULES = (retrieval, evaluation, corpus, mining, operations)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
