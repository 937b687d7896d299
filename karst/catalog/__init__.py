"""The registered queries of the engine's operators and functions, each with the SQL that DuckDB runs."""

from . import functions, operators

QUERIES = operators.QUERIES | functions.QUERIES
ORACLES = operators.ORACLES | functions.ORACLES
