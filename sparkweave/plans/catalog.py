"""All queries by name, and their SQL for DuckDB."""

from sparkweave.plans import decision, decision_sql, grouping, relational, scalar

_PARTS = (relational.R, grouping.R, scalar.R)
QUERIES = {**decision.PLANS, **{name: run for part in _PARTS for name, run in part.queries.items()}}
ORACLE_SQL = {**decision_sql.SQL, **{name: text for part in _PARTS for name, text in part.oracle.items()}}
