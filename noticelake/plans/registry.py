"""All queries of the engine with the SQL that states the same result."""

from __future__ import annotations

from noticelake.plans import chains, domain, evaluation, events, more, parts, relational, scoring, verified, whole

MODULES = (relational, domain, events, more, evaluation, whole, scoring, parts, chains, verified)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "j04_unpushed_notices"
