"""All queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from sparkloom.plans import acts, analytics, answers, changes, chats, ledger, matchings, matchings_sql, parties, records, retrieval, texts

MODULES = (retrieval, analytics, ledger, texts, matchings, parties, changes, acts, chats, records, answers)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in (retrieval, analytics, ledger, texts, matchings_sql, parties, changes, acts, chats, records, answers) for name, sql in m.ORACLES.items()}
