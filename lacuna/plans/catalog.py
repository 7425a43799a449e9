"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from lacuna.plans import media, slicing, transforms, transport

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (slicing, transforms, transport, media):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
