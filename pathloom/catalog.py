"""The library's own queries by name, with the SQL that checks them."""

from __future__ import annotations

from pathloom.plans.queries import ORACLE_SQL, QUERIES, customers_by_stem

flagship = customers_by_stem

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
