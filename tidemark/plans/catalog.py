"""All core queries and their SQL."""

from __future__ import annotations

from tidemark.plans import problems, reference, workflow  # noqa: F401  workflow adds its queries to those of reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
SQL: dict[str, str] = {**problems.SQL, **reference.SQL}
