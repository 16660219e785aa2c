"""Every query by name, and its SQL twin."""

from __future__ import annotations

from . import code, files, relational, runs, trees

QUERIES: dict = {**relational.Q, **code.Q, **runs.Q, **files.Q, **trees.Q}
ORACLE_SQL: dict[str, str] = {**relational.SQL, **code.SQL, **runs.SQL, **files.SQL, **trees.SQL}
