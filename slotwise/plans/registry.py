"""All queries by name, and for each the SQL that must give the same rows."""

from __future__ import annotations

from . import evaluation, neural  # noqa: F401  they register their queries
from .catalogue import QUERIES
from .oracle import ORACLE_SQL as _CATALOGUE_SQL
from .oracle_evaluation import ORACLE_SQL as _EVALUATION_SQL
from .oracle_neural import ORACLE_SQL as _NEURAL_SQL

ORACLE_SQL: dict[str, str] = _CATALOGUE_SQL | _EVALUATION_SQL | _NEURAL_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
