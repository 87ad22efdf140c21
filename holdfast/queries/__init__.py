"""Named queries over the driver's tables, each with SQL that DuckDB runs beside it where SQL can express it."""

from . import detections, sequences, evaluation, workflow, files, videos, shapes, heads  # noqa: F401, I001
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
