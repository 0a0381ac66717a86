"""Queries over the test tables and the SQL that must give the same rows."""

from checks import comparison, core, deep, diagnosis, extra, inference, keyed, kpi, runs, text, tracing  # noqa: F401
from checks.base import QUERIES, SQL  # noqa: F401
