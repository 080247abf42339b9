"""Registered queries over the given tables, each with SQL for the same rows where SQL can say it."""

from plumbline.workload import on_bins, on_cells, on_injections, on_models  # noqa: F401
from plumbline.workload.inputs import QUERIES, SQL
from plumbline.workload.on_models import flagship

__all__ = ["QUERIES", "SQL", "flagship"]
