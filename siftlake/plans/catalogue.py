"""All registered queries."""

from __future__ import annotations

import importlib

from siftlake.plans.base import QUERIES

_MODULES = ["schema_queries", "ledger_queries", "report_queries", "function_queries", "artifact_queries",
            "stream_queries", "io_queries", "folder_queries"]
for _name in _MODULES:
    importlib.import_module(f"siftlake.plans.{_name}")


def queries():
    return {name: q.fn for name, q in QUERIES.items()}


def oracle_sql():
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def operator_ids():
    return {name: q.ids for name, q in QUERIES.items()}
