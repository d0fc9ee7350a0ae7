"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "register_queries",
    "feature_queries",
    "metric_queries",
    "explain_queries",
    "corpus_queries",
    "evidence_queries",
    "model_queries",
    "stream_queries",
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"lendwell.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)


def flagship(spark, d):
    return QUERIES["build_dataset"](spark, d)
