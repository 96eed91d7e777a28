"""Registered queries: each runs a public function of the package on tables derived from the inputs."""

from __future__ import annotations

from importlib import import_module

from filingscope.catalog.registry import QUERIES, Query

MODULES = ("index_queries", "text_queries", "section_queries", "change_queries", "panel_queries", "model_queries")


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"filingscope.catalog.{name}")
    return dict(QUERIES)
