"""Registered queries: every operator run over whole tables, with equivalent SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ["texts", "domains", "structures", "questions", "retrieval", "curation", "running", "reusing"]


def _collect(attribute: str) -> dict:
    out = {}
    for area in AREAS:
        out.update(getattr(import_module(f"docquarry.catalog.{area}"), attribute))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict[str, str]:
    return _collect("SQL")
