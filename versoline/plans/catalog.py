"""Imports every module that registers queries."""

from versoline.plans import building, ingest, live, passages, shelves, texts, timeline  # noqa: F401
