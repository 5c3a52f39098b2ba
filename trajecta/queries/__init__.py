"""Registered queries of the core library with their SQL oracles.

Modules hold ``QUERIES``: name -> (callable, SQL or None)."""

from __future__ import annotations

from . import detections, documents, evidence, graph, motion, payload, questions, reports, review, search, tracks

_ALL = {**motion.QUERIES, **evidence.QUERIES, **graph.QUERIES, **search.QUERIES, **documents.QUERIES, **review.QUERIES, **questions.QUERIES, **detections.QUERIES, **payload.QUERIES, **reports.QUERIES, **tracks.QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
