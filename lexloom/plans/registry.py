"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from lexloom.plans import corpus, evaluation, golden, retrieval, sessions
from lexloom.plans.tables import Query

_BOOKS = [retrieval.BOOK, corpus.BOOK, evaluation.BOOK, golden.BOOK, sessions.BOOK]
QUERIES: dict[str, Query] = {k: v for b in _BOOKS for k, v in b.queries.items()}
ORACLES: dict[str, str] = {k: v for b in _BOOKS for k, v in b.oracles.items()}
