"""Registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import the query modules so that they register themselves."""
    from codemix.plans import (  # noqa: F401
        queries_corpus, queries_sample, queries_score, queries_switch, queries_text, queries_vocab)
