"""All queries of the engine by name, each with its SQL where SQL expresses it."""

from __future__ import annotations

from ..streaming import fetches, heat
from . import archives, landed, prices, publications, research, signals, sql, universes

_ALL = prices.QUERIES | signals.QUERIES | research.QUERIES | publications.QUERIES | archives.QUERIES | landed.QUERIES | universes.QUERIES | {"heat_stream": (heat.heat_stream, heat.SQL), "fetch_cache_stream": (fetches.fetch_cache_stream, fetches.SQL)}


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.steady(text) for name, (_, text) in _ALL.items() if text}
