"""Every query of the trace engine by name, with its DuckDB oracle where SQL can state it."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _ORACLES[name] = sql


def _load() -> None:
    from . import catalog, scalar_catalog  # noqa: F401  they register what they hold


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
