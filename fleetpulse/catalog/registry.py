"""`@query(key, sql)` collects the queries; `ctes(...)` builds the shared SQL prefixes."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return add


def r6(expr: str, alias: str, digits: int = 6) -> str:
    """Rounded output column; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, {digits}) + 0e0) AS {alias}"


def with_(*ctes: tuple[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + select
