"""Registered queries and the SQL another engine runs for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the named building blocks of ``CTES``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def block(name: str, sql: str) -> None:
    CTES[name] = sql


def _exact_rounds(sql: str) -> str:
    """``round(x, n)`` by text, so that both engines round the exact value."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, comma, end = 1, None, m.end()
        while depth:
            ch = sql[end]
            depth += (ch == "(") + (ch == "[") - (ch == ")") - (ch == "]")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        digits = sql[comma + 1:end - 1].strip() if comma else ""
        if digits.isdigit():
            inner = _exact_rounds(sql[m.end():comma])
            out += sql[at:m.start()] + f"CAST(printf('%.{digits}f', CAST({inner} AS DOUBLE)) AS DOUBLE)"
            at = end
    return out + sql[at:]


def expanded(sql: str) -> str:
    """The statement with every building block it needs, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for word in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if word in CTES and word not in seen:
                seen.add(word)
                need(CTES[word])
                order.append(word)

    need(sql)
    if not order:
        return _exact_rounds(sql)
    # some comparisons walk their rows with a recursive block
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return _exact_rounds(head + ",\n" + body[5:])
    return _exact_rounds(head + "\n" + body)
