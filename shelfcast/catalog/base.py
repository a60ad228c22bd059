"""Registry of named queries, each with the SQL that must give the same rows.

An output spec lists the columns of both sides: ``~x`` rounds a double, ``#x`` makes a
bigint, ``@x`` a string; a bare name is taken as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    fn: QueryFn
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def _ordered(needs: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in needs:
        if n not in seen:
            _ordered(CTES[n][1], seen)
            if n not in seen:
                seen.append(n)
    return seen


def shape(df: DataFrame, spec: str, digits: int) -> DataFrame:
    out = []
    for item in spec.split():
        kind, name = (item[0], item[1:]) if item[0] in "~#@" else ("", item)
        x = F.col(f"`{name}`")
        if kind == "~":
            x = F.round(x.cast("double"), digits) + F.lit(0.0)
        elif kind == "#":
            x = x.cast("bigint")
        elif kind == "@":
            x = x.cast("string")
        out.append(x.alias(name))
    return df.select(*out)


def shape_sql(spec: str, digits: int) -> str:
    out = []
    for item in spec.split():
        kind, name = (item[0], item[1:]) if item[0] in "~#@" else ("", item)
        x = f'"{name}"'
        expr = {"~": f"round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)", "#": f"CAST({x} AS BIGINT)",
                "@": f"CAST({x} AS VARCHAR)", "": x}[kind]
        out.append(f"{expr} AS {x}")
    return ", ".join(out)


def query(name: str, spec: str, ids: str, needs: str = "", sql: str | None = None, digits: int = 6):
    """Register a query. ``sql`` is a SELECT over the CTEs named in ``needs``."""

    def wrap(fn: QueryFn) -> QueryFn:
        text = None
        if sql is not None:
            names = _ordered(tuple(needs.split()), [])
            # a table read twice is computed once: sums of two copies may differ in the last digit
            itself = {n for n in names if re.search(rf"\b(FROM|JOIN) {n}\b", CTES[n][0])}
            parts = [f"{n} AS {'' if n in itself else 'MATERIALIZED '}({CTES[n][0]})" for n in names] + [f"answer AS ({sql})"]
            recursive = "RECURSIVE " if itself else ""
            text = f"WITH {recursive}" + ",\n".join(parts) + f"\nSELECT {shape_sql(spec, digits)} FROM answer"
        REGISTRY[name] = Query(lambda spark, sf: shape(fn(spark, sf), spec, digits), text, tuple(ids.split()))
        return fn

    return wrap
