"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rnd(value: Column | str, digits: int) -> Column:
    """Decimal rounding that gives the same double in both engines.

    Means of a few short decimals often end exactly on a half, where the last
    bit decides; shifting the boundary slightly makes those cases safe.
    """
    scale = float(10**digits)
    column = F.col(value) if isinstance(value, str) else value
    return F.floor(column * scale + 0.5001) / scale


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Rounds the named columns, leaving the rest."""
    return df.select(*[rnd(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def same_rounding(sql: str) -> str:
    """Writes every ``ROUND(x, d)`` of an oracle text the way :func:`rnd` rounds."""
    while (start := sql.find("ROUND(")) >= 0:
        depth, comma, at = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        scale = f"1e{int(sql[comma + 1 : at - 1])}"
        inner = sql[start + 6 : comma]
        sql = f"{sql[:start]}(FLOOR(({inner}) * {scale} + 0.5001e0) / {scale}){sql[at:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Registers a query function, with its oracle SQL where one exists."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = same_rounding(sql)
        return fn

    return register
