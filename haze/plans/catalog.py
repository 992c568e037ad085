"""Registered queries: each is a Spark job over the driver tables plus the
equivalent DuckDB SQL used as an independent oracle.

Every query reads whole tables (no id subsets, prefixes or row caps); a
limit appears only where it is the feature (top-k). Doubles in results are
rounded to 6 decimals on both sides so that summation order does not
decide equality.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = dt.datetime(2024, 1, 20, 18, 30, 0)  # fixed "now" (UTC) for time-relative operators
AS_OF_SQL = "TIMESTAMP '2024-01-20 18:30:00'"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


GRID = 1048576.0  # 2**20: results are snapped to multiples of 2**-20 (about 1e-6)


def round6(c):
    """Snap to the 2**-20 grid with exact IEEE steps (scaling by a power of two
    is exact), so both engines agree. Decimal rounding is avoided on purpose:
    cent-valued data averaged over 2**k rows lands exactly on decimal half
    points, where summation order would decide the last digit."""
    return F.floor(c * F.lit(GRID) + F.lit(0.5)).cast("double") / F.lit(GRID)


def rounded(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column (result hygiene for the oracle compare); one projection call."""
    exprs = [f"CAST(floor(`{f.name}` * {GRID!r}D + 0.5D) AS DOUBLE) / {GRID!r}D AS `{f.name}`"
             if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`" for f in df.schema.fields]
    return df.selectExpr(*exprs)


def r6(expr: str) -> str:
    return f"(floor(({expr}) * CAST('1048576.0' AS DOUBLE) + CAST('0.5' AS DOUBLE)) / CAST('1048576.0' AS DOUBLE))"


def R(expr: str, alias: str | None = None) -> str:
    return f"{r6(expr)} AS {alias or expr}"


def register_all() -> None:
    """Import the query modules so that their decorators run."""
    from haze.plans import q_core, q_learn, q_profile, q_series, q_store, q_users  # noqa: F401
