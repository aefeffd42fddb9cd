"""Registry of named queries: a Spark plan and, where SQL can say it, an oracle text.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables.  The
oracle text is plain SQL for DuckDB over the same Parquet tables; it builds the
observation view as a CTE and is written independently of the Spark plan
(joins and windows where the Spark side uses projections, and so on).
"""

from __future__ import annotations

from collections.abc import Callable

from helio.sources.observations import observation_view_sql

QueryFn = Callable[..., object]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def with_obs(body: str, extra_ctes: str = "") -> str:
    """Oracle text: ``with obs as (<observation view>) [, extra] <body>``."""
    sep = ",\n" if extra_ctes else ""
    return f"with obs as ({observation_view_sql('events')}){sep}{extra_ctes}\n{body}"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_num(x: float) -> str:
    return repr(float(x)) + "e0" if "e" not in repr(float(x)) else repr(float(x))


def round_sql(x: str, places: int = 6) -> str:
    """DuckDB text that rounds like Spark's ``round`` on doubles: half up on the
    shortest decimal text of the value (DuckDB's own ``round`` scales in binary)."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,18)), {places}) as double)"
