"""Registry of queries and of their SQL counterparts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.fixtures import Fixtures, sql_views
from fieldweave.functions.cells import DEFAULT_EDGE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """``sql`` over the fixture views; its own leading WITH is folded into the list of views."""
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{sql_views()},\n{body[len(head):]}"
    return f"WITH {sql_views()}\n{body}"


def query(key: str, sql: str | None = None):
    """Register ``fn(fixtures)`` under ``key``."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Fixtures(spark, folder))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def num(value: float) -> str:
    """A double literal for SQL (a plain one would be a decimal)."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def sql_cells(out: str, source: str, x: str = "lon", y: str = "lat", edge: float = DEFAULT_EDGE) -> str:
    """Common table expressions adding the cell ``q, r`` of a point to ``source``."""
    k1, k2, k3, e = num(math.sqrt(3.0) / 3.0), num(1.0 / 3.0), num(2.0 / 3.0), num(edge)
    return f"""
{out}_f AS (SELECT *, ({x} * {k1} - {y} * {k2}) / {e} AS qf, ({y} * {k3}) / {e} AS rf FROM {source}),
{out}_n AS (SELECT *, floor(qf + 0.5e0) AS rq, floor(rf + 0.5e0) AS rr, floor(-qf - rf + 0.5e0) AS rs FROM {out}_f),
{out}_d AS (SELECT *, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs - (-qf - rf)) AS ds FROM {out}_n),
{out} AS (SELECT * EXCLUDE (qf, rf, rq, rr, rs, dq, dr, ds),
    CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q,
    CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM {out}_d)""".strip()


def sql_ratio(a: str, b: str) -> str:
    return f"CAST(floor((1e0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) * 100e0 + 0.5e0) AS INTEGER)"


def sql_steps(a: str, b: str) -> str:
    return f"CAST((abs({a}.q - {b}.q) + abs({a}.r - {b}.r) + abs({a}.q - {b}.q + {a}.r - {b}.r)) / 2 AS BIGINT)"


def sql_decay(steps: str) -> str:
    return f"CASE WHEN {steps} < 50 THEN 100e0 * exp(-0.5e0 * ({steps} * 0.1e0) * ({steps} * 0.1e0)) ELSE -40e0 END"


def _sql_match_step(new: str, source_id: str, known: str, rank: int) -> str:
    """Brute-force best match of every row of one source against the table so far."""
    return f"""
{new}_p AS (SELECT n.field_id, k.entity_id, k.seq,
    0.7e0 * {sql_ratio("n.name", "k.name")} + 0.3e0 * ({sql_decay(sql_steps("n", "k"))}) AS sc
    FROM src n, {known} k WHERE n.source_id = '{source_id}'),
{new}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY sc DESC, seq) AS rn
    FROM {new}_p WHERE sc >= 60) WHERE rn = 1),
{new} AS (SELECT coalesce(b.entity_id, (SELECT max(entity_id) FROM {known})
        + row_number() OVER (PARTITION BY b.entity_id IS NULL ORDER BY n.field_id)) AS entity_id,
    n.name, n.q, n.r, n.source_id, n.source_name, n.field_id, coalesce(b.sc, 100e0) AS score,
    n.field_id + {rank << 40} AS seq
    FROM src n LEFT JOIN {new}_b b ON n.field_id = b.field_id WHERE n.source_id = '{source_id}')""".strip()


SQL_MATCHES = f"""WITH {sql_cells("src", "(SELECT * FROM fx_source WHERE name IS NOT NULL)")},
m1 AS (SELECT row_number() OVER (ORDER BY field_id) - 1 AS entity_id, name, q, r, source_id, source_name, field_id,
    100e0 AS score, field_id AS seq FROM src WHERE source_id = 'a2024'),
{_sql_match_step("m2b", "b2022", "m1", 1)},
m2 AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2b),
{_sql_match_step("m3c", "c2021", "m2", 2)},
matches AS (SELECT * FROM m2 UNION ALL SELECT * FROM m3c)"""
