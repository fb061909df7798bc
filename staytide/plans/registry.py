"""Registry of named queries with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views of staytide.sources.tables, in SQL.
VIEWS = {
    "f_stays": """
        SELECT user_id AS stay_id, user_id % 50 AS patient_id, MIN(ts) AS t0, MAX(ts) AS t1,
               CASE WHEN user_id % 3 = 0 THEN MIN(ts) + (user_id % 30) * INTERVAL '1' DAY END AS death_ts,
               CASE WHEN user_id % 3 = 0 THEN 'Expired' WHEN user_id % 11 = 5 THEN NULL ELSE 'Alive' END AS status
        FROM events GROUP BY user_id""",
    "f_m1": """
        SELECT event_id, user_id AS stay_id, ts, value FROM events
        WHERE event_type = 'view' AND value <= 300""",
    "f_m2": """
        SELECT event_id, user_id AS stay_id, ts, value FROM events
        WHERE event_type IN ('click', 'purchase') AND value BETWEEN 30 AND 300""",
    "f_ticks": """
        SELECT event_id, user_id AS stay_id, ts, CAST(FLOOR(value) AS INT) % 6 - 1 AS typ, value > 100 AS active
        FROM events WHERE event_type = 'signup'""",
    "f_intervals": """
        SELECT user_id AS stay_id, ts AS start_ts, ts + INTERVAL '1' DAY AS end_ts, value AS score
        FROM events WHERE event_type = 'error'""",
    "f_demo": """
        SELECT c_custkey AS stay_id, c_mktsegment AS ethnicity,
               CASE WHEN c_nationkey % 2 = 0 THEN 'Male' WHEN c_nationkey % 5 = 0 THEN 'Unknown' ELSE 'Female' END AS gender,
               CASE WHEN c_custkey % 9 = 4 THEN '> 89' ELSE CAST(18 + c_custkey % 70 AS VARCHAR) END AS age_text,
               CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE CAST(140 + c_nationkey AS DOUBLE) END AS height,
               CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE 50.0::DOUBLE + c_acctbal / 200.0::DOUBLE END AS weight
        FROM customer""",
    "f_off1": """
        SELECT e.*, epoch_us(e.ts) - epoch_us(s.t0) AS off_us, epoch_us(s.death_ts) - epoch_us(s.t0) AS death_us
        FROM f_m1 e JOIN f_stays s USING (stay_id)""",
    "f_off2": """
        SELECT e.*, epoch_us(e.ts) - epoch_us(s.t0) AS off_us, epoch_us(s.death_ts) - epoch_us(s.t0) AS death_us
        FROM f_m2 e JOIN f_stays s USING (stay_id)""",
    "f_grid": """
        SELECT a.m1, b.m2 FROM (SELECT unnest(range(40, 151)) AS m1) a CROSS JOIN (SELECT unnest(range(60, 201)) AS m2) b""",
    "f_docs": """
        SELECT l.doc_id, l.quality, l.toxic, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)""",
    "f_medians": """
        SELECT a.stay_id, a.m1, b.m2 FROM
          (SELECT stay_id, median(value) AS m1 FROM f_m1 GROUP BY stay_id) a
          JOIN (SELECT stay_id, median(value) AS m2 FROM f_m2 GROUP BY stay_id) b USING (stay_id)""",
}


def _risk(k: int, m1: str, m2: str) -> str:
    return (
        f"1 / (1 + exp(-(-4.0::DOUBLE + 0.0009::DOUBLE * pow({m1} - (70 + 3 * {k} + stay_id % 10), 2)"
        f" + 0.0006::DOUBLE * pow({m2} - (115 + 2 * {k} + stay_id % 15), 2))))"
    )


def risk_sql(k: int, m1: str = "m1", m2: str = "m2") -> str:
    return _risk(k, f"CAST({m1} AS DOUBLE)", f"CAST({m2} AS DOUBLE)")


AVERAGE_SQL = "(" + " + ".join(risk_sql(k) for k in range(5)) + ") / 5"

VIEWS["f_scored"] = f"""
        SELECT stay_id, m1, m2, {AVERAGE_SQL} AS avg_pred FROM f_stays CROSS JOIN f_grid"""
VIEWS["f_targets"] = """
        SELECT stay_id, AVG(m1) AS optimal_m1, AVG(m2) AS optimal_m2 FROM (
          SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY round(avg_pred, 9), m1, m2) AS rn FROM f_scored)
        WHERE rn <= 100 GROUP BY stay_id"""


def with_views(sql: str) -> str:
    """The statement with the views it names put in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    if sql[:5].upper() == "WITH ":
        return f"WITH {views},\n{sql[5:]}"
    return f"WITH {views}\n{sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
