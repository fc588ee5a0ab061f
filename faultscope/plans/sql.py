"""Building blocks of the check queries (DuckDB dialect)."""

from __future__ import annotations

from faultscope.canonical import METRICS

M = METRICS


def r(expr: str, digits: int = 6) -> str:
    """Same rounding as ``functions.numeric.stable``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rr(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


def hash_uniform(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _panel(case_expr: str, start_expr: str, hour_expr: str, hours: int | str, where: str) -> str:
    return f"""
    SELECT p.case_id, 'case' AS role, p.service, p.start + g.h * 3600 AS ts, g.h AS i, CAST({hours} AS BIGINT) AS n,
           coalesce(c.total / 100.0::DOUBLE / c.c, 0.0) AS cpu_usage,
           coalesce(c.low, 0.0) AS memory_usage,
           coalesce(CAST(c.c AS DOUBLE), 0.0) AS request_rate,
           coalesce(CAST(c.big AS DOUBLE) / c.c, 0.0) AS error_rate,
           coalesce(c.high, 0.0) AS latency,
           coalesce(c.ev / 100.0::DOUBLE, 0.0) AS network_in,
           coalesce(c.od / 100.0::DOUBLE, 0.0) AS network_out
    FROM (SELECT DISTINCT {case_expr} AS case_id, event_type AS service, {start_expr} AS start FROM events) p
    CROSS JOIN (SELECT range AS h FROM range({hours})) g
    LEFT JOIN (
        SELECT {case_expr} AS case_id, event_type AS service, {hour_expr} AS h, count(*) AS c,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS total, min(value) AS low, max(value) AS high,
               sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS big,
               CAST(sum(CASE WHEN user_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) AS ev,
               CAST(sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) AS od
        FROM events {where} GROUP BY 1, 2, 3) c
      ON c.case_id = p.case_id AND c.service = p.service AND c.h = g.h"""


_DAY_ID = "strftime(ts, '%Y-%m-%d') || '#' || CAST(user_id // 50 AS VARCHAR)"
_FIRST_DAY = "(SELECT CAST(min(ts) AS DATE) FROM events)"
_LONG_HOUR = f"(date_diff('day', {_FIRST_DAY}, CAST(ts AS DATE)) * 24 + hour(ts))"
_LONG_HOURS = f"((SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 FROM events) * 24)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "day": ((), _panel(_DAY_ID, "CAST(epoch(CAST(ts AS DATE)) AS BIGINT)", "hour(ts)", 24, "")),
    "long": ((), _panel("'cohort-' || CAST(user_id // 50 AS VARCHAR)", f"CAST(epoch({_FIRST_DAY}) AS BIGINT)", _LONG_HOUR, _LONG_HOURS, "")),
}


def cte(name: str, body: str, *needs: str) -> None:
    """Register a named sub-query and the names it reads."""
    CTES[name] = (needs, body)


def with_ctes(*names: str, body: str) -> str:
    """``body`` preceded by the named sub-queries and all they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body
