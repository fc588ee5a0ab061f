"""Queries on the panels themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultscope.canonical import METRICS
from faultscope.functions.numeric import stable
from faultscope.plans.registry import query
from faultscope.plans.sql import rr, with_ctes
from faultscope.sources.panel import panel_day, panel_long
from faultscope.sources.tables import table


def _shown(panel: DataFrame) -> DataFrame:
    return panel.select("case_id", "role", "service", "ts", "i", "n", *[stable(panel[m]).alias(m) for m in METRICS])


@query("panel_day", with_ctes("day", body=f"SELECT case_id, role, service, ts, i, n, {rr(*METRICS)} FROM day"))
def _(spark, sf_dir):
    return _shown(panel_day(table(spark, sf_dir, "events")))


@query("panel_long", with_ctes("long", body=f"SELECT case_id, role, service, ts, i, n, {rr(*METRICS)} FROM long"))
def _(spark, sf_dir):
    return _shown(panel_long(table(spark, sf_dir, "events")))
