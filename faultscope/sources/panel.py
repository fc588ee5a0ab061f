"""Panels (case x service x hour) derived from the ``events`` table.

Every service seen in a case gets one row per hour of the case's span; hours
without events are zero-filled. Amounts are summed as whole cents, so a cell
does not depend on the order in which its events arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.canonical import METRICS

COHORT_USERS = 50       # users per cohort: the number of cases grows with the users
HIGH_VALUE = 50.0       # events above this count into the error rate
DAY_HOURS = 24

# Neighbours of each event type, standing in for a service graph.
EVENT_EDGES = {
    "click": ["view", "purchase"],
    "error": ["click", "view", "signup"],
    "purchase": ["click", "error"],
    "signup": ["view"],
    "view": ["click", "signup", "purchase", "error"],
}


def _densify(keyed: DataFrame, hours: int) -> DataFrame:
    """Aggregate events to (case, service, hour) cells and fill the gaps.

    The first ``groupBy`` combines on the map side, so a hot service costs no
    more than its number of distinct hours; the second collects at most
    ``hours`` cells per series.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    even = F.col("user_id") % 2 == 0
    cells = keyed.groupBy("case_id", "service", "start", "hour").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(cents).alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.sum(F.when(F.col("value") > HIGH_VALUE, 1).otherwise(0)).alias("big"),
        F.sum(F.when(even, cents).otherwise(0)).alias("even_cents"),
        F.sum(F.when(even, 0).otherwise(cents)).alias("odd_cents"),
    )
    count = F.col("c").cast("double")
    values = F.struct(
        (F.col("total") / 100.0 / count).alias("cpu_usage"),
        F.col("low").alias("memory_usage"),
        count.alias("request_rate"),
        (F.col("big") / count).alias("error_rate"),
        F.col("high").alias("latency"),
        (F.col("even_cents") / 100.0).alias("network_in"),
        (F.col("odd_cents") / 100.0).alias("network_out"),
    )
    zero = F.struct(*[F.lit(0.0).alias(m) for m in METRICS])
    series = cells.groupBy("case_id", "service", "start").agg(
        F.map_from_entries(F.collect_list(F.struct("hour", values))).alias("by_hour")
    )
    spine = series.select(
        "case_id", "service", "start", "by_hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("i")
    )
    cell = F.coalesce(F.col("by_hour")[F.col("i")], zero)
    filled = spine.select("case_id", "service", "start", "i", cell.alias("m"))
    return filled.select(
        "case_id",
        F.lit("case").alias("role"),
        "service",
        (F.col("start") + F.col("i").cast("long") * 3600).alias("ts"),
        F.col("i").cast("long").alias("i"),
        F.lit(hours).cast("long").alias("n"),
        *[F.col(f"m.{m}").alias(m) for m in METRICS],
    )


def cohort() -> Column:
    return F.expr(f"user_id div {COHORT_USERS}")


def panel_day(events: DataFrame) -> DataFrame:
    """One case per day and user cohort, 24 hourly points per service."""
    day = F.to_date("ts")
    keyed = events.select(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("#"), cohort().cast("string")).alias("case_id"),
        F.col("event_type").alias("service"),
        (F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("start"),
        F.hour("ts").alias("hour"),
        "user_id",
        "value",
    )
    return _densify(keyed, DAY_HOURS)


def long_span(events: DataFrame) -> tuple[int, int]:
    """First day of all events, in days since 1970, and the hours from there to the end of their last day."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    first, last = events.agg(F.min(day), F.max(day)).first()
    return (0, 0) if first is None else (first, (last - first + 1) * DAY_HOURS)


def panel_long(events: DataFrame) -> DataFrame:
    """One case per user cohort, an hourly point per service from the first day
    of the table's events to their last. Events without a time have no hour."""
    first, hours = long_span(events)
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    keyed = events.select(
        F.concat(F.lit("cohort-"), cohort().cast("string")).alias("case_id"),
        F.col("event_type").alias("service"),
        F.lit(first * 86400).cast("long").alias("start"),
        ((day - first) * 24 + F.hour("ts")).alias("hour"),
        "user_id",
        "value",
    ).filter("hour is not null")
    return _densify(keyed, max(hours, DAY_HOURS))


def day_cases(events: DataFrame, inject_hour: int = 12) -> DataFrame:
    """Case table of ``panel_day``: attributes follow from day and cohort."""
    day = F.to_date("ts")
    base = events.select(day.alias("d"), cohort().alias("cohort")).distinct()
    dom = F.dayofmonth("d")
    systems = F.array(*[F.lit(s) for s in ("online-boutique", "sock-shop", "train-ticket")])
    services = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    kinds = F.array(*[F.lit(s) for s in ("cpu", "mem", "disk", "delay", "loss", "socket")])
    multiplier = F.lit(1.0) + (dom * 7 % 50) / F.lit(10.0)
    entries = F.filter(
        F.array(
            F.struct(F.lit("event_type").alias("k"), F.when(dom % 3 == 0, F.lit("flash_sale")).alias("v")),
            F.struct(F.lit("load_multiplier").alias("k"),
                     F.when(dom % 2 == 0, multiplier.cast("string")).alias("v")),
            F.struct(F.lit("event_name").alias("k"), F.when(dom % 4 == 0, F.lit("flash_sale_event")).alias("v")),
        ),
        lambda e: e["v"].isNotNull(),
    )
    return base.select(
        F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("#"), F.col("cohort").cast("string")).alias("case_id"),
        F.lit("demo").alias("dataset"),
        systems[(F.col("cohort") % 3).cast("int")].alias("system"),
        ((dom + F.col("cohort")) % 2).cast("int").alias("label"),
        F.map_from_entries(entries).alias("context"),
        services[dom % 5].alias("fault_service"),
        kinds[dom % 6].alias("fault_type"),
        multiplier.alias("load_multiplier"),
        (F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long") * 86400
         + F.lit(inject_hour * 3600)).alias("inject_time"),
    )


def long_cases(events: DataFrame, inject_hour: int | None = None) -> DataFrame:
    """Case table of ``panel_long``; without ``inject_hour`` two thirds of the span come before the event."""
    first, hours = long_span(events)
    base = events.select(cohort().alias("cohort")).distinct()
    inject_hour = hours * 2 // 3 if inject_hour is None else inject_hour
    start = F.lit(first * 86400).cast("long")
    return base.select(
        F.concat(F.lit("cohort-"), F.col("cohort").cast("string")).alias("case_id"),
        F.lit("demo").alias("dataset"),
        F.lit("online-boutique").alias("system"),
        (F.col("cohort") % 2).cast("int").alias("label"),
        F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")).alias("context"),
        F.lit("click").alias("fault_service"),
        F.lit("cpu").alias("fault_type"),
        F.lit(1.0).alias("load_multiplier"),
        (start + F.lit(inject_hour * 3600)).alias("inject_time"),
    )
