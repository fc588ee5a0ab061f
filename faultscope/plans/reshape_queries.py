"""Queries on reading, reshaping and labelling recordings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.canonical import FAULT_TAXONOMY, FEATURE_GROUPS, METRICS, SEVERITY_PROFILES
from faultscope.functions.decision import decode_label, encode_label
from faultscope.functions.numeric import hash_uniform, stable
from faultscope.operators import reshape as rs
from faultscope.operators.split import half_sizes, split_cases, split_recordings, tag_halves
from faultscope.plans.feature_queries import rounded
from faultscope.plans.registry import query
from faultscope.plans.sql import cte, hash_uniform as sql_uniform, r, rr, with_ctes
from faultscope.sources import recordings as rec
from faultscope.sources.panel import day_cases, panel_day
from faultscope.sources.tables import land, shared_folder, table

ROOT = "/recordings"
# Wide column suffix -> panel metric it carries in the derived recordings.
WIDE = [("cpu", "cpu_usage"), ("mem", "memory_usage"), ("load", "request_rate"), ("error", "error_rate"),
        ("latency-90", "latency"), ("latency-50", "half_latency"), ("diskio", "network_in"), ("socket", "network_out")]


def recording_lines(panel: DataFrame, cases: DataFrame) -> DataFrame:
    """The panel written as CSV lines, the form ``scan_lines`` returns.

    Cohorts alternate between the flat and the nested layout; service ``view``
    has no memory column; every third day has a decoy file of lower priority.
    """
    services = panel.withColumn("half_latency", F.col("latency") / 2)
    cells = F.transform(
        F.array(*[F.struct(F.lit(s).alias("s"), F.col(m).cast("string").alias("v")) for s, m in WIDE]), lambda c: c
    )
    kept = F.filter(cells, lambda c: ~((F.col("service") == "view") & (c["s"] == "mem")))
    per_row = services.select("case_id", "ts", "i", "service", kept.alias("cells")).groupBy("case_id", "ts", "i").agg(
        F.sort_array(F.collect_list(F.struct("service", "cells"))).alias("all")
    )
    names = F.flatten(F.transform("all", lambda s: F.transform(s["cells"], lambda c: F.concat(s["service"], F.lit("_"), c["s"]))))
    values = F.flatten(F.transform("all", lambda s: F.transform(s["cells"], lambda c: c["v"])))
    header = F.concat(F.lit("time,"), F.array_join(names, ","))
    line = F.concat(F.col("ts").cast("string"), F.lit(","), F.array_join(values, ","))
    cohort = F.substring_index("case_id", "#", -1).cast("int")
    day = F.substring_index("case_id", "#", 1)
    flat = F.concat_ws("/", F.lit(ROOT), "dataset", "system",
                       F.concat_ws("_", "system", "fault_service", "fault_type", F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lpad(cohort.cast("string"), 4, "0"))))
    nested = F.concat_ws("/", F.lit(ROOT), "dataset", "system", F.lit("P1"), F.concat_ws("_", "fault_service", "fault_type"),
                         F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lpad(cohort.cast("string"), 4, "0")))
    folder = F.when(cohort % 2 == 0, flat).otherwise(nested)
    rows = per_row.join(cases.select("case_id", "dataset", "system", "fault_service", "fault_type"), "case_id")
    real = rows.select(
        F.concat(folder, F.lit("/simple_metrics.csv")).alias("path"),
        F.expr("i div 8").alias("block"),
        F.posexplode(F.when(F.col("i") == 0, F.array(header, line)).otherwise(F.array(line))).alias("k", "line"),
        "i",
    ).select("path", "block", (F.col("i") * 2 + F.col("k")).alias("seq"), "line")
    decoy = rows.filter((F.col("i") < 2) & (F.dayofmonth(F.to_date(day)) % 3 == 0)).select(
        F.concat(folder, F.lit("/data.csv")).alias("path"), F.lit(0).cast("long").alias("block"), F.col("i").alias("seq"),
        F.lit("time,decoy_cpu").alias("line"),
    )
    return land(real.unionByName(decoy), "recording-lines")


cte("rec_cases", """
    SELECT *, dataset || '/' || system || '/' || CASE WHEN cohort % 2 = 0 THEN system || '_' || fault_service || '_' || fault_type || '_' || inst
                   ELSE 'P1/' || fault_service || '_' || fault_type || '/' || inst END AS rec_id
    FROM (SELECT *, CAST(split_part(case_id, '#', 2) AS INTEGER) AS cohort,
                 replace(split_part(case_id, '#', 1), '-', '') || lpad(split_part(case_id, '#', 2), 4, '0') AS inst FROM cases_day)""",
    "cases_day")


@query("recording_reader", with_ctes("day", "rec_cases", body=f"""
    SELECT c.rec_id AS case_id, c.dataset, c.system, c.fault_service, c.fault_type, d.service, d.ts, d.i AS row,
           {rr('cpu_usage')}, {r("CASE WHEN d.service = 'view' THEN 0 ELSE memory_usage END")} AS memory_usage,
           {rr('request_rate', 'error_rate', 'latency', 'network_in', 'network_out')}
    FROM day d JOIN rec_cases c USING (case_id)"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = rec.panel_rows(recording_lines(panel_day(events), day_cases(events)), ROOT)
    return rounded(rows, "case_id", "dataset", "system", "fault_service", "fault_type", "service", "ts", "row")


@query("recording_reader_filtered", with_ctes("day", "rec_cases", body="""
    SELECT c.rec_id AS case_id, c.system, c.fault_type, count(*) AS rows, count(DISTINCT d.service) AS services
    FROM day d JOIN rec_cases c USING (case_id)
    WHERE c.fault_type IN ('cpu', 'delay') AND c.system IN ('sock-shop', 'online-boutique') GROUP BY 1, 2, 3"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = rec.panel_rows(recording_lines(panel_day(events), day_cases(events)), ROOT, fault_types=["cpu", "delay"],
                          datasets=["demo"], systems=["sock-shop", "online-boutique"])
    return rows.groupBy("case_id", "system", "fault_type").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("service").alias("services"))


@query("recording_headers", with_ctes("day", "rec_cases", body=f"""
    SELECT c.rec_id AS case_id, s.service, CAST(count(DISTINCT i) AS BIGINT) AS points,
           CAST(any_value(CASE WHEN s.service = 'view' THEN 6 ELSE 7 END) AS INTEGER) AS metrics
    FROM day s JOIN rec_cases c USING (case_id) GROUP BY 1, 2"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lines = recording_lines(panel_day(events), day_cases(events))
    chosen = rec.choose_metrics_file(rec.locate(rec.read_files(lines), ROOT))
    plan = rec.reading_plan(chosen.select("path", "header"))
    counts = lines.groupBy("path").agg((F.count(F.lit(1)) - 1).alias("points"))
    flat = chosen.join(plan, "path").join(counts, "path").withColumn("s", F.explode("services"))
    present = sum((F.col(f"s.{m}").isNotNull().cast("int") for m in METRICS), F.lit(0))
    return flat.select("case_id", F.col("s.service").alias("service"), "points", present.alias("metrics"))


cte("side_cases", """
    SELECT o_orderkey AS k, ['RE1', 'RE2'][1 + o_orderkey % 2] AS dataset, ['sock-shop', 'train-ticket'][1 + o_custkey % 2] AS system,
           ['P', 'Q'][1 + o_orderkey // 2 % 2] AS prefix, o_totalprice AS price, o_orderstatus AS status FROM orders""")


def _side_lines(spark, sf_dir) -> DataFrame:
    """Orders as rows of side files: one file per dataset, system and prefix, all in folders of one name, columns in two orders."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    dataset = F.when(key % 2 == 0, "RE1").otherwise("RE2")
    system = F.when(F.col("o_custkey") % 2 == 0, "sock-shop").otherwise("train-ticket")
    prefix = F.when(F.floor(key / 2) % 2 == 0, "P").otherwise("Q")
    turned = dataset == "RE2"
    price = F.col("o_totalprice").cast("string")
    rows = o.select(F.concat_ws("/", F.lit(ROOT), dataset, system, prefix, F.lit("cart_cpu"), F.lit("1"), F.lit("logs.csv")).alias("path"),
                    turned.alias("turned"), key.alias("k"), price.alias("price"), F.col("o_orderstatus").alias("status"))
    line = F.when(F.col("turned"), F.concat_ws(",", "status", "k", "price")).otherwise(F.concat_ws(",", "k", "price", "status"))
    body = rows.select("path", (F.floor(F.col("k") / 1000) + 1).cast("long").alias("block"), F.col("k").alias("seq"), line.alias("line"))
    heads = rows.select("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"),
                        F.when(F.col("turned"), "status,key,price").otherwise("key,price,status").alias("line")).distinct()
    return land(heads.unionByName(body), "side-lines")


@query("side_tables_mixed_headers", with_ctes("side_cases", body="""
    SELECT dataset || '/' || system || '/' || prefix || '/cart_cpu/1' AS case_id, dataset, system, k AS key, price, status FROM side_cases"""))
def _(spark, sf_dir):
    rows = rec.side_rows(_side_lines(spark, sf_dir), ROOT)
    return rows.select("case_id", "dataset", "system", F.col("cells.key").cast("bigint").alias("key"),
                       F.col("cells.price").cast("double").alias("price"), F.col("cells.status").alias("status"))


_FOLDERS = ["dataset", "system", "prefix", "fault", "instance"]


def _case_folders(o: DataFrame) -> list:
    """Folder columns of orders: dataset, system, prefix, one fault name and an instance per 10,000 keys."""
    key = F.col("o_orderkey")
    return [F.when(key % 2 == 0, "RE1").otherwise("RE2").alias("dataset"),
            F.when(F.col("o_custkey") % 2 == 0, "sock-shop").otherwise("train-ticket").alias("system"),
            F.when(F.floor(key / 2) % 2 == 0, "P").otherwise("Q").alias("prefix"),
            F.lit("cart_cpu").alias("fault"), F.floor(key / 10000).alias("instance")]


def _write_tree(rows: DataFrame, root: str, kind: str = "csv") -> None:
    """All folders in one job, each by one task as one file; their number grows with the table.

    The number of tasks is given, since Spark joins tasks by their bytes: many folders of few bytes would be written by one."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, *_FOLDERS).write.partitionBy(*_FOLDERS).option("header", True).format(kind).save(root)


@query("side_files_stored", """
    SELECT ['RE1', 'RE2'][1 + o_orderkey % 2] || '/' || ['sock-shop', 'train-ticket'][1 + o_custkey % 2] || '/'
               || ['P', 'Q'][1 + o_orderkey // 2 % 2] || '/cart_cpu/' || o_orderkey // 10000 AS case_id,
           CAST(count(*) AS BIGINT) AS log_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(max(length(o_orderstatus)) AS INTEGER) AS longest,
           CAST(max(o_orderkey) AS BIGINT) AS inject_time, CAST(count(*) AS BIGINT) AS numbered
    FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    """Log files and injection times of a tree on storage, read back by file: a log per case, its largest key as its time."""
    o = table(spark, sf_dir, "orders")
    base = f"{shared_folder(spark)}/side-{uuid.uuid4().hex}"
    _write_tree(o.select(*_case_folders(o), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), f"{base}/logs")
    times = o.select(*_case_folders(o), "o_orderkey").groupBy(*_FOLDERS).agg(F.max("o_orderkey").cast("string").alias("value"))
    _write_tree(times, f"{base}/times", "text")
    logs = rec.read_side_table(spark, f"{base}/logs", "part-*.csv")
    per_case = logs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("log_rows"), F.sum(F.col("key").cast("bigint")).alias("keys"), F.max(F.length("status")).alias("longest"),
        (F.max("row") + 1).alias("numbered"))
    return per_case.join(rec.inject_times(rec.scan_texts(spark, f"{base}/times", "part-*.txt"), f"{base}/times"), "case_id", "left")


@query("recording_tree_multi", """
    SELECT ds || '/' || sy || '/' || px || '/cart_cpu/' || inst AS case_id, ds AS dataset, sy AS system, 'cart' AS service, ts, cpu, clocked FROM (
        SELECT ['RE1', 'RE2'][1 + o_orderkey % 2] AS ds, ['sock-shop', 'train-ticket'][1 + o_custkey % 2] AS sy,
               ['P', 'Q'][1 + o_orderkey // 2 % 2] AS px, o_orderkey // 10000 AS inst, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS ts,
               o_totalprice AS cpu, o_orderkey % 11 <> 0 AS clocked FROM orders)""")
def _(spark, sf_dir):
    """Real files under the shared folder: two datasets, systems and prefixes with equal folder names, an instance per
    10,000 order keys; every eleventh clock is no number. One job writes all, a file per folder."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    clock = F.when(key % 11 == 0, "nan").otherwise(key.cast("string"))
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    rows = o.select(*_case_folders(o), clock.alias("time"), F.col("o_totalprice").alias("cart_cpu"))
    _write_tree(rows, root)
    rows, _ = rec.load_recordings(spark, root, glob="part-*.csv")
    located = rows.select("case_id", F.split("case_id", "/").alias("f"), "service", "ts", F.col("cpu_usage").alias("cpu"))
    return located.select("case_id", F.col("f")[0].alias("dataset"), F.col("f")[1].alias("system"), "service", "ts", "cpu", F.col("ts").isNotNull().alias("clocked"))


@query("side_files", with_ctes("rec_cases", body="""
    SELECT rec_id AS case_id, CASE WHEN dom % 7 = 0 THEN NULL ELSE inject_time END AS inject_time,
           CASE WHEN dom % 5 = 0 THEN NULL ELSE fault_service END AS root_cause_service,
           CASE WHEN dom % 5 = 0 THEN NULL ELSE fault_type END AS root_cause_metric FROM rec_cases"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lines = recording_lines(panel_day(events), day_cases(events))
    folders = rec.choose_metrics_file(rec.locate(rec.read_files(lines), ROOT))
    dated = folders.withColumn("day", F.to_date(F.regexp_extract("case_id", r"[_/](\d{8})\d{4}$", 1), "yyyyMMdd"))
    dom = F.dayofmonth("day")
    time = (F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + 43200).cast("string")
    texts = dated.select(
        F.concat("case_dir", F.lit("/inject_time.txt")).alias("path"),
        F.when(dom % 7 == 0, F.lit("not a number")).otherwise(F.concat(F.lit(" "), time, F.lit("\n"))).alias("content"))
    truths = dated.filter(dom % 5 != 0).select(
        F.concat("case_dir", F.lit("/ground_truth.json")).alias("path"),
        F.to_json(F.struct(F.col("fault_service").alias("root_cause_service"),
                           F.col("fault_type").alias("root_cause_metric"))).alias("content"))
    return rec.inject_times(texts, ROOT).join(rec.ground_truth(truths, ROOT), "case_id", "left")


_NAMES = """
    SELECT event_id, CASE event_id % 5
        WHEN 0 THEN event_type || '_cpu'
        WHEN 1 THEN 'sock-shop_' || event_type || '_f' || CAST(event_id % 5 + 1 AS VARCHAR) || '_' || CAST(user_id AS VARCHAR)
        WHEN 2 THEN event_type || '_db_delay_' || CAST(user_id AS VARCHAR)
        WHEN 3 THEN 'lab_' || event_type || '_crash_' || CAST(user_id AS VARCHAR)
        ELSE 'train-ticket_' || event_type || '_db_loss' END AS name, event_type, user_id
    FROM events"""


@query("parse_case_name", f"""
    WITH names AS ({_NAMES}), parts AS (
        SELECT *, string_split(name, '_') AS p,
               list_position(list_transform(string_split(name, '_'), lambda x: x IN ('cpu','mem','disk','delay','loss','socket','f1','f2','f3','f4','f5')), true) AS hit
        FROM names)
    SELECT event_id, name,
        CASE WHEN coalesce(hit, 0) = 0 THEN p[1] WHEN hit >= 3 AND p[1] IN ('online-boutique', 'sock-shop', 'train-ticket') THEN p[1] ELSE 'unknown' END AS system,
        CASE WHEN coalesce(hit, 0) = 0 THEN p[2]
             WHEN hit >= 3 AND p[1] IN ('online-boutique', 'sock-shop', 'train-ticket') THEN array_to_string(p[2:hit-1], '_')
             ELSE array_to_string(p[1:hit-1], '_') END AS service,
        CASE WHEN coalesce(hit, 0) = 0 THEN p[3] ELSE p[hit] END AS fault_type,
        coalesce(TRY_CAST(CASE WHEN coalesce(hit, 0) = 0 THEN p[4] ELSE p[hit + 1] END AS BIGINT), 0) AS instance
    FROM parts""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    u, t = F.col("user_id").cast("string"), F.col("event_type")
    name = (F.when(kind == 0, F.concat(t, F.lit("_cpu")))
            .when(kind == 1, F.concat_ws("_", F.lit("sock-shop"), t, F.concat(F.lit("f"), (kind + 1).cast("string")), u))
            .when(kind == 2, F.concat_ws("_", t, F.lit("db"), F.lit("delay"), u))
            .when(kind == 3, F.concat_ws("_", F.lit("lab"), t, F.lit("crash"), u))
            .otherwise(F.concat_ws("_", F.lit("train-ticket"), t, F.lit("db"), F.lit("loss"))))
    return e.select("event_id", name.alias("name")).withColumn("p", rec.parse_case_name(F.col("name"))).select(
        "event_id", "name", "p.system", "p.service", "p.fault_type", "p.instance")


def _wide(spark, sf_dir) -> DataFrame:
    """One wide row per case and hour: 5 services x 3 columns and a stray one."""
    panel = panel_day(table(spark, sf_dir, "events"))
    services = ["click", "error", "purchase", "signup", "view"]

    def cell(s, m):
        return F.max(F.when(F.col("service") == s, F.col(m)))

    cols = []
    for s in services:
        cols += [cell(s, "cpu_usage").alias(f"{s}_cpu"), cell(s, "latency").alias(f"{s}_latency-90"),
                 (cell(s, "latency") / 2).alias(f"{s}_latency-50"), cell(s, "request_rate").alias(f"{s}_workload")]
    return panel.groupBy("case_id", F.col("ts").alias("time")).agg(*cols, F.count(F.lit(1)).alias("stray"))


cte("wide_long", """
    SELECT c.case_id, t.time, s.service, d.cpu_usage, d.latency, d.request_rate
    FROM (SELECT DISTINCT case_id, ts AS time FROM day) t
    JOIN (SELECT DISTINCT case_id FROM day) c USING (case_id)
    CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS service) s
    LEFT JOIN day d ON d.case_id = t.case_id AND d.ts = t.time AND d.service = s.service""", "day")


@query("wide_unpivot", with_ctes("wide_long", body=f"""
    SELECT case_id, time, service, metric, col, {r('value')} AS value FROM (
        SELECT case_id, time, service, 'cpu_usage' AS metric, service || '_cpu' AS col, cpu_usage AS value FROM wide_long
        UNION ALL SELECT case_id, time, service, 'latency', service || '_latency-90', latency FROM wide_long
        UNION ALL SELECT case_id, time, service, 'latency', service || '_latency-50', latency / 2 FROM wide_long
        UNION ALL SELECT case_id, time, service, 'request_rate', service || '_workload', request_rate FROM wide_long)"""))
def _(spark, sf_dir):
    long = rs.unpivot_wide(_wide(spark, sf_dir), ["case_id", "time"])
    return long.select("case_id", "time", "service", "metric", "col", stable("value").alias("value"))


for _name, _p90, _lat in (("canonical_pivot", True, "latency"), ("canonical_pivot_last_wins", False, "latency / 2")):
    @query(_name, with_ctes("wide_long", body=f"""
        SELECT case_id, time, service, {r('coalesce(cpu_usage, 0)')} AS cpu_usage, 0.0::DOUBLE AS memory_usage,
               {r('coalesce(request_rate, 0)')} AS request_rate, 0.0::DOUBLE AS error_rate, {r(f'coalesce({_lat}, 0)')} AS latency,
               0.0::DOUBLE AS network_in, 0.0::DOUBLE AS network_out FROM wide_long"""))
    def _(spark, sf_dir, p90=_p90):
        ids = ["case_id", "time"]
        return rounded(rs.pivot_canonical(rs.unpivot_wide(_wide(spark, sf_dir), ids), ids, p90), "case_id", "time", "service")


@query("unmatched_header_fallback", with_ctes("day", body="""
    SELECT case_id, ts AS time, 'unknown' AS service, count(*) AS stray FROM day GROUP BY 1, 2"""))
def _(spark, sf_dir):
    plain = _wide(spark, sf_dir).select("case_id", "time", "stray")
    return rs.parse_wide(plain, ["case_id", "time"])


def _mixed_cases(events):
    dom = F.dayofmonth(F.to_date(F.substring_index("case_id", "#", 1)))
    moved = F.col("inject_time") - 43200 + (8 + dom % 8) * 3600
    return day_cases(events).withColumn("inject_time", F.when(dom % 10 != 0, moved))


@query("split_guard_and_missing_time", with_ctes("split_mixed", body=f"""
    SELECT case_id, role, service, ts, i, n, {rr(*METRICS)} FROM split_mixed"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(split_recordings(panel_day(events), _mixed_cases(events)), "case_id", "role", "service", "ts", "i", "n")


@query("half_sizes", with_ctes("split_mixed_sizes", body="SELECT case_id, n_pre, n_post FROM split_mixed_sizes"))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return half_sizes(tag_halves(panel_day(events), _mixed_cases(events)))


@query("split_by_row_index", with_ctes("day", body=f"""
    SELECT case_id || CASE WHEN i < 11 THEN '_pre' ELSE '_post' END AS part, service, count(*) AS rows, {r('sum(cpu_usage)')} AS total
    FROM day GROUP BY 1, 2"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    panel = panel_day(events).withColumn("ts", F.lit(None).cast("long"))
    tagged = tag_halves(panel, day_cases(events).withColumn("inject_time", F.lit(11).cast("long")))
    return tagged.groupBy(F.concat_ws("_", "case_id", "half").alias("part"), "service").agg(
        F.count(F.lit(1)).alias("rows"), stable(F.sum("cpu_usage")).alias("total"))


_UF, _UN = sql_uniform("42/fault", "case_id"), sql_uniform("42/normal", "case_id")


cte("kept_mixed", """
    SELECT * FROM cases_mixed JOIN split_mixed_sizes USING (case_id)
    WHERE inject_time IS NULL OR (n_pre >= 10 AND n_post >= 10)""", "cases_mixed", "split_mixed_sizes")


@query("split_case_table", with_ctes("kept_mixed", body=f"""
    SELECT case_id, system, label, event_type, context_confidence, fault_service, fault_type, has_reference FROM (
        SELECT case_id || '_fault' AS case_id, system, 0 AS label, CASE WHEN {_UF} < 0.3 THEN 'maintenance_window' END AS event_type,
               CASE WHEN {_UF} < 0.3 THEN '0.6' END AS context_confidence, fault_service, fault_type, true AS has_reference
        FROM kept_mixed WHERE inject_time IS NOT NULL
        UNION ALL SELECT case_id || '_normal', system, 1, CASE WHEN {_UN} < 0.7 THEN 'normal_operation' END,
               CASE WHEN {_UN} < 0.7 THEN '0.8' END, NULL, NULL, true FROM kept_mixed WHERE inject_time IS NOT NULL
        UNION ALL SELECT case_id, system, 0, NULL, NULL, fault_service, fault_type, false FROM kept_mixed WHERE inject_time IS NULL)"""))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = split_cases(panel_day(events), _mixed_cases(events))
    get = lambda k: F.try_element_at("context", F.lit(k)).alias(k)
    return out.select("case_id", "system", "label", get("event_type"), get("context_confidence"),
                      "fault_service", "fault_type", "has_reference")


@query("label_codes", with_ctes("cases_day", body="""
    SELECT case_id, CASE dom % 4 WHEN 0 THEN 'FAULT' WHEN 1 THEN 'EXPECTED_LOAD' WHEN 2 THEN 'UNKNOWN' ELSE 'OTHER' END AS name,
           CASE dom % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS code,
           CASE dom % 4 WHEN 0 THEN 'FAULT' WHEN 1 THEN 'EXPECTED_LOAD' WHEN 2 THEN 'UNKNOWN' END AS back FROM cases_day"""))
def _(spark, sf_dir):
    dom = F.dayofmonth(F.to_date(F.substring_index("case_id", "#", 1)))
    name = F.when(dom % 4 == 0, "FAULT").when(dom % 4 == 1, "EXPECTED_LOAD").when(dom % 4 == 2, "UNKNOWN").otherwise("OTHER")
    cases = day_cases(table(spark, sf_dir, "events")).select("case_id", name.alias("name"))
    return cases.withColumn("code", encode_label(F.col("name"))).withColumn("back", decode_label(F.col("code")))


@query("load_difficulty", with_ctes("cases_day", body=f"""
    SELECT case_id, {r('load_multiplier')} AS load_multiplier,
           CASE WHEN load_multiplier >= 4 THEN 'hard' WHEN load_multiplier >= 2.5 THEN 'medium' ELSE 'easy' END AS difficulty
    FROM cases_day"""))
def _(spark, sf_dir):
    cases = day_cases(table(spark, sf_dir, "events"))
    return cases.select("case_id", stable("load_multiplier").alias("load_multiplier"),
                        rs.load_difficulty(F.col("load_multiplier")).alias("difficulty"))


def _bucket_sql(profile: str) -> str:
    w = SEVERITY_PROFILES[profile]
    u = sql_uniform("42/severity", "event_id")
    return f"CASE WHEN {u} < {w['low']!r}::DOUBLE THEN 'low' WHEN {u} < {w['low'] + w['medium']!r}::DOUBLE THEN 'medium' ELSE 'high' END"


@query("weighted_buckets", f"""
    SELECT profile, severity, count(*) AS events FROM (
        SELECT 'default' AS profile, {_bucket_sql('default')} AS severity FROM events
        UNION ALL SELECT 'moderate', {_bucket_sql('moderate')} FROM events
        UNION ALL SELECT 'hard', {_bucket_sql('hard')} FROM events) GROUP BY 1, 2""")
def _(spark, sf_dir):
    u = hash_uniform("42/severity", F.col("event_id"))
    drawn = table(spark, sf_dir, "events").select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("profile"), rs.severity(u, p).alias("severity")) for p in SEVERITY_PROFILES])).alias("d"))
    return drawn.groupBy("d.profile", "d.severity").agg(F.count(F.lit(1)).alias("events"))


_TAX = ", ".join(f"('{k}', '{v}')" for k, v in FAULT_TAXONOMY.items())
_DETAILED = list(FAULT_TAXONOMY)


@query("fault_taxonomy", f"""
    WITH tax(detailed, benchmark) AS (VALUES {_TAX}),
    typed AS (SELECT {_DETAILED!r}[CAST(event_id % 11 AS INTEGER) + 1] AS detailed, value FROM events)
    SELECT benchmark, detailed, count(*) AS events, {r('sum(value)')} AS total FROM typed JOIN tax USING (detailed) GROUP BY 1, 2""")
def _(spark, sf_dir):
    names = F.array(*[F.lit(d) for d in _DETAILED])
    typed = table(spark, sf_dir, "events").select(names[(F.col("event_id") % 11).cast("int")].alias("detailed"), "value")
    return typed.withColumn("benchmark", rs.benchmark_fault(F.col("detailed"))).groupBy("benchmark", "detailed").agg(
        F.count(F.lit(1)).alias("events"), stable(F.sum("value")).alias("total"))


@query("fault_taxonomy_inverse", f"""
    WITH tax(detailed, benchmark) AS (VALUES {_TAX}),
    typed AS (SELECT DISTINCT {_DETAILED!r}[CAST(event_id % 11 AS INTEGER) + 1] AS detailed FROM events)
    SELECT benchmark, string_agg(detailed, ',' ORDER BY detailed) AS detailed FROM typed JOIN tax USING (detailed) GROUP BY 1""")
def _(spark, sf_dir):
    names = F.array(*[F.lit(d) for d in _DETAILED])
    seen = table(spark, sf_dir, "events").select(names[(F.col("event_id") % 11).cast("int")].alias("detailed"))
    mapping = seen.withColumn("benchmark", rs.benchmark_fault(F.col("detailed")))
    return rs.taxonomy_inverse(mapping).select("benchmark", F.array_join("detailed", ",").alias("detailed"))


@query("numeric_cleaning", f"""
    SELECT o_orderkey, {r('CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN 0 ELSE o_totalprice END')} AS o_totalprice,
           CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS as_float
    FROM orders""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_custkey") % 3
    dirty = o.select("o_orderkey", F.col("o_totalprice").alias("raw"),
                     F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
                     .alias("o_totalprice"))
    clean = rs.as_float(rs.clean_numeric(dirty), ["raw"])
    return clean.select("o_orderkey", stable("o_totalprice").alias("o_totalprice"), F.col("raw").cast("double").alias("as_float"))


@query("numeric_columns", f"SELECT {r('sum(l_quantity)')} AS l_quantity, {r('sum(l_tax)')} AS l_tax, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_linenumber", "l_returnflag", "l_shipdate")
    real = {f.name: f.dataType.simpleString() for f in li.schema}
    return li.agg(*[(stable(F.sum(c)) if real[c] == "double" else F.sum(c)).alias(c) for c in rs.numeric_columns(li)])


_CTX = FEATURE_GROUPS["context"]
_WORK = FEATURE_GROUPS["workload"][:2]


def _small_features(spark, sf_dir) -> DataFrame:
    """A few named feature columns per order, enough to exercise the masks."""
    o = table(spark, sf_dir, "orders")
    base = F.col("o_totalprice")
    cols = {c: base / (k + 2) for k, c in enumerate(_WORK + _CTX + ["mean_latency", "n_services"])}
    return o.select(F.col("o_orderkey").alias("case_id"), *[v.alias(c) for c, v in cols.items()])


def _mask_sql(kept: list[str]) -> str:
    names = _WORK + _CTX + ["mean_latency", "n_services"]
    parts = [f"{r(f'o_totalprice / {k + 2}')} AS {c}" if c in kept else f"0.0::DOUBLE AS {c}" for k, c in enumerate(names)]
    return f"SELECT o_orderkey AS case_id, {', '.join(parts)} FROM orders"


for _variant in rs.VARIANT_GROUPS:
    _kept = [c for g in rs.VARIANT_GROUPS[_variant] for c in FEATURE_GROUPS[g]]

    @query(f"mask_{_variant}", _mask_sql(_kept))
    def _(spark, sf_dir, variant=_variant):
        return rounded(rs.mask_groups(_small_features(spark, sf_dir), variant), "case_id")


@query("drop_context_group", f"""
    SELECT o_orderkey AS case_id, {r('o_totalprice / 2')} AS {_WORK[0]}, {r('o_totalprice / 3')} AS {_WORK[1]},
           {r('o_totalprice / 9')} AS mean_latency, {r('o_totalprice / 10')} AS n_services FROM orders""")
def _(spark, sf_dir):
    return rounded(rs.drop_group(_small_features(spark, sf_dir), "context"), "case_id")


_KEEP = sql_uniform("42/3", "o_orderkey")


@query("context_dropout", "SELECT o_orderkey AS case_id, " + ", ".join(
    f"{r(f'CASE WHEN {_KEEP} > 0.3 THEN o_totalprice / {k + 4} ELSE 0 END')} AS {c}" for k, c in enumerate(_CTX)) + " FROM orders")
def _(spark, sf_dir):
    out = rs.drop_context_at_random(_small_features(spark, sf_dir), epoch=3)
    return rounded(out.select("case_id", *_CTX), "case_id")


@query("concat_feature_sources", f"""
    SELECT vec_id, len(v) AS size, {r('v[1]')} AS head, {r('v[65]')} AS joined FROM (
        SELECT vec_id, list_concat(embedding, [CAST(label AS FLOAT), CAST(label AS FLOAT) * 2]) AS v FROM embeddings)""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    extra = e.select("vec_id", F.array(F.col("label").cast("float"), F.col("label").cast("float") * 2).alias("extra"))
    both = rs.concat_sources(e, extra, "vec_id", ["embedding", "extra"])
    v = F.col("features")
    return both.select("vec_id", F.size(v).cast("long").alias("size"), stable(v[0].cast("double")).alias("head"),
                       stable(v[64].cast("double")).alias("joined"))

