"""Reader for trees of wide CSV recordings.

    <root>/<dataset>/<system>/<case>/metrics.csv
    <root>/<dataset>/<system>/<prefix>/<service>_<fault>/<instance>/metrics.csv

Files are chosen from their listing, before any is opened. The chosen ones are
read as text lines, so a large file splits over tasks. The header of each file
is turned into a reading plan (service -> column numbers) once; a data line then
becomes its panel rows on the spot, without a shuffle. Folders may be named
``key=value``, as a partitioned write names them; the key is left out.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultscope.canonical import FAULT_TOKENS, METRIC_ALIASES, METRICS, METRICS_FILES
from faultscope.sources.tables import land

KNOWN_SYSTEMS = ["online-boutique", "sock-shop", "train-ticket"]
CLOCK_NAMES = ["timestamp", "time", "ts"]
METRICS_GLOB = "*{[mM][eE][tT][rR][iI][cC],[dD][aA][tT][aA]}*.csv"


# ---------------------------------------------------------------- scanning

@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Inside, Spark lists folders in a few tasks a core; else it starts a task for each of up to 10,000 folders."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tree(spark: SparkSession, root: str, glob: str, kind: str, **options) -> DataFrame:
    """All files below ``root`` that match ``glob``; they are listed here."""
    with _few_listing_tasks(spark):
        return spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob, **options).format(kind).load(root)


def list_files(spark: SparkSession, root: str, glob: str = METRICS_GLOB) -> DataFrame:
    """``(path)`` of all matching files. Only their listing is used, none is opened."""
    files = _tree(spark, root, glob, "binaryFile")
    return files.select(F.col("_metadata.file_path").alias("path"))


def scan_lines(spark: SparkSession, root: str, glob: str = METRICS_GLOB, chosen: DataFrame | None = None) -> DataFrame:
    """``(path, block, seq, line)`` of the lines that are not blank, of all matching files or of those whose ``path``
    is in ``chosen``; ``(block, seq)`` orders the lines of a file, ``seq`` has no gaps inside a block.

    The choice reaches Spark as a list of the chosen or of the other paths, whichever is shorter: at most half of the
    listing that its file index holds on the driver anyway. Files outside it are not opened.
    """
    lines = _tree(spark, root, glob, "text")
    if chosen is not None:
        files = list_files(spark, root, glob)
        few, all_of_them = chosen.count(), files.count()
        if few < all_of_them:
            wanted = 2 * few <= all_of_them
            named = chosen if wanted else files.join(chosen, "path", "left_anti")
            within = F.col("_metadata.file_path").isin([r.path for r in named.select("path").toLocalIterator()])
            lines = lines.where(within if wanted else ~within)
    return lines.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def scan_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(path, content)`` of small side files."""
    texts = _tree(spark, root, glob, "text", wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


# ------------------------------------------------------- paths and case names

def parse_case_name(name: Column) -> Column:
    """``struct(system, service, fault_type, instance)`` of a directory name.

    The fault is the first known token; a known system in front of at least one
    service token is the system. Without a fault token the parts are read in
    the order system, service, fault, instance.
    """
    parts = F.split(name, "_")
    tokens = F.array(*[F.lit(t) for t in FAULT_TOKENS])
    flags = F.transform(parts, lambda p: F.array_contains(tokens, p))
    at = F.array_position(flags, F.lit(True)).cast("int")
    named = (at >= 3) & parts[0].isin(KNOWN_SYSTEMS)
    service = F.when(named, F.array_join(F.slice(parts, F.lit(2), at - 2), "_")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), "_")
    )

    def part(k: Column | int, default: str) -> Column:
        index = k if isinstance(k, Column) else F.lit(k)
        return F.coalesce(F.get(parts, index), F.lit(default))

    def number(k: Column | int) -> Column:
        return F.coalesce(part(k, "0").try_cast("bigint"), F.lit(0).cast("bigint"))

    found = F.struct(
        F.when(named, parts[0]).otherwise(F.lit("unknown")).alias("system"),
        service.alias("service"),
        F.get(parts, at - 1).alias("fault_type"),
        number(at).alias("instance"),
    )
    plain = F.struct(
        part(0, "unknown").alias("system"),
        part(1, "unknown").alias("service"),
        part(2, "unknown").alias("fault_type"),
        number(3).alias("instance"),
    )
    return F.when(at > 0, found).otherwise(plain)


def locate(paths: DataFrame, root: str) -> DataFrame:
    """Add dataset, system, case directory and case attributes to ``path``.

    ``case_id`` is the case folder below the root, so equal folder names in other
    datasets, systems or prefixes stay apart. Files that lie above a case folder
    (less than ``<dataset>/<system>/<case>/<file>``) belong to no case and raise.
    """
    below = F.regexp_replace(F.col("path"), r"^[a-zA-Z]+:/*/", "/")
    tail = F.filter(F.split(F.substring_index(below, root.rstrip("/") + "/", -1), "/"), lambda p: p != "")
    tail = F.transform(tail, lambda p: F.regexp_replace(p, r"^[A-Za-z_]\w*=", ""))
    out = paths.withColumn("_seg", tail).withColumn("_depth", F.size("_seg"))
    misplaced = F.concat(F.lit("no <dataset>/<system>/<case>/ folder around "), F.col("path"))
    out = out.withColumn("_depth", F.when(F.col("_depth") >= 4, F.col("_depth")).otherwise(F.raise_error(misplaced).cast("int")))
    name = F.when(F.col("_depth") >= 6, F.get("_seg", F.lit(3))).otherwise(F.get("_seg", F.col("_depth") - 2))
    out = out.withColumn("case_name", name).withColumn("_info", parse_case_name(F.col("case_name")))
    return out.select(
        *paths.columns,
        F.get("_seg", F.lit(0)).alias("dataset"),
        F.when(F.col("_info.system") == "unknown", F.get("_seg", F.lit(1))).otherwise(F.col("_info.system")).alias("system"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("case_dir"),
        F.element_at("_seg", -1).alias("file"),
        "case_name",
        F.array_join(F.slice("_seg", F.lit(1), F.col("_depth") - 1), "/").alias("case_id"),
        F.col("_info.service").alias("fault_service"),
        F.col("_info.fault_type").alias("fault_type"),
    )


def choose_metrics_file(located: DataFrame) -> DataFrame:
    """Keep the best metrics file of each case directory: the listed names in
    order, then any other matching CSV by name."""
    names = F.array(*[F.lit(n) for n in METRICS_FILES])
    place = F.array_position(names, F.col("file"))
    priority = F.when(place > 0, place).otherwise(F.lit(len(METRICS_FILES) + 1))
    best = Window.partitionBy("case_dir").orderBy("_p", "file")
    ranked = located.withColumn("_p", priority).withColumn("_k", F.row_number().over(best))
    return ranked.filter("_k = 1").drop("_p", "_k")


def choose_files(paths: DataFrame, root: str, fault_types: list[str] | None = None,
                 datasets: list[str] | None = None, systems: list[str] | None = None) -> DataFrame:
    """The located files to read: one of each case directory, of the wanted faults, datasets and systems."""
    chosen = choose_metrics_file(locate(paths, root))
    for wanted, c in ((fault_types, "fault_type"), (datasets, "dataset"), (systems, "system")):
        if wanted:
            chosen = chosen.filter(F.col(c).isin(wanted))
    return chosen


# ------------------------------------------------------------ headers, lines

def _fields(line: Column) -> Column:
    """Cells of a CSV line; quotes are only looked for where there are any."""
    clean = F.regexp_replace(line, r"[\r\n]+$", "")
    quoted = F.transform(
        F.split(clean, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.regexp_replace(c, r'^\s*"|"\s*$', "")
    )
    return F.when(clean.contains('"'), quoted).otherwise(F.split(clean, ",", -1))


def header_columns(files: DataFrame) -> DataFrame:
    """``(path, ordinal, col)`` from ``(path, header)``: first of repeated names
    only, and a leading ``time``/``ts`` renamed to ``timestamp``."""
    names = F.transform(_fields(F.col("header")), lambda c: F.trim(c))
    cols = files.select("path", names.alias("names"), F.posexplode(names).alias("ordinal", "col"))
    cols = cols.filter(F.array_position("names", F.col("col")) == F.col("ordinal") + 1)
    rename = (F.col("ordinal") == 0) & F.lower("col").isin("time", "ts") & ~F.array_contains("names", "timestamp")
    return cols.select("path", "ordinal", F.when(rename, "timestamp").otherwise(F.col("col")).alias("col"))


def split_column(col: Column) -> tuple[Column, Column]:
    """``{service}_{suffix}`` -> (service, canonical metric), longest suffix
    first; both null when nothing matches."""
    suffixes = sorted(METRIC_ALIASES, key=len, reverse=True)
    matches = [(F.endswith(col, F.lit("_" + s)) & (F.length(col) > len(s) + 1), s) for s in suffixes]
    service = metric = None
    for hit, s in matches:
        prefix = F.substring(col, F.lit(1), F.length(col) - len(s) - 1)
        target = F.lit(METRIC_ALIASES[s])
        service = F.when(hit, prefix) if service is None else service.when(hit, prefix)
        metric = F.when(hit, target) if metric is None else metric.when(hit, target)
    return service, metric


def winner(col: Column, ordinal: Column, prefer_p90: bool = True) -> Column:
    """Sort key among columns of one (service, metric): the largest wins."""
    tail = F.when(F.endswith(col, F.lit("latency-90")), 1).otherwise(0) if prefer_p90 else F.lit(0)
    return F.struct(tail.alias("tail"), ordinal.alias("ordinal"))


def reading_plan(files: DataFrame, prefer_p90: bool = True) -> DataFrame:
    """One row per file: ordinal of the clock and, per service, the ordinals of
    the seven metrics (null = absent). A header without any service column gives
    one service ``unknown`` read by plain metric names."""
    cols = header_columns(files)
    lowered = F.lower("col")
    service, metric = split_column(F.col("col"))
    is_clock = lowered.isin(*CLOCK_NAMES)
    tagged = cols.select(
        "path", "ordinal", "col",
        F.when(~is_clock, service).alias("service"),
        F.when(~is_clock, metric).alias("metric"),
        F.when(F.col("col").isin(*CLOCK_NAMES),
               F.struct(F.array_position(F.array(*[F.lit(c) for c in CLOCK_NAMES]), F.col("col")).alias("k"),
                        F.col("ordinal"))).alias("clock"),
    )

    def pick(on: Column, c: str) -> Column:
        return F.max_by(F.when(on, F.col("ordinal")), F.when(on, winner(F.col("col"), F.col("ordinal"), prefer_p90))).alias(c)

    per_service = tagged.filter("service is not null").groupBy("path", "service").agg(
        *[pick(F.col("metric") == m, m) for m in METRICS]
    )
    services = per_service.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("service", *METRICS))).alias("services")
    )
    whole = tagged.groupBy("path").agg(F.min("clock").alias("clock"), *[pick(F.col("col") == m, m) for m in METRICS])
    fallback = F.array(F.struct(F.lit("unknown").alias("service"), *[F.col(m) for m in METRICS]))
    return whole.join(services, "path", "left").select(
        "path", F.col("clock.ordinal").alias("clock"), F.coalesce("services", fallback).alias("services")
    )


def file_blocks(lines: DataFrame) -> DataFrame:
    """``(path, block, first, rows)``: the least ``seq`` and the number of lines of every file block.

    One pass over numbers, no line is touched. The table has a row per block and is landed, as are the
    others made from it: Spark then knows their sizes and broadcasts them while they are small.
    """
    blocks = lines.groupBy("path", "block").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    return land(blocks, "file-blocks")


def read_files(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``(path, header, header_block, header_seq)`` of every file: its first line, looked up by its place."""
    blocks = file_blocks(lines) if blocks is None else blocks
    first = blocks.groupBy("path").agg(F.min(F.struct("block", "first")).alias("at"))
    first = land(first.select("path", F.col("at.block").alias("block"), F.col("at.first").alias("seq")), "file-heads")
    return lines.join(first, ["path", "block", "seq"]).select(
        "path", F.col("line").alias("header"), F.col("block").alias("header_block"), F.col("seq").alias("header_seq"))


def body_rows(lines: DataFrame, plans: DataFrame, blocks: DataFrame, gapless: bool) -> DataFrame:
    """The data lines of the files of ``plans`` with the plan's columns and their 0-based ``row`` in the file.

    ``gapless`` says that ``seq`` has no gaps inside a block, as in ``scan_lines``: the row is then the distance from
    the block's first line shifted by the lines before the block, and no line is shuffled. Otherwise lines are ranked.
    """
    plans = plans.drop("header")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    if not gapless:
        body = lines.join(land(plans, "reading-plans"), "path").filter(
            ((F.col("block") != F.col("header_block")) | (F.col("seq") != F.col("header_seq"))) & (F.trim("line") != ""))
        counts = body.groupBy("path", "block").agg(F.count(F.lit(1)).alias("rows"))
        offsets = land(counts.select("path", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")), "block-offsets")
        local = F.row_number().over(Window.partitionBy("path", "block").orderBy("seq"))
        return body.withColumn("k", local).join(offsets, ["path", "block"]).withColumn(
            "row", F.col("offset") + F.col("k") - 1).drop("k", "offset")
    # The header is the line before row 0.
    shifted = blocks.withColumn("shift", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first") - 1)
    per_block = land(shifted.select("path", "block", "shift").join(plans, "path"), "reading-plans")
    numbered = lines.join(per_block, ["path", "block"]).withColumn("row", F.col("seq") + F.col("shift"))
    return numbered.where("row >= 0").drop("shift")


def panel_rows(lines: DataFrame, root: str, fault_types: list[str] | None = None,
               datasets: list[str] | None = None, systems: list[str] | None = None,
               prefer_p90: bool = True, gapless: bool = False) -> DataFrame:
    """Long panel ``(case_id, service, ts, row, metrics...)`` of the chosen file
    of every case; filters act on the path before any line is parsed."""
    blocks = file_blocks(lines)
    chosen = choose_files(read_files(lines, blocks), root, fault_types, datasets, systems)
    plans = chosen.join(reading_plan(chosen.select("path", "header"), prefer_p90), "path")
    numbered = body_rows(lines, plans, blocks, gapless)
    cells = numbered.withColumn("cells", _fields(F.col("line"))).withColumn("s", F.explode("services"))

    def value(m: str) -> Column:
        text = F.trim(F.get("cells", F.col(f"s.{m}")))
        parsed = F.when(F.lower(text).isin("", "nan"), F.lit(None)).otherwise(text).try_cast("double")
        return F.when(F.col(f"s.{m}").isNull(), F.lit(0.0)).otherwise(parsed).alias(m)

    ts = F.trim(F.get("cells", F.col("clock"))).try_cast("double").try_cast("long")
    return cells.select(
        "case_id", "dataset", "system", "fault_service", "fault_type", F.col("s.service").alias("service"),
        F.when(F.col("clock").isNull(), F.lit(None)).otherwise(ts).alias("ts"), "row", *[value(m) for m in METRICS],
    )


# ----------------------------------------------------------------- side files

def inject_times(texts: DataFrame, root: str) -> DataFrame:
    """``(case_id, inject_time)``; text that is no integer gives null."""
    located = locate(texts, root)
    return located.select("case_id", F.trim(F.regexp_replace("content", r"\s+$", "")).try_cast("bigint").alias("inject_time"))


def ground_truth(texts: DataFrame, root: str) -> DataFrame:
    located = locate(texts, root)
    return located.select(
        "case_id",
        F.get_json_object("content", "$.root_cause_service").alias("root_cause_service"),
        F.get_json_object("content", "$.root_cause_metric").alias("root_cause_metric"),
    )


def side_rows(lines: DataFrame, root: str, gapless: bool = False) -> DataFrame:
    """``(case_id, dataset, system, row, cells)`` of side-file lines; ``cells`` maps column names to values.

    Every file is read by its own header, so files may differ in columns and their order.
    """
    blocks = file_blocks(lines)
    files = read_files(lines, blocks)
    names = header_columns(files.select("path", "header")).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "col"))).alias("plan"))
    located = locate(files, root).select("path", "header_block", "header_seq", "case_id", "dataset", "system")
    numbered = body_rows(lines, located.join(names, "path"), blocks, gapless).withColumn("c", _fields(F.col("line")))
    pairs = F.transform("plan", lambda p: F.struct(p["col"], F.get("c", p["ordinal"])))
    return numbered.select("case_id", "dataset", "system", "row", F.map_from_entries(pairs).alias("cells"))


def read_side_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Optional ``logs.csv`` / ``traces.csv`` of all cases, or ``None`` when no
    case has one. The columns of all files together; a file without one has nulls."""
    lines = land(scan_lines(spark, root, name), "side-lines")
    if lines.isEmpty():
        return None
    rows = land(side_rows(lines, root, gapless=True), "side-rows")
    columns = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().orderBy("col").collect()]
    taken = {"case_id", "dataset", "system", "row"}
    values = [F.try_element_at("cells", F.lit(c)).alias(f"{c}_" if c in taken else c) for c in columns]
    return rows.select("case_id", "dataset", "system", "row", *values)


def load_recordings(spark: SparkSession, root: str, glob: str = METRICS_GLOB, prefer_p90: bool = True,
                    **filters) -> tuple[DataFrame, DataFrame]:
    """(panel rows, case table) of a tree on storage. Files are chosen by their paths, then read; the
    text is parsed once and landed in columns, which every later step reads. Side files without any
    match leave their columns null."""
    chosen = land(choose_files(list_files(spark, root, glob), root, **filters).select("path"), "chosen-files")
    # Line numbers must agree in every pass over the lines, so the lines are landed first.
    lines = land(scan_lines(spark, root, glob, chosen), "recording-lines")
    rows = land(panel_rows(lines, root, prefer_p90=prefer_p90, gapless=True), "recordings")
    times = inject_times(scan_texts(spark, root, "inject_time.txt"), root)
    truth = ground_truth(scan_texts(spark, root, "ground_truth.json"), root)
    cases = rows.select("case_id", "dataset", "system", "fault_service", "fault_type").distinct()
    cases = cases.join(times, "case_id", "left").join(truth, "case_id", "left")
    if cases.isEmpty():
        raise FileNotFoundError(f"no recording under {root} matches")
    return rows.drop("dataset", "system", "fault_service", "fault_type"), cases
