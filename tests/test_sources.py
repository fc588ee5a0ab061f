"""Reading a tree of recordings and writing result tables."""

import json

import pytest
from pyspark.sql import functions as F

from faultscope.plans.reshape_queries import _write_tree
from faultscope.sources import recordings as rec
from faultscope.sources import results as rt
from faultscope.sources.tables import land, shared_folder

FLAT, NESTED, PLAIN = "D1/sock-shop/sock-shop_cart_cpu_3", "D1/sock-shop/P/user_mem/2", "D2/train-ticket/ts_f3"
HEADER = "time,time,cart_cpu,cart_latency-90,cart_latency-50,cart_load,redis-cart_mem,stray"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    rows = "\n".join(f"{100 + k},0,{k}.5,{k * 10},{k},{k + 1},,7" for k in range(30))
    flat = root / "D1" / "sock-shop" / "sock-shop_cart_cpu_3"
    write(flat / "simple_metrics.csv", HEADER + "\n" + rows + "\n")
    write(flat / "data.csv", "time,decoy_cpu\n1,1\n")
    write(flat / "inject_time.txt", "115\n")
    write(flat / "ground_truth.json", json.dumps({"root_cause_service": "cart", "root_cause_metric": "cpu"}))
    write(flat / "logs.csv", "ts,message\n1,hello\n2,bye\n")
    nested = root / "D1" / "sock-shop" / "P" / "user_mem" / "2"
    write(nested / "my_Metrics.csv", 'timestamp,"cart_cpu",cart_error\n5,"1.25",oops\n6,nan,0.5\n')
    write(nested / "inject_time.txt", "soon")
    write(nested / "logs.csv", "level,message,ts\nhigh,turned,9\n")
    plain = root / "D2" / "train-ticket" / "ts_f3"
    write(plain / "data.csv", "cpu_usage,other\n1,2\n3,4\n")
    write(root / "D2" / "train-ticket" / "empty_cpu" / "metrics.csv", "time,a_cpu\n")
    return str(root)


def test_tree(spark, tree):
    rows, cases = rec.load_recordings(spark, tree)
    got = {r.case_id: r for r in cases.collect()}
    assert set(got) == {FLAT, NESTED, PLAIN}
    first = got[FLAT]
    assert (first.dataset, first.system, first.fault_service, first.fault_type, first.inject_time) == ("D1", "sock-shop", "cart", "cpu", 115)
    assert (first.root_cause_service, first.root_cause_metric) == ("cart", "cpu")
    assert got[NESTED].inject_time is None and got[NESTED].system == "sock-shop"
    assert (got[PLAIN].system, got[PLAIN].fault_type) == ("train-ticket", "f3")

    flat = rows.filter(f"case_id = '{FLAT}'")
    assert {r.service for r in flat.select("service").distinct().collect()} == {"cart", "redis-cart"}
    cart = flat.filter("service = 'cart'").orderBy("row").collect()
    assert [r.row for r in cart] == list(range(30))
    assert [r.ts for r in cart] == [100 + k for k in range(30)]
    assert cart[4].latency == 40.0 and cart[4].cpu_usage == 4.5 and cart[4].request_rate == 5.0 and cart[4].network_in == 0.0
    assert flat.filter("service = 'redis-cart'").first().memory_usage is None

    nested = rows.filter(f"case_id = '{NESTED}'").orderBy("row").collect()
    assert [(r.ts, r.cpu_usage, r.error_rate) for r in nested] == [(5, 1.25, None), (6, None, 0.5)]
    plain = rows.filter(f"case_id = '{PLAIN}'").orderBy("row").collect()
    assert [(r.service, r.ts, r.row, r.cpu_usage, r.latency) for r in plain] == [("unknown", None, 0, 1.0, 0.0), ("unknown", None, 1, 3.0, 0.0)]


def test_filters_and_last_wins(spark, tree):
    rows, cases = rec.load_recordings(spark, tree, fault_types=["cpu"], datasets=["D1"], prefer_p90=False)
    assert [r.case_id for r in cases.collect()] == [FLAT]
    assert rows.filter("service = 'cart' and row = 4").first().latency == 4.0
    with pytest.raises(FileNotFoundError):
        rec.load_recordings(spark, tree, systems=["nowhere"])


def test_large_file_is_split_and_numbered(spark, tmp_path):
    path = tmp_path / "D" / "sock-shop" / "cart_cpu" / "metrics.csv"
    write(path, "time,cart_cpu\n" + "".join(f"{k},{k}.0\n" for k in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        lines = rec.scan_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        rows = rec.panel_rows(lines, str(tmp_path))
        assert rows.count() == 20000
        assert rows.filter("row <> ts or row <> cpu_usage").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_chosen_files_are_opened(spark, tree):
    """The listing decides; the scan of the chosen files has no others among its inputs."""
    listed = rec.list_files(spark, tree)
    assert {p.path.rsplit("/", 1)[1] for p in listed.collect()} == {"simple_metrics.csv", "data.csv", "my_Metrics.csv", "metrics.csv"}
    for filters, want in (({}, {"simple_metrics.csv", "my_Metrics.csv", "data.csv", "metrics.csv"}), ({"fault_types": ["mem"]}, {"my_Metrics.csv"})):
        chosen = rec.choose_files(listed, tree, **filters)
        lines = rec.scan_lines(spark, tree, chosen=chosen)
        paths = {r.path for r in lines.select("path").distinct().collect()}
        assert {p.rsplit("/", 1)[1] for p in paths} == want
        assert not any("sock-shop_cart_cpu_3/data.csv" in p for p in paths)
        scan = lines._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        scan.executeColumnar() if scan.supportsColumnar() else scan.execute()
        assert scan.metrics().get("numFiles").get().value() == len(paths)


def test_blank_lines_and_blocks_leave_rows_gapless(spark, tmp_path):
    path = tmp_path / "D" / "sock-shop" / "cart_cpu" / "metrics.csv"
    write(path, "\ntime,cart_cpu\n" + "".join(f"{k},{k}.0\n" + "  \n" * (k % 3 == 0) for k in range(9000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = land(rec.scan_lines(spark, str(tmp_path)), "lines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert lines.select("block").distinct().count() > 3
    for gapless in (True, False):
        rows = rec.panel_rows(lines, str(tmp_path), gapless=gapless)
        assert rows.count() == 9000 and rows.filter("row <> ts or row <> cpu_usage").isEmpty()


def test_folders_of_a_partitioned_write(spark):
    files = spark.createDataFrame([("file:///r/a=D1/b=sock-shop/c=P/d=cart_cpu/e=7/x=y.csv",)], "path string")
    got = rec.locate(files, "/r").first()
    assert (got.dataset, got.system, got.fault_service, got.fault_type, got.case_id) == ("D1", "sock-shop", "cart", "cpu", "D1/sock-shop/P/cart_cpu/7")


def test_side_tables(spark, tree):
    logs = rec.read_side_table(spark, tree, "logs.csv")
    assert {(r.case_id, r.message) for r in logs.collect()} == {(FLAT, "hello"), (FLAT, "bye"), (NESTED, "turned")}
    assert rec.read_side_table(spark, tree, "traces.csv") is None


@pytest.mark.parametrize("name, want", [
    ("adservice_cpu", ("unknown", "adservice", "cpu", 0)),
    ("sock-shop_user_db_delay_7", ("sock-shop", "user_db", "delay", 7)),
    ("some_user_loss_1", ("unknown", "some_user", "loss", 1)),
    ("lab_cart_crash_4", ("lab", "cart", "crash", 4)),
    ("alone", ("alone", "unknown", "unknown", 0)),
    ("cart_mem_x", ("unknown", "cart", "mem", 0)),
])
def test_case_names(spark, name, want):
    got = spark.range(1).select(rec.parse_case_name(F.lit(name)).alias("p")).first()["p"]
    assert tuple(got) == want


def test_summary_and_upsert_files(spark, tmp_path):
    old = spark.createDataFrame([(100, "a", 0.5), (200, "a", 0.25)], "total int, variant string, f1 double")
    rt.write_summary_csv(old, str(tmp_path / "one"), ["total", "variant"])
    new = spark.createDataFrame([(200, "a", "0.9000"), (50, "b", "0.1000")], "total int, variant string, f1 string")
    rt.upsert_csv(new, str(tmp_path / "one"), str(tmp_path / "two"), ["total", "variant"])
    got = {(r.total, r.variant): r.f1 for r in spark.read.option("header", True).csv(str(tmp_path / "two")).collect()}
    assert got == {("100", "a"): "0.5000", ("200", "a"): "0.9000", ("50", "b"): "0.1000"}


def test_merge_ignores_missing_systems(spark):
    rows = spark.createDataFrame([("x", "v", 0.5), ("y", "v", 1.0), ("x", "w", 0.25)], "system string, variant string, f1_mean double")
    got = {r.variant: r for r in rt.merge_systems(rows, ["x", "y"], ["f1_mean"]).collect()}
    assert got["v"].Avg_f1_mean == 0.75 and got["w"].Avg_f1_mean == 0.25 and got["w"].y_f1_mean is None


def test_landed_tables_live_in_the_shared_folder(spark):
    df = land(spark.range(5).toDF("x"), "test")
    assert df.count() == 5
    assert shared_folder(spark) in df.inputFiles()[0]


def test_equal_folder_names_stay_apart(spark, tmp_path):
    """Two datasets, systems and prefixes with one folder name; a clock that is no number."""
    for d in ("RE1", "RE2"):
        for s in ("sock-shop", "train-ticket"):
            for p in ("P", "Q"):
                folder = tmp_path / d / s / p / "cart_cpu" / "1"
                write(folder / "metrics.csv", "time,cart_cpu\n" + "".join(f"{k},{k}.0\n" for k in range(5)) + "nan,9\n")
                write(folder / "inject_time.txt", "3" if p == "P" else "4")
    rows, cases = rec.load_recordings(spark, str(tmp_path))
    assert cases.count() == 8 and rows.count() == 48
    assert {r["count"] for r in rows.groupBy("case_id").count().collect()} == {6}
    assert rows.filter("cpu_usage = 9 and ts is null").count() == 8
    assert {(r.case_id.split("/")[2], r.inject_time) for r in cases.collect()} == {("P", 3), ("Q", 4)}


def test_files_outside_a_case_folder_raise(spark, tmp_path):
    write(tmp_path / "D" / "sock-shop" / "metrics.csv", "time,a_cpu\n1,2\n")
    with pytest.raises(Exception, match="no <dataset>/<system>/<case>/ folder"):
        rec.load_recordings(spark, str(tmp_path))


def test_many_small_folders_are_written_and_listed_by_several_tasks(spark, tmp_path):
    names = [F.lit("D").alias("dataset"), F.lit("S").alias("system"), F.lit("P").alias("prefix"), F.lit("f").alias("fault"), F.col("id").alias("instance")]
    _write_tree(spark.range(40).select(*names, F.lit("x").alias("value")), str(tmp_path / "t"), "text")
    files = [r.path for r in rec.list_files(spark, str(tmp_path / "t"), "part-*.txt").collect()]
    assert len(files) == 40
    # The file's name tells its task: tiny rows must not be joined into one.
    assert len({f.rsplit("/", 1)[1][:10] for f in files}) > 1
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with rec._few_listing_tasks(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
