"""From a tree of CSV files to features, a fitted model and an evaluation."""

import numpy as np

from faultscope.canonical import FEATURE_COLUMNS
from faultscope.models.classifiers import train_and_evaluate
from faultscope.operators.evaluation import by_fault_type
from faultscope.operators.features import extract_features
from faultscope.operators.split import split_cases, split_recordings
from faultscope.sources.recordings import load_recordings
from faultscope.sources.tables import land

SERVICES = ["frontend", "cart", "checkout"]


def write_tree(root, n=12, rows=80, inject=50):
    g = np.random.default_rng(9)
    for k in range(n):
        kind = ["cpu", "delay"][k % 2]
        folder = root / "D1" / "sock-shop" / "P" / f"cart_{kind}" / str(k)
        folder.mkdir(parents=True)
        cols = [f"{s}_{m}" for s in SERVICES for m in ("cpu", "mem", "load", "error", "latency-90")]
        x = g.normal(10, 1, (rows, len(cols)))
        x[inject:, cols.index("cart_cpu")] += 15
        x[inject:, cols.index("cart_error")] += 3
        text = "time," + ",".join(cols) + "\n" + "\n".join(
            f"{1_700_000_000 + r}," + ",".join("" if (r, c) == (3, 0) else f"{v:.6f}" for c, v in enumerate(row)) for r, row in enumerate(x))
        (folder / "metrics.csv").write_text(text)
        (folder / "inject_time.txt").write_text(str(1_700_000_000 + inject))


def test_files_to_evaluation(spark, tmp_path):
    write_tree(tmp_path)
    rows, cases = load_recordings(spark, str(tmp_path))
    panel = rows.withColumnRenamed("row", "i")
    metrics = land(split_recordings(panel, cases), "panel")
    table = split_cases(panel, cases)
    features = land(extract_features(metrics, table, "comparison"), "features")
    assert features.count() == 24 and features.filter("not has_reference").isEmpty()
    assert np.isfinite(features.select(*FEATURE_COLUMNS).toPandas().to_numpy()).all()
    f = features.filter("case_id = 'D1/sock-shop/P/cart_cpu/0_fault'").first()
    assert f.n_services == 3.0 and f.cpu_deviation > 0.01
    assert features.filter("label = 0 and cpu_deviation < 0.01").isEmpty() and features.filter("label = 1 and cpu_deviation > 0.01").isEmpty()
    _, result = train_and_evaluate(features, "random_forest", numTrees=10, maxDepth=3)
    assert result["metrics"].first()["accuracy"] == 1.0
    typed = result["predictions"].join(table.select("case_id", "fault_type"), "case_id")
    assert {r.recall for r in by_fault_type(typed).collect()} == {1.0}
