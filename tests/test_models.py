"""Classifiers, detector, centroids and streaming."""

import numpy as np
import pytest
from helpers import panel
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from faultscope.canonical import FEATURE_COLUMNS
from faultscope.models import classifiers as cl
from faultscope.models import grid as gr
from faultscope.models import many
from faultscope.models.centroids import CentroidClassifier, CentroidModel
from faultscope.models.detector import WindowDetector
from faultscope.operators.transform import ColumnScaler, ColumnScalerModel, PiecewiseBins, PiecewiseBinsModel
from faultscope.operators.reshape import mask_groups

SMALL = {"numTrees": 5, "maxDepth": 3}


@pytest.fixture(scope="module")
def features(spark):
    x = np.random.default_rng(0).normal(0, 1, (80, 44))
    x[:40] += 1.0
    rows = [(f"c{k}", int(k >= 40), *map(float, r)) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "case_id string, label int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)).persist()


def test_unsupported_model():
    with pytest.raises(ValueError):
        cl.classifier("svm", FEATURE_COLUMNS)


def test_forest(spark, features, tmp_path):
    model, tables = cl.train_and_evaluate(features, "random_forest", **SMALL)
    test = tables["predictions"]
    assert test.count() == 16
    assert test.filter("abs(p0 + p1 - 1) > 1e-9 or y_pred not in (0, 1)").isEmpty()
    assert tables["metrics"].first()["f1"] > 0.7
    assert cl.feature_importance(spark, model, FEATURE_COLUMNS).count() == 44
    assert cl.predict_with_threshold(model, features, 0.3).filter("y_pred = 2").isEmpty()
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = cl.predict(model, features), cl.predict(again, features)
    assert a.select("case_id", "p0").exceptAll(b.select("case_id", "p0")).isEmpty()


def test_forest_keeps_node_ids_and_finds_the_same_trees(features):
    train = cl.prepare(features, FEATURE_COLUMNS, "random_forest")
    kept, walked = (cl.classifier("random_forest", FEATURE_COLUMNS, **SMALL, **more) for more in ({}, {"cacheNodeIds": False}))
    assert kept.getStages()[-1].getCacheNodeIds()
    a, b = (p.fit(train).stages[-1].toDebugString.split("\n", 1)[1] for p in (kept, walked))
    assert a == b


def test_cross_validation_and_grid(features):
    factory = lambda: cl.classifier("random_forest", FEATURE_COLUMNS, **SMALL)
    folds = cl.cross_validate(features, factory, FEATURE_COLUMNS, "random_forest", 3)
    assert folds.count() == 3 and folds.agg(F.avg("f1")).first()[0] > 0.7
    names = ["Forest (no context)", "Naive", "Rule"]
    scored = gr.run_grid(features, {n: gr.VARIANTS[n] for n in names}, 2, params={"random_forest": {"trees": 20, "depth": 4}})
    summary = {r.variant: r for r in gr.grid_summary(scored).collect()}
    assert set(summary) == set(names)
    assert summary["Naive"].fp_rate_mean == 1.0 and summary["Naive"].fault_recall_mean == 1.0 and summary["Naive"].fp_reduction_mean == 0.0


def test_a_scoring_task_reads_one_slice_or_few(features):
    specs = [many.Spec("m", "random_forest", tuple(range(44)))]
    rows = features.withColumn("run", F.lit(0))
    models = many.fit_all(rows, specs, FEATURE_COLUMNS, ["run"], settings={"random_forest": {"trees": 3, "depth": 2}})
    scored = many.score_all(rows, models, specs, FEATURE_COLUMNS, ["run"], rows_of_slice=2)
    # As many tasks as slices, whatever the session's number of shuffle partitions.
    assert scored.rdd.getNumPartitions() == 40
    assert scored.count() == 80 and scored.select("case_id").distinct().count() == 80


def test_masks(features):
    row = mask_groups(features, "context_only").first()
    assert row["cpu_deviation"] != 0.0 and row["mean_latency"] == 0.0 and row["n_services"] == 0.0


def test_scaler_and_bins_survive_storage(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (float("nan"), 5.0)], "a double, b double")
    model = ColumnScaler(inputCols=["a", "b"]).fit(df)
    model.write().overwrite().save(str(tmp_path / "s"))
    out = [tuple(r) for r in ColumnScalerModel.load(str(tmp_path / "s")).transform(df).collect()]
    assert np.allclose(out, [(-np.sqrt(1.5), 0), (0, 0), (np.sqrt(1.5), 0), (0, 0)])
    bins = PiecewiseBins(inputCols=["b"], bins=4).fit(df)
    edges = bins.edges()["b"]
    assert edges == pytest.approx([5.0, 5.0 + 1e-8, 5.0 + 2e-8, 5.0 + 3e-8, 5.0 + 4e-8]) and all(np.diff(edges) > 0)
    bins.write().overwrite().save(str(tmp_path / "b"))
    assert PiecewiseBinsModel.load(str(tmp_path / "b")).edges() == bins.edges()


def test_detector(spark, tmp_path):
    g = np.random.default_rng(4)
    calm = {f"s{k}": 10 + np.sin(np.arange(80) / 4 + k) + g.normal(0, 0.1, 80) for k in range(30)}
    odd = {"s1": np.r_[calm["s1"][:40], g.normal(40, 15, 40)]}
    m = panel(spark, calm, case_id="calm").unionByName(panel(spark, odd, case_id="odd")).persist()
    detector = WindowDetector.fit(m.filter("case_id = 'calm'"), length=10, components=4)
    scores = {r.case_id: r.score for r in detector.case_scores(m).collect()}
    assert scores["odd"] > 5 > scores["calm"]
    assert detector.scores(m.filter("case_id = 'odd'")).count() == 71
    assert "odd" in {r.case_id for r in detector.flagged(m).collect()}
    detector.save(str(tmp_path / "d"))
    again = WindowDetector.load(str(tmp_path / "d"))
    assert {r.case_id: r.score for r in again.case_scores(m).collect()} == scores
    short = panel(spark, {"a": np.arange(5.0)}, case_id="short")
    assert detector.case_scores(short).first()["score"] == 0.0


def test_centroids(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 0.1], 0), ([2.0, -0.1], 0), ([0.0, 3.0], 1), ([0.0, 0.0], 1)], "v array<double>, label int")
    model = CentroidClassifier(inputCol="v", limit=0.5).fit(df)
    out = [r.prediction for r in model.transform(df).collect()]
    assert out == [0, 0, 1, 2]
    model.write().overwrite().save(str(tmp_path / "c"))
    assert [r.prediction for r in CentroidModel.load(str(tmp_path / "c")).transform(df).collect()] == out


def test_detector_errors_match_numpy_across_chunks(spark, monkeypatch):
    from faultscope.canonical import METRICS
    from faultscope.models import detector as dt

    monkeypatch.setattr(dt, "CHUNK_POINTS", 16)
    g = np.random.default_rng(8)
    calm = panel(spark, {f"s{k}": {m: g.normal(0, 1, 60) for m in METRICS} for k in range(12)}).persist()
    fitted = WindowDetector.fit(calm, length=5, components=3)
    got = [r.error for r in fitted.errors(calm).filter("service = 's3'").orderBy("start").collect()]
    x = fitted.scaler.transform(calm).filter("service = 's3'").orderBy("i").select(*METRICS).toPandas().to_numpy()
    p, mean = fitted.components, fitted.mean
    count, mean_all, gram = dt.window_moments(dt._chunks(fitted.scaler.transform(calm), 5), 5)
    y = fitted.scaler.transform(calm).orderBy("service", "i").select(*METRICS).toPandas().to_numpy().reshape(12, 60, -1)
    every = np.array([one[k:k + 5].reshape(-1) for one in y for k in range(56)])
    assert count == len(every) and np.allclose(mean_all, every.mean(0)) and np.allclose(gram, every.T @ every)
    want = []
    for s in range(56):
        c = x[s:s + 5].reshape(-1) - mean
        want.append(((c - p @ (p.T @ c)) ** 2).mean())
    assert len(got) == 56 and np.allclose(got, want)


def test_registered_grids_and_detector_take_the_whole_job(spark, monkeypatch):
    from faultscope.plans import model_queries as mq
    from faultscope.plans.registry import QUERIES

    features = spark.createDataFrame([(str(i), int(i % 4 == 0)) for i in range(400)], "case_id string, label int")
    seen = {}
    monkeypatch.setattr(mq, "order_features", lambda *a: features)
    monkeypatch.setattr(mq, "rounded", lambda df, *a: df)
    monkeypatch.setattr(mq, "_case", lambda *a: features)
    monkeypatch.setattr(gr, "grid_summary", lambda df: df)
    for name in ("run_grid", "scaling_grid"):
        monkeypatch.setattr(gr, name, lambda *a, name=name, **kw: seen.setdefault(name, (a, kw)))
    monkeypatch.setattr(WindowDetector, "fit", lambda *a, **kw: seen.setdefault("fit", kw))
    QUERIES["variant_grid"](spark, "")
    QUERIES["scaling_grid"](spark, "")
    mq._detector(spark, "")
    assert seen["run_grid"][0][1:] == (gr.VARIANTS, 5) and not seen["run_grid"][1]
    assert seen["scaling_grid"][0][1:] == (gr.VARIANTS, [8, 20, 40, 80, 200], 3) and not seen["scaling_grid"][1]
    assert seen["fit"] == {}
    assert gr.balanced_sizes(features.where("false"), [0.5]) == []


def _plain_data(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    return x, ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(np.int64)


@pytest.mark.parametrize("kind,least", [("random_forest", 0.85), ("boosted_trees", 0.9), ("mlp", 0.9)])
def test_learners_on_held_out_rows(kind, least):
    from faultscope.models import many

    (x, y), (xt, yt) = _plain_data(2500), _plain_data(600, 4)
    settings = {**many.DEFAULTS[kind], **({"epochs": 60} if kind == "mlp" else {})}
    model = many.FITS[kind](x, y, np.random.default_rng(1), **settings)
    p = many.probability(kind, model, xt)
    assert ((p > 0.5) == yt).mean() > least and p.min() >= 0.0 and p.max() <= 1.0
    one_class = many.FITS[kind](x, np.zeros(len(x), np.int64), np.random.default_rng(1), **settings)
    assert (many.probability(kind, one_class, xt) < 0.5).all()


def test_tree_splits_like_a_plain_search():
    """The first split of a tree is the best of all columns and cuts; leaves hold the mean of their rows."""
    from faultscope.models import many

    x, y = _plain_data(300)
    cuts, codes = many.binned(x)
    w = np.ones(len(y))
    tree = many.grow(codes, y * w, w, 1, 6, np.random.default_rng(0))
    best = max(((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum(), -f, -b) for f in range(6) for b in range(31)
                if 0 < (left := codes[:, f] <= b).sum() < len(y)), default=None)
    assert (tree[0, 0], tree[0, 1]) == (-best[1], -best[2])
    left = codes[:, int(tree[0, 0])] <= tree[0, 1]
    assert np.allclose(many.descend(tree, codes), np.where(left, y[left].mean(), y[~left].mean()))


def test_grid_covers_every_variant_run_and_size(spark, features):
    small = {"random_forest": {"trees": 3, "depth": 2}, "boosted_trees": {"rounds": 3, "depth": 2}, "mlp": {"epochs": 2}}
    scored = gr.run_grid(features, gr.VARIANTS, 2, params=small, fit_rows=40)
    counts = {(r.variant, r.run): r["count"] for r in scored.groupBy("variant", "run").count().collect()}
    assert counts == {(v, k): 16 for v in gr.VARIANTS for k in range(2)}
    assert scored.filter("abs(p0 + p1 - 1) > 1e-9 or y_pred <> cast(p1 > p0 as int)").isEmpty()
    sized = gr.scaling_predictions(features, gr.VARIANTS, [20, 40], 2, params=small)
    counts = {tuple(r)[:3]: r["count"] for r in sized.groupBy("variant", "size", "run").count().collect()}
    assert counts == {(v, s, k): s // 5 for v in gr.VARIANTS for s in (20, 40) for k in range(2)}
    # One run again gives the same predictions.
    again = gr.run_grid(features, gr.VARIANTS, 2, params=small, fit_rows=40)
    assert scored.exceptAll(again).isEmpty()


def test_blocked_search_over_many_classes(spark):
    """More classes than a block holds, more rows than a slice, ties and a zero vector."""
    from faultscope.models.centroids import nearest_blocked

    g = np.random.default_rng(9)
    c = g.normal(size=(3000, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[2999] = c[5]
    x = np.vstack([g.normal(size=(700, 8)), c[5:6] * 2, np.zeros((1, 8))])
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "label int, centroid array<double>")
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "id long, v array<double>, label string")
    got = {r.id: r for r in nearest_blocked(rows, "id", "v", centroids, 0.4, -1, slice_rows=100, block_centroids=256).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - u @ c.T
    assert len(got) == len(x) and got[700].prediction == 5
    for i in range(len(x)):
        assert got[i].distance == pytest.approx(d[i].min(), abs=1e-12)
        assert got[i].prediction == (-1 if d[i].min() > 0.4 else d[i].argmin())
    assert nearest_blocked(rows, "id", "v", centroids.filter("false")).count() == 0


def _labelled(spark, n=6000, tasks=6):
    x, y = _plain_data(n)
    return spark.createDataFrame([(int(label), *map(float, r)) for r, label in zip(x, y, strict=True)], "label int, " + ", ".join(f"x{j} double" for j in range(6))).repartition(tasks)


def test_boosting_agrees_with_sparks_whatever_the_dealing(spark):
    """Blocks of binned rows give the trees of ``GBTClassifier``, the same ones to the bit in any order of the rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from faultscope.models.boosting import BoostedTrees

    columns = [f"x{j}" for j in range(6)]
    rows = _labelled(spark).persist()
    ours = cl.classifier("gradient_boosting", columns, maxIter=6, maxDepth=4)
    assert isinstance(ours.getStages()[-1], BoostedTrees)
    sparks = cl.classifier("gradient_boosting", columns, maxIter=6, maxDepth=4, cacheNodeIds=False)
    assert isinstance(sparks.getStages()[-1], GBTClassifier)
    a, b, c = ours.fit(rows), sparks.fit(rows), ours.fit(rows.orderBy("x3").coalesce(1))
    assert a.stages[-1]._numbers() == c.stages[-1]._numbers()
    assert np.allclose(a.stages[-1].featureImportances.toArray(), b.stages[-1].featureImportances.toArray(), atol=1e-6)
    p = [np.array([r.p1 for r in m.transform(rows.orderBy(*columns)).select(vector_to_array("probability")[1].alias("p1")).collect()]) for m in (a, b)]
    assert np.abs(p[0] - p[1]).max() < 1e-6


def test_boosted_model_survives_storage_and_odd_rows(spark, tmp_path):
    columns = [f"x{j}" for j in range(6)]
    rows = _labelled(spark, 300, 2)
    model = cl.classifier("boosted_trees", columns, maxIter=3, maxDepth=2).fit(rows)
    model.write().overwrite().save(str(tmp_path / "b"))
    again = PipelineModel.load(str(tmp_path / "b"))
    a, b = (cl.predict(m, rows).select("x0", "y_pred", "p0", "p1") for m in (model, again))
    assert a.exceptAll(b).isEmpty() and a.count() == 300
    one_class = cl.classifier("boosted_trees", columns, maxIter=3).fit(rows.withColumn("label", F.lit(1)))
    assert cl.predict(one_class, rows).filter("y_pred <> 1").isEmpty()
    for odd in (None, 2):
        with pytest.raises(ValueError):
            cl.classifier("boosted_trees", columns, maxIter=1).fit(rows.withColumn("label", F.lit(odd).cast("int")))


def test_boosting_makes_margins_anew(spark, monkeypatch):
    from faultscope.models import boosting as bo

    columns = [f"x{j}" for j in range(6)]
    rows, numbers = _labelled(spark, 400, 2).persist(), []
    for fresh in (2, 50):
        monkeypatch.setattr(bo, "FRESH", fresh)
        numbers.append(cl.classifier("boosted_trees", columns, maxIter=5, maxDepth=3).fit(rows).stages[-1]._numbers())
    assert numbers[0] == numbers[1]


def test_perceptron_slope_and_agreement_with_sparks(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from faultscope.models import perceptron as pe

    (x, y), layers = _plain_data(50), [6, 4, 2]
    w = np.random.default_rng(2).normal(size=6 * 4 + 4 + 4 * 2 + 2)
    loss, slope = pe.loss_and_slope(w, layers, x.astype(np.float32), y)
    for j in (0, 11, 25, 30, 37):
        e = np.eye(len(w))[j] * 1e-2
        near = [pe.loss_and_slope(w + s * e, layers, x.astype(np.float32), y)[0] for s in (1, -1)]
        assert (near[0] - near[1]) / 2e-2 == pytest.approx(slope[j], rel=2e-2, abs=2e-2)
    rows, columns = _labelled(spark).persist(), [f"x{j}" for j in range(6)]
    ours = cl.classifier("mlp", columns, layers=[6, 8, 2], maxIter=60)
    assert isinstance(ours.getStages()[-1], pe.Perceptron)
    sparks = cl.classifier("mlp", columns, layers=[6, 8, 2], maxIter=60, blockSize=128)
    assert isinstance(sparks.getStages()[-1], MultilayerPerceptronClassifier)
    share = [cl.predict(p.fit(rows), rows).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).first()[0] for p in (ours, sparks)]
    assert share[0] > 0.9 and share[0] > share[1] - 0.03


def test_minimise_finds_the_least():
    from faultscope.models.perceptron import minimise

    a = np.diag([1.0, 10.0, 100.0])
    x = minimise(lambda v: (float(v @ a @ v) + 1.0, 2 * a @ v), np.array([3.0, -2.0, 1.0]), 200, 1e-12)
    assert np.abs(x).max() < 1e-4


def test_sizes_of_the_scaling_grid_are_ranked_once_per_run(spark, features, monkeypatch):
    """The samples are those of a split per size, but rows are written once per run."""
    from faultscope.operators.sampling import stratified_split, with_hash_rank

    landed, seen = [], []
    monkeypatch.setattr(gr, "land", lambda df, name: landed.append(name) or df)
    monkeypatch.setattr(gr, "predict_grid", lambda parts, *a, **kw: seen.append(parts))
    gr.scaling_predictions(features, gr.VARIANTS, [7, 20, 100], 2, 42)
    assert landed == ["grid-ranks"] * 2
    got = {tuple(r) for r in seen[0].select("size", "run", "case_id", "split").collect()}
    want = set()
    for run in range(2):
        ranked = with_hash_rank(features, ["label"], "case_id", 42 + run).drop("stratum_size")
        for size in (7, 20, 100):
            part = stratified_split(ranked.filter(F.col("rank") < size // 2).drop("rank"), "label", "case_id", 0.2, seed=42 + run)
            want |= {(size, run, r.case_id, r.split) for r in part.collect()}
    assert got == want and len(got) == 2 * (6 + 20 + 80)


def test_large_groups_are_fitted_on_all_rows(spark):
    """Beyond ``fit_rows`` nothing is thinned: cuts and class shares are those of all rows, for every group size."""
    import pickle

    (x, y), (xt, yt) = _plain_data(3000), _plain_data(600, 4)
    columns = [f"x{j}" for j in range(6)]
    data = [(0, f"c{i}", int(label), *map(float, r)) for i, (r, label) in enumerate(zip(x, y, strict=True))]
    rows = spark.createDataFrame(data + [(1, *r[1:]) for r in data[:200]], "run int, case_id string, label int, " + ", ".join(f"{c} double" for c in columns)).repartition(5).persist()
    specs = [many.Spec("forest", "random_forest", (0, 1, 2, 4)), many.Spec("boosted", "boosted_trees", tuple(range(6)), (3,)), many.Spec("mlp", "mlp", tuple(range(6)), (5,))]
    settings = {"random_forest": {"trees": 30, "depth": 6}, "boosted_trees": {"rounds": 25, "depth": 4}, "mlp": {"epochs": 40, "batch": 50}}
    fitted = {(r.run, r.model): pickle.loads(r.content) for r in many.fit_all(rows, specs, columns, ["run"], settings=settings, fit_rows=500).collect()}
    assert set(fitted) == {(run, s.name) for run in range(2) for s in specs}
    for run, n in ((0, 3000), (1, 200)):
        for s, kept in ((specs[0], []), (specs[1], [3])):
            want = x[:n].copy()
            want[:, kept] = 0.0
            assert all(np.array_equal(a, b) for a, b in zip(fitted[run, s.name]["cuts"], many.binned(want[:, list(s.used)])[0], strict=True))
        assert fitted[run, "boosted"]["start"] == pytest.approx(np.log((y[:n].sum() + 0.5) / (n - y[:n].sum() + 0.5)))
        assert np.allclose(fitted[run, "mlp"]["mean"][:5], x[:n, :5].mean(0)) and np.allclose(fitted[run, "mlp"]["scale"][:5], x[:n, :5].std(0))
    for s, least in zip(specs, (0.85, 0.87, 0.87), strict=True):
        p = many.probability(s.kind, fitted[0, s.name], s.view(xt))
        assert ((p > 0.5) == yt).mean() > least and p.min() >= 0.0 and p.max() <= 1.0
    # A boosted tree over all tasks is the one of a single task.
    alone = many.fit_boosted(specs[1].view(x), y, np.random.default_rng(0), **{**many.DEFAULTS["boosted_trees"], **settings["boosted_trees"]})
    a, b = (many.probability("boosted_trees", m, specs[1].view(xt)) for m in (alone, fitted[0, "boosted"]))
    assert np.abs(a - b).max() < 1e-5


def test_cuts_of_all_rows_are_exact(spark):
    from faultscope.models import spread

    g = np.random.default_rng(5)
    x = np.stack([g.normal(size=997), -np.exp(g.normal(size=997) * 40), np.round(g.normal(size=997)), np.where(g.random(997) < 0.9, 0.0, -0.0), np.full(997, 1e300)], 1)
    blocks = spark.sparkContext.parallelize([(part,) for part in np.array_split(x, 7)], 3)
    assert all(np.array_equal(a, b) for a, b in zip(spread.exact_cuts(blocks, 5, 997, 32), many.binned(x)[0], strict=True))


def test_grid_splits_without_copies_of_the_features(spark, monkeypatch):
    """Rows that come twice or have no key are split as exactly as others, those without class are left out, and nothing wide is written."""
    from faultscope.operators.sampling import stratified_split

    plain = spark.createDataFrame([(f"c{i}", i % 3 == 0 and 1 or 0, float(i)) for i in range(500)], "case_id string, label int, v double")
    odd = plain.unionByName(plain.filter("v < 301")).unionByName(spark.createDataFrame([(None, 1, float(i)) for i in range(37)] + [(f"n{i}", None, 0.0) for i in range(21)], plain.schema)).persist()
    seen, landed = [], []
    monkeypatch.setattr(gr, "land", lambda df, name: landed.append(name) or df)
    monkeypatch.setattr(gr, "predict_grid", lambda parts, *a, **kw: seen.append(parts))
    gr.run_grid(plain, gr.VARIANTS, 2, 42)
    assert landed == []
    want = {(run, r.case_id, r.split) for run in range(2) for r in stratified_split(plain, "label", "case_id", 0.2, seed=42 + run).collect()}
    assert {(r.run, r.case_id, r.split) for r in seen[0].collect()} == want
    gr.run_grid(odd, gr.VARIANTS, 1, 42)
    counts = {tuple(r) for r in seen[1].groupBy("label", "split").count().collect()}
    assert counts == {tuple(r) for r in stratified_split(odd, "label", "case_id", 0.2, seed=42).groupBy("label", "split").count().collect()}
    assert seen[1].count() == odd.count() - 21


def test_forest_on_blocks_agrees_with_sparks_whatever_the_dealing(spark, tmp_path):
    """The model is Spark's own, its trees are the same in any order of the rows and as good as those of Spark's learner."""
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from faultscope.models.forest import Forest

    columns = [f"x{j}" for j in range(6)]
    rows = cl.prepare(_labelled(spark, 4000).withColumn("id", F.monotonically_increasing_id()).persist(), columns, "random_forest").persist()
    settings = {"numTrees": 25, "maxDepth": 7}
    ours, sparks = cl.classifier("random_forest", columns, **settings), cl.classifier("random_forest", columns, **settings, subsamplingRate=1.0)
    assert isinstance(ours.getStages()[-1], Forest) and isinstance(sparks.getStages()[-1], RandomForestClassifier)
    a, b, c = ours.fit(rows), sparks.fit(rows), ours.fit(rows.orderBy("x3").coalesce(1))
    assert isinstance(a.stages[-1], RandomForestClassificationModel) and a.stages[-1].getNumTrees == 25
    text = [m.stages[-1].toDebugString.split("\n", 1)[1] for m in (a, c)]
    assert text[0] == text[1] and max(t.depth for t in a.stages[-1].trees) <= 7
    importance = [m.stages[-1].featureImportances.toArray() for m in (a, b)]
    assert importance[0].sum() == pytest.approx(1.0) and np.abs(importance[0] - importance[1]).max() < 0.08
    x, y = _plain_data(800, 4)
    unseen = spark.createDataFrame([(int(label), *map(float, r)) for r, label in zip(x, y, strict=True)], rows.drop("id", "weight").schema)
    share = [cl.predict(m, unseen).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).first()[0] for m in (a, b)]
    assert share[0] > 0.85 and share[0] > share[1] - 0.03
    assert cl.predict(a, unseen).filter("abs(p0 + p1 - 1) > 1e-9 or p0 < 0 or p1 < 0").isEmpty()


def test_forest_counts_draws_as_a_plain_count(spark):
    """The root of every tree holds the draws of all rows; its best split is the best of the columns it may choose."""
    from faultscope.models import forest as fo

    x, y = _plain_data(500)
    cuts, codes = many.binned(x)
    key = np.random.default_rng(6).integers(1 << 63, size=500).astype(np.uint64)
    blocks = spark.sparkContext.parallelize([(codes[a : a + 100].T.copy(), y[a : a + 100].astype(np.int8), key[a : a + 100]) for a in range(0, 500, 100)], 3)
    grown = fo.grow_forest(blocks, list(range(6)), 32, 4, 3, 6, (1.0, 1.0), 7)
    salts = np.random.default_rng(7).integers(1 << 62, size=4)
    for tree, salt in zip(grown, salts, strict=True):
        w = fo.drawn(key, int(salt)).astype(float)
        assert tree.counts[0] == (w[y == 0].sum(), w[y == 1].sum()) and 350 < w.sum() < 650
        alone = many.grow(codes, w * y, w, 3, 6, np.random.default_rng(0))
        assert len(alone) == len(tree.feature) and (alone[0, 0], alone[0, 1]) == (tree.feature[0], tree.cut[0])
        assert sorted(np.round([b / (a + b) for (a, b), f in zip(tree.counts, tree.feature, strict=True) if f < 0], 9)) == sorted(np.round(alone[alone[:, 0] < 0, 3], 9))


@pytest.mark.parametrize("label", [0, 2])
def test_forest_leaves_other_classes_to_spark(spark, label):
    rows = _labelled(spark, 60, 2).withColumn("label", F.lit(label) + (F.col("x0") > 0).cast("int") * int(label > 0))
    model = cl.classifier("random_forest", [f"x{j}" for j in range(6)], weighted=False, **SMALL).fit(rows)
    assert model.stages[-1].numClasses == rows.agg(F.max("label")).first()[0] + 1
