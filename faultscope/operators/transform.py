"""Fitted column transformers: exact quantiles, scaler, piecewise-linear bins."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.functions.numeric import clip, finite_or_zero
from faultscope.operators.chunks import running_totals

ACCURACY = 2000


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles, exact at any size.

    A sketch brackets each quantile first (its rank error is at most one in
    ``ACCURACY``); then only the values inside the narrow brackets are counted,
    over sampled ranges of them: no bracket is one task, and equal values are
    one row. The driver receives two values per quantile.
    """
    slack = 2.0 / ACCURACY
    basics = df.agg(*[
        x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))
    ]).first()
    ranks = {c: [p * (basics[f"n_{c}"] - 1) for p in probabilities] for c in columns if basics[f"n_{c}"]}

    def bracket(c: str) -> Column:
        """Sketch values safely below rank ``k`` and above rank ``k + 1``."""
        n = basics[f"n_{c}"]
        ends = [max(0.0, int(h) / n - slack) for h in ranks[c]] + [min(1.0, (int(h) + 2) / n + slack) for h in ranks[c]]
        return F.percentile_approx(c, F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias(f"q_{c}")

    sketched = df.agg(*[bracket(c) for c in ranks]).first() if ranks else {}
    targets = []
    for c, hs in ranks.items():
        n, sketch = basics[f"n_{c}"], sketched[f"q_{c}"]
        for k, h in enumerate(hs):
            lo = basics[f"min_{c}"] if int(h) / n <= slack else sketch[k]
            hi = basics[f"max_{c}"] if (int(h) + 2) / n + slack >= 1.0 else sketch[len(hs) + k]
            targets.append((c, k, int(h), h - int(h), float(lo), float(hi)))
    if not targets:
        return {c: [None] * len(probabilities) for c in columns}

    def near(c: str) -> Column:
        x = F.col(c).cast("double")
        hits = [(x >= lo) & (x <= hi) for t, _, _, _, lo, hi in targets if t == c]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    # Only values near a quantile go on, combined per distinct value.
    kept = F.array(*[F.when(near(c), F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x"))) for c in columns])
    distinct = df.select(F.explode(kept).alias("b")).filter("b is not null").groupBy("b.c", "b.x").agg(
        F.count(F.lit(1)).alias("rows"))
    below = df.agg(*[F.count(F.when(F.col(c) < lo, 1)).alias(f"b{j}") for j, (c, _, _, _, lo, _) in enumerate(targets)]).first()
    brackets = F.array(*[
        F.when((F.col("c") == c) & (F.col("x") >= lo) & (F.col("x") <= hi), F.lit(j))
        for j, (c, _, _, _, lo, hi) in enumerate(targets)
    ])
    values = distinct.select("x", F.col("rows").alias("c"), F.explode(brackets).alias("j")).filter("j is not null")
    first = F.create_map(*[x for j, t in enumerate(targets) for x in (F.lit(j), F.lit(t[2] - below[f"b{j}"]))])[F.col("j")]
    placed = running_totals(values, ["j"], "x", ["c"]).withColumn("upto", F.col("upto_c")).withColumn("at", first)
    picked = placed.groupBy("j").agg(
        F.min(F.when(F.col("upto") > F.col("at"), F.col("x"))).alias("a"),
        F.min(F.when(F.col("upto") > F.col("at") + 1, F.col("x"))).alias("b"),
    ).collect()
    out = {c: [None] * len(probabilities) for c in columns}
    for row in picked:
        c, k, _, part, _, hi = targets[row["j"]]
        a = row["a"]
        b = row["b"] if row["b"] is not None else a
        out[c][k] = a + (b - a) * part
    return out


class _Fitted(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Model whose state is a flat list of numbers."""

    values = Param(Params._dummy(), "values", "fitted numbers", TypeConverters.toListFloat)

    def _numbers(self) -> list[float]:
        return self.getOrDefault(self.values)


class ColumnScalerModel(_Fitted):
    """Standardised columns; anything that is not finite becomes 0."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, v = self.getInputCols(), self._numbers()
        k = len(columns)
        return dataset.withColumns({
            c: finite_or_zero((F.col(c).cast("double") - F.lit(v[j])) / F.lit(v[k + j])) for j, c in enumerate(columns)
        })


class ColumnScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Mean and population deviation per column; a constant column keeps scale 1."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ColumnScalerModel:
        columns = self.getInputCols()
        real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = dataset.agg(*[
            x for c in columns for x in (F.avg(real(c)).alias(f"m_{c}"), F.stddev_pop(real(c)).alias(f"s_{c}"),
                                         F.min(real(c)).alias(f"l_{c}"), F.max(real(c)).alias(f"h_{c}"))
        ]).first()
        means = [float(row[f"m_{c}"] or 0.0) for c in columns]
        scales = [float(row[f"s_{c}"]) if row[f"s_{c}"] and row[f"h_{c}"] > row[f"l_{c}"] else 1.0 for c in columns]
        model = ColumnScalerModel()
        return model._set(inputCols=columns, values=means + scales)


class PiecewiseBinsModel(_Fitted):
    """Column ``<c>_ple``: one value in [0, 1] per quantile bin."""

    bins = Param(Params._dummy(), "bins", "bins per column", TypeConverters.toInt)

    def edges(self) -> dict[str, list[float]]:
        k, v = self.getOrDefault(self.bins) + 1, self._numbers()
        return {c: v[j * k:(j + 1) * k] for j, c in enumerate(self.getInputCols())}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({f"{c}_ple": piecewise(F.col(c), e) for c, e in self.edges().items()})


class PiecewiseBins(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Quantile bin edges per column (Gorishniy et al., 2022); an edge that does
    not exceed the one before is moved 1e-8 above it."""

    bins = Param(Params._dummy(), "bins", "bins per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, bins: int = 8):
        super().__init__()
        self._setDefault(bins=8)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PiecewiseBinsModel:
        columns, k = self.getInputCols(), self.getOrDefault(self.bins)
        quantiles = exact_quantiles(dataset, columns, [j / k for j in range(k + 1)])
        flat: list[float] = []
        for c in columns:
            edges: list[float] = []
            for e in quantiles[c]:
                edges.append(e if not edges or e > edges[-1] else edges[-1] + 1e-8)
            flat += edges
        model = PiecewiseBinsModel()
        return model._set(inputCols=columns, bins=k, values=flat)


def piecewise(x: Column, edges: list[float]) -> Column:
    parts = [clip((x - F.lit(lo)) / F.lit(max(hi - lo, 1e-8))) for lo, hi in zip(edges, edges[1:])]
    return F.array(*parts)


def encode_columns(df: DataFrame, model: PiecewiseBinsModel, passthrough: list[str], output: str = "encoded") -> DataFrame:
    """Encoded columns first, then the pass-through columns, as one array."""
    encoded = model.transform(df)
    parts = [F.col(f"{c}_ple") for c in model.getInputCols()]
    tail = [F.array(*[F.col(c).cast("double") for c in passthrough])] if passthrough else []
    return encoded.withColumn(output, F.concat(*parts, *tail)).drop(*[f"{c}_ple" for c in model.getInputCols()])
