"""Class centroids of unit vectors and nearest-centroid classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.canonical import UNKNOWN

MIN_NORM = 1e-12


def unit(vector: Column) -> Column:
    """Array scaled to length 1; a zero array stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(MIN_NORM)))


def class_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``label, centroid``: unit rows averaged per class and scaled back to
    length 1. The average is a mergeable summary; no class is collected."""
    rows = df.select(F.col(label).alias("label"), array_to_vector(unit(F.col(vector))).alias("v"))
    mean = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    return mean.select("label", unit(F.col("m")).alias("centroid"))


class CentroidModel(Model, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Nearest centroid by cosine distance; beyond ``limit`` the prediction is
    ``unknown``."""

    labels = Param(Params._dummy(), "labels", "class labels", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "centroids, flattened", TypeConverters.toListFloat)
    limit = Param(Params._dummy(), "limit", "largest accepted distance", TypeConverters.toFloat)
    unknown = Param(Params._dummy(), "unknown", "label beyond the limit", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = np.asarray(self.getOrDefault(self.labels))
        centroids = np.asarray(self.getOrDefault(self.values)).reshape(len(labels), -1)
        limit, unknown = self.getOrDefault(self.limit), self.getOrDefault(self.unknown)
        schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("distance", T.DoubleType())])

        @F.pandas_udf(schema)
        def nearest(vectors: pd.Series) -> pd.DataFrame:
            x = np.stack(vectors.to_numpy()).astype(float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), MIN_NORM)
            distance = 1.0 - x @ centroids.T
            at = distance.argmin(axis=1)
            best = distance[np.arange(len(x)), at]
            return pd.DataFrame({"label": np.where(best > limit, unknown, labels[at]), "distance": best})

        out = dataset.withColumn("_n", nearest(F.col(self.getInputCol())))
        return out.withColumn("prediction", F.col("_n.label")).withColumn("distance", F.col("_n.distance")).drop("_n")


class CentroidClassifier(Estimator, HasInputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    limit = Param(Params._dummy(), "limit", "largest accepted distance", TypeConverters.toFloat)
    unknown = Param(Params._dummy(), "unknown", "label beyond the limit", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, labelCol: str = "label", limit: float = 1.5, unknown: int = UNKNOWN):
        super().__init__()
        self._setDefault(labelCol="label", limit=1.5, unknown=UNKNOWN)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CentroidModel:
        rows = class_centroids(dataset, self.getInputCol(), self.getLabelCol()).orderBy("label").collect()
        model = CentroidModel()
        return model._set(
            inputCol=self.getInputCol(), labels=[r["label"] for r in rows], values=[x for r in rows for x in r["centroid"]],
            limit=self.getOrDefault(self.limit), unknown=self.getOrDefault(self.unknown))


#: Rows of a slice and centroids of a block in a blocked search.
SLICE_ROWS, BLOCK_CENTROIDS = 50_000, 2048


def nearest_blocked(rows: DataFrame, key: str, vector: str, centroids: DataFrame, limit: float = 1.5, unknown: int = UNKNOWN,
                    slice_rows: int = SLICE_ROWS, block_centroids: int = BLOCK_CENTROIDS) -> DataFrame:
    """``key, prediction, distance`` for any number of classes; ``key`` is unique.

    ``centroids`` is a table ``label, centroid``. Slices of the rows meet blocks
    of the centroids in one task each, as one matrix product; each meeting gives
    the nearest centroid of the block, and the least of these is kept, of equal
    distances the smaller label. Nothing is collected on the driver.
    """
    def parts(df: DataFrame, size: int, *by: Column) -> DataFrame:
        count = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("n"))
        return df.withColumn("_part", F.pmod(F.xxhash64(*by), count.scalar()))

    left = parts(rows.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")), slice_rows, F.col("_key"))
    right = parts(centroids.select(F.col("label").cast("int").alias("_label"), F.col("centroid").alias("_c")), block_centroids, F.col("_label"))
    slices, blocks = left.agg(F.max("_part")).scalar(), right.agg(F.max("_part")).scalar()
    zero = F.lit(0).cast("long")
    left = left.withColumn("_other", F.explode(F.sequence(zero, F.coalesce(blocks, zero))))
    right = right.withColumn("_other", F.explode(F.sequence(zero, F.coalesce(slices, zero))))
    kind = rows.schema[key].dataType.simpleString()

    def product(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(block):
            return pd.DataFrame(columns=["_key", "_distance", "_label"])
        block = block.sort_values("_label")
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), MIN_NORM)
        distance = 1.0 - x @ np.stack(block["_c"].to_numpy()).astype(float).T
        at = distance.argmin(axis=1)
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "_distance": distance[np.arange(len(x)), at], "_label": block["_label"].to_numpy()[at]})

    met = left.groupBy("_part", "_other").cogroup(right.groupBy("_other", "_part")).applyInPandas(product, f"_key {kind}, _distance double, _label int")
    best = met.groupBy("_key").agg(F.min(F.struct("_distance", "_label")).alias("b"))
    found = F.when(F.col("b._distance") > limit, F.lit(unknown)).otherwise(F.col("b._label"))
    return best.select(F.col("_key").alias(key), found.cast("int").alias("prediction"), F.col("b._distance").alias("distance"))
