"""Unsupervised study pieces.

PCA is MLlib's (distributed covariance, driver eigen-solve of p x p); K-Means
is MLlib's k-means||; both work on vector columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.operators.preprocess import fit_preprocessing
from driftkit.operators.quantiles import exact_quantiles


def entity_profile(df: DataFrame, keys: Sequence[str], value: str, label: str | None = None, lag: str | None = None) -> DataFrame:
    """Per entity median, IQR (q75 - q25), fail fraction (label = 1) and lag median.

    Quantiles come from counted values and distributed prefix sums: no buffer holds an
    entity's values, however many rows it has.  A NULL key is an entity of its own."""
    named = df.withColumn("_entity", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    aggs = [F.first(F.struct(*keys)).alias("_keys"), F.count(value).alias("n")]
    if label:
        aggs.append(F.avg((F.col(label) == 1).cast("double")).alias("fail_fraction"))
    out = named.groupBy("_entity").agg(*aggs)
    quantiles = exact_quantiles(named, value, [0.25, 0.5, 0.75], ["_entity"], ["_q1", "median", "_q3"]).drop("n")
    out = out.join(quantiles, "_entity", "left")
    if lag:
        out = out.join(exact_quantiles(named, lag, [0.5], ["_entity"], ["lag_median"]).drop("n"), "_entity", "left")
    return out.select("_keys.*", "n", "median", (F.col("_q3") - F.col("_q1")).alias("iqr"),
                      *([F.col("fail_fraction")] if label else []), *([F.col("lag_median")] if lag else []))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of (row value, column value), long form (pivot-ready)."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))


def explode_vector(df: DataFrame, array_col: str, dims: int, prefix: str = "x", keep: Sequence[str] = ()) -> DataFrame:
    """array<float> -> one double column per dimension."""
    return df.select(*keep, *[F.col(array_col)[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)])


def pca(df: DataFrame, features: Sequence[str], standardize: bool = True, k: int | None = None, keep: Sequence[str] = ()):
    """MLlib PCA (distributed covariance, p x p eigen-solve) on the z-scored
    features.  Returns (explained rows, loadings rows, PCAModel, frame with a
    ``pcs`` vector column of the first ``k`` components)."""
    feats = list(features)
    z = fit_preprocessing(df, feats, []).transform(df, keep=list(keep)) if standardize else df.select(*keep, *feats)
    vec = VectorAssembler(inputCols=feats, outputCol="_v").transform(z).select(*keep, "_v")
    full = PCA(k=len(feats), inputCol="_v", outputCol="_pc").fit(vec)
    ratio = full.explainedVariance.toArray()
    cum = np.cumsum(ratio)
    explained = [(j + 1, float(ratio[j]), float(cum[j])) for j in range(len(ratio))]
    pc = full.pc.toArray()
    loadings = [(j + 1, f, float(pc[i, j])) for j in range(pc.shape[1]) for i, f in enumerate(feats)]
    k = k or components_for(explained)
    first = F.slice(vector_to_array("_pc"), 1, k)  # of the one fit, the first k components
    return explained, loadings, full, full.transform(vec).select(*keep, array_to_vector(first).alias("pcs"))


def components_for(explained: list, share: float = 0.90) -> int:
    for j, _, c in explained:
        if c >= share - 1e-12:
            return j
    return len(explained)


def kmeans(df: DataFrame, vector_col: str, k: int = 3, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """MLlib k-means|| on a vector column; adds ``cluster``."""
    model = KMeans(k=k, seed=seed, featuresCol=vector_col, predictionCol="cluster", maxIter=100).fit(df)
    return model.transform(df).select(*keep, "cluster")


def explained_frame(spark: SparkSession, explained: list) -> DataFrame:
    return spark.createDataFrame(explained, "component int, variance_ratio double, cumulative_ratio double")
