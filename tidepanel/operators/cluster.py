"""Clustering of behavior vectors."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import c, finite
from ..session import cut
from .order import places
from .screens import top_k


def medians(df: DataFrame, columns) -> DataFrame:
    """Exact median per column, long (field, median): the columns are ordered together,
    in one shuffle; no task holds a whole column."""
    cells = df.select(*[F.col(x).cast("double").alias(x) for x in columns]).unpivot(
        [], list(columns), "field", "value").filter("value IS NOT NULL")
    placed = places(cells, "value", ("field",), place="place", size="n", ties="k")
    half = (F.col("k") - 1) / 2
    holds = [F.abs(F.col("place") - p) <= half for p in (F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)]
    return placed.filter(holds[0] | holds[1]).groupBy("field").agg(
        (F.max(F.when(holds[0], F.col("value"))) / 2 + F.max(F.when(holds[1], F.col("value"))) / 2).alias("median"))


def behavior_matrix(df: DataFrame, features) -> DataFrame:
    """Infinities to NULL, NULLs to the column median, then population standardization
    (a constant column keeps deviation 1). Standardized columns get the prefix z_.

    The matrix is stored; medians and moments, a number for each column, are read from there."""
    df = cut(df.withColumns({x: finite(x) for x in features}), "behavior")
    middle = {r["field"]: r["median"] for r in medians(df, features).collect()}
    filled = {x: F.coalesce(F.col(x), F.lit(float(middle.get(x) or 0.0))) for x in features}
    of = df.select(*[v.alias(x) for x, v in filled.items()]).agg(
        *[F.avg(x).alias(f"m_{x}") for x in features], *[F.stddev_pop(x).alias(f"s_{x}") for x in features]).first()
    return df.withColumns(filled).withColumns({f"z_{x}": (F.col(x) - F.lit(of[f"m_{x}"])) / F.lit(
        of[f"s_{x}"] or 1.0) for x in features})


def fit_kmeans(matrix: DataFrame, features, k: int, seed: int = 42, starts: int = 20, max_iter: int = 300):
    """K-means on standardized behavior, the best of several starts: labels, raw-space
    centers and the cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    # Every iteration reads the matrix again: store it instead of recomputing it.
    rows = VectorAssembler(inputCols=[f"z_{x}" for x in features], outputCol="_x").transform(
        cut(matrix, "behavior"))
    models = [KMeans(k=k, seed=seed + i, featuresCol="_x", predictionCol="cluster", maxIter=max_iter).fit(rows)
              for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    labels = model.transform(rows).drop("_x")
    return labels, raw_centers(labels, features), float(model.summary.trainingCost)


def raw_centers(labels: DataFrame, features) -> DataFrame:
    """Centers in the units of the features: the means of the members."""
    return labels.groupBy("cluster").agg(*[F.avg(x).alias(f"c_{x}") for x in features])


def representatives(labels: DataFrame, centers: DataFrame, features, key: str, per_cluster: int = 1) -> DataFrame:
    """Members nearest to their cluster's center by raw distance, ties by key. The
    center table has one row per cluster."""
    near = labels.join(F.broadcast(centers), "cluster")
    d2 = reduce(add, [F.pow(F.col(x) - F.col(f"c_{x}"), 2) for x in features])
    near = near.withColumn("distance", F.round(F.sqrt(d2), 9)).withColumn("_near", -F.col("distance"))
    return top_k(near, "_near", per_cluster, by=("cluster",), tie=key, place="place").drop("_near")
