"""K-means, centroids, assignment and cluster quality.

Inputs have ``id`` and ``vector`` (array) columns, clusters an integer ``cluster``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import SCORE_DIGITS, as_double, dot, normalize, rounded
from ..sources.workspace import Workspace
from . import kmeans
from .neighbours import BLOCK_ROWS, MAX_BROADCAST_QUESTIONS, to_matrix
from .silhouette import PARTS, mean_distances, moments

ROWS_PER_FIT_TASK = 200_000


# --- centroids and assignment --------------------------------------------------------


def centroid_means(df: DataFrame) -> DataFrame:
    """Mean vector per cluster; vectors are summed inside tasks before the shuffle."""
    mean = Summarizer.mean(array_to_vector(as_double(F.col("vector"))))
    return df.groupBy("cluster").agg(vector_to_array(mean).alias("centroid"))


# Fits stop when the centers rest; this many rounds are the common limit of such fits.
MAX_ITER = 300


@dataclass(frozen=True)
class Centroids:
    """Centroids of a fitted or averaged clustering: k vectors, held by the driver."""

    clusters: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, df: DataFrame) -> Centroids:
        rows = df.select("cluster", "centroid").toArrow()
        clusters = rows.column("cluster").to_numpy()
        order = np.argsort(clusters)
        return cls(clusters[order].astype(np.int32), to_matrix(rows.column("centroid"))[order])

    @classmethod
    def of_model(cls, model: KMeansModel) -> Centroids:
        centers = np.array(model.clusterCenters(), dtype=np.float64)
        return cls(np.arange(len(centers), dtype=np.int32), centers)

    @classmethod
    def of_fit(cls, fit: kmeans.Fit) -> Centroids:
        return cls(np.arange(len(fit.centers), dtype=np.int32), fit.centers)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(c), [float(x) for x in v]) for c, v in zip(self.clusters, self.matrix)]
        return spark.createDataFrame(rows, "cluster int, centroid array<double>")

    def nearest(self, vector: Column, n: int = 1) -> Column:
        """The ``n`` nearest clusters, nearest first, as ``array<struct<cluster, d2>>``.

        Squared distances are rounded before they are compared; the smaller cluster
        wins a tie.
        """
        clusters, matrix = self.clusters, self.matrix

        @F.pandas_udf("cluster array<int>, d2 array<double>")
        def measure(vectors: pd.Series) -> pd.DataFrame:
            points = np.stack(vectors.to_numpy()).astype(np.float64)
            squares = np.einsum("ij,ij->i", points, points)[:, None]
            d2 = squares + np.einsum("ij,ij->i", matrix, matrix) - 2.0 * (points @ matrix.T)
            d2 = np.round(np.maximum(d2, 0.0), SCORE_DIGITS) + 0.0
            if n == 1:  # the first of equal minima is the smaller cluster
                order = d2.argmin(axis=1)[:, None]
            else:
                order = np.argsort(d2, axis=1, kind="stable")[:, :n]
            return pd.DataFrame(
                {
                    "cluster": list(clusters[order]),
                    "d2": list(np.take_along_axis(d2, order, axis=1)),
                }
            )

        found = measure(vector)
        return F.arrays_zip(found.getField("cluster"), found.getField("d2"))


def assign_nearest(df: DataFrame, centroids: Centroids) -> DataFrame:
    """Nearest centroid of every row: adds ``cluster`` and ``d2``.

    Rows without a vector have no cluster and are left out, as the searches do.
    """
    nearest = centroids.nearest(F.col("vector"))
    return (
        df.where(F.col("vector").isNotNull())
        .withColumn("_nearest", F.explode(nearest))
        .withColumn("cluster", F.col("_nearest").getField("cluster"))
        .withColumn("d2", F.col("_nearest").getField("d2"))
        .drop("_nearest")
    )


def route(questions: DataFrame, centroids: Centroids, n: int) -> DataFrame:
    """The ``n`` nearest clusters per question: one row per ``(query_id, cluster)``."""
    check_cluster_count(n, len(centroids.clusters))
    nearest = centroids.nearest(F.col("vector"), n)
    return questions.where(F.col("vector").isNotNull()).select(
        "query_id", "vector", F.posexplode(nearest).alias("pos", "found")
    ).select(
        "query_id",
        "vector",
        (F.col("pos") + 1).alias("route_rank"),
        F.col("found").getField("cluster").alias("cluster"),
        F.col("found").getField("d2").alias("d2"),
    )


def write_by_cluster(
    df: DataFrame, key: str, workspace: Workspace, name: str, rows_per_file: int = 1_000_000
) -> DataFrame:
    """Store rows partitioned by ``cluster``, so a probe reads only its clusters.

    Rows are first gathered per cluster, a large cluster over several tasks: files are
    as many as the data needs, not tasks times clusters.
    """
    if not workspace.has(name):
        files = df.groupBy("cluster").agg(
            F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files")
        )
        part = F.pmod(F.xxhash64(key), F.col("_files"))
        df = (
            df.join(F.broadcast(files), "cluster")  # one row per cluster
            .repartition("cluster", part)
            .drop("_files")
        )
    columns = sorted(df.schema, key=lambda field: field.name == "cluster")
    return workspace.stage(name, lambda: df, partition_by="cluster", schema=StructType(columns))


def check_cluster_count(n: int, available: int) -> None:
    if n > available:
        raise ValueError(f"asked for {n} clusters, only {available} exist")


def lloyd_step(df: DataFrame, centroids: Centroids) -> DataFrame:
    """Assign every row to its nearest centroid and average the rows of each."""
    return centroid_means(assign_nearest(df, centroids))


def inertia(df: DataFrame, centroids: Centroids) -> DataFrame:
    return assign_nearest(df, centroids).agg(
        F.count("*").alias("n"), rounded(F.sum("d2"), 4).alias("inertia")
    )


def cluster_sizes(df: DataFrame) -> DataFrame:
    """Rows and share per cluster; the total comes from the small table of counts."""
    total = df.count()
    counts = df.groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.withColumn("share", rounded(F.col("n") / F.lit(float(total))))


# --- fitting -------------------------------------------------------------------------


def for_fit(df: DataFrame, n_rows: int) -> DataFrame:
    """Rows in a layout that depends on the data alone, as vectors.

    The seeded start of k-means reads partitions in order, so the number of partitions
    must not follow the cluster's settings.
    """
    tasks = max(8, -(-n_rows // ROWS_PER_FIT_TASK))
    return (
        df.repartition(tasks, "id")
        .sortWithinPartitions("id")
        .withColumn("features", array_to_vector(as_double(F.col("vector"))))
    )


def fit_kmeans(df: DataFrame, k: int, seed: int = 0, max_iter: int = MAX_ITER) -> KMeansModel:
    """Seeded k-means on ``id, vector``, until the centers rest or ``max_iter``."""
    rows = for_fit(df.select("id", "vector"), df.count())
    return KMeans(k=k, seed=seed, maxIter=max_iter).fit(rows)


def unit_vectors(df: DataFrame) -> DataFrame:
    """Vectors scaled to length one; rows without a direction are dropped."""
    return df.withColumn("vector", normalize(F.col("vector"))).where(
        F.col("vector").isNotNull()
    )


# --- quality -------------------------------------------------------------------------

def silhouette_parts(
    df: DataFrame,
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, cluster, a, b, compared``: mean distance of every row to its own cluster and
    to the nearest other one, and the number of rows it was compared with.

    Clusters that bounds rule out are not compared: see :mod:`.silhouette`. Rows without
    a vector or a cluster take no part; ids are distinct.
    """
    rows = df.select("id", "vector", F.col("cluster").cast("int").alias("cluster")).where(
        "vector is not null and cluster is not null"
    )
    means = Centroids.of(centroid_means(rows)) if not rows.isEmpty() else None
    if means is None:
        return df.sparkSession.createDataFrame([], PARTS)
    known = moments(rows, means.clusters, means.matrix)
    return mean_distances(rows, known, max_broadcast, block_rows)


def silhouette_rows(df: DataFrame, **options: int) -> DataFrame:
    """Exact silhouette of every row: ``id, cluster, silhouette``; 0 for a row alone in
    its cluster."""
    value = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return silhouette_parts(df, **options).select(
        "id", "cluster", F.coalesce(value, F.lit(0.0)).alias("silhouette")
    )


def silhouette_score(df: DataFrame, **options: int) -> float:
    return silhouette_rows(df, **options).agg(F.avg("silhouette")).first()[0]


def silhouette_squared(df: DataFrame) -> float:
    """Silhouette on squared distances: linear in the rows, another statistic."""
    rows = df.select(
        array_to_vector(as_double(F.col("vector"))).alias("features"),
        F.col("cluster").cast("double").alias("prediction"),
    )
    return ClusteringEvaluator(metricName="silhouette").evaluate(rows)


def sweep_k(
    df: DataFrame,
    ks: range,
    measure: Callable[[DataFrame], float] = silhouette_squared,
) -> DataFrame:
    """Fit every k on one input and mark the best silhouette, the smaller k on ties.

    Fits are those of :mod:`.kmeans`, made in the same scans; the seeds of a smaller k begin
    those of a larger.

    The default measure is linear in the rows; ``silhouette_score``, the exact one,
    compares rows with the clusters that bounds leave.
    """
    results = []
    seeds = kmeans.farthest_first(df, max(ks))
    fits = kmeans.lloyd_all(df, [seeds[:k] for k in ks], MAX_ITER)
    for k, fit in zip(ks, fits):
        centroids = Centroids.of_fit(fit)
        labelled = assign_nearest(df.select("id", "vector"), centroids)
        cost = labelled.agg(F.sum("d2")).first()[0]
        results.append((k, cost, float(measure(labelled))))
    best = min(results, key=lambda r: (-r[2], r[0]))[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in results],
        "k int, inertia double, silhouette double, best boolean",
    )


def principal_axes(df: DataFrame, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` principal axes (columns) and the share of variance along each.

    The sign of an axis is free; here its largest component, the first of equal ones, is
    positive.
    """
    rows = df.select(array_to_vector(as_double(F.col("vector"))).alias("features"))
    model = PCA(k=n, inputCol="features", outputCol="plane").fit(rows)
    axes = model.pc.toArray()
    largest = np.abs(np.round(axes, SCORE_DIGITS)).argmax(axis=0)
    signs = np.where(axes[largest, np.arange(n)] < 0, -1.0, 1.0)
    return axes * signs, model.explainedVariance.toArray()


def project_2d(df: DataFrame) -> DataFrame:
    """Every row along the two principal axes, for a map of the clusters."""
    axes, _ = principal_axes(df)
    along = [F.array(*[F.lit(float(x)) for x in axis]) for axis in axes.T]
    return df.select(
        "id", dot(F.col("vector"), along[0]).alias("x"), dot(F.col("vector"), along[1]).alias("y"), "cluster"
    )
