"""A stored vector index: unit vectors dealt to the nearest of some centres, and searches that read a few lists only."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from .search import knn


def _unit(v):
    return F.transform(v.cast("array<double>"), lambda x: x / F.sqrt(dot(v, v)))


def centres(vectors: DataFrame, lists: int = 16, sample: int = 50_000, vector: str = "embedding", id_col: str = "chunk_id", seed: int = 3) -> list[list[float]]:
    """At most `lists` centres, fitted to the `sample` vectors of the smallest hashes; none without vectors."""
    v = F.col(vector)
    d = vectors.where(v.isNotNull() & (dot(v, v) > 0)).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(array_to_vector(_unit(v)).alias("features"))
    n = d.count()
    return [c.tolist() for c in KMeans(k=min(lists, n), seed=seed, maxIter=10).fit(d).clusterCenters()] if n > 1 else []


def nearest_lists(v, centre_rows: list[list[float]], n: int):
    """The numbers of the n centres of the highest inner product with v, as a column."""
    by = F.array(*[F.struct((-dot(v, F.array(*[F.lit(float(x)) for x in c]))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centre_rows)])
    return F.transform(F.slice(F.array_sort(by), 1, n), lambda x: x["k"])


def with_lists(vectors: DataFrame, centre_rows: list[list[float]], vector: str = "embedding") -> DataFrame:
    """vectors with `list`, the number of the nearest centre: the column to partition a stored index by."""
    one = nearest_lists(_unit(F.col(vector)), centre_rows, 1)[0] if centre_rows else F.lit(0)
    return vectors.withColumn("list", one)


def search(index: DataFrame, centre_rows: list[list[float]], query: list[float], k: int = 10, probes: int = 4, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """id, score: the k rows of the highest cosine among the `probes` lists nearest to the query; all lists give the exact result."""
    if probes < len(centre_rows):
        near = sorted(range(len(centre_rows)), key=lambda i: (-sum(a * b for a, b in zip(centre_rows[i], query, strict=True)), i))
        index = index.where(F.col("list").isin(near[:probes]))
    return knn(index, query, k, id_col, vector)
