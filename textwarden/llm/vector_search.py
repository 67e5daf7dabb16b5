"""Exact top-k search by inner product over norm-bucketed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.sources.checkpoints import cut_lineage

#: Vectors of one bucket differ in length by this factor at most.
RATIO = 1.1
#: Candidates and queries that meet in one group.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: From this local cosine threshold on, coordinates prune; below it, lengths do.
COORDINATE_FROM = 0.3
#: Coordinates in focus: those in which the query is largest.
FOCUS = 6
_SLACK = 1e-9
_PART = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def to_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, with x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _products(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    size = float(np.abs(matrix.astype(float)).max(initial=0)) * float(np.abs(vector.astype(float)).max(initial=0))
    if size * max(1, len(vector)) < 2**53:
        return (matrix.astype(float) @ vector.astype(float)).astype(np.int64)
    return matrix @ vector


class Bucket:
    """A block of candidates in descending order of length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.longest = float(self.length[0]) if len(ids) else 0.0
        self.exact = self.vectors.astype(float) if np.abs(vectors.astype(float)).max(initial=0) < 2**20 else None
        self.unit = (self.vectors / np.maximum(self.length, 1e-300)[:, None]).T.copy()

    def survivors(self, query: np.ndarray, threshold: float | None) -> np.ndarray | None:
        """Places that can reach the threshold; None for all of them.

        The local threshold is the cosine that the bucket's longest vector needs. Above 1
        the whole bucket goes. A high one prunes by coordinates: a unit vector at an angle
        of at most acos(t) to the query lies in each coordinate within that angle of the
        query's own. A low one prunes by length alone.
        """
        size = float(np.sqrt((query.astype(float) ** 2).sum()))
        if threshold is None or threshold <= 0 or size == 0:
            return None
        local = threshold / (size * self.longest) if self.longest else np.inf
        if local > 1 + _SLACK:
            return np.zeros(0, dtype=np.int64)
        if local < COORDINATE_FROM:
            return np.arange(np.searchsorted(-self.length, -(threshold / size) * (1 - _SLACK), side="right"))
        angle = np.arccos(min(1.0, local))
        at = None
        unit = query / size
        for k in np.argsort(-np.abs(unit))[:FOCUS]:
            own = np.arccos(np.clip(unit[k], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - _SLACK, np.cos(max(0.0, own - angle)) + _SLACK
            values = self.unit[k] if at is None else self.unit[k][at]
            fits = (values >= low) & (values <= high)
            at = np.flatnonzero(fits) if at is None else at[fits]
        return at

    def best(self, query_id: int, query: np.ndarray, threshold: float | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best other vectors, ties to smaller ids; each pair of both once."""
        at = self.survivors(query, threshold)
        ids = self.ids if at is None else self.ids[at]
        matrix = self.vectors if at is None else self.vectors[at]
        if len(ids) == 0:
            return ids, ids
        if self.exact is not None and np.abs(query).max(initial=0) < 2**20 and len(query) < 2**12:
            scores = ((self.exact if at is None else self.exact[at]) @ query.astype(float)).astype(np.int64)
        else:
            scores = _products(matrix, query)
        other = ids != query_id
        if threshold is not None:
            other &= scores >= threshold
        ids, scores = ids[other], scores[other]
        if len(ids) > 4 * k + 64:
            # The k-th best of different ids is among these: an id may repeat.
            floor_ = np.partition(scores, len(scores) - k)[len(scores) - k]
            if len(np.unique(ids[scores >= floor_])) >= k:
                ids, scores = ids[scores >= floor_], scores[scores >= floor_]
        pairs = np.unique(np.stack([-scores, ids], axis=1), axis=0)[:k] if len(ids) else np.zeros((0, 2), dtype=np.int64)
        return pairs[:, 1], -pairs[:, 0]


def _search(k: int):
    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(block):
            bucket = Bucket(block["vec_id"].to_numpy(), np.stack(block["v"].to_list()).astype(np.int64))
            for query_id, v, threshold in zip(queries["query_id"], queries["v"], queries["threshold"]):
                limit = None if pd.isna(threshold) else float(threshold)
                ids, scores = bucket.best(int(query_id), np.asarray(v, dtype=np.int64), limit, k)
                found.append((np.full(len(ids), query_id, dtype=np.int64), ids, scores))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = parts.withColumn("rank", F.row_number().over(order))
    return once.where(F.col("rank") <= k)


def top_products(
    vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest integer inner products.

    Every row that takes part is a candidate for every query but those of its own id; ties
    go to smaller ids; with fewer candidates all are returned. Vectors that are null or hold
    null or non-finite components, and null ids, take no part; vectors of different
    dimension never meet; empty ones score 0. Rows that repeat an id and a score count
    once. Other columns do not come along.

    Candidates are grouped by dimension and length, and each bucket is dealt into blocks of
    about BLOCK_ROWS by a hash. A first round over one block of the longest bucket gives
    each query a threshold, its k-th best score so far. In the second round a query visits
    only buckets whose longest vector can reach it, and in each block prunes by coordinates
    or length before products are verified. A group holds one block and at most about
    QUERY_ROWS queries; each returns k rows a query. The driver sees a row for each bucket:
    at most a few hundred a dimension, for lengths grow by a factor from bucket to bucket.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(
        vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
            F.col(vec_id).cast("long").alias("vec_id"), to_integers(F.col(vector), scale).alias("v"), is_query.alias("q")
        )
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = rows.withColumns({"dim": F.size("v"), "norm": norm}).withColumn(
        "bucket", F.when(F.col("norm") < 1, -1).otherwise(F.floor(F.log("norm") / F.lit(float(np.log(RATIO))))).cast("int")
    )
    buckets = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    queries = cut_lineage(rows.where(F.coalesce("q", F.lit(False))).drop("q", "bucket"))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    sizes = [(b["dim"], b["bucket"], max(1, -(-b["n"] // BLOCK_ROWS)), b["longest"]) for b in buckets]
    schema = "dim int, bucket int, blocks int, longest double"
    # One row a bucket; see above for its bound.
    plan = F.broadcast(spark.createDataFrame(sizes, schema))
    blocks = rows.join(plan, ["dim", "bucket"]).select(
        "dim", "bucket", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    )
    asked = queries.select(
        F.col("vec_id").alias("query_id"), "v", "dim", "norm", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block")
    )
    # The longest bucket of each dimension with enough vectors to give a threshold.
    seeds = {}
    for dim, bucket, n, _ in sorted(sizes, key=lambda s: s[1]):
        if next(b["n"] for b in buckets if (b["dim"], b["bucket"]) == (dim, bucket)) > 2 * k * n:
            seeds[dim] = bucket
    seed = F.broadcast(spark.createDataFrame([*seeds.items()], "dim int, bucket int"))
    is_seed = F.col("block") == 0
    key = ["dim", "bucket", "block", "query_block"]

    def visit(visits: DataFrame, candidates: DataFrame) -> DataFrame:
        spread = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        return visits.groupBy(key).cogroup(spread.groupBy(key)).applyInPandas(_search(k), _PART)

    first = asked.join(seed, "dim").select("*", F.lit(0).alias("block"), F.lit(None).cast("double").alias("threshold"))
    seeded = cut_lineage(visit(first, blocks.where(is_seed).join(seed, ["dim", "bucket"])))
    limits = (
        # A query whose row repeats finds the same pairs once for each of its rows.
        _ranked(seeded.distinct(), k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("threshold"))
        .groupBy("query_id").agg(F.max("threshold").alias("threshold"))
    )
    visits = (
        asked.join(limits, "query_id", "left")
        .join(plan, "dim")
        .where(F.col("threshold").isNull() | (F.col("norm") * F.col("longest") * (1 + _SLACK) >= F.col("threshold")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(seed.select("dim", F.col("bucket").alias("seed")), "dim", "left")
        .where(F.coalesce((F.col("bucket") != F.col("seed")) | ~is_seed, F.lit(True)))
        .select(*key, "query_id", "v", "threshold")
    )
    rest = blocks.join(seed.select("dim", F.col("bucket").alias("seed")), "dim", "left").where(
        F.coalesce((F.col("bucket") != F.col("seed")) | ~is_seed, F.lit(True))
    ).drop("seed")
    parts = seeded.unionByName(visit(visits, rest))
    return _ranked(parts.distinct(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.c, c.c) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
