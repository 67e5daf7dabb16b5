"""Centroid clustering over approximations: few-bit cells for each dimension tell most centroids apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.matrices import floor_quotients, integer_vectors, matrix, seed_vectors
from textwarden.sources.checkpoints import cut_lineage

#: Bits of a cell number.
BITS = 7
#: Cells are quantiles of a normal distribution this much wider than the components' own: so the sum of the
#: widths of the cells that vectors fall into is about the least.
STRETCH = 1.5
#: Vectors compared at once.
SLICE = 2048


class Cells:
    """Borders of the cells of each dimension and what they tell of distances.

    Cell j of a dimension holds the integers above border j - 1 up to border j; the outer cells end at
    the least and greatest component of the whole table.
    """

    def __init__(self, low: list[int], high: list[int], mean: list[float], deviation: list[float], bits: int = BITS):
        steps = np.array([NormalDist().inv_cdf(i / 2**bits) for i in range(1, 2**bits)]) * STRETCH
        self.borders = np.floor(np.array(mean)[:, None] + np.array(deviation)[:, None] * steps).astype(np.int64)
        ends = np.array(low, dtype=np.int64)[:, None], np.array(high, dtype=np.int64)[:, None]
        self.first = np.concatenate([ends[0], self.borders + 1], axis=1)
        self.last = np.concatenate([self.borders, ends[1]], axis=1)

    def number(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each component, a byte each."""
        cells = [np.searchsorted(border, vectors[:, d], side="left") for d, border in enumerate(self.borders)]
        return np.stack(cells, axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """[dimension, cell, centroid]: least squared difference; after the centroids, the greatest ones."""
        below = self.first[:, :, None] - centroids.T[:, None, :]
        above = centroids.T[:, None, :] - self.last[:, :, None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        greatest = np.maximum(np.abs(below), np.abs(above)) ** 2
        return np.concatenate([least, greatest], axis=2)


def nearest(cells: np.ndarray, fetch, tables: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row, ties to the smaller number, and for how many rows full vectors were fetched.

    Each table look-up adds a dimension to the interval in which the distance to each centroid lies. A centroid stays
    if its interval begins no later than another one's ends. `fetch` gives the full vectors of rows with several
    left; their exact distances to those decide.
    """
    k = len(centroids)
    interval = np.zeros((len(cells), 2 * k), dtype=np.int64)
    for d, table in enumerate(tables):
        interval += table[cells[:, d]]
    stays = interval[:, :k] <= interval[:, k:].min(axis=1, keepdims=True)
    chosen = stays.argmax(axis=1)
    open_rows = np.flatnonzero(stays.sum(axis=1) > 1)
    if len(open_rows):
        vectors = fetch(open_rows)
        row, centroid = np.nonzero(stays[open_rows])
        exact = np.full((len(open_rows), k), np.iinfo(np.int64).max, dtype=np.int64)
        exact[row, centroid] = ((vectors[row] - centroids[centroid]) ** 2).sum(axis=1)
        chosen[open_rows] = exact.argmin(axis=1)
    return chosen, len(open_rows)


def _approximated(rows: DataFrame, dim: int, cells: Cells) -> DataFrame:
    """The rows with their cells, a byte a dimension, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = cells.number(matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n.tobytes() for n in numbers], pa.binary())], names=[*batch.schema.names, "cells"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return cut_lineage(rows.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<long>, cells binary"))


def _assigned(batch: pa.RecordBatch, dim: int, tables: np.ndarray, centroids: np.ndarray) -> Iterator[tuple]:
    """Slices of a batch with the cluster of each row."""
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        numbers = np.frombuffer(b"".join(part.column("cells").to_pylist()), dtype=np.uint8).reshape(-1, dim)
        vectors = part.column("v")
        chosen, _ = nearest(numbers, lambda which: matrix(vectors.take(pa.array(which)), dim), tables, centroids)
        yield part, chosen


def _moved(rows: DataFrame, dim: int, cells: Cells, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each task adds up its own rows, one row a cluster leaves it."""
    tables = cells.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros((len(centroids), dim), dtype=np.int64)
        for batch in batches:
            for part, chosen in _assigned(batch, dim, tables, centroids):
                count += np.bincount(chosen, minlength=len(centroids))
                np.add.at(total, chosen, matrix(part.column("v"), dim))
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * dim, pa.array(total[used].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), sums], names=["cluster", "n", "s"])

    each = rows.select("v", "cells").mapInArrow(run, "cluster int, n long, s array<long>")
    # One aggregate a dimension would make a plan of thousands for long vectors.
    sums = each.select("cluster", "n", F.posexplode("s").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    moved = centroids.copy()
    for row in sums.collect():
        (moved[row["cluster"], row["d"]],) = floor_quotients([row["x"]], row["n"])
    return moved


def cluster(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dim: int = 64,
    clusters: int = 40,
    rounds: int = 5,
    seed: int = 2,
    scale: int = 256,
    bits: int = BITS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of `dim` usable components.

    Vectors that are null, of another dimension, or hold null or non-finite components take no part.
    Centroids start as the vectors whose ids have the smallest sha256 of `seed:vec_id`; an id that repeats
    starts one, with its smallest vector, and a null id none; with fewer ids there are fewer clusters. Each row
    counts, also one that repeats another. Components must lie within 2**25 after scaling, which is checked.
    Without usable vectors there are no rows. Other columns do not come along.

    Each round is one scan of a written table. Rows whose intervals leave one centroid are assigned by
    their cells; of the others the full vectors are decoded. The exact sums that move the centroids and the final
    distance to the own centroid need every vector once more. Shuffled are sums: a row for each cluster and
    task. The driver holds centroids and cell borders: clusters x dim and dim x 2**bits numbers.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.where(F.size(vector) == dim), vec_id, vector, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = seed_vectors(rows, rows.select("vec_id"), [key], clusters)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    x = F.col("x")
    shape = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min(x), F.max(x), F.avg(x), F.stddev_pop(x)).orderBy("d").collect()
    cells = Cells(*([row[i] for row in shape] for i in range(1, 5)), bits=bits)
    rows = _approximated(rows, dim, cells)
    centroids = np.array(first, dtype=np.int64)
    for _ in range(rounds):
        centroids = _moved(rows, dim, cells, centroids)
    tables = cells.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chosen in _assigned(batch, dim, tables, centroids):
                distance = ((matrix(part.column("v"), dim) - centroids[chosen]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(chosen.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    found = cut_lineage(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row a cluster.
    facts = spark.createDataFrame(
        [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return cluster(vectors)


def _sql(dim: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, min(dist * {clusters} + cluster) AS best
  FROM (SELECT c.rid, e.cluster, CAST(sum((c.x - e.x) * (c.x - e.x)) AS BIGINT) AS dist
        FROM comps c JOIN e{r} e USING (d) GROUP BY c.rid, e.cluster)
  GROUP BY rid
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT a.best % {clusters} AS cluster, c.d, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n
  FROM a{r} a JOIN comps c USING (rid) GROUP BY ALL
),
e{r + 1} AS MATERIALIZED (
  SELECT cluster, d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, e.x) AS x
  FROM e{r} e LEFT JOIN m{r} m USING (cluster, d)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
comps AS MATERIALIZED (SELECT rid, vec_id, i AS d, v[i + 1] AS x FROM kept, range({dim}) t(i)),
seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS cluster
  FROM (SELECT vec_id, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {clusters})
),
e0 AS MATERIALIZED (SELECT s.cluster, c.d, c.x FROM comps c JOIN seeds s USING (vec_id)),{",".join(steps)},
found AS (SELECT rid, CAST(best % {clusters} AS INTEGER) AS cluster, best // {clusters} AS distance FROM a{rounds}),
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM e{rounds} GROUP BY cluster)
SELECT k.vec_id, f.cluster, f.distance,
  CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.distance) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM kept k JOIN found f USING (rid) JOIN digests g USING (cluster)
"""


SQL = _sql()
