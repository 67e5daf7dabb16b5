"""Compression of vectors to codebook indexes, with a geometric access tree over each codebook's entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.matrices import floor_quotients, integer_vectors, matrix, seed_vectors
from textwarden.sources.checkpoints import cut_lineage

#: Split points of a node; so many entries or fewer are a leaf.
DEGREE, LEAF = 6, 4
#: Vectors searched at once.
SLICE = 8192
_WIDER = 2.0**-50
_FAR = np.iinfo(np.int64).max


class Gnat:
    """Nearest of at most a few hundred integer entries, for many queries at once.

    A node has split points, taken far from each other, and each other entry of the node belongs to the
    nearest of them. For each pair of split points it has the range of distances from the first to the
    entries of the second. A query at distance d from a split point, whose nearest entry so far is at
    distance r, cannot find one as near in a subtree whose range from that split point lies wholly
    below d - r or above d + r. Distances are squared integers; where roots are compared they are
    widened outwards, and subtrees go only if strictly farther, so that an equally near entry of a lower
    index is still met and compared as integers.
    """

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries = np.asarray(entries, dtype=np.int64)
        self.degree, self.leaf = degree, leaf
        self.measured = 0
        self.root = self._node(np.arange(len(self.entries)))

    def _node(self, at: np.ndarray):
        """(split points, their children, least and greatest distance from each split point to each child)."""
        if len(at) <= max(self.leaf, self.degree):
            return at, [], None, None
        points = self.entries[at]
        chosen = [0]
        nearest = ((points - points[0]) ** 2).sum(axis=1)
        distances = [nearest]
        while len(chosen) < self.degree:
            farthest = int(nearest.argmax())
            if nearest[farthest] == 0:
                # Only copies of split points are left: any entries not taken yet will do.
                farthest = next(i for i in range(len(at)) if i not in chosen)
            chosen.append(farthest)
            distances.append(((points - points[farthest]) ** 2).sum(axis=1))
            nearest = np.minimum(nearest, distances[-1])
        table = np.stack(distances)
        owner = table.argmin(axis=0)
        owner[chosen] = -1
        groups = [np.flatnonzero(owner == j) for j in range(len(chosen))]
        used = [g for g in groups if len(g)]
        low = np.stack([table[:, g].min(axis=1) for g in used], axis=1)
        high = np.stack([table[:, g].max(axis=1) for g in used], axis=1)
        return (
            at[chosen],
            [self._node(at[g]) for g in used],
            np.sqrt(low.astype(float)) * (1 - _WIDER),
            np.sqrt(high.astype(float)) * (1 + _WIDER),
        )

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry, ties to the lower index."""
        best = np.full(len(queries), _FAR, dtype=np.int64)
        place = np.zeros(len(queries), dtype=np.int64)
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), best, place)
        return place, best

    def _visit(self, node, queries, rows, best, place) -> None:
        splits, children, low, high = node
        asked = queries[rows]
        distance = np.stack([((asked - self.entries[s]) ** 2).sum(axis=1) for s in splits], axis=1)
        self.measured += distance.size
        for k, s in enumerate(splits):
            d = distance[:, k]
            nearer = (d < best[rows]) | ((d == best[rows]) & (s < place[rows]))
            best[rows[nearer]], place[rows[nearer]] = d[nearer], s
        if not children:
            return
        root = np.sqrt(distance.astype(float))
        below, above = root * (1 - _WIDER), root * (1 + _WIDER)
        for j, child in enumerate(children):
            radius = np.sqrt(best[rows].astype(float))[:, None] * (1 + _WIDER)
            alive = ((below - radius <= high[:, j]) & (above + radius >= low[:, j])).all(axis=1)
            if alive.any():
                self._visit(child, queries, rows[alive], best, place)


def _parts(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    return matrix(batch.column("v"), parts * width).reshape(-1, parts, width)


def _sums(rows: DataFrame, books: list[np.ndarray]) -> list:
    """Per part and entry the count and the componentwise sum of the parts that it is nearest to.

    Each task adds up its own rows and hands on one row for each part and entry in use.
    """
    width, most = books[0].shape[1], len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        count = np.zeros((len(books), most), dtype=np.int64)
        total = np.zeros((len(books), most, width), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                cut = _parts(batch.slice(at, SLICE), len(books), width)
                for p, tree in enumerate(trees):
                    place, _ = tree.nearest(cut[:, p])
                    count[p] += np.bincount(place, minlength=most)
                    np.add.at(total[p], place, cut[:, p])
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums],
            names=["part", "entry", "n", "s"],
        )

    each = rows.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()


def train(rows: DataFrame, first: list[list[int]], parts: int, rounds: int) -> list[np.ndarray]:
    """One codebook for each part, begun with the given vectors' parts; the driver sees entries only."""
    width = len(first[0]) // parts
    start = np.array(first, dtype=np.int64).reshape(len(first), parts, width)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for row in _sums(rows, books):
            sums = [row[f"s{i}"] for i in range(width)]
            books[row["part"]][row["entry"]] = floor_quotients(sums, row["n"])
    return books


def assign(rows: DataFrame, books: list[np.ndarray], *others: str) -> DataFrame:
    """vec_id, the named columns, code (two hex digits for each part) and error of each row."""
    width = books[0].shape[1]
    kept = ["vec_id", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cut = _parts(part, len(books), width)
                found = [tree.nearest(cut[:, p]) for p, tree in enumerate(trees)]
                codes = np.stack([place for place, _ in found], axis=1).astype(np.uint8)
                error = np.sum([distance for _, distance in found], axis=0, dtype=np.int64)
                text = codes.tobytes().hex()
                size = 2 * len(books)
                code = pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], code, pa.array(error)], names=[*kept, "code", "error"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "v").mapInArrow(run, f"{types}, code string, error long")


def compress(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each vector; and the codebooks, entries by components.

    Vectors that are null or hold null or non-finite components take no part. Vectors are cut into equal
    parts, so only those of one dimension can be coded together: that of the smallest vec_id whose
    dimension is a positive multiple of `parts`; others take no part. Components must lie within 2**25
    after scaling, which is checked. Each row counts, also one that repeats another; an id that repeats
    starts one entry, with its smallest vector, and a null id none. With fewer ids than entries the
    codebooks are smaller. Equal labels, nulls together, share label_error. Tables without usable
    vectors give no rows. Other columns do not come along. At most 256 entries fit two digits.

    The vectors are written once as integers and read by rounds + 1 scans; only sums for each entry are
    shuffled, one row for each entry, part and task at most. The errors of labels come back by a join
    with a written table of one row a label.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for an entry")
    spark = vectors.sparkSession
    all_rows = integer_vectors(vectors, vec_id, vector, scale, label=label)
    fits = (F.size("v") > 0) & (F.size("v") % parts == 0)
    size = all_rows.where(fits).agg(F.min_by(F.size("v"), F.struct("vec_id", F.size("v"))).alias("size")).first()["size"]
    rows = all_rows.where(F.size("v") == (size or 0))
    first = seed_vectors(rows, rows.select("vec_id"), ["vec_id"], entries) if size else []
    if not first:
        none = "label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long, {none}"), []
    books = train(rows, first, parts, rounds)
    text = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    coded = cut_lineage(assign(rows, books, "label"))
    sums = cut_lineage(coded.groupBy(F.col("label").alias("sum_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("sum_label"))).drop("sum_label")
    return out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())), books


def op11(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return compress(vectors)[0].drop("label")


def _sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    steps = []
    for r in range(rounds + 1):
        # The least of distance * entries + entry has the nearest entry, ties to the lower one.
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, p, min(dist * {entries} + entry) AS best
  FROM (SELECT c.rid, c.p, e.entry, CAST(sum((c.x - e.x) * (c.x - e.x)) AS BIGINT) AS dist
        FROM comps c JOIN e{r} e USING (p, d) GROUP BY c.rid, c.p, e.entry)
  GROUP BY rid, p
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT a.p, a.best % {entries} AS entry, c.d, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n
  FROM a{r} a JOIN comps c USING (rid, p) GROUP BY ALL
),
e{r + 1} AS MATERIALIZED (
  SELECT p, entry, d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, e.x) AS x
  FROM e{r} e LEFT JOIN m{r} m USING (p, entry, d)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {parts * width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
comps AS MATERIALIZED (
  SELECT rid, vec_id, i // {width} AS p, i % {width} AS d, v[i + 1] AS x FROM kept, range({parts * width}) t(i)
),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
e0 AS MATERIALIZED (SELECT c.p, s.entry, c.d, c.x FROM comps c JOIN seeds s USING (vec_id)),{",".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid
),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, entry, d)) AS h FROM e{rounds})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, books.h AS codebooks_sha256
FROM kept k JOIN coded c USING (rid) CROSS JOIN books
"""


SQL = _sql()
