"""Integer vectors as written tables, and their Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.vector_search import to_integers, usable
from textwarden.sources.checkpoints import cut_lineage

#: Beyond this, squared distances of a few thousand components may pass 64 bits.
LARGEST = 2**25


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int, **columns: str) -> DataFrame:
    """A written table of vec_id, v = floor(scale * x) and the named columns, without null or non-finite vectors."""
    kept = vectors.where(usable(F.col(vector)))
    others = [F.col(source).alias(name) for name, source in columns.items()]
    return cut_lineage(kept.select(F.col(vec_id).alias("vec_id"), to_integers(F.col(vector), scale).alias("v"), *others))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch, all of that width, as rows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    if rows.size and max(-int(rows.min()), int(rows.max())) > LARGEST:
        raise OverflowError(f"components beyond {LARGEST} after scaling: distances would pass 64 bits")
    return rows


def floor_quotients(sums: list[int], count: int) -> list[int]:
    return [s // count for s in sums]


def seed_vectors(rows: DataFrame, ids: DataFrame, order: list, k: int) -> list[list[int]]:
    """The vectors of the k first ids in that order, of an id that repeats its smallest; to the driver, k rows."""
    first = [r["vec_id"] for r in ids.where("vec_id IS NOT NULL").distinct().orderBy(*order).limit(k).collect()]
    found = rows.where(F.col("vec_id").isin(first)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    place = {i: at for at, i in enumerate(first)}
    return [list(r["v"]) for r in sorted(found, key=lambda r: place[r["vec_id"]])]
