"""Admission of runs under record and byte limits, exactly as if one by one.

A rejected run uses up nothing, so admission is not a prefix sum: each tenant's runs are
walked in the order of their arrival, with two numbers carried along.  The walk is a sorted
pass, so no group is held in memory.  Most rows of a tenant with very many runs never come to it.
If a run is admitted, then so were all earlier ones that are not larger, for room only shrinks;
so a run with ``max_records`` earlier ones of its size or less can never be.  This is told within
any part of a tenant's rows, by a heap of the smallest sizes so far: first where the rows lie, before any
shuffle, then in salted parts of each tenant, and what is left is walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textwarden.policy import StoragePolicy
from textwarden.sources.checkpoints import cut_lineage

#: Parts that a tenant's rows are dealt into for the second thinning.
SALTS = 64
_ROW = "tenant string, arrival bigint, bytes bigint"
_NAMES = ["tenant", "arrival", "bytes"]


def _thinned(rows: DataFrame, max_records: int) -> DataFrame:
    """Rows of each partition but those that cannot be admitted whatever other partitions hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, smallest = None, []
        for batch in batches:
            keep = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != tenant:
                    tenant, smallest = name, []
                if len(smallest) < max_records:
                    heappush(smallest, -size)
                    keep.append(True)
                elif smallest and size < -smallest[0]:
                    heapreplace(smallest, -size)
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.select(*_NAMES).sortWithinPartitions("tenant", "arrival").mapInArrow(run, _ROW)


def _walked(rows: DataFrame, limits: StoragePolicy) -> DataFrame:
    """The rows that are admitted; rows without an arrival come first and say what a tenant has stored."""
    max_records, max_bytes = limits.max_records, limits.max_total_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, records, total = None, 0, 0
        for batch in batches:
            admitted = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for name, arrival, size, held in zip(*columns):
                if name != tenant:
                    tenant, records, total = name, 0, 0
                if arrival is None:
                    records, total = records + held, total + size
                    admitted.append(False)
                    continue
                fits = records < max_records and total + size <= max_bytes
                if fits:
                    records, total = records + 1, total + size
                admitted.append(fits)
            part = batch.filter(pa.array(admitted, pa.bool_()))
            yield pa.RecordBatch.from_arrays(part.columns[:3], names=_NAMES)

    return rows.repartition("tenant").sortWithinPartitions("tenant", "arrival").mapInArrow(run, _ROW)


def admit(
    runs: DataFrame, used: DataFrame | None = None, limits: StoragePolicy = StoragePolicy()
) -> DataFrame:
    """``(tenant, arrival, run_id, stream_bytes, bytes)`` to ``within_quota``.

    ``arrival`` orders a tenant's runs, is unique per tenant and never null; ``stream_bytes`` is
    the larger stream; ``used`` holds ``(tenant, records, bytes)`` already stored.
    """
    # Sizes are costly to compute, and read twice.
    runs = cut_lineage(runs)
    todo = runs.where(
        (F.col("stream_bytes") <= limits.max_stream_bytes) & (F.col("bytes") <= limits.max_total_bytes)
    )
    salt = F.pmod(F.hash("arrival"), F.lit(SALTS))
    thin = _thinned(_thinned(todo, limits.max_records).repartition("tenant", salt), limits.max_records)
    rows = thin.withColumn("records", F.lit(0).cast("bigint"))
    if used is not None:
        none = F.lit(None).cast("bigint").alias("arrival")
        rows = rows.unionByName(used.select("tenant", none, "bytes", "records"))
    admitted = _walked(rows, limits).select("tenant", "arrival", F.lit(True).alias("_in"))
    return (
        runs.join(admitted, ["tenant", "arrival"], "left")
        .withColumn("within_quota", F.coalesce("_in", F.lit(False)))
        .drop("_in")
    )
