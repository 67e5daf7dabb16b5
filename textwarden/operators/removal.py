"""Removal of retained runs from disk: deletion, expiry, purge.

Parts that hold a run to be removed are written anew without it; the list that names the new files
is published, and then the old files are deleted. Parts without such a run are neither read nor moved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.operators.store import bury, deletion_status
from textwarden.policy import StoragePolicy
from textwarden.sources.checkpoints import cut_lineage, delete_folder
from textwarden.sources.manifests import SCHEMAS, TOMBSTONES, Part, Snapshot, publish


def remove(
    spark: SparkSession,
    before: Snapshot,
    gone: DataFrame,
    tombstones: DataFrame,
) -> Snapshot:
    """The store without the runs ``(run_id, commit, created_date)``, with these tombstones.

    The driver sees a row for each part that is touched.
    """
    from textwarden.operators.commit import write_table, written_parts

    counts = {
        (r["commit"], str(r["created_date"])): r["n"]
        for r in gone.groupBy("commit", "created_date").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    touched = [p for p in before.parts if (p.commit, p.created_date) in counts]
    # Parts that lose all of their runs need not be read.
    thinned = [p for p in touched if counts[p.commit, p.created_date] < p.runs]
    fresh: list[Part] = []
    if thinned:
        mark = str(uuid.uuid4())
        ids = gone.select("run_id")
        for name in SCHEMAS:
            if name != "runs" and not any(p.lines for p in thinned):
                continue
            left = before.table(spark, name, thinned).join(ids, "run_id", "left_anti").drop("commit")
            where = ["created_date"] if name == "runs" else ["created_date", "bucket"]
            write_table(left.repartition(*where), before.root, name, mark)
        fresh = written_parts(spark, before, mark)
    marks = str(uuid.uuid4())
    tombstones.select(*[c.split()[0] for c in TOMBSTONES.split(", ")]).write.parquet(f"{before.root}/tombstones/commit={marks}")
    after = publish(spark, before, [*(p for p in before.parts if p not in touched), *fresh], marks)
    live = {p.commit for p in after.parts}
    for p in touched:
        date = f"/created_date={p.created_date}" if p.commit in live else ""
        for name in SCHEMAS:
            delete_folder(spark, f"{before.root}/{name}/commit={p.commit}{date}")
    if before.tombstones is not None:
        delete_folder(spark, f"{before.root}/tombstones/commit={before.tombstones}")
    return after


def _places(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "commit", "created_date")


def delete(
    spark: SparkSession, before: Snapshot, requests: DataFrame, now: int, limits: StoragePolicy = StoragePolicy()
) -> tuple[Snapshot, DataFrame]:
    """Remove requested runs; the outcome for each requested id, once: deleted, already_gone or not_found."""
    runs, tombs = before.table(spark, "runs"), before.tombstone_table(spark)
    outcome = cut_lineage(deletion_status(requests, runs, tombs, now))
    gone = cut_lineage(_places(runs.join(requests.select("run_id"), "run_id", "left_semi")))
    if gone.isEmpty():
        return before, outcome
    marks = tombs.join(gone, "run_id", "left_anti").unionByName(bury(gone, "deleted", now, limits))
    return remove(spark, before, gone, marks), outcome


def expire(
    spark: SparkSession, before: Snapshot, now: int, limits: StoragePolicy = StoragePolicy(), at_most: int | None = None
) -> Snapshot:
    """Remove runs whose time is over, or the oldest of them, and leave tombstones."""
    due = before.table(spark, "runs").where(F.col("expires_at") <= now)
    if at_most is not None:
        due = due.orderBy("expires_at", "run_id").limit(at_most)
    gone = cut_lineage(_places(due))
    if gone.isEmpty():
        return before
    tombs = before.tombstone_table(spark)
    return remove(spark, before, gone, tombs.join(gone, "run_id", "left_anti").unionByName(bury(gone, "expired", now, limits)))


def purge(
    spark: SparkSession, before: Snapshot, now: int, expired_only: bool = True, limits: StoragePolicy = StoragePolicy()
) -> tuple[Snapshot, int]:
    """Remove what is past its time, tombstones included, or everything; and how many runs and tombstones went.

    A full purge buries each run before it clears the tombstones, and counts both.
    """
    if expired_only:
        held = sum(p.runs for p in before.parts)
        swept = expire(spark, before, now, limits)
        removed = held - sum(p.runs for p in swept.parts)
        tombs = swept.tombstone_table(spark)
        stale = tombs.where(F.col("expires_at") <= now).count()
        if stale:
            nothing = swept.table(spark, "runs", ()).select("run_id", "commit", "created_date")
            swept = remove(spark, swept, nothing, tombs.where(F.col("expires_at") > now))
        return swept, removed + stale
    runs, tombs = before.table(spark, "runs"), before.tombstone_table(spark)
    gone = cut_lineage(_places(runs))
    # One row each: a run that is removed replaces its older tombstone.
    buried = tombs.select("run_id").unionByName(gone.select("run_id")).distinct().count()
    return remove(spark, before, gone, tombs.limit(0)), sum(p.runs for p in before.parts) + buried
