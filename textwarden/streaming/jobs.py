"""The same decisions over streams of text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textwarden.functions.paths import first_blocked_argument
from textwarden.functions.shaping import reduction
from textwarden.operators import gate, lines, store
from textwarden.policy import Policy, StoragePolicy
from textwarden.sources.captures import streams
from textwarden.sources.checkpoints import shared_dir

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_stream(
    spark: SparkSession, table: str, schema: str, files_per_batch: int = 64
) -> DataFrame:
    """A table, one file or a folder of part files, as a stream of its files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, a path may also be that of a single file.
    return reader.parquet(f"{table[:-1]}[{table[-1]}]")


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder of batches is there yet, on whatever file system it lies."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"


def run_to_end(writer) -> int:
    """Process what is there, in as many batches as it takes, then stop.

    Returns how many rows came later than the watermark allows.
    """
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(
        op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators
    )


# ------------------------------------------------------------------ redact and gate


def gate_stream(docs: DataFrame, out: str, policy: Policy = Policy()) -> None:
    """Gate every document once; stateless, so any batch can be run again."""
    decided = gate.gate_documents(docs, policy).select(
        "doc_id", "blocked", "reason", "path_rule", "redactions", "warnings", "exit_code", "content"
    )
    run_to_end(
        decided.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
    )


# ------------------------------------------------------------------ live totals


def stats_stream(
    docs: DataFrame, out: str, policy: Policy = Policy(), lateness: str = "3 days"
) -> int:
    """Hourly totals per source.  Each batch writes only the totals it changed, into
    a folder of its own that a repeated batch overwrites.

    Rows more than ``lateness`` behind the newest one are not counted in any hour, as
    its totals are closed; their number is returned.
    """
    decided = gate.gate_documents(docs, policy)
    totals = (
        decided.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"), "source")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.count_if("blocked").alias("blocked"),
            F.sum("raw_bytes").alias("raw_bytes"),
            F.sum("returned_bytes").alias("returned_bytes"),
            F.sum("redactions").alias("redactions"),
        )
        .select(F.unix_timestamp("window.start").alias("hour_start"), "*")
        .drop("window")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return run_to_end(
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(write)
    )


def latest_stats(spark: SparkSession, out: str) -> DataFrame:
    """The current totals: per hour and source, the row of the last batch."""
    rows = spark.read.parquet(f"{out}/data")
    names = ["docs", "blocked", "raw_bytes", "returned_bytes", "redactions"]
    last = F.max_by(F.struct(*names), "batch").alias("_l")
    rows = rows.groupBy("hour_start", "source").agg(last).select("hour_start", "source", "_l.*")
    return rows.withColumn("reduction", reduction(F.col("raw_bytes"), F.col("returned_bytes")))


# ------------------------------------------------------------------ commit once


def commit_stream(
    runs: DataFrame, out: str, limits: StoragePolicy = StoragePolicy(), policy: Policy = Policy()
) -> None:
    """Retain each run once, however often and however late it arrives.

    Every batch is compared with the ids stored by earlier ones, so no time limit decides
    what is a repeat and no run is lost for being late. A batch that runs again replaces
    its own folders. Lines are written before headers: a run with a header has its lines.
    Runs with an argument (column ``argv``, where there is one) that the policy blocks are not retained.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if "argv" in batch.columns:
            batch = batch.where(first_blocked_argument(F.col("argv"), policy).isNull()).drop("argv")
        once = batch.dropDuplicates(["run_id"])
        earlier = f"{out}/runs"
        if batch_id > 0 and has_files(session, earlier):
            known = session.read.parquet(earlier).where(F.col("batch") < batch_id)
            once = once.join(known.select("run_id"), "run_id", "left_anti")
        for name in ("stdout", "stderr"):
            once = gate.with_stored_text(once, name, f"_{name}", policy).drop(name)
        once = once.withColumnsRenamed({"_stdout": "stdout", "_stderr": "stderr"})
        # Two outputs from one batch: write the sanitised runs first, read them twice.
        once.write.mode("overwrite").parquet(f"{out}/sanitized/batch={batch_id}")
        saved = session.read.schema(once.schema).parquet(f"{out}/sanitized/batch={batch_id}")
        saved = store.storable(saved, limits)
        index = lines.line_index(streams(saved), limits)
        index.sortWithinPartitions("run_id", "stream", "line_no").write.mode(
            "overwrite"
        ).parquet(f"{out}/lines/batch={batch_id}")
        headers = store.run_headers(saved, "created_at", limits)
        headers.write.mode("overwrite").parquet(f"{out}/runs/batch={batch_id}")

    run_to_end(
        runs.writeStream.outputMode("append")
        .option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(write)
    )


# ------------------------------------------------------------------ expiry

TOMBSTONES = "run_id string, status string, recorded_at bigint, expires_at bigint"
_STATE = "run_id array<string>, expires_at array<bigint>, timer array<bigint>, buried array<boolean>"
#: Groups that runs are dealt into by a hash. A call serves all runs of a group, so calls do not grow with the runs.
GROUPS = 1024


def expire_stream(
    runs: DataFrame, out: str, limits: StoragePolicy = StoragePolicy(), lateness: str = "0 seconds", groups: int = GROUPS
) -> int:
    """Emit a tombstone when a run's time is over; forget it when the tombstone's is.

    Time is the stream's own: its newest row less ``lateness``, so a replay gives the same
    rows. State is two numbers and a flag per run, kept by groups of runs: a call for each run would cost
    far more than the run. Rows that come later than that are returned as
    a number; :func:`sweep_late` finds what they leave undone in the tables.
    """
    keep = limits.tombstone_ttl_seconds

    def step(
        key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        # By run: when it expires, the watermark past which it is looked at without a row, whether it is buried.
        held = {run: rest for run, *rest in zip(*state.get)} if state.exists else {}
        seen: dict[str | None, int] = {}
        # On a timeout there is one batch, of nulls.
        for batch in () if state.hasTimedOut else batches:
            for run, first in batch.groupby("run_id", dropna=False)["expires_at"].min().items():
                run, first = None if pd.isna(run) else run, int(first)
                seen[run] = min(seen.get(run, first), first)
        due = [run for run, (_, timer, _) in held.items() if timer < mark and run not in seen]
        over = []
        for run in [*seen, *due]:
            expires_at, _, buried = held.get(run, (seen.get(run), None, False))
            if buried and run not in seen:
                del held[run]
                continue
            expires_at = min(expires_at, seen.get(run, expires_at))
            if not buried and expires_at * 1000 <= mark:
                buried = True
                over.append((run, "expired", expires_at, expires_at + keep))
            end = (expires_at + keep if buried else expires_at) * 1000
            # A timer fires once the watermark is past it.
            held[run] = (expires_at, max(end - 1, mark + 1), buried)
        if over:
            yield pd.DataFrame(over, columns=["run_id", "status", "recorded_at", "expires_at"])
        if not held:
            state.remove()
            return
        state.update((list(held), *map(list, zip(*held.values()))))
        state.setTimeoutTimestamp(max(min(timer for _, timer, _ in held.values()), mark))

    group = F.pmod(F.xxhash64("run_id"), F.lit(groups)).alias("group")
    expired = (
        runs.select(group, "run_id", "expires_at", "ts")
        .withWatermark("ts", lateness)
        .groupBy("group")
        .applyInPandasWithState(
            step, TOMBSTONES, _STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return run_to_end(
        expired.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
    )


def sweep_late(
    runs: DataFrame, tombstones: DataFrame, now: int, limits: StoragePolicy = StoragePolicy()
) -> DataFrame:
    """Tombstones for runs past due that the stream has buried none for, ``(run_id, expires_at)`` given.

    The batch twin of :func:`expire_stream`: it sees all runs, however late they came.
    """
    due = runs.groupBy("run_id").agg(F.min("expires_at").alias("recorded_at"))
    due = due.where(F.col("recorded_at") <= now)
    return due.join(tombstones.select("run_id"), "run_id", "left_anti").select(
        "run_id", F.lit("expired").alias("status"), "recorded_at",
        (F.col("recorded_at") + limits.tombstone_ttl_seconds).alias("expires_at"),
    )
