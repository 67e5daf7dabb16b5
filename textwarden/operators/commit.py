"""One commit: sweep, admit, write, publish, and tell each run what became of it."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textwarden import policy as P
from textwarden.functions.paths import first_blocked_argument
from textwarden.operators import gate, quota, removal, store
from textwarden.operators.block_search import block_index
from textwarden.operators.lines import indexable, line_count, line_index
from textwarden.policy import Policy, StoragePolicy
from textwarden.sources.captures import is_run_id, streams
from textwarden.sources.checkpoints import cut_lineage
from textwarden.sources.manifests import Part, Snapshot, latest, names_in, publish

KEYS = ("run_id", "tenant", "arrival", "command_kind", "created_at")


def bucket_of(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def date_of(created_at: Column) -> Column:
    return F.to_date(F.timestamp_seconds(created_at))


def sanitized(runs: DataFrame, limits: StoragePolicy, policy: Policy) -> DataFrame:
    """Runs that pass the argument check, their texts as they would be stored, and what those texts take up.

    Texts of runs that are not to be stored, or have no valid id, become null before anything reads them.
    """
    keeps = is_run_id(F.col("run_id")) & ~F.col("no_store")
    rows = runs.where(first_blocked_argument(F.col("argv"), policy).isNull())
    rows = rows.withColumn("_keeps", F.coalesce(keeps, F.lit(False)))
    for name in ("stdout", "stderr"):
        rows = rows.withColumn(name, F.when(F.col("_keeps"), F.coalesce(name, F.lit(""))))
        rows = gate.with_stored_text(rows, name, f"_{name}", policy).drop(name).withColumnRenamed(f"_{name}", name)
    out, err = F.col("stdout"), F.col("stderr")

    def facts(text: Column) -> Column:
        return F.struct(
            F.octet_length(text).cast("bigint").alias("byte_len"),
            line_count(text).alias("line_count"),
            F.sha2(text, 256).alias("checksum"),
        )

    return rows.select(
        *KEYS, "no_store", "_keeps", "stdout", "stderr",
        facts(out).alias("out"), facts(err).alias("err"),
        store.estimated_bytes(out, err).alias("bytes"),
        F.greatest(F.octet_length(out), F.octet_length(err)).cast("bigint").alias("stream_bytes"),
        F.coalesce(indexable(out, limits) & indexable(err, limits), F.lit(False)).alias("_fits"),
        F.monotonically_increasing_id().alias("_row"),
    )


def decide(rows: DataFrame, known: DataFrame, used: DataFrame, limits: StoragePolicy) -> DataFrame:
    """``reason`` for each sanitised row, texts not read: stored, no_store, storage_error or quota_exceeded.

    Of rows that share an id the first to arrive counts; the others find the run stored already, or share
    its refusal. So does a row whose id is known. Neither uses up room.
    """
    rows = rows.drop("stdout", "stderr")
    order = F.struct("arrival", "_row", "tenant", "bytes", "stream_bytes", "_fits")
    first = rows.where("_keeps").groupBy("run_id").agg(F.min(order).alias("f")).select("run_id", "f.*")
    first = first.join(known.select("run_id", F.lit(True).alias("_known")), "run_id", "left")
    first = cut_lineage(first.withColumn("_known", F.coalesce("_known", F.lit(False))))
    asked = first.where(~F.col("_known") & F.col("_fits")).select("tenant", "arrival", "run_id", "stream_bytes", "bytes")
    admitted = quota.admit(asked, used, limits).where("within_quota").select("run_id", F.lit(True).alias("_in"))
    outcome = first.join(admitted, "run_id", "left").select(
        "run_id", F.col("_row").alias("_first"), "_known", F.coalesce("_in", F.lit(False)).alias("_in")
    )
    rows = rows.join(outcome, "run_id", "left")
    reason = (
        F.when(F.col("no_store"), F.lit("no_store"))
        .when(~F.col("_keeps") | F.col("_known"), F.lit("storage_error"))
        .when(~F.col("_in"), F.lit("quota_exceeded"))
        .when(F.col("_row") != F.col("_first"), F.lit("storage_error"))
        .otherwise(F.lit("stored"))
    )
    return rows.withColumn("reason", reason).drop("_first", "_known", "_in")


def commit(
    spark: SparkSession,
    root: str,
    runs: DataFrame,
    now: int,
    limits: StoragePolicy = StoragePolicy(),
    policy: Policy = Policy(),
    buckets: int = 16,
) -> tuple[Snapshot, DataFrame]:
    """Store runs ``(run_id, tenant, arrival, command_kind, argv, no_store, created_at, stdout, stderr)``.

    Returns the new snapshot and a receipt for each row but those whose arguments a path rule blocks:
    they never ran. First, runs whose time is over are removed. Then rows are admitted in the order of their
    arrival, unique per tenant, against what their tenant has stored. Lines, the block index and headers go into
    folders of this commit, and one list makes all of them visible together; whatever stops the job before
    that leaves the store as it was.

    Texts are sanitised once and written; admission reads ids and sizes only. The texts that stay move once, to
    the date and bucket where they are kept, and are sorted there by run and line.
    """
    before = latest(spark, root, buckets)
    before = removal.expire(spark, before, now, limits)
    held = before.table(spark, "runs")
    used = store.usage(held, "tenant")
    staged = cut_lineage(sanitized(runs, limits, policy))
    decided = cut_lineage(decide(staged, held.select("run_id"), used, limits))
    placed = kept_rows(staged, decided).withColumns(
        {"created_date": date_of(F.col("created_at")), "bucket": bucket_of(F.col("run_id"), before.buckets)}
    )
    parts = write_parts(before, placed, limits)
    after = publish(spark, before, [*before.parts, *parts], before.tombstones) if parts else before
    expires = (F.col("created_at") + limits.ttl_seconds).alias("expires_at")
    stored = F.col("reason") == "stored"
    receipts = decided.select(
        "run_id", "arrival", stored.alias("stored"), stored.alias("retrievable"), "reason",
        F.when(stored, expires).alias("expires_at"),
    )
    return after, receipts


def kept_rows(staged: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows that are to be stored, told by the shorter of two lists: those that are, or those that are not.

    The list is a written table; while it is small it is broadcast, so that texts do not move for it.
    """
    stored = F.col("reason") == "stored"
    n = decided.agg(F.count_if(stored).alias("stored"), F.count_if(~stored).alias("refused")).first()
    if n["stored"] <= n["refused"]:
        return staged.join(cut_lineage(decided.where(stored).select("_row")), "_row", "left_semi")
    return staged.join(cut_lineage(decided.where(~stored).select("_row")), "_row", "left_anti")


def write_parts(before: Snapshot, placed: DataFrame, limits: StoragePolicy) -> list[Part]:
    """Write the tables of one commit, which nobody sees yet: lines, block index, headers."""
    mark = str(uuid.uuid4())
    where = ["created_date", "bucket"]
    texts = streams(placed, "created_date", "bucket")
    index = line_index(texts, limits, keep=where, cluster=where)
    write_table(index, before.root, "lines", mark)
    # Texts move, not their filters, which are larger than most of them.
    blocks = block_index(texts.repartition(*where), where)
    write_table(blocks, before.root, "blocks", mark)
    headers = placed.select(
        "run_id", "tenant", "command_kind", F.lit(P.SCHEMA_VERSION).alias("schema_version"), "created_at",
        (F.col("created_at") + limits.ttl_seconds).alias("expires_at"),
        F.lit(P.SANITIZER_VERSION).alias("sanitizer_version"), F.lit(P.ENCODING).alias("encoding"),
        F.col("out").alias("stdout"), F.col("err").alias("stderr"), F.col("bytes").alias("record_bytes"), "bucket", "created_date",
    )
    write_table(headers.repartition("created_date"), before.root, "runs", mark)
    return written_parts(placed.sparkSession, before, mark)


SORTED = {"runs": ["run_id"], "lines": ["run_id", "stream", "line_no"], "blocks": ["run_id", "stream", "block"]}


def write_table(rows: DataFrame, root: str, name: str, mark: str) -> None:
    """Rows in folders by date, lines and blocks also by bucket; sorted in each file, so that readers skip row groups."""
    folders = ["created_date"] if name == "runs" else ["created_date", "bucket"]
    rows.sortWithinPartitions(*folders, *SORTED[name]).write.partitionBy(*folders).parquet(f"{root}/{name}/commit={mark}")


def written_parts(spark: SparkSession, before: Snapshot, mark: str) -> list[Part]:
    """What a commit wrote, a part a date, told by its headers."""
    folder = f"{before.root}/runs/commit={mark}"
    if not any(name.startswith("created_date=") for name in names_in(spark, folder)):
        return []
    sums = spark.read.parquet(folder).groupBy(F.col("created_date").cast("string").alias("d")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col("stdout.line_count") + F.col("stderr.line_count")).alias("lines")
    )
    return sorted((Part(mark, r["d"], r["runs"], r["lines"]) for r in sums.collect()), key=lambda p: p.created_date)

