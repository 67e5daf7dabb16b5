"""Comparing decisions with what was expected, and with an earlier run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.sources.checkpoints import cut_lineage


def snapshot_diff(
    previous: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows only in one of two snapshots, by multiplicity, in one shuffle."""
    sides = previous.select(*columns, F.lit(-1).alias("_d")).unionByName(
        current.select(*columns, F.lit(1).alias("_d"))
    )
    net = sides.groupBy(*columns).agg(F.sum("_d").alias("_net")).where(F.col("_net") != 0)
    change = F.when(F.col("_net") > 0, F.lit("added")).otherwise(F.lit("removed"))
    copies = F.sequence(F.lit(1).cast("bigint"), F.abs("_net"))
    return net.select(change.alias("change"), *columns, F.explode(copies).alias("_copy")).drop(
        "_copy"
    )


def contract_audit(observed: DataFrame, matrix: DataFrame) -> DataFrame:
    """Failures of observed cases against the coverage matrix.

    ``observed(case, exit_code)``; ``matrix(case, expected_exit_code, priority,
    status)``.  The first entry of a repeated case counts; repeats are reported.
    """
    named = matrix.where(F.coalesce(F.col("case") != "", F.lit(False)))
    unnamed = matrix.where(~F.coalesce(F.col("case") != "", F.lit(False))).select(
        F.lit("").alias("case"), F.lit("unnamed_entry").alias("failure_kind")
    )
    entries = named.groupBy("case").agg(
        F.min_by(F.struct("expected_exit_code", "priority", "status"), "position").alias("_m"),
        F.count(F.lit(1)).alias("_n"),
    )
    repeats = entries.where(F.col("_n") > 1).select(
        "case", F.lit("duplicate_case").alias("failure_kind")
    )
    entries = entries.select(
        "case",
        F.col("_m.expected_exit_code").alias("_exit"),
        F.col("_m.priority").alias("_priority"),
        F.col("_m.status").alias("_status"),
        F.lit(True).alias("_listed"),
    )
    verified = F.coalesce(F.col("_status") == "verified", F.lit(False))
    # Equal observations are counted before anything is joined, and written once as
    # two branches read them.
    seen = cut_lineage(
        observed.groupBy("case", F.col("exit_code").alias("_seen")).agg(
            F.count(F.lit(1)).alias("_copies")
        )
    )

    def failure(kind: str, test: Column) -> Column:
        return F.when(test, F.lit(kind))

    listed = F.coalesce("_listed", F.lit(False))
    kinds = F.array_compact(
        F.array(
            failure("missing_from_matrix", ~listed),
            failure("not_verified", listed & ~verified),
            failure("wrong_exit_code", listed & (F.col("_exit") != F.col("_seen"))),
        )
    )
    rows = seen.join(entries, "case", "left").select(
        "case", "_copies", F.explode(kinds).alias("failure_kind")
    )
    rows = rows.select(
        "case", "failure_kind", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("_c")
    ).drop("_c")
    unseen = entries.where(verified).join(seen.select("case").distinct(), "case", "left_anti")
    open_cases = entries.where(
        ~verified & F.coalesce(F.col("_priority") == "required", F.lit(False))
    )
    return (
        rows.unionByName(unseen.select("case", F.lit("verified_unobserved").alias("failure_kind")))
        .unionByName(open_cases.select("case", F.lit("required_uncovered").alias("failure_kind")))
        .unionByName(repeats)
        .unionByName(unnamed)
    )


def block_contract(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Fields of block records that are not as expected, one row per case at fault."""
    e, o = "_e_{}".format, F.col
    wanted = expected.select(
        "case", *[F.col(c).alias(e(c)) for c in ("reason", "path_rule", "redactions_min")]
    )
    rows = observed.join(wanted, "case")

    def fault(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    faults = F.array_compact(
        F.array(
            fault("blocked", o("blocked")),
            fault("reason", o("reason") == o(e("reason"))),
            fault("path_rule", o("path_rule") == o(e("path_rule"))),
            fault("path_rule_not_empty", (o(e("reason")) == "path_blocked") | (o("path_rule") == "")),
            fault("redactions", o("redactions") >= o(e("redactions_min"))),
            fault("exit_code", o("exit_code") == 1),
        )
    )
    return rows.select("case", F.array_join(faults, ",").alias("faults")).where(
        F.col("faults") != ""
    )


def coverage(matrix: DataFrame) -> DataFrame:
    """Whether every required case is verified."""
    gap = F.coalesce(F.col("priority") == "required", F.lit(False)) & ~F.coalesce(
        F.col("status") == "verified", F.lit(False)
    )
    rows = matrix.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(gap).alias("gaps"),
    )
    state = F.when(F.col("gaps") == 0, F.lit("COMPLETE")).otherwise(F.lit("PARTIAL"))
    return rows.withColumn("completeness", state)
