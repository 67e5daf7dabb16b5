"""Captured command output: two text streams per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def streams(captures: DataFrame, *keep: str, stdout="stdout", stderr="stderr") -> DataFrame:
    """One row per run and stream; empty streams stay."""
    both = F.array(
        F.struct(F.lit("stdout").alias("stream"), F.col(stdout).alias("text")),
        F.struct(F.lit("stderr").alias("stream"), F.col(stderr).alias("text")),
    )
    return captures.select("run_id", *keep, F.inline(both))


def is_run_id(value: Column) -> Column:
    return value.rlike(
        "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    )
