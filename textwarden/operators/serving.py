"""Lookups in a published store: retrieval by the folders of the wanted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from textwarden.operators.store import retrieve
from textwarden.policy import Policy
from textwarden.sources.manifests import Snapshot

FOLDERS = ("commit", "created_date", "bucket")


def retrieve_store(
    spark: SparkSession, snapshot: Snapshot, requests: DataFrame, now: str | Column, policy: Policy = Policy()
) -> DataFrame:
    """As :func:`textwarden.operators.store.retrieve`, over one snapshot.

    A request for few lines reads the headers and the date and bucket folders of its runs, in which lines lie
    sorted by run, stream and number.
    """
    return retrieve(
        requests, snapshot.table(spark, "runs"), snapshot.tombstone_table(spark), snapshot.table(spark, "lines"), now, policy, FOLDERS
    )
