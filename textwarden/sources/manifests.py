"""Which files of a retained store count: a numbered list, published whole or not at all.

A writer puts its tables into folders of its own, ``<table>/commit=<id>/created_date=.../``, and then
publishes the next list, which names them.  Readers take folders from a list only, so what a writer
that died has left behind is never seen.  Of two writers that start from the same list, one is told so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from textwarden.sources.checkpoints import delete_folder, hadoop_path

STREAM = "struct<byte_len: bigint, line_count: bigint, checksum: string>"
SCHEMAS = {
    "runs": (
        "run_id string, tenant string, command_kind string, schema_version int, created_at bigint, expires_at bigint, "
        f"sanitizer_version string, encoding string, stdout {STREAM}, stderr {STREAM}, record_bytes bigint, bucket int, "
        "commit string, created_date date"
    ),
    "lines": (
        "run_id string, stream string, line_no bigint, byte_offset bigint, byte_len bigint, text string, checksum string, "
        "commit string, created_date date, bucket int"
    ),
    "blocks": (
        "run_id string, stream string, block bigint, line_count bigint, byte_offset bigint, byte_len bigint, "
        "trigrams array<bigint>, commit string, created_date date, bucket int"
    ),
}
TOMBSTONES = "run_id string, status string, recorded_at bigint, expires_at bigint"


class ConcurrentCommit(RuntimeError):
    """Another writer has published in between; nothing of this one is visible."""


@dataclass(frozen=True)
class Part:
    """The runs of one date that one commit wrote."""

    commit: str
    created_date: str
    runs: int
    lines: int


@dataclass(frozen=True)
class Snapshot:
    """One list: its parts, the folder with the tombstones, and how many buckets each date has."""

    root: str
    version: int = 0
    buckets: int = 16
    parts: tuple[Part, ...] = ()
    tombstones: str | None = None

    def table(self, spark: SparkSession, name: str, parts: Sequence[Part] | None = None) -> DataFrame:
        """One of the tables, or only the given parts of it; no other folder is listed or read."""
        chosen = self.parts if parts is None else parts
        used = [p for p in chosen if name == "runs" or p.lines]
        if not used:
            return spark.createDataFrame([], SCHEMAS[name])
        base = f"{self.root}/{name}"
        folders = [f"{base}/commit={p.commit}/created_date={p.created_date}" for p in used]
        return spark.read.schema(SCHEMAS[name]).option("basePath", base).parquet(*folders)

    def tombstone_table(self, spark: SparkSession) -> DataFrame:
        if self.tombstones is None:
            return spark.createDataFrame([], TOMBSTONES)
        return spark.read.schema(TOMBSTONES).parquet(f"{self.root}/tombstones/commit={self.tombstones}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    files, place = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def latest(spark: SparkSession, root: str, buckets: int = 16) -> Snapshot:
    """The newest list, or an empty one for a store that nothing was published to."""
    names = [n for n in names_in(spark, f"{root}/manifests") if n.endswith(".json")]
    if not names:
        return Snapshot(root, buckets=buckets)
    files, place = hadoop_path(spark, f"{root}/manifests/{names[-1]}")
    source = files.open(place)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()
    return Snapshot(root, found["version"], found["buckets"], tuple(Part(**p) for p in found["parts"]), found["tombstones"])


def publish(spark: SparkSession, before: Snapshot, parts: Sequence[Part], tombstones: str | None) -> Snapshot:
    """Make a new list the newest one; fails if the one it was made from no longer is."""
    after = replace(before, version=before.version + 1, parts=tuple(parts), tombstones=tombstones)
    folder = f"{before.root}/manifests"
    text = json.dumps({k: v for k, v in asdict(after).items() if k != "root"})
    files, draft = hadoop_path(spark, f"{folder}/{uuid.uuid4()}.draft")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, place = hadoop_path(spark, f"{folder}/{after.version:012d}.json")
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), options)
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise ConcurrentCommit(f"version {after.version} is taken") from error
        raise
    return after


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete every folder that the newest list does not name; returns how many.

    Call it while no writer is at work: a folder that is not published yet looks like one left behind.
    """
    now = latest(spark, root)
    live = {(p.commit, p.created_date) for p in now.parts}
    gone = 0
    for name in SCHEMAS:
        for commit in names_in(spark, f"{root}/{name}"):
            for date in names_in(spark, f"{root}/{name}/{commit}"):
                if date.startswith("created_date=") and (commit[len("commit="):], date[len("created_date="):]) not in live:
                    gone += delete_folder(spark, f"{root}/{name}/{commit}/{date}")
            if not any(commit == f"commit={c}" for c, _ in live):
                delete_folder(spark, f"{root}/{name}/{commit}")
    for commit in names_in(spark, f"{root}/tombstones"):
        if commit != f"commit={now.tombstones}":
            gone += delete_folder(spark, f"{root}/tombstones/{commit}")
    for name in names_in(spark, f"{root}/manifests"):
        if name != f"{now.version:012d}.json":
            delete_folder(spark, f"{root}/manifests/{name}")
    return gone
