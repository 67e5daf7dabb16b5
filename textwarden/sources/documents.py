"""Loading documents from tables and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textwarden.functions.paths import block_rule
from textwarden.policy import Policy


def lossy_text(content: Column) -> Column:
    """Bytes as text, with bad sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: partitions to deal texts into after the scan; unset, rows stay as scanned.
PARTITIONS = "spark.textwarden.texts.partitions"


def read_texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts.

    Text rules are bound by CPU. A caller who knows that the input is one small file of a
    single row group, which only one task can read, asks for a number of partitions.
    """
    rows = read_table(spark, sf_dir, name).select(*columns)
    asked = spark.conf.get(PARTITIONS, None)
    return rows.repartition(int(asked)) if asked else rows


def read_folder(spark: SparkSession, root: str, policy: Policy | None = None) -> DataFrame:
    """Every file below ``root`` as one row: path, text and raw size.

    With a blocking policy, files under a dangerous path are dropped.  The rule is
    tested on the file and on each folder above it, which is what not descending
    into a blocked folder amounts to.  The test reads file names only, and the
    filter sits below the projection that touches the content.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )
    path = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    files = files.select(path.alias("path"), "content", F.col("length").alias("raw_bytes"))
    if policy is not None and policy.action == "Block":
        files = files.where(blocked_ancestor(F.col("path"), root, policy).isNull())
    return files.select("path", lossy_text(F.col("content")).alias("text"), "raw_bytes", "content")


def blocked_ancestor(path: Column, root: str, policy: Policy) -> Column:
    """Rule of the outermost blocked folder or file between ``root`` and ``path``."""
    base = root.rstrip("/")
    depth = base.count("/") + 1
    parts = F.split(path, "/")
    steps = F.sequence(F.lit(depth + 1), F.greatest(F.size(parts), F.lit(depth + 1)))
    rules = F.transform(
        steps, lambda n: block_rule(F.array_join(F.slice(parts, F.lit(1), n), "/"), policy)
    )
    return F.get(F.filter(rules, lambda r: r.isNotNull()), 0)
