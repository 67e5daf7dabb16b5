"""What several operators share: word splitting, fences between projections, files in shared storage."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.sources.checkpoints import shared_dir

#: The six ASCII white-space characters between words.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def without_space(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row.

    The one-row generator keeps Catalyst from copying the expression into lambdas
    that refer to it, where it would be computed once for each element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under the names c0, c1, …, which an operator's own columns cannot clash with; and these names by column."""
    names = {column: f"c{i}" for i, column in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def handed_back(out: DataFrame, names: dict[str, str], added: Sequence[str], changed: dict[str, str] | None = None) -> DataFrame:
    """The input's columns under their names, then the added ones, which take the place of input columns of their name.

    `changed` gives, for a column of the input, the column that holds its new value.
    """
    taken = {name.lower() for name in added}
    places = names | (changed or {})
    return out.select(*[F.col(at).alias(c) for c, at in places.items() if c.lower() not in taken], *added)


#: Functions that keep a model and its table in a Python worker from task to task.
_KEPT = {
    "textwarden.llm.toxicity": "_decoder", "textwarden.llm.tokenize_pieces": "coder",
    "textwarden.llm.token_files": "coder", "textwarden.llm.byte_bpe": "coder",
}


def forget_tables(keep: str | None = None) -> None:
    """Drop what operators of other modules than `keep` hold in the worker, which Spark reuses: it would only take room."""
    for module, name in _KEPT.items():
        if module != keep and module in sys.modules:
            getattr(sys.modules[module], name).cache_clear()
    if "pyarrow" in sys.modules:
        sys.modules["pyarrow"].default_memory_pool().release_unused()


#: Settings of the Bloom filters of joins. Spark takes them for scans above 10 GB and keys of at most 10 MB, and sizes them for
#: a million keys. Here they serve scans of any size; 4 MB of filter let 2 % of the others through at four million keys.
_FILTERS = {
    "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g", "expectedNumItems": "4000000", "numBits": str(1 << 25),
}


@contextmanager
def runtime_filter(spark: SparkSession, *, always: bool = False) -> Iterator[None]:
    """Let joins filter their larger side by a Bloom filter of the smaller one before it is shuffled.

    The smaller side needs a condition of its own. Filters have a fixed size. With `always`, a smaller side
    that could be broadcast is filtered and shuffled all the same, so that small inputs are handled as large ones.
    """
    settings = {f"spark.sql.optimizer.runtime.bloomFilter.{name}": value for name, value in _FILTERS.items()}
    if always:
        settings["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    with _set(spark, settings):
        yield


#: Rows that a Python worker gets at a time. Spark would send it 10,000 texts, which executor and worker hold several times over.
BATCH = 512


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Let the Python steps of what is written or collected within get BATCH rows at a time."""
    with _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        yield


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, for files that tasks write."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4()}"


def file_system(path: str):
    """The file system and the path on it; for use in tasks and on the driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, parts: Iterable[bytes]) -> None:
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        for part in parts:
            out.write(part)


def read_file(path: str) -> bytes:
    system, place = file_system(path)
    with system.open_input_stream(place) as source:
        return source.read()
