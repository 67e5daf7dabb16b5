"""Statistics per run, per corpus search and over many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from textwarden.functions.redaction import count_redactions, has_secret, let, redact
from textwarden.functions.shaping import reduction, report_text

STATS = (
    "run_id", "command", "exit_code", "raw_bytes", "returned_bytes", "reduction",
    "redactions", "prompt_injection_warnings", "truncated", "timeout", "timestamp",
)


def run_stats(streams: DataFrame, *keep: str, env: str | None = None) -> DataFrame:
    """Totals over the two gated streams of each run; blocked runs have none.

    ``keep`` names columns that are equal on both rows of a run; ``env`` a map whose
    redacted values count once a run, or their number, if it was counted before the run was split.
    """
    cleaned = F.lit(0).cast("bigint") if env is None else F.col(env)
    if env is not None and isinstance(streams.schema[env].dataType, MapType):
        cleaned = map_redactions(cleaned)
    rows = streams.where(~F.col("blocked")).withColumn("_env", cleaned)
    totals = rows.groupBy("run_id", *keep).agg(
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("returned_bytes").alias("returned_bytes"),
        (F.sum("redactions") + F.max("_env")).alias("redactions"),
        F.sum("warnings").cast("int").alias("prompt_injection_warnings"),
        F.bool_or("truncated").alias("truncated"),
    )
    return totals.withColumn("reduction", reduction(F.col("raw_bytes"), F.col("returned_bytes")))


def grep_stats(hits: DataFrame, *by: str) -> DataFrame:
    """Totals per query: hit count, redactions, size of the joined hits."""
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum("redactions").alias("redactions"),
        (F.sum(F.octet_length("hit").cast("bigint")) + F.count(F.lit(1)) - 1).alias("raw_bytes"),
    )


def report(decisions: DataFrame, *by: str) -> DataFrame:
    """Decisions and sizes per group; the saving is taken from the sums."""
    totals = decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("returned_bytes").alias("returned_bytes"),
        F.sum("redactions").alias("redactions"),
    )
    return totals.withColumn("reduction", reduction(F.col("raw_bytes"), F.col("returned_bytes")))


def latest_run(stats: DataFrame, committed_at: str, *by: str) -> DataFrame:
    """The run committed last, per group or overall: one partial maximum per task."""
    columns = [c for c in stats.columns if c not in by]
    best = F.max_by(F.struct(*columns), F.struct(committed_at, "run_id")).alias("_b")
    return stats.groupBy(*by).agg(best).select(*by, "_b.*")


def sanitized_report(stats: DataFrame, heading: bool = False) -> Column:
    """The readable report, redacted once more as a whole."""
    return redact(report_text({c: F.col(c) for c in stats.columns}, heading))


def stats_json(stats: DataFrame) -> DataFrame:
    """Rows as JSON: the command is redacted, then the whole text."""
    cleaned = stats.withColumn("command", redact(F.col("command")))
    present = [c for c in STATS if c in stats.columns]
    # Keys and values of absent options stay in the text, as null.
    json = F.to_json(F.struct(*present), {"ignoreNullFields": "false"})
    return cleaned.select("run_id", redact(json).alias("stats_json"))


def redact_map(pairs: Column) -> Column:
    """Clean the values of a key/value map, each tested as ``key=value``.

    Only flagged pairs change.  Where the rules reach into the key, the value is
    dropped.
    """
    def clean(key: Column, value: Column) -> Column:
        pair, prefix = F.concat(key, F.lit("="), value), F.concat(key, F.lit("="))
        kept = let(
            redact(pair),
            lambda r: F.when(
                F.startswith(r, prefix), F.substr(r, F.length(prefix) + 1)
            ),
        )
        return F.when(has_secret(pair), kept).otherwise(value)

    return F.transform_values(pairs, clean)


def map_redactions(pairs: Column) -> Column:
    """Markers added by cleaning a map."""
    def count(entry: Column) -> Column:
        pair = F.concat(entry["key"], F.lit("="), entry["value"])
        # The count names the redacted form several times, which is made once.
        count = let(redact(pair), lambda r: count_redactions(pair, r))
        return F.when(has_secret(pair), count).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(
        F.transform(F.map_entries(pairs), count), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
