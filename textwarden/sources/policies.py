"""Policies and retention settings held in tables, one row per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.policy import DAY, MAX_TTL, Policy, StoragePolicy
from textwarden.sources.checkpoints import cut_lineage

CONFIG_SCHEMA = (
    "blocked_patterns array<string>, action string, prompt_injection_action string, "
    "timeout_seconds bigint, max_chars bigint, _bad string"
)


def resolve_policies(df: DataFrame, config: str = "config") -> DataFrame:
    """Parse each row's JSON; missing keys, or an unusable text, mean defaults."""
    defaults = Policy()
    parsed = F.from_json(
        F.col(config), CONFIG_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    staged = df.withColumn("_p", parsed)
    usable = (
        F.col("_p._bad").isNull()
        & F.coalesce(F.col("_p.action").isin("Block", "Redact", "Allow"), F.lit(True))
        & F.coalesce(F.col("_p.prompt_injection_action").isin("Warn", "Block"), F.lit(True))
        & F.coalesce(F.col("_p.timeout_seconds") >= 0, F.lit(True))
        & F.coalesce(F.col("_p.max_chars") >= 0, F.lit(True))
    )

    def value(name: str, default: Column) -> Column:
        return F.coalesce(F.when(usable, F.col(f"_p.{name}")), default).alias(name)

    patterns = F.array(*[F.lit(p) for p in defaults.blocked_patterns])
    return staged.select(
        *df.columns,
        value("blocked_patterns", patterns),
        value("action", F.lit(defaults.action)),
        value("prompt_injection_action", F.lit(defaults.prompt_injection_action)),
        value("timeout_seconds", F.lit(defaults.timeout_seconds).cast("bigint")),
        value("max_chars", F.lit(defaults.max_chars).cast("bigint")),
    )


#: Policies that differ, of one table, that one plan may tell apart.
MAX_POLICIES = 500


def policy_set(df: DataFrame, config: str = "config", at_most: int = MAX_POLICIES) -> tuple[DataFrame, dict[str, Policy]]:
    """The rows with ``policy_key`` instead of their JSON, and the policy of each key.

    Rows whose settings come out alike share a key, so there are as many policies as differ,
    however many rows.  The rows are written once, so that their size is known to joins on them.
    More than ``at_most`` policies are an error; none is left out.
    """
    fields = ("blocked_patterns", "action", "prompt_injection_action", "timeout_seconds", "max_chars")
    resolved = resolve_policies(df, config).withColumn("policy_key", F.sha2(F.to_json(F.struct(*fields)), 256))
    keyed = cut_lineage(resolved.drop(config))
    rows = keyed.select("policy_key", *fields).distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} policies that differ")
    policies = {
        r["policy_key"]: Policy(
            tuple(r["blocked_patterns"]), r["action"], r["prompt_injection_action"], r["timeout_seconds"],
            min(r["max_chars"], 2**31 - 1),
        )
        for r in rows
    }
    return keyed.drop(*fields), policies


def bounded_ttl(setting: Column) -> Column:
    """Whole seconds between one second and seven days, else the default of a day."""
    seconds = F.when(setting.rlike(r"^[+-]?[0-9]{1,18}$"), setting.try_cast("bigint"))
    return F.when(seconds.between(1, MAX_TTL), seconds).otherwise(F.lit(DAY)).cast("bigint")


def resolve_retention(df: DataFrame, ttl: str, tombstone_ttl: str) -> DataFrame:
    limits = StoragePolicy()
    return df.select(
        *[c for c in df.columns if c not in (ttl, tombstone_ttl)],
        bounded_ttl(F.col(ttl)).alias("ttl_seconds"),
        bounded_ttl(F.col(tombstone_ttl)).alias("tombstone_ttl_seconds"),
        F.lit(limits.max_stream_bytes).cast("bigint").alias("max_stream_bytes"),
        F.lit(limits.max_total_bytes).cast("bigint").alias("max_total_bytes"),
        F.lit(limits.max_records).cast("bigint").alias("max_records"),
    )
