"""What the rules find, in long form, and checks that nothing is left."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textwarden import rules as R
from textwarden.functions.redaction import TRIGGERS, in_reach, trigger, with_redaction


def secret_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and rule that hits, counted on the raw text.

    Rules overlap: a quoted value, say, is also seen by the rule for bare values.
    Rules are only counted where their trigger occurs.
    """
    kept = [c for c in df.columns if c != text]
    source = F.col(text)
    staged = df.withColumn("_low", F.lower(source))
    staged = staged.select(
        *kept, source,
        *[trigger(F.col("_low"), group).alias(f"_t_{group}") for group in TRIGGERS],
    )
    counted = []
    for group, (_, names) in TRIGGERS.items():
        for name in names:
            rule = R.rule_named(R.REPLACE_RULES, name)
            hits = F.when(
                F.col(f"_t_{group}"), F.regexp_count(in_reach(source, rule), F.lit(R.spark_pattern(rule)))
            ).otherwise(F.lit(0))
            counted.append(F.struct(F.lit(name).alias("rule"), hits.cast("bigint").alias("hits")))
    rows = staged.select(*kept, F.inline(F.array(*counted)))
    return rows.where(F.col("hits") > 0)


def redact_pages(df: DataFrame, html: str = "html", redacted: str = "redacted") -> DataFrame:
    """Redaction of HTML, with the five common entities resolved first."""
    text = F.col(html)
    # The ampersand goes last, so that no entity is resolved twice.
    for entity, char in (
        ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return with_redaction(df.withColumn("_plain", text), "_plain", redacted).drop("_plain")


def leaks(df: DataFrame, text: str, values: Sequence[str]) -> DataFrame:
    """Pairs of row and known value still present, as ``leaked``.

    The list is a plan-time parameter and is searched inside each row, in one pass over
    the table and without a join.
    """
    kept = [c for c in df.columns if c != text]
    distinct = list(dict.fromkeys(values))
    # One literal, split when the plan is made, whatever the length of the list.
    listed = F.from_json(F.lit(json.dumps(distinct)), "array<string>")
    found = F.filter(listed, lambda v: F.contains(F.col(text), v))
    return df.select(*kept, F.explode(found).alias("leaked"))


def leak_counts(df: DataFrame, text: str, values: Sequence[str]) -> DataFrame:
    """Rows per known value, zero included."""
    spark = df.sparkSession
    found = leaks(df.select(text), text, values).groupBy("leaked").agg(
        F.count(F.lit(1)).alias("leaked_rows")
    )
    listed = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "value string")
    return listed.join(found, F.col("value") == F.col("leaked"), "left").select(
        "value", F.coalesce("leaked_rows", F.lit(0).cast("bigint")).alias("leaked_rows")
    )

