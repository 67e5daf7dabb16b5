"""One decision per document or captured run."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.functions.injection import injection_score
from textwarden.functions.paths import (
    block_rule,
    first_blocked_argument,
    inside_workspace,
    path_rule,
)
from textwarden.functions.redaction import count_redactions, redact, with_redaction
from textwarden.functions.shaping import (
    block_record,
    normalize_newlines,
    reduction,
    truncate_middle,
    wrap_untrusted,
)
from textwarden.policy import Policy
from textwarden.sources.captures import streams

WORKSPACE_RULE = "workspace_boundary"


def turned_away(path: Column, policy: Policy) -> Column:
    """The path rule, or the workspace's, that keeps a document from being read; else null."""
    rule = block_rule(path, policy)
    if policy.workspace_root is not None:
        outside = F.when(~inside_workspace(path, policy.workspace_root), F.lit(WORKSPACE_RULE))
        rule = F.coalesce(rule, outside)
    return rule


def _common_prefixes(policies: list[Policy]) -> tuple[str, ...]:
    if len({p.path_prefixes for p in policies}) > 1:
        raise ValueError("policies of one pass must name the same path prefixes")
    return policies[0].path_prefixes


def gate_documents(
    df: DataFrame, policy: Policy = Policy(), path: str = "path", text: str = "text"
) -> DataFrame:
    """Decide per document, in the order path, workspace, secret, injection.

    A single narrow stage.  Rows turned away by path carry a null text from then
    on, so nothing is scanned for them.  ``content`` is what may be passed on: the
    bounded and wrapped text, or the wrapped block record.
    """
    return _gate(df, [policy], lambda value: value(policy), path, text)


def gate_by_policy(
    df: DataFrame,
    policies: Mapping[str, Policy],
    key: str,
    default: Policy = Policy(),
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """As :func:`gate_documents`, each row under the policy that its ``key`` column names.

    Keys that are null or name no policy fall to ``default``.  All rows share one scan
    for secrets and phrases; only paths, actions and limits are told apart by key, so
    the plan grows with the policies that differ, not with those who hold them.
    """

    def choose(value: Callable[[Policy], Column]) -> Column:
        chosen = value(default)
        for name, policy in policies.items():
            chosen = F.when(F.col(key) == name, value(policy)).otherwise(chosen)
        return chosen

    return _gate(df, [default, *policies.values()], choose, path, text)


def decide_documents(
    df: DataFrame, policies: Mapping[str, Policy], path: str = "path", text: str = "text"
) -> DataFrame:
    """The rows with the reason that each policy gives, under the policy's name: one scoring, several decisions.

    A text is scanned unless every policy turns its path away.
    """
    prefixes = _common_prefixes(list(policies.values()))
    rules = {f"_rule_{i}": turned_away(F.col(path), p) for i, p in enumerate(policies.values())}
    staged = df.withColumns(rules)
    unread = F.lit(True)
    for name in rules:
        unread = unread & F.col(name).isNotNull()
    staged = staged.withColumn("_open", F.when(~unread, F.col(text)))
    staged = with_redaction(staged, "_open", "_red", "_secret", prefixes)
    staged = staged.withColumn("_score", injection_score(F.col("_red")))
    reasons = []
    for name, rule, policy in zip(policies, rules, policies.values()):
        reason = F.when(F.col(rule).isNotNull(), F.lit("path_blocked")).when(F.col("_secret"), F.lit("secret_detected"))
        if policy.prompt_injection_action == "Block":
            reason = reason.when(F.col("_score") > 0, F.lit("prompt_injection_detected"))
        reasons.append(reason.otherwise(F.lit("")).alias(name))
    return staged.select(*df.columns, *reasons)


def _gate(
    df: DataFrame, policies: list[Policy], choose: Callable[[Callable[[Policy], Column]], Column], path: str, text: str
) -> DataFrame:
    """The gate; ``choose`` gives a row's value of what differs between policies."""
    kept = list(df.columns)
    prefixes = _common_prefixes(policies)
    limit = choose(lambda p: F.lit(p.max_chars))
    staged = df.withColumn("_rule", choose(lambda p: turned_away(F.col(path), p)))
    staged = staged.withColumn("_open", F.when(F.col("_rule").isNull(), F.col(text)))
    staged = with_redaction(staged, "_open", "_red", "_secret", prefixes)
    staged = staged.withColumn("_score", injection_score(F.col("_red")))
    reason = F.when(F.col("_rule").isNotNull(), F.lit("path_blocked")).when(
        F.col("_secret"), F.lit("secret_detected")
    )
    strict = choose(lambda p: F.lit(p.prompt_injection_action == "Block"))
    reason = reason.when(strict & (F.col("_score") > 0), F.lit("prompt_injection_detected"))
    staged = staged.withColumn("reason", reason.otherwise(F.lit("")))

    # Allowed texts that are cut, or redacted before the cut, are filtered again.
    source = F.col("_open")
    again = F.length(source) > limit
    if any(p.action == "Redact" for p in policies):
        listed = choose(
            lambda p: path_rule(F.col(path), p.blocked_patterns).isNotNull() if p.action == "Redact" else F.lit(False)
        )
        staged = staged.withColumn("_listed", listed)
        source = F.when(F.col("_listed"), F.col("_red")).otherwise(source)
        again = again | F.col("_listed")
    allowed = F.col("reason") == ""
    staged = staged.withColumn("_shape", F.when(allowed & again, source))
    staged = staged.withColumn("_cut", truncate_middle(F.col("_shape"), limit))
    staged = with_redaction(staged, "_cut", "_cut_red", prefixes=prefixes)
    reshaped = F.col("_cut").isNotNull()
    redactions = F.when(reshaped, count_redactions(F.col("_cut"), F.col("_cut_red"))).otherwise(
        F.coalesce(count_redactions(F.col("_open"), F.col("_red")), F.lit(0).cast("bigint"))
    )
    warnings = F.when(reshaped, injection_score(F.col("_cut_red"))).otherwise(
        F.coalesce(F.col("_score"), F.lit(0))
    )
    staged = staged.withColumns(
        {
            "blocked": ~allowed,
            "path_rule": F.coalesce(F.col("_rule"), F.lit("")),
            "redactions": redactions,
            "warnings": warnings,
            "exit_code": F.when(allowed, F.lit(0)).otherwise(F.lit(1)),
            "truncated": allowed & F.coalesce(F.length("_shape") > limit, F.lit(False)),
        }
    )
    record = redact(block_record(F.col("reason"), F.col("path_rule"), F.col("redactions")))
    shown = F.when(F.col("blocked"), record).otherwise(F.coalesce("_cut_red", "_red"))
    staged = staged.withColumn("content", wrap_untrusted(shown))
    staged = staged.withColumns(
        {
            "raw_bytes": F.octet_length(text).cast("bigint"),
            "returned_bytes": F.octet_length("content").cast("bigint"),
        }
    )
    return staged.select(
        *kept, "blocked", "reason", "path_rule", "redactions", "warnings", "exit_code",
        "truncated", "content", "raw_bytes", "returned_bytes",
        reduction(F.col("raw_bytes"), F.col("returned_bytes")).alias("reduction"),
    )


def with_stored_text(
    df: DataFrame, text: str, stored: str = "stored", policy: Policy = Policy()
) -> DataFrame:
    """The form kept for retrieval: one kind of line end, redacted, never cut."""
    staged = df.withColumn("_lf", normalize_newlines(F.col(text)))
    return with_redaction(staged, "_lf", stored, prefixes=policy.path_prefixes).drop("_lf")


def gate_streams(captures: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Sanitised text and counts per run and stream.

    Runs whose arguments hit a path rule are marked and pass no text.  Content is
    never a reason to block here; injection phrases are only counted.
    """
    kept = [c for c in captures.columns if c not in ("stdout", "stderr", "run_id")]
    rows = captures.withColumn("_rule", first_blocked_argument(F.col("argv"), policy))
    rows = streams(rows, *kept, "_rule")
    rows = rows.withColumn("_open", F.when(F.col("_rule").isNull(), F.col("text")))
    rows = with_redaction(rows, "_open", "redacted", prefixes=policy.path_prefixes)
    # What is shown is filtered once more after the cut.  A text that was neither
    # changed nor cut would come out as it is, so it is left alone.
    again = (F.col("redacted") != F.col("_open")) | (F.length("redacted") > policy.max_chars)
    cut = truncate_middle(F.col("redacted"), policy.max_chars)
    rows = rows.withColumn("_cut", F.when(again, cut))
    rows = with_redaction(rows, "_cut", "_cut_red", prefixes=policy.path_prefixes)
    rows = rows.withColumn("shown", F.coalesce("_cut_red", "redacted"))
    output = F.when(F.col("stream") == "stdout", wrap_untrusted(F.col("shown"))).otherwise(
        F.col("shown")
    )
    rows = rows.withColumn("output", output)
    zero = F.lit(0).cast("bigint")
    redactions = count_redactions(F.col("_open"), F.col("redacted")) + F.coalesce(
        count_redactions(F.col("_cut"), F.col("_cut_red")), zero
    )
    return rows.select(
        "run_id", *kept, "stream",
        F.col("_rule").isNotNull().alias("blocked"),
        F.coalesce("_rule", F.lit("")).alias("path_rule"),
        "text", "redacted", "output",
        F.coalesce(redactions, zero).alias("redactions"),
        F.coalesce(injection_score(F.col("redacted")), F.lit(0)).alias("warnings"),
        F.coalesce(F.octet_length("_open").cast("bigint"), zero).alias("raw_bytes"),
        F.coalesce(F.octet_length("output").cast("bigint"), zero).alias("returned_bytes"),
        F.coalesce(F.length("redacted") > policy.max_chars, F.lit(False)).alias("truncated"),
    )
