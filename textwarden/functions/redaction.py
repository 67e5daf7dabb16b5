"""Secret detection and redaction as native column expressions.

Two forms are offered.  :func:`redact`, :func:`has_secret` are plain columns for
short values (map entries, commands, reports).  For text tables use
:func:`with_redaction`, which stages the work over a few projections so that
every expensive step runs once per row and only on rows that need it.

The staging rests on one fact.  A replacement inserts ``[MARKER]`` and no rule's
literal trigger contains a bracket, so a trigger found after any number of
replacements either stood in the original text or is the word SECRET inside a
marker, where the preceding underscore keeps it from being a key.  A rule whose
trigger is missing from the original text therefore cannot fire later, and the
triggers can be looked up once with plain substring searches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from textwarden import rules as R
from textwarden.functions.encoded import GUARD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Runs always match whole, so a run can only start where the last one ended.
BASE64 = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{12,}+={0,2}+"

# What must stand in a text, in lower case, before a group of rules is tried: one
# word of each set.
KEY_WORDS = ("password", "secret", "token", "apikey", "api-key", "api_key")
BLOCK_SIGNS = ("|", ">")
TRIGGERS: dict[str, tuple[tuple[tuple[str, ...], ...], tuple[str, ...]]] = {
    "block": ((KEY_WORDS, BLOCK_SIGNS, ("\n",)), ("yaml_block",)),
    "escaped": ((KEY_WORDS, BLOCK_SIGNS, ("\\",)), ("escaped_yaml_block",)),
    "quoted": ((KEY_WORDS, ('"', "'")), ("quoted_value",)),
    "key": ((KEY_WORDS,), ("bare_value",)),
    "bearer": ((("authorization",),), ("bearer_header",)),
    "url": ((("://",),), ("url_password",)),
    "aws": ((("akia",),), ("aws_key_id",)),
    "pem": ((("private key-----",),), ("pem_block", "pem_header")),
    "home": ((("/users/", "/home/"),), ("unix_home",)),
    "winhome": (((":\\users\\",),), ("windows_home",)),
}
DETECTED_BY = {
    "key": "key_value",
    "bearer": "bearer",
    "url": "url_credentials",
    "aws": "aws_key",
    "pem": "pem",
}
# U+017F is the one letter that folds into ASCII but is left alone by lower().
LONG_S = "\u017f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def _either(columns: Sequence[Column]) -> Column:
    result = columns[0]
    for column in columns[1:]:
        result = result | column
    return result


def _all(columns: Sequence[Column]) -> Column:
    result = columns[0]
    for column in columns[1:]:
        result = result & column
    return result


def trigger(lowered: Column, group: str) -> Column:
    """Whether the rules of ``group`` can match at all."""
    sets = [
        _either([F.contains(lowered, F.lit(w)) for w in words]) for words in TRIGGERS[group][0]
    ]
    return _all(sets) | F.contains(lowered, F.lit(LONG_S))


def in_reach(text: Column, rule: R.Rule) -> Column:
    """The part of a text that the rule can match in: up to the last of what its matches end with."""
    return F.regexp_extract(text, R.spark_reach(rule), 0) if rule.last else text


def apply_rule(text: Column, rule: R.Rule) -> Column:
    def replaced(part: Column) -> Column:
        return F.regexp_replace(part, R.spark_pattern(rule), R.spark_replacement(rule))

    if not rule.last:
        return replaced(text)
    parts = let(text, lambda t: F.struct(t.alias("all"), in_reach(t, rule).alias("reach")))
    return let(parts, lambda p: F.concat(replaced(p["reach"]), F.substr(p["all"], F.length(p["reach"]) + 1)))


def apply_rules(text: Column, names: Sequence[str]) -> Column:
    for name in names:
        text = apply_rule(text, R.rule_named(R.REPLACE_RULES, name))
    return text


def usable_prefixes(prefixes: Sequence[str]) -> list[str]:
    return [p for p in prefixes if p not in ("", "/")]


def redact_prefixes(text: Column, prefixes: Sequence[str]) -> Column:
    for prefix in usable_prefixes(prefixes):
        text = F.replace(text, F.lit(prefix), F.lit(R.PATH_MARKER))
    return text


# ------------------------------------------------------------------ Base64


def _decoded_is_secret(decoded: Column) -> Column:
    lowered = F.translate(decoded, UPPER, LOWER)
    words = F.contains(lowered, F.lit("secret")) & (
        F.contains(lowered, F.lit("pass")) | F.contains(lowered, F.lit("token"))
    )
    return words | decoded.rlike(R.spark_any(R.DETECT_RULES))


def blob_is_secret(blob: Column) -> Column:
    """Whether one Base64 candidate decodes to text that holds a secret."""
    decoded = F.when(F.octet_length(blob) % 4 == 0, F.unbase64(blob).cast("string"))
    return let(
        decoded,
        lambda d: F.when(F.is_valid_utf8(d), _decoded_is_secret(d)).otherwise(F.lit(False)),
    )


def may_hold_encoded(text: Column) -> Column:
    """Whether any blob of the text can hold a secret, told without cutting it up."""
    return text.rlike(GUARD)


def has_encoded_secret(text: Column) -> Column:
    blobs = F.regexp_extract_all(text, F.lit(BASE64), F.lit(0))
    none = F.when(text.isNotNull(), F.lit(False))
    return F.when(may_hold_encoded(text), F.exists(blobs, blob_is_secret)).otherwise(none)


def redact_encoded(text: Column) -> Column:
    """Replace, in place, the Base64 blobs that hold a secret."""
    return F.when(may_hold_encoded(text), splice_encoded(text)).otherwise(text)


def splice_encoded(text: Column) -> Column:
    between = F.split(text, BASE64, -1)
    blobs = F.regexp_extract_all(text, F.lit(BASE64), F.lit(0))
    kept = F.transform(
        blobs, lambda b: F.when(blob_is_secret(b), F.lit(R.SECRET_MARKER)).otherwise(b)
    )
    pieces = F.zip_with(between, kept, lambda s, b: F.concat(s, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


# ------------------------------------------------------------------ columns


def has_plain_secret(text: Column) -> Column:
    """Detection without the Base64 step."""
    lowered = F.lower(text)
    return _either(
        [
            F.when(
                trigger(lowered, group),
                text.rlike(R.spark_test(R.rule_named(R.DETECT_RULES, name))),
            ).otherwise(F.when(text.isNotNull(), F.lit(False)))
            for group, name in DETECTED_BY.items()
        ]
    )


def has_secret(text: Column) -> Column:
    return F.when(has_plain_secret(text), F.lit(True)).otherwise(has_encoded_secret(text))


def redact(text: Column, prefixes: Sequence[str] = ()) -> Column:
    lowered = F.lower(text)
    possible = _either([trigger(lowered, group) for group in TRIGGERS])
    every_rule = [rule.name for rule in R.REPLACE_RULES]
    chained = F.when(possible, apply_rules(text, every_rule)).otherwise(text)
    return let(redact_prefixes(chained, prefixes), redact_encoded)


def marker_count(text: Column) -> Column:
    """Markers in a text, from its length before and after dropping them."""

    def occurrences(marker: str) -> Column:
        removed = F.replace(text, F.lit(marker), F.lit(""))
        return (F.octet_length(text) - F.octet_length(removed)) / len(marker)

    return (occurrences(R.SECRET_MARKER) + occurrences(R.PATH_MARKER)).cast("bigint")


def count_redactions(before: Column, after: Column) -> Column:
    return F.when(
        before == after, F.when(before.isNotNull(), F.lit(0).cast("bigint"))
    ).otherwise(F.greatest(F.lit(0).cast("bigint"), marker_count(after) - marker_count(before)))


# ------------------------------------------------------------------ tables


def fenced(df: DataFrame, kept: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """Project ``columns`` so that later filters on them stay above the projection.

    Catalyst moves a filter below a plain projection by repeating the projected
    expression, which would redact twice.  It does not do so for a generator.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))


def with_redaction(
    df: DataFrame,
    text: str,
    redacted: str = "redacted",
    secret: str | None = None,
    prefixes: Sequence[str] = (),
) -> DataFrame:
    """Add the redacted form of ``text`` and, on request, a secret flag.

    Null texts are passed over at no cost, which is how callers keep rows that
    were turned away earlier (by path, say) from being scanned.
    """
    kept = list(df.columns)
    app = df.sparkSession.sparkContext.applicationId
    plan = _stages(app, text, redacted, secret, tuple(usable_prefixes(prefixes)))
    flags = [f"_t_{group}" for group in TRIGGERS]
    staged = df.select(*kept, plan["lowered"]).select(*kept, *plan["triggers"])
    for step in plan["steps"]:
        staged = staged.select(*kept, *flags, step)
    staged = staged.withColumn("_encoded", plan["encoded"])
    return fenced(staged, kept, plan["results"])


@lru_cache(maxsize=256)
def _stages(
    app: str, text: str, redacted: str, secret: str | None, prefixes: tuple[str, ...]
) -> dict:
    """The columns of :func:`with_redaction`, which name their inputs and so can be
    used again; ``app`` keeps them to one JVM."""
    source = current = F.col(text)
    steps = []
    for group, (_, names) in TRIGGERS.items():
        step = F.when(F.col(f"_t_{group}"), apply_rules(current, names)).otherwise(current)
        steps.append(step.alias(f"_s_{group}"))
        current = F.col(f"_s_{group}")
    if prefixes:
        steps.append(redact_prefixes(current, prefixes).alias("_s_prefix"))
        current = F.col("_s_prefix")
    # One Base64 pass over the original serves both the flag and the decision
    # whether the rewritten text needs a pass of its own.
    splice = F.col("_encoded") | (current != source)
    results = [F.when(splice, redact_encoded(current)).otherwise(current).alias(redacted)]
    if secret:
        plain = _either(
            [
                F.when(
                    F.col(f"_t_{group}"),
                    source.rlike(R.spark_test(R.rule_named(R.DETECT_RULES, name))),
                ).otherwise(F.lit(False))
                for group, name in DETECTED_BY.items()
            ]
        )
        results.append(F.when(source.isNotNull(), F.col("_encoded") | plain).alias(secret))
    lowered = F.col("_low")
    return {
        "lowered": F.lower(source).alias("_low"),
        "triggers": [trigger(lowered, group).alias(f"_t_{group}") for group in TRIGGERS],
        "steps": steps,
        "encoded": has_encoded_secret(source),
        "results": results,
    }


def with_secret_flag(df: DataFrame, text: str, flag: str = "has_secret") -> DataFrame:
    """Add only the secret flag; the Base64 pass is skipped on plain hits."""
    kept = list(df.columns)
    staged = df.withColumn("_plain", has_plain_secret(F.col(text)))
    found = F.when(F.col("_plain"), F.lit(True)).otherwise(has_encoded_secret(F.col(text)))
    return fenced(staged, kept, [found.alias(flag)])
