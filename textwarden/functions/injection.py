"""Prompt-injection phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from textwarden import rules as R

# Lower-case substrings, one of which every rule needs.
TRIGGER_WORDS = ("ignore previous", "reveal secret", "print private", "exfiltrate", "curl", "wget")
LONG_S = "\u017f"


def injection_score(text: Column, rules: Sequence[R.Rule] = R.INJECTION_RULES) -> Column:
    """How many distinct rules match, with a cheap test in front for the default list."""
    score = F.lit(0)
    for rule in rules:
        score = score + text.rlike(R.spark_test(rule)).cast("int")
    if tuple(rules) != R.INJECTION_RULES:
        return score
    lowered = F.lower(text)
    possible = F.contains(lowered, F.lit(LONG_S))
    for word in TRIGGER_WORDS:
        possible = possible | F.contains(lowered, F.lit(word))
    return F.when(possible, score).otherwise(F.when(text.isNotNull(), F.lit(0)))
