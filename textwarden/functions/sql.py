"""The rules as temporary SQL functions; Catalyst inlines them into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textwarden import rules as R
from textwarden.functions.encoded import GUARD
from textwarden.functions.redaction import BASE64, LOWER, UPPER
from textwarden.functions.shaping import ENVELOPE_HEAD, ENVELOPE_TAIL


def register_functions(spark: SparkSession) -> None:
    """``redact``, ``has_secret``, ``injection_score``, ``truncate_middle``, ``wrap_untrusted``."""
    raw = str(spark.conf.get("spark.sql.parser.escapedStringLiterals")).lower() == "true"

    def lit(text: str) -> str:
        if raw:
            # Backslashes stand for themselves, so quotes are joined in.
            return "concat(" + ", chr(39), ".join(f"'{part}'" for part in text.split("'")) + ")"
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def define(name: str, arguments: str, kind: str, body: str) -> None:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}"
        )

    detect = lit(R.spark_any(R.DETECT_RULES))
    lowered = f"translate(d, {lit(UPPER)}, {lit(LOWER)})"
    words = (
        f"contains({lowered}, 'secret') AND (contains({lowered}, 'pass') OR contains({lowered}, 'token'))"
    )
    decoded = "CASE WHEN octet_length(b) % 4 = 0 THEN CAST(unbase64(b) AS STRING) END"
    blob = (
        f"transform(array({decoded}), d -> CASE WHEN is_valid_utf8(d) "
        f"THEN ({words}) OR rlike(d, {detect}) ELSE false END)[0]"
    )
    blobs = f"regexp_extract_all(x, {lit(BASE64)}, 0)"
    define(
        "has_secret", "x STRING", "BOOLEAN",
        f"CASE WHEN rlike(x, {detect}) THEN true WHEN rlike(x, {lit(GUARD)}) THEN exists({blobs}, b -> {blob}) "
        "WHEN x IS NOT NULL THEN false END",
    )
    chain = "t"
    for rule in R.REPLACE_RULES:
        old, new = lit(R.spark_pattern(rule)), lit(R.spark_replacement(rule))
        if not rule.last:
            chain = f"regexp_replace({chain}, {old}, {new})"
            continue
        parts = f"transform(array({chain}), w -> struct(w, regexp_extract(w, {lit(R.spark_reach(rule))}, 0) AS r))"
        rest = "substr(p.w, length(p.r) + 1)"
        chain = f"transform({parts}, p -> concat(regexp_replace(p.r, {old}, {new}), {rest}))[0]"
    kept = f"transform({blobs}, b -> CASE WHEN {blob} THEN {lit(R.SECRET_MARKER)} ELSE b END)"
    splice = (
        f"array_join(zip_with(split(x, {lit(BASE64)}, -1), {kept}, (s, k) -> concat(s, coalesce(k, ''))), '')"
    )
    define("redact", "t STRING", "STRING", f"transform(array({chain}), x -> CASE WHEN rlike(x, {lit(GUARD)}) THEN {splice} ELSE x END)[0]")
    score = " + ".join(f"CAST(rlike(t, {lit(R.spark_test(r))}) AS INT)" for r in R.INJECTION_RULES)
    define("injection_score", "t STRING", "INT", score)
    first, last = "substring(t, 1, n DIV 2)", "right(t, n - n DIV 2)"
    cut = (
        f"concat({first}, chr(10), '... [TRUNCATED: omitted ', octet_length(t) - octet_length({first}) "
        f"- octet_length({last}), ' bytes] ...', chr(10), {last})"
    )
    cut = cut.replace("n DIV 2", "CAST(n DIV 2 AS INT)")
    define("truncate_middle", "t STRING, n INT", "STRING", f"CASE WHEN length(t) > n THEN {cut} ELSE t END")
    define("wrap_untrusted", "t STRING", "STRING", f"concat({lit(ENVELOPE_HEAD)}, t, {lit(ENVELOPE_TAIL)})")
