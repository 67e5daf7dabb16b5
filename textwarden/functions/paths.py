"""Dangerous-path rules and workspace bounds."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from textwarden.functions.redaction import let
from textwarden.policy import Policy

_SPECIAL = re.compile(r"[*?\[]")


def glob_to_regex(pattern: str) -> str:
    """Anchored regex for a shell glob; ``*`` and ``?`` also match ``/``.

    ``**`` is only allowed as a whole path component.  Raises ``ValueError`` on a
    malformed pattern, so that a bad policy stops the job instead of allowing.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            end = i + stars
            if stars > 2:
                raise ValueError(f"too many wildcards in {pattern!r}")
            if stars == 2:
                whole = (i == 0 or pattern[i - 1] == "/") and (end == n or pattern[end] == "/")
                if not whole:
                    raise ValueError(f"'**' must be a whole component in {pattern!r}")
                out.append(".*" if end == n else "(?:.*/)?")
                i = end if end == n else end + 1
            else:
                out.append(".*")
                i = end
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            negated = i + 1 < n and pattern[i + 1] == "!"
            first = i + (2 if negated else 1)
            close = pattern.find("]", first + 1)
            if close < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            out.append(_class(pattern[first:close], negated))
            i = close + 1
        else:
            out.append(_literal(c))
            i += 1
    return "(?s)^" + "".join(out) + r"\z"


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 or char in "/_ " else "\\" + char


def _class(body: str, negated: bool) -> str:
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                parts.append(f"{_literal(low)}-{_literal(high)}")
            i += 3
        else:
            parts.append(_literal(body[i]))
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return ("[^" if negated else "[") + "".join(parts) + "]"


def glob_match(pattern: str) -> Callable[[Column], Column]:
    """Predicate for one glob: a plain string test where one is enough."""
    regex = glob_to_regex(pattern)
    if not _SPECIAL.search(pattern):
        return lambda c: c == F.lit(pattern)
    if pattern[0] == "*" and len(pattern) > 1 and not _SPECIAL.search(pattern[1:]):
        return lambda c: F.endswith(c, F.lit(pattern[1:]))
    if pattern[-1] == "*" and len(pattern) > 1 and not _SPECIAL.search(pattern[:-1]):
        return lambda c: F.startswith(c, F.lit(pattern[:-1]))
    return lambda c: c.rlike(regex)


def _first_rule(patterns: Sequence[str], test: Callable[[str], Column]) -> Column:
    branches = None
    for pattern in patterns:
        hit, name = test(pattern), F.lit(pattern)
        branches = F.when(hit, name) if branches is None else branches.when(hit, name)
    return branches if branches is not None else F.lit(None).cast("string")


def path_rule(path: Column, patterns: Sequence[str]) -> Column:
    """The first rule a path falls under, or null.

    Looked at in turn: the whole path, the path without a leading ``./``, the
    file name, then each component with and without a trailing slash.
    """
    tests = {p: glob_match(p) for p in patterns}

    def resolve(p: Column) -> Column:
        raw = F.split(p, "/", -1)
        named = F.filter(raw, lambda c: (c != "") & (c != "."))
        lead = (
            F.when(F.startswith(p, F.lit("/")), F.array(F.lit("/")))
            .when((p == ".") | F.startswith(p, F.lit("./")), F.array(F.lit(".")))
            .otherwise(F.array().cast("array<string>"))
        )
        relative = F.when(F.startswith(p, F.lit("./")), F.substr(p, F.lit(3))).otherwise(p)
        last = F.get(named, F.size(named) - 1)
        file_name = F.when(last != "..", last)
        by_component = F.get(
            F.filter(
                F.transform(
                    F.concat(lead, named),
                    lambda c: _first_rule(
                        patterns, lambda q: tests[q](c) | tests[q](F.concat(c, F.lit("/")))
                    ),
                ),
                lambda r: r.isNotNull(),
            ),
            0,
        )
        return F.coalesce(
            _first_rule(patterns, lambda q: tests[q](p)),
            _first_rule(patterns, lambda q: tests[q](relative)),
            _first_rule(patterns, lambda q: tests[q](file_name)),
            by_component,
        )

    return let(F.replace(path, F.lit("\\"), F.lit("/")), resolve)


def path_decision(rule: Column, action: str) -> Column:
    """block / redact / allow for a row whose rule is known."""
    if action == "Allow":
        return F.lit("allow")
    return F.when(rule.isNotNull(), F.lit(action.lower())).otherwise(F.lit("allow"))


def block_rule(path: Column, policy: Policy) -> Column:
    if policy.action != "Block":
        return F.lit(None).cast("string")
    return path_rule(path, policy.blocked_patterns)


def first_blocked_argument(argv: Column, policy: Policy) -> Column:
    """Rule of the first argument that names a blocked path."""
    hits = F.filter(F.transform(argv, lambda a: block_rule(a, policy)), lambda r: r.isNotNull())
    return F.get(hits, 0)


def normalize_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes by text alone."""
    rooted = F.startswith(path, F.lit("/"))

    def step(stack: Column, part: Column) -> Column:
        depth = F.size(stack)
        at_root = (depth == 0) | (F.get(stack, depth - 1) == "..")
        popped = F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        return (
            F.when(part.isin("", "."), stack)
            .when(part != "..", F.concat(stack, F.array(part)))
            .when(~at_root, popped)
            .when(rooted & (depth == 0), stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def inside_workspace(path: Column, root: str) -> Column:
    """Component-wise test; relative paths are taken from the root."""
    root = root.rstrip("/") or "/"
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path)
    )
    prefix = "/" if root == "/" else root + "/"
    return let(
        normalize_path(absolute),
        lambda p: (p == F.lit(root)) | F.startswith(p, F.lit(prefix)),
    )
