"""Detection and redaction rules as data, with one rendering per SQL engine.

The patterns, markers and word lists below are *fixed values*: results are only
right when they match exactly, so they are written out plainly and in order.
Everything else in the package refers to them by name.

Placeholders expanded by :func:`spark_pattern` and :func:`duckdb_pattern`:

``{W}``  whitespace characters, for use inside a character class
``{S}``  one whitespace character
``{B}``  what may stand before a key name (one capture group)
``{K}``  the key names (one capture group)

Spark runs patterns on java.util.regex, which backtracks.  Every repeat in the
table is therefore possessive wherever giving characters back could not lead to
a match; DuckDB (RE2) has no possessive form and needs none, so its rendering
drops the extra ``+``.

Four patterns look far ahead from each start, and many starts without an end would
take quadratic time.  ``linear`` is for those that are only looked for: it begins
at the front of a unit (a word, or what lies between line ends and bars), takes one start of
the unit that matches if any does, and never tries another.  ``last`` is for the one that is replaced:
what follows the last end is set aside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

SECRET_MARKER = "[REDACTED_SECRET]"
PATH_MARKER = "[REDACTED_PATH]"

WHITESPACE = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
BOUNDARY = r"(^|[^A-Za-z0-9_]|\\[rn])"
KEYS = r"(password|secret(?:_key)?|token|api[_-]?key)"


@dataclass(frozen=True)
class Rule:
    """One pattern; ``before`` and ``after`` list the groups copied around the marker."""

    name: str
    flags: str
    pattern: str
    marker: str = ""
    before: tuple[int, ...] = ()
    after: tuple[int, ...] = ()
    # Every match ends with this, so nothing behind its last occurrence can match.
    last: str = ""
    # Matches in the same texts, in linear time where the pattern backtracks.
    linear: str = ""


# Applied in this order.
REPLACE_RULES: tuple[Rule, ...] = (
    Rule(
        "yaml_block", "im",
        r"{B}{K}({S}*+:{S}*+)[|>][-+]?[ \t]*+(?:\r?\n[ \t]++[^\r\n]*+)++",
        SECRET_MARKER, (1, 2, 3),
    ),
    Rule(
        "escaped_yaml_block", "i",
        r"{B}{K}({S}*+:{S}*+)[|>][-+]?[ \t]*+(?:\\[rn][ \t]++[^\\\r\n]*+)++",
        SECRET_MARKER, (1, 2, 3),
    ),
    Rule(
        "quoted_value", "i",
        r"""{B}{K}({S}*+[:=]{S}*+)(\\?["'])([^'"\r\n]*?)(\\?["'])""",
        SECRET_MARKER, (1, 2, 3, 4), (6,),
    ),
    Rule(
        "bare_value", "i",
        r"""{B}{K}({S}*+[:=]{S}*+)([^{W}"';\\]++)""",
        SECRET_MARKER, (1, 2, 3),
    ),
    Rule(
        "bearer_header", "i",
        r"""(authorization{S}*+:{S}*+bearer{S}++)([^{W}"']++)""",
        SECRET_MARKER, (1,),
    ),
    Rule(
        "url_password", "i",
        r"((?:postgres|mysql|mongodb|redis|sqlite|mssql|sftp|http|https)"
        r"://[^:{W}]++:)([^@{W}]++)",
        SECRET_MARKER, (1,),
    ),
    Rule("aws_key_id", "i", r"AKIA[A-Za-z0-9]{16}", SECRET_MARKER),
    Rule(
        "pem_block", "",
        r"-----BEGIN [A-Z0-9_ ]+PRIVATE KEY-----(?s:.*?)-----END [A-Z0-9_ ]+PRIVATE KEY-----",
        SECRET_MARKER, last=r"-----END [A-Z0-9_ ]+PRIVATE KEY-----",
    ),
    Rule("pem_header", "i", r"-----BEGIN [A-Za-z0-9_ ]+PRIVATE KEY-----", SECRET_MARKER),
    Rule("unix_home", "", r"/(?:Users|home)/[a-zA-Z0-9_-]++", PATH_MARKER),
    Rule("windows_home", "i", r"[A-Za-z]:\\Users\\[a-zA-Z0-9_.-]++", PATH_MARKER),
)

# A text holds a secret when any of these matches.
DETECT_RULES: tuple[Rule, ...] = (
    Rule("key_value", "i", r"{B}{K}{S}*+[:=]"),
    Rule("bearer", "i", r"authorization{S}*+:{S}*+bearer"),
    Rule(
        "url_credentials", "i",
        r"(postgres|mysql|mongodb|redis|sqlite|mssql|sftp|http|https)"
        r"://[^:{W}]++:[^@{W}]++@",
        linear=r"(?<![^{W}])(?>[^{W}]*?(?:postgres|mysql|mongodb|redis|sqlite|mssql|sftp|http|https)"
        r"://[^:{W}]++:(?=[^@{W}]))[^@{W}]*+@",
    ),
    Rule("aws_key", "i", r"AKIA[A-Za-z0-9]{16}"),
    Rule("pem", "", r"-----BEGIN [A-Z0-9_ ]+PRIVATE KEY-----"),
)

# The injection score is the number of these that match at all.
INJECTION_RULES: tuple[Rule, ...] = (
    Rule("ignore_instructions", "i", r"ignore previous instructions"),
    Rule("reveal_secrets", "i", r"reveal secrets"),
    Rule("print_private_key", "i", r"print private key"),
    Rule("exfiltrate", "i", r"exfiltrate"),
    Rule(
        "curl_pipe", "i", r"curl{S}++[^\n|]*+\|",
        linear=r"(?<![^\n|])(?>[^\n|]*curl{S}++)[^\n|]*+\|",
    ),
    Rule(
        "wget_pipe", "i", r"wget{S}++[^\n|]*+\|",
        linear=r"(?<![^\n|])(?>[^\n|]*wget{S}++)[^\n|]*+\|",
    ),
)

BASE64_CANDIDATE = r"[A-Za-z0-9+/]{12,}={0,2}"

# Paths blocked unless the policy names its own list.
DEFAULT_PATH_PATTERNS: tuple[str, ...] = (
    ".env",
    ".env*",
    "*.pem",
    "*.key",
    "*.p12",
    "*.pfx",
    ".aws/",
    ".ssh/",
    ".gnupg/",
    ".git/",
    "node_modules/",
    "dist/",
    "build/",
)

# --------------------------------------------------------------------------
# Renderings
# --------------------------------------------------------------------------

# Non-ASCII letters that fold into ASCII ones, and the two Turkish
# letters that java.util.regex (alone) takes for an ``i``.
FOLDED = r"\x{17F}\x{212A}"
TURKISH_I = r"\x{130}\x{131}"

_POSSESSIVE = re.compile(r"(?<!\\)([+*?}])\+")
_TOKEN = re.compile(r"\\x\{[0-9A-F]+\}|\\.|\[(?:\\.|[^\]\\])*\]|[A-Za-z]")


def _expand(pattern: str) -> str:
    return (
        pattern.replace("{B}", BOUNDARY)
        .replace("{K}", KEYS)
        .replace("{S}", "[" + WHITESPACE + "]")
        .replace("{W}", WHITESPACE)
    )


def _without_turkish_i(pattern: str) -> str:
    """Undo what Java's Unicode case folding adds to plain simple folding."""

    def fix(match: re.Match) -> str:
        token = match.group()
        if token in "iI":
            return "(?-i:[iI])"
        if token.startswith("[") and ("A-Za-z" in token or "a-zA-Z" in token):
            if token.startswith("[^"):
                return f"(?:{token}|(?-i:[{TURKISH_I}]))"
            return f"(?-i:[{FOLDED}{token[1:]})"
        return token

    return _TOKEN.sub(fix, pattern)


def spark_pattern(rule: Rule) -> str:
    """Java form.  ``d``: only ``\\n`` ends a line; ``u``: case folds by Unicode."""
    body = _expand(rule.pattern)
    flags = rule.flags + "d"
    if "i" in rule.flags:
        body = _without_turkish_i(body)
        flags += "u"
    return f"(?{flags}:{body})"


def spark_test(rule: Rule) -> str:
    """Java form that finds something in the same texts, but not the same places."""
    return spark_pattern(replace(rule, pattern=rule.linear or rule.pattern))


def spark_any(rules: tuple[Rule, ...]) -> str:
    """One Java alternation that matches when any of ``rules`` does."""
    return "|".join(spark_test(rule) for rule in rules)


def spark_reach(rule: Rule) -> str:
    """Java form of all that comes before the end of the last possible match."""
    return rf"(?s:\A.*)(?{rule.flags}d:{_expand(rule.last)})"


def duckdb_pattern(rule: Rule) -> str:
    """RE2 form, with the flags inside the pattern."""
    flags = f"(?{rule.flags})" if rule.flags else ""
    return flags + _POSSESSIVE.sub(r"\1", _expand(rule.pattern))


def _replacement(rule: Rule, sigil: str) -> str:
    before = "".join(f"{sigil}{g}" for g in rule.before)
    after = "".join(f"{sigil}{g}" for g in rule.after)
    return before + rule.marker + after


def spark_replacement(rule: Rule) -> str:
    return _replacement(rule, "$")


def duckdb_replacement(rule: Rule) -> str:
    return _replacement(rule, "\\")


def rule_named(rules: tuple[Rule, ...], name: str) -> Rule:
    return next(r for r in rules if r.name == name)
