"""The oracle side: the same results as plain SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from textwarden import rules as R
from textwarden.functions.paths import glob_to_regex
from textwarden.functions.redaction import usable_prefixes
from textwarden.functions.shaping import CUT_MARKER, ENVELOPE_HEAD, ENVELOPE_TAIL
from textwarden.plans import planted as T
from textwarden.rules import DEFAULT_PATH_PATTERNS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ANY_DETECT = quote("|".join(f"(?:{R.duckdb_pattern(r)})" for r in R.DETECT_RULES))
BLOB = quote(R.BASE64_CANDIDATE)
SECRET, PATHM = quote(R.SECRET_MARKER), quote(R.PATH_MARKER)


def chain(text: str, prefixes: Sequence[str] = ()) -> str:
    for rule in R.REPLACE_RULES:
        pattern, new = quote(R.duckdb_pattern(rule)), quote(R.duckdb_replacement(rule))
        text = f"regexp_replace({text}, {pattern}, {new}, 'g')"
    for prefix in usable_prefixes(prefixes):
        text = f"replace({text}, {quote(prefix)}, {PATHM})"
    return text


def blob_is_secret(blob: str) -> str:
    d = f"try(decode(from_base64({blob})))"
    words = f"contains(lower({d}), 'secret') AND (contains(lower({d}), 'pass') OR contains(lower({d}), 'token'))"
    return f"coalesce(regexp_matches({d}, {ANY_DETECT}) OR ({words}), false)"


def has_encoded(text: str) -> str:
    return f"len(list_filter(regexp_extract_all({text}, {BLOB}), lambda b: {blob_is_secret('b')})) > 0"


def has_secret(text: str) -> str:
    return f"(regexp_matches({text}, {ANY_DETECT}) OR {has_encoded(text)})"


def splice(text: str) -> str:
    swap = f"CASE WHEN p[2] IS NULL THEN '' WHEN {blob_is_secret('p[2]')} THEN {SECRET} ELSE p[2] END"
    pairs = f"list_zip(string_split_regex({text}, {BLOB}), regexp_extract_all({text}, {BLOB}))"
    return f"array_to_string(list_transform({pairs}, lambda p: p[1] || {swap}), '')"


def redacted(source: str, text: str, out: str, name: str, prefixes: Sequence[str] = ()) -> str:
    """Two CTEs that add the redacted form of a column of ``source``."""
    return (
        f"{name}_c AS (SELECT *, {chain(text, prefixes)} AS _chain FROM {source}), "
        f"{name} AS (SELECT * EXCLUDE (_chain), {splice('_chain')} AS {out} FROM {name}_c)"
    )


def redact(text: str) -> str:
    """As one expression, for short values."""
    return splice(f"({chain(text)})")


def markers(text: str) -> str:
    return (
        f"(len(string_split({text}, {SECRET})) - 1 + len(string_split({text}, {PATHM})) - 1)"
    )


def new_markers(before: str, after: str) -> str:
    return f"greatest(0, {markers(after)} - {markers(before)})"


def score(text: str) -> str:
    parts = [
        f"CAST(regexp_matches({text}, {quote(R.duckdb_pattern(r))}) AS INT)"
        for r in R.INJECTION_RULES
    ]
    return "(" + " + ".join(parts) + ")"


def truncate_middle(text: str, limit: int | str) -> str:
    h, t = f"({limit} // 2)", f"({limit} - {limit} // 2)"
    omitted = f"strlen({text}) - strlen(left({text}, {h})) - strlen(right({text}, {t}))"
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE left({text}, {h}) || chr(10) || "
        f"'... [TRUNCATED: omitted ' || ({omitted}) || ' bytes] ...' || chr(10) || right({text}, {t}) END"
    )


def fit_budget(text: str, limit: int) -> str:
    if limit <= len(CUT_MARKER):
        cut = quote(CUT_MARKER[:limit])
    else:
        room = limit - len(CUT_MARKER)
        cut = f"left({text}, {room // 2}) || {quote(CUT_MARKER)} || right({text}, {room - room // 2})"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE {cut} END"


def wrap(text: str) -> str:
    return f"{quote(ENVELOPE_HEAD)} || ({text}) || {quote(ENVELOPE_TAIL)}"


def wrap_bounded(text: str, limit: int) -> str:
    return wrap(fit_budget(text, limit - len(ENVELOPE_HEAD) - len(ENVELOPE_TAIL)))


def reduction(raw: str, returned: str) -> str:
    return (
        f"CASE WHEN {raw} > 0 THEN greatest(0.0::DOUBLE, "
        f"({raw}::DOUBLE - {returned}::DOUBLE) / {raw}::DOUBLE * 100.0::DOUBLE) ELSE 0.0::DOUBLE END"
    )


def line_count(text: str) -> str:
    newlines = f"(length({text}) - length(replace({text}, chr(10), '')))"
    return (
        f"CASE WHEN {text} = '' THEN 0 ELSE {newlines} + "
        f"CASE WHEN ends_with({text}, chr(10)) THEN 0 ELSE 1 END END"
    )


def _first(tests: list[tuple[str, str]]) -> str:
    arms = " ".join(f"WHEN {test} THEN {quote(rule)}" for test, rule in tests)
    return f"CASE {arms} ELSE NULL END"


def path_rule(path: str, patterns: Sequence[str] = DEFAULT_PATH_PATTERNS) -> str:
    p = f"replace({path}, chr(92), '/')"
    relative = f"CASE WHEN starts_with({p}, './') THEN substr({p}, 3) ELSE {p} END"
    named = f"list_filter(string_split({p}, '/'), lambda c: c <> '' AND c <> '.')"
    lead = f"CASE WHEN starts_with({p}, '/') THEN ['/'] WHEN {p} = '.' OR starts_with({p}, './') THEN ['.'] ELSE [] END"
    file_name = f"nullif({named}[-1], '..')"

    def hit(value: str, pattern: str) -> str:
        return f"regexp_matches({value}, {quote(glob_to_regex(pattern))})"

    def over(value: str) -> str:
        return _first([(hit(value, q), q) for q in patterns])

    component = _first([(f"({hit('c', q)} OR {hit(chr(99) + chr(32) + '|| ' + quote('/'), q)})", q) for q in patterns])
    rules = f"list_filter(list_transform(list_concat({lead}, {named}), lambda c: {component}), lambda r: r IS NOT NULL)[1]"
    return f"coalesce({over(p)}, {over(relative)}, {over(file_name)}, {rules})"


# ------------------------------------------------------------------ named CTEs

STORED = "regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "plain": ((), f"plain AS (SELECT doc_id, source, lang, {T.PLAIN_PATH} AS path, text FROM documents)"),
    "docs": ((), f"docs AS (SELECT doc_id, source, lang, {T.PATH} AS path, {T.TEXT} AS text FROM documents)"),
    "red": (("docs",), redacted("docs", "text", "redacted", "red")),
    "caps": (
        ("docs",),
        f"caps AS (SELECT doc_id, path, {T.select(T.CAPTURE)} FROM docs)",
    ),
    "streams": (
        ("caps",),
        "streams AS (SELECT run_id, doc_id, tenant, path, created_at, 'stdout' AS stream, stdout AS text FROM caps "
        "UNION ALL SELECT run_id, doc_id, tenant, path, created_at, 'stderr', stderr FROM caps)",
    ),
    "normal": (("streams",), f"normal AS (SELECT * EXCLUDE (text), {STORED} AS text FROM streams)"),
    "stored": (("normal",), redacted("normal", "text", "stored_text", "stored")),
    "pieces": (
        ("stored",),
        "pieces AS (SELECT run_id, stream, string_split(stored_text, chr(10)) AS p FROM stored), "
        "split_lines AS (SELECT run_id, stream, len(p) AS n, unnest(p) AS text, "
        "generate_subscripts(p, 1) - 1 AS line_no FROM pieces), "
        "kept_lines AS (SELECT *, text || CASE WHEN line_no = n - 1 THEN '' ELSE chr(10) END AS whole "
        "FROM split_lines WHERE NOT (line_no = n - 1 AND text = ''))",
    ),
    "lines": (
        ("pieces",),
        "lines AS (SELECT run_id, stream, line_no, CAST(coalesce(sum(strlen(whole)) OVER "
        "(PARTITION BY run_id, stream ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
        "AS byte_offset, strlen(whole) AS byte_len, text, sha256(whole) AS checksum, whole FROM kept_lines)",
    ),
    "heads": (
        ("stored",),
        f"heads AS (SELECT run_id, stream, strlen(stored_text) AS byte_len, {line_count('stored_text')} AS line_count, "
        "sha256(stored_text) AS checksum, stored_text FROM stored)",
    ),
    "runs": (
        ("caps", "heads"),
        "runs AS (SELECT c.run_id, c.tenant, c.doc_id, 2 AS schema_version, c.command_kind, c.created_at, "
        f"c.created_at + {T.TTL} AS expires_at, o.byte_len AS out_bytes, o.line_count AS out_lines, o.checksum AS out_checksum, "
        "e.byte_len AS err_bytes, e.line_count AS err_lines, e.checksum AS err_checksum "
        "FROM caps c JOIN heads o ON o.run_id = c.run_id AND o.stream = 'stdout' "
        "JOIN heads e ON e.run_id = c.run_id AND e.stream = 'stderr')",
    ),
    # Where only ids and times matter, without the texts.
    "headers": (
        (),
        f"headers AS (SELECT {T.RUN_ID} AS run_id, doc_id, source AS tenant, CAST({T.CREATED} AS BIGINT) AS created_at, "
        f"CAST({T.CREATED} + {T.TTL} AS BIGINT) AS expires_at FROM documents)",
    ),
    # Runs that the argument check lets through, and what a store knows of them.
    "held": (
        ("docs", "headers"),
        f"open_ids AS (SELECT doc_id FROM docs WHERE {path_rule('path')} IS NULL), "
        "held AS (SELECT h.* FROM headers h JOIN open_ids USING (doc_id))",
    ),
    "tombs": ((), f"tombs AS (SELECT {T.select(T.TOMBSTONE)} FROM documents WHERE {T.TOMBSTONE_ROWS})"),
    "reqs": ((), f"reqs AS (SELECT {T.select(T.REQUEST)} FROM documents)"),
    "gate": (("docs",), ""),
    "gate_plain": (("plain",), ""),
    "sgate": (("streams",), ""),
}


def gate(
    source: str, name: str, limit: int | str = 12_000, rule: str | None = None, listed: str = "false", strict: str = "true"
) -> str:
    """The gate as CTEs; what differs between policies may be given as expressions over ``source``."""
    rule = rule or path_rule("path")
    cut = truncate_middle("CASE WHEN _listed THEN _red ELSE text END", limit)
    record = (
        "'blocked: true' || chr(10) || 'reason: ' || reason || chr(10) || 'path_rule: ' || path_rule || chr(10) "
        "|| 'redactions: ' || redactions || chr(10) || 'exit_code: 1'"
    )
    return (
        f"{name}_a AS (SELECT *, {rule} AS _rule, {has_secret('text')} AS _secret, {listed} AS _listed FROM {source}), "
        + redacted(f"{name}_a", "text", "_red", f"{name}_b")
        + f", {name}_c AS (SELECT *, {cut} AS _cut FROM {name}_b), "
        + redacted(f"{name}_c", "_cut", "_cut_red", f"{name}_d")
        + f", {name}_e AS (SELECT *, {score('_red')} AS _score, CASE WHEN _rule IS NOT NULL THEN 'path_blocked' "
        f"WHEN _secret THEN 'secret_detected' WHEN {strict} AND {score('_red')} > 0 THEN 'prompt_injection_detected' ELSE '' END AS reason FROM {name}_d), "
        f"{name}_f AS (SELECT *, reason <> '' AS blocked, coalesce(_rule, '') AS path_rule, "
        f"CASE WHEN reason = 'path_blocked' THEN 0 WHEN reason <> '' THEN {new_markers('text', '_red')} "
        f"ELSE {new_markers('_cut', '_cut_red')} END AS redactions, "
        f"CASE WHEN reason = 'path_blocked' THEN 0 WHEN reason <> '' THEN _score ELSE {score('_cut_red')} END AS warnings, "
        f"CASE WHEN reason <> '' THEN 1 ELSE 0 END AS exit_code, "
        f"reason = '' AND length(CASE WHEN _listed THEN _red ELSE text END) > {limit} AS truncated FROM {name}_e), "
        f"{name} AS (SELECT *, strlen(text) AS raw_bytes, "
        f"{wrap(f'CASE WHEN blocked THEN {record} ELSE _cut_red END')} AS content FROM {name}_f)"
    )


def _stream_gate(limit: int = 12_000) -> str:
    cut = truncate_middle("redacted", limit)
    return (
        redacted("streams", "text", "redacted", "sg_a")
        + f", sg_b AS (SELECT *, {cut} AS _cut, {path_rule('path')} AS _rule FROM sg_a), "
        + redacted("sg_b", "_cut", "shown", "sg_c")
        + f", sgate AS (SELECT *, _rule IS NOT NULL AS blocked, coalesce(_rule, '') AS path_rule, "
        f"CASE WHEN _rule IS NULL THEN CASE WHEN stream = 'stdout' THEN {wrap('shown')} ELSE shown END END AS output, "
        f"CASE WHEN _rule IS NULL THEN {new_markers('text', 'redacted')} + {new_markers('_cut', 'shown')} ELSE 0 END AS redactions, "
        f"CASE WHEN _rule IS NULL THEN {score('redacted')} ELSE 0 END AS warnings, "
        f"CASE WHEN _rule IS NULL THEN strlen(text) ELSE 0 END AS raw_bytes, "
        f"_rule IS NULL AND length(redacted) > {limit} AS truncated FROM sg_c)"
    )


CTES["gate"] = (("docs",), gate("docs", "gate"))
CTES["gate_plain"] = (("plain",), gate("plain", "gate_plain"))
CTES["sgate"] = (("streams",), _stream_gate())


def sql(body: str, *needs: str) -> str:
    """``body`` with the named CTEs, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    head = "WITH " + ", ".join(CTES[n][1] for n in order) + " " if order else ""
    # A body that brings CTEs of its own starts with a comma.
    text = head.rstrip() + body if body.startswith(",") else head + body
    # Computed once, however often they are read.
    return text.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def status(now: str = str(T.NOW)) -> str:
    """Lookup status over a request left-joined to tombstones t and headers r."""
    return (
        f"CASE WHEN t.run_id IS NOT NULL AND t.expires_at > {now} THEN CASE WHEN t.status = 'expired' THEN 'expired' ELSE 'deleted' END "
        f"WHEN r.run_id IS NULL THEN 'not_found' WHEN {now} >= r.expires_at THEN 'expired' ELSE 'active' END"
    )
