"""The retained store: runs, lines and tombstones as tables.

Every function takes and returns data frames and is told the time; none reads a
clock.  Lines are looked up in blocks: a request is spread over the blocks it
touches and joined on ``(run_id, stream, block)``, so that requests crowding on
one run still land in many tasks and no pair outside a block is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textwarden import policy as P
from textwarden.functions.injection import injection_score
from textwarden.functions.redaction import count_redactions, redact, with_redaction
from textwarden.functions.shaping import fit_budget, match_excerpt, wrap_bounded
from textwarden.operators.lines import check_lines, indexable, line_count, newline_count, stored_line
from textwarden.policy import Policy, StoragePolicy
from textwarden.sources.captures import is_run_id
from textwarden.sources.checkpoints import cut_lineage

RETRIEVE_BLOCK = 64
SEARCH_BLOCK = 4096


# ------------------------------------------------------------------ commit


def run_headers(
    runs: DataFrame, created_at: str, limits: StoragePolicy = StoragePolicy(), stats=None
) -> DataFrame:
    """Header rows for sanitised runs ``(run_id, command_kind, stdout, stderr)``."""

    def stream(name: str) -> Column:
        text = F.col(name)
        return F.struct(
            F.octet_length(text).cast("bigint").alias("byte_len"),
            line_count(text).alias("line_count"),
            F.sha2(text, 256).alias("checksum"),
        ).alias(name)

    created = F.col(created_at).cast("bigint")
    columns = [
        "run_id",
        F.lit(P.SCHEMA_VERSION).alias("schema_version"),
        "command_kind",
        created.alias("created_at"),
        (created + limits.ttl_seconds).alias("expires_at"),
        F.lit(P.SANITIZER_VERSION).alias("sanitizer_version"),
        F.lit(P.ENCODING).alias("encoding"),
        stream("stdout"),
        stream("stderr"),
    ]
    return runs.select(*columns, *([stats] if stats is not None else []))


def new_runs(runs: DataFrame, existing: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows that may be committed: valid id, not stored yet, first of their id.

    Only ids and arrival numbers are shuffled to find repeats; the rows with their
    texts meet the short list of repeated ids and the list of known ids.
    """
    runs = runs.where(is_run_id(F.col("run_id")))
    repeated = (
        runs.groupBy("run_id")
        .agg(F.min(arrival).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    rows = runs.join(repeated, "run_id", "left")
    rows = rows.where(F.col("_first").isNull() | (F.col(arrival) == F.col("_first")))
    return rows.drop("_first").join(existing.select("run_id"), "run_id", "left_anti")


def storable(runs: DataFrame, limits: StoragePolicy = StoragePolicy()) -> DataFrame:
    """Runs of which both streams keep within the limits; others are not kept at all."""
    return runs.where(indexable(F.col("stdout"), limits) & indexable(F.col("stderr"), limits))


def write_store(runs: DataFrame, lines: DataFrame, root: str) -> None:
    """Append lines, which come with ``created_at``, then headers: a run with a header has its lines.

    Lines are sorted inside their files, so that row-group statistics on run and line
    number let readers skip.
    """
    date = F.to_date(F.timestamp_seconds("created_at")).alias("created_date")
    placed = lines.select("*", date).drop("created_at")
    placed = placed.sortWithinPartitions("created_date", "run_id", "stream", "line_no")
    placed.write.mode("append").partitionBy("created_date").parquet(f"{root}/lines")
    headers = runs.select("*", date)
    headers.write.mode("append").partitionBy("created_date").parquet(f"{root}/runs")


def receipts(decided: DataFrame) -> DataFrame:
    """``(run_id, no_store, failed, within_quota, expires_at)`` to receipts."""
    reason = (
        F.when(F.col("no_store"), F.lit("no_store"))
        .when(F.col("failed"), F.lit("storage_error"))
        .when(~F.col("within_quota"), F.lit("quota_exceeded"))
        .otherwise(F.lit("stored"))
    )
    rows = decided.withColumn("reason", reason)
    stored = F.col("reason") == "stored"
    return rows.select(
        "run_id",
        stored.alias("stored"),
        stored.alias("retrievable"),
        "reason",
        F.when(stored, F.col("expires_at")).alias("expires_at"),
    )


# ------------------------------------------------------------------ usage and quota


def index_bytes(text: Column) -> Column:
    """Index estimate: one entry per line start, a closing newline adds none."""
    closing = F.when(F.endswith(text, F.lit("\n")), F.lit(1)).otherwise(F.lit(0))
    entries = F.when(text == "", F.lit(0)).otherwise(1 + newline_count(text) - closing)
    return entries.cast("bigint") * P.INDEX_ENTRY_BYTES


def estimated_bytes(stdout: Column, stderr: Column) -> Column:
    plain = (F.octet_length(stdout) + F.octet_length(stderr)).cast("bigint")
    return plain + index_bytes(stdout) + index_bytes(stderr) + P.MANIFEST_OVERHEAD_BYTES


def usage(headers: DataFrame, *by: str) -> DataFrame:
    """Records and bytes per group; partial sums are formed before the shuffle."""
    return headers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("record_bytes"), F.lit(0)).cast("bigint").alias("bytes"),
    )


# ------------------------------------------------------------------ lookup


def resolve_status(
    requests: DataFrame, runs: DataFrame, tombstones: DataFrame, now: str | Column
) -> DataFrame:
    """Add ``status`` to requests by run id.

    A tombstone in force wins; one past its own time is as good as none.  ``runs``
    brings ``run_id``, ``schema_version``, ``created_at``, ``expires_at`` and may
    bring further header columns, which are kept.

    The store is asked about each id once, and the answers are then brought to the requests:
    a join with one row an id, which is broadcast or, for an id that very many requests
    name, split by Spark's skew join.
    """
    now = F.col(now) if isinstance(now, str) else now
    dead = tombstones.select(
        "run_id",
        F.col("status").alias("_tomb"),
        F.col("expires_at").alias("_tomb_until"),
    )
    known = runs.withColumnsRenamed(
        {"schema_version": "_schema", "created_at": "_created", "expires_at": "_expires"}
    )
    facts = requests.select("run_id").distinct().join(dead, "run_id", "left").join(known, "run_id", "left")
    rows = requests.join(facts, "run_id", "left")
    tomb = F.col("_tomb").isNotNull() & (F.col("_tomb_until") > now)
    status = (
        F.when(tomb & (F.col("_tomb") == "expired"), F.lit("expired"))
        .when(tomb, F.lit("deleted"))
        .when(F.col("_expires").isNull(), F.lit("not_found"))
        .when(
            (F.col("_schema") != P.SCHEMA_VERSION) | (F.col("_expires") < F.col("_created")),
            F.lit("corrupt"),
        )
        .when(now >= F.col("_expires"), F.lit("expired"))
        .otherwise(F.lit("active"))
    )
    rows = rows.withColumn("status", status)
    return rows.drop("_tomb", "_tomb_until", "_schema", "_created", "_expires")


def live_runs(runs: DataFrame, tombstones: DataFrame, now: int) -> DataFrame:
    """Runs that may still be served."""
    dead = tombstones.where(F.col("expires_at") > now).select("run_id")
    return runs.where(F.col("expires_at") > now).join(dead, "run_id", "left_anti")


# ------------------------------------------------------------------ retrieval


def valid_range(requests: DataFrame) -> DataFrame:
    """Fill in defaults and mark requests outside the allowed range."""
    lines = F.coalesce("lines", F.lit(P.DEFAULT_RETRIEVE_LINES))
    start = F.coalesce("start_line", F.lit(0).cast("bigint"))
    ok = lines.between(1, P.MAX_LINES_PER_QUERY) & (start >= 0)
    ok = ok & F.col("stream").isin("stdout", "stderr") & is_run_id(F.col("run_id"))
    error = F.when(~ok, F.lit("invalid_request"))
    return requests.withColumns({"start_line": start, "lines": lines, "error": error})


def _blocks(first: Column, last: Column, size: int) -> Column:
    return F.sequence(
        F.floor(first / size).cast("bigint"), F.floor(last / size).cast("bigint")
    )


def retrieve(
    requests: DataFrame,
    runs: DataFrame,
    tombstones: DataFrame,
    lines: DataFrame,
    now: str | Column,
    policy: Policy = Policy(),
    folders: Sequence[str] = (),
) -> DataFrame:
    """Line ranges, blocked when an injection phrase lies in or next to them.

    A range of which a line is damaged, or missing though the header counts it, is corrupt.
    ``folders`` names columns of ``runs`` and ``lines`` by which lines lie in folders: few requests
    then read only the folders of their runs. Only lines that are asked for are hashed.
    """
    requests = valid_range(requests)
    bad = requests.where(F.col("error").isNotNull()).select(
        "request_id", F.col("error").alias("status"),
        F.lit(None).cast("string").alias("content"), F.lit(0).alias("warnings"),
    )
    good = requests.where(F.col("error").isNull()).drop("error")
    found = resolve_status(good, runs.select(
        "run_id", "schema_version", "created_at", "expires_at", *folders,
        F.col("stdout.line_count").alias("_out_lines"),
        F.col("stderr.line_count").alias("_err_lines"),
    ), tombstones, now)
    stream_lines = F.when(F.col("stream") == "stdout", F.col("_out_lines")).otherwise(
        F.col("_err_lines")
    )
    found = found.withColumn("_lines", stream_lines).drop("_out_lines", "_err_lines")

    # The context starts one line early and is two lines longer; at line 0 that
    # means two lines after the range.
    start, count = F.col("start_line"), F.col("lines")
    first = F.greatest(start - 1, F.lit(0).cast("bigint"))
    wanted = found.where(F.col("status") == "active").select(
        "request_id", "run_id", "stream", *folders, start.alias("_from"),
        (start + count).alias("_to"),
        first.alias("_ctx_from"), (first + count + 2).alias("_ctx_to"),
    )
    # A written table of known size: if it is small it is broadcast, and with it folders are pruned.
    wanted = cut_lineage(wanted).where(F.col("_to") > 0).withColumn(
        "_block", F.explode(_blocks(F.col("_ctx_from"), F.col("_ctx_to") - 1, RETRIEVE_BLOCK))
    )
    blocked = lines.withColumn("_block", F.floor(F.col("line_no") / RETRIEVE_BLOCK).cast("bigint"))
    inside = (F.col("line_no") >= F.col("_ctx_from")) & (F.col("line_no") < F.col("_ctx_to"))
    pieces = check_lines(wanted.join(blocked, [*folders, "run_id", "stream", "_block"]).where(inside))
    chosen = (F.col("line_no") >= F.col("_from")) & (F.col("line_no") < F.col("_to"))
    raw = stored_line(F.col("text"), F.col("byte_len"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", raw.alias("raw"), chosen.alias("sel"))))
    # At most 2,002 lines per request.
    gathered = pieces.groupBy("request_id").agg(
        ordered.alias("_l"), F.bool_or("corrupt").alias("_corrupt"), F.count(F.lit(1)).alias("_got")
    )

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda e: e["raw"]), "")

    gathered = gathered.select(
        "request_id", "_corrupt", "_got",
        joined(F.col("_l")).alias("_context"),
        joined(F.filter("_l", lambda e: e["sel"])).alias("_selected"),
    )
    rows = found.join(gathered, "request_id", "left")
    active = F.col("status") == "active"
    from_line = F.greatest(F.col("start_line") - 1, F.lit(0).cast("bigint"))
    expected = F.least(F.col("_lines"), from_line + F.col("lines") + 2) - from_line
    lost = F.coalesce(F.coalesce("_got", F.lit(0)) < expected, F.lit(False))
    rows = rows.withColumns(
        {
            "status": F.when(active & (lost | F.coalesce("_corrupt", F.lit(False))), F.lit("corrupt"))
            .otherwise(F.col("status")),
            "_context": F.coalesce("_context", F.lit("")),
            "_selected": F.coalesce("_selected", F.lit("")),
        }
    )
    rows = with_redaction(rows, "_context", "_ctx_red", prefixes=policy.path_prefixes)
    rows = with_redaction(rows, "_selected", "_sel_red", prefixes=policy.path_prefixes)
    warnings = F.greatest(injection_score(F.col("_ctx_red")), injection_score(F.col("_sel_red")))
    rows = rows.withColumn("warnings", F.when(active, warnings).otherwise(F.lit(0)))
    if policy.prompt_injection_action == "Block":
        stopped = active & (F.col("warnings") > 0)
        rows = rows.withColumn(
            "status", F.when(stopped, F.lit("blocked")).otherwise(F.col("status"))
        )
    note = F.when(
        F.col("warnings") > 0,
        F.concat(
            F.lit("prompt_injection_warnings: "), F.col("warnings").cast("string"), F.lit("\n")
        ),
    ).otherwise(F.lit(""))
    body = F.concat(
        F.lit("status: active\nrun_id: "), F.col("run_id"),
        F.lit("\nstream: "), F.col("stream"), F.lit("\n"),
        note, fit_budget(F.col("_sel_red"), policy.max_chars),
    )
    content = F.when(active, wrap_bounded(body, policy.max_chars))
    return rows.select("request_id", "status", content.alias("content"), "warnings").unionByName(bad)


# ------------------------------------------------------------------ search


def cursor_binding(run_id: Column, stream: Column, literal: Column, line: Column) -> Column:
    bound = F.concat_ws(":", run_id, stream, literal, line.cast("string"))
    return F.substring(F.sha2(bound, 256), 1, 16)


def make_cursor(run_id: Column, stream: Column, literal: Column, line: Column) -> Column:
    return F.concat_ws(
        ":", F.lit("v1"), run_id, stream, cursor_binding(run_id, stream, literal, line),
        line.cast("string"),
    )


def parse_cursor(cursor: Column, run_id: Column, stream: Column, literal: Column) -> Column:
    """The line to resume at, or null for a cursor that is not ours."""
    line = F.get(F.split(cursor, ":", -1), 4).try_cast("bigint")
    return F.when(cursor == make_cursor(run_id, stream, literal, line), line)


def valid_search(requests: DataFrame) -> DataFrame:
    """Check literal, stream, id and cursor; add ``start_line``."""
    size = F.octet_length("literal")
    ok = size.between(1, P.MAX_PATTERN_BYTES) & F.col("stream").isin("stdout", "stderr")
    ok = F.coalesce(ok & is_run_id(F.col("run_id")), F.lit(False))
    resume = parse_cursor(F.col("cursor"), F.col("run_id"), F.col("stream"), F.col("literal"))
    bad_cursor = F.col("cursor").isNotNull() & resume.isNull()
    return requests.withColumns(
        {
            "start_line": F.coalesce(resume, F.lit(0).cast("bigint")),
            "error": F.when(~ok, F.lit("invalid_request")).when(
                bad_cursor, F.lit("invalid_cursor")
            ),
        }
    )


def search(
    requests: DataFrame,
    runs: DataFrame,
    tombstones: DataFrame,
    lines: DataFrame,
    now: str | Column,
    max_matches: int = P.MAX_MATCHES,
    max_scan_bytes: int = P.MAX_SCAN_BYTES,
) -> DataFrame:
    """Literal search in stored lines: one row per hit, or one per request without.

    Byte offsets in the index tell where the scan budget ends, so no running sum is
    needed.  The line that would exceed the budget is where the next page starts.
    Every scanned line is hashed again; damaged streams are reported as corrupt.
    """
    requests = valid_search(requests)
    counts = runs.select(
        "run_id", "schema_version", "created_at", "expires_at",
        F.col("stdout.line_count").alias("_out_lines"),
        F.col("stderr.line_count").alias("_err_lines"),
    )
    found = resolve_status(requests, counts, tombstones, now)
    found = found.withColumns(
        {
            "status": F.coalesce("error", "status"),
            "_lines": F.when(F.col("stream") == "stdout", F.col("_out_lines")).otherwise(
                F.col("_err_lines")
            ),
        }
    ).select(
        "request_id", "run_id", "stream", "literal", "start_line", "status", "_lines"
    )
    wanted = found.where(
        (F.col("status") == "active") & (F.col("start_line") < F.col("_lines"))
    ).select("request_id", "run_id", "stream", "literal", "start_line", "_lines")
    # Where the scan starts, in bytes: zero unless the request resumes.
    heads = lines.select(
        "run_id", "stream", F.col("line_no").alias("start_line"),
        F.col("byte_offset").alias("_base"),
    ).where(F.col("start_line") > 0)
    resumed = wanted.where(F.col("start_line") > 0).join(
        heads, ["run_id", "stream", "start_line"]
    )
    fresh = wanted.where(F.col("start_line") == 0).withColumn("_base", F.lit(0).cast("bigint"))
    wanted = fresh.unionByName(resumed).withColumn(
        "_block",
        F.explode(_blocks(F.col("start_line"), F.col("_lines") - 1, SEARCH_BLOCK)),
    )
    stored = check_lines(lines)
    stored = stored.withColumn("_block", F.floor(F.col("line_no") / SEARCH_BLOCK).cast("bigint"))
    scanned = wanted.join(stored, ["run_id", "stream", "_block"]).where(
        F.col("line_no") >= F.col("start_line")
    )
    done = F.col("byte_offset") - F.col("_base")
    over = done + F.col("byte_len") > max_scan_bytes
    is_hit = ~over & F.contains(F.col("text"), F.col("literal"))
    first_over = over & (done <= max_scan_bytes)
    marked = scanned.select(
        "request_id", "line_no", "text", "literal", "_lines", "corrupt",
        is_hit.alias("_hit"), first_over.alias("_over"),
    ).where(F.col("_hit") | F.col("_over") | F.col("corrupt"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("line_no"))
    # A rank filter: each task keeps its first rows per request before the shuffle.
    page = marked.withColumn("_rank", rank).where(F.col("_rank") <= max_matches)
    hits = page.where(F.col("_hit") & ~F.col("corrupt")).select(
        "request_id",
        (F.col("line_no") + 1).alias("line"),
        match_excerpt(F.col("text"), F.col("literal")).alias("content"),
    )
    ends = page.groupBy("request_id").agg(
        F.bool_or("corrupt").alias("_corrupt"),
        F.min(F.when(F.col("_over"), F.col("line_no"))).alias("_stop"),
        F.count_if("_hit").alias("_hits"),
        F.max(F.when(F.col("_hit"), F.col("line_no"))).alias("_last"),
    )
    return finish_search(found.join(ends, "request_id", "left"), hits, "request_id", max_matches)


def finish_search(state: DataFrame, hits: DataFrame, key: str, max_matches: int) -> DataFrame:
    """Pages from what a scan has found out about each search, with its hits, both by ``key``."""
    full = F.coalesce(F.col("_hits") >= max_matches, F.lit(False))
    more = full & (F.col("_last") + 1 < F.col("_lines"))
    truncated = F.col("_stop").isNotNull() | more
    corrupt = F.coalesce("_corrupt", F.lit(False))
    next_line = F.when(F.col("_stop").isNotNull(), F.col("_stop")).when(more, F.col("_last") + 1)
    names = dict.fromkeys(("request_id", key, "run_id", "stream", "literal"))
    state = state.select(
        *names,
        F.when(corrupt, F.lit("corrupt")).otherwise(F.col("status")).alias("status"),
        F.when(corrupt, F.lit(False)).otherwise(F.coalesce(truncated, F.lit(False)))
        .alias("scan_truncated"),
        F.when(~corrupt, next_line).alias("next_line"),
    )
    result = state.join(hits, key, "left")
    sound = F.col("status") == "active"
    return result.select(
        "request_id", "status", "run_id", "stream", "literal",
        F.when(sound, F.col("line")).alias("line"),
        F.when(sound, F.col("content")).alias("content"),
        "scan_truncated", "next_line",
        F.when(
            F.col("next_line").isNotNull(),
            make_cursor(F.col("run_id"), F.col("stream"), F.col("literal"), F.col("next_line")),
        ).alias("next_cursor"),
    )


def render_search(found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The bounded, wrapped page of each active search."""
    entry = F.concat(
        F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("content"), F.lit("\n")
    )
    pages = found.where(F.col("status") == "active").groupBy(
        "request_id", "run_id", "stream", "scan_truncated", "next_cursor"
    ).agg(
        F.count("line").alias("matches"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line", entry.alias("e")))),
                lambda x: x["e"],
            ),
            "",
        ).alias("_entries"),
    )
    body = F.concat(
        F.lit("status: active\nrun_id: "), F.col("run_id"),
        F.lit("\nstream: "), F.col("stream"),
        F.lit("\nmatches: "), F.col("matches").cast("string"), F.lit("\n"),
        F.when(F.col("scan_truncated"), F.lit("scan_truncated: true\n")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("next_cursor: "), F.col("next_cursor"), F.lit("\n")), F.lit("")),
        F.col("_entries"),
    )
    pages = with_redaction(
        pages.withColumn("_body", body), "_body", "_red", prefixes=policy.path_prefixes
    )
    pages = pages.withColumn("warnings", injection_score(F.col("_red")))
    refused = F.concat(
        F.lit("status: blocked\nrun_id: "), F.col("run_id"),
        F.lit("\nstream: "), F.col("stream"), F.lit("\nprompt_injection: true"),
    )
    blocks = policy.prompt_injection_action == "Block"
    blocked = (F.col("warnings") > 0) & F.lit(blocks)
    noted = F.when(
        F.col("warnings") > 0,
        F.concat(
            F.lit("prompt_injection_warnings: "), F.col("warnings").cast("string"),
            F.lit("\n"), F.col("_red"),
        ),
    ).otherwise(F.col("_red"))
    shown = F.when(blocked, refused).otherwise(fit_budget(noted, policy.max_chars))
    return pages.select(
        "request_id", "matches", "warnings", blocked.alias("blocked"),
        wrap_bounded(shown, policy.max_chars).alias("page"),
    )


def render_external(
    df: DataFrame, text: str, policy: Policy = Policy()
) -> DataFrame:
    """Redact, count, look for injections, block or fit: what may leave the store."""
    kept = list(df.columns)
    rows = with_redaction(df, text, "_red", prefixes=policy.path_prefixes)
    rows = rows.withColumn("warnings", injection_score(F.col("_red")))
    blocks = policy.prompt_injection_action == "Block"
    rows = rows.withColumn("blocked", (F.col("warnings") > 0) & F.lit(blocks))
    return rows.select(
        *kept,
        F.when(~F.col("blocked"), fit_budget(F.col("_red"), policy.max_chars)).alias("content"),
        count_redactions(F.col(text), F.col("_red")).alias("redactions"),
        "warnings", "blocked",
        (~F.col("blocked") & (F.length("_red") > policy.max_chars)).alias("truncated"),
    )


# ------------------------------------------------------------------ deletion and expiry


def deletion_status(
    requests: DataFrame, runs: DataFrame, tombstones: DataFrame, now: int
) -> DataFrame:
    """deleted / already_gone / not_found per requested id, each id once."""
    asked = requests.select("run_id").distinct()
    stored = runs.select("run_id", F.lit(True).alias("_stored"))
    dead = tombstones.where(F.col("expires_at") > now).select("run_id", F.lit(True).alias("_dead"))
    rows = asked.join(stored, "run_id", "left").join(dead, "run_id", "left")
    return rows.select(
        "run_id",
        F.when(F.col("_stored"), F.lit("deleted"))
        .when(F.col("_dead"), F.lit("already_gone"))
        .otherwise(F.lit("not_found"))
        .alias("status"),
    )


def bury(ids: DataFrame, status: str, now: int, limits: StoragePolicy) -> DataFrame:
    return ids.select(
        "run_id",
        F.lit(status).alias("status"),
        F.lit(now).cast("bigint").alias("recorded_at"),
        F.lit(now + limits.tombstone_ttl_seconds).cast("bigint").alias("expires_at"),
    )


def delete_runs(
    requests: DataFrame,
    runs: DataFrame,
    tombstones: DataFrame,
    now: int,
    limits: StoragePolicy = StoragePolicy(),
) -> tuple[DataFrame, DataFrame]:
    """Remaining runs and the tombstones after the deletions.

    Frames in, frames out; :mod:`textwarden.operators.removal` does the same to the files of a
    published store.
    """
    gone = runs.join(requests.select("run_id"), "run_id", "left_semi").select("run_id")
    left = runs.join(requests.select("run_id"), "run_id", "left_anti")
    older = tombstones.join(gone, "run_id", "left_anti")
    return left, older.unionByName(bury(gone, "deleted", now, limits))


def purge(
    runs: DataFrame,
    tombstones: DataFrame,
    now: int,
    expired_only: bool = True,
    limits: StoragePolicy = StoragePolicy(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining runs, remaining tombstones, and the number removed.

    A full purge buries each run and then clears every tombstone, the new ones
    included, and counts both steps.
    """
    if expired_only:
        over = runs.where(F.col("expires_at") <= now).select("run_id")
        fresh = tombstones.join(over, "run_id", "left_anti")
        left = runs.where(F.col("expires_at") > now)
        kept = fresh.where(F.col("expires_at") > now).unionByName(
            bury(over, "expired", now, limits)
        )
        removed = over.select(F.lit(1).alias("_x")).unionByName(
            fresh.where(F.col("expires_at") <= now).select(F.lit(1).alias("_x"))
        )
        return left, kept, removed.agg(F.count(F.lit(1)).alias("removed"))
    ids = runs.select("run_id")
    marks = tombstones.join(ids, "run_id", "left_anti").select("run_id").unionByName(ids)
    removed = ids.unionByName(marks).agg(F.count(F.lit(1)).alias("removed"))
    return runs.limit(0), tombstones.limit(0), removed


def sweep_batch(runs: DataFrame, now: int, size: int = P.SWEEP_RECORD_LIMIT) -> DataFrame:
    """The next runs to expire, oldest first."""
    over = runs.where(F.col("expires_at") <= now).select("run_id", "expires_at")
    return over.orderBy("expires_at", "run_id").limit(size)


def store_status(
    runs: DataFrame, tombstones: DataFrame, limits: StoragePolicy = StoragePolicy()
) -> DataFrame:
    """One row: what the store holds and its limits."""
    both = runs.select(F.lit(1).alias("_run")).unionByName(
        tombstones.select(F.lit(0).alias("_run"))
    )
    return both.agg(
        F.count_if(F.col("_run") == 1).alias("active_records"),
        F.count_if(F.col("_run") == 0).alias("tombstones"),
        F.lit(limits.ttl_seconds).cast("bigint").alias("ttl_seconds"),
        F.lit(limits.max_stream_bytes).cast("bigint").alias("max_stream_bytes"),
        F.lit(limits.max_total_bytes).cast("bigint").alias("max_total_bytes"),
        F.lit(limits.max_records).cast("bigint").alias("max_records"),
    )


def sanitized_command(argv: Column) -> Column:
    return redact(F.array_join(argv, " "))
