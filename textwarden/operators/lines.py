"""Jobs over the lines of documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from textwarden.functions.paths import block_rule
from textwarden.functions.redaction import count_redactions, with_redaction
from textwarden.policy import GREP_MAX_LINES, MAX_INDEX_ENTRIES, Policy, StoragePolicy
from textwarden.sources.checkpoints import cut_lineage


def document_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Numbered lines, from 1; a line ends at ``\\n`` or ``\\r\\n``."""
    kept = [c for c in df.columns if c != text]
    rows = _split_lines(df.select(*kept, F.col(text).alias("line")), kept)
    ended = F.endswith(F.col("line"), F.lit("\r")) & ~F.col("_last")
    line = F.when(ended, F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(
        F.col("line")
    )
    return rows.select(*kept, (F.col("_pos") + 1).cast("bigint").alias("line_no"), line.alias("line"))


def _split_lines(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Split ``line`` at newlines; what follows a final newline is no line.

    A one-character separator is split without a regex.  The outer form of explode
    keeps Catalyst from adding a filter that would split a second time.
    """
    pieces = df.select(*kept, F.split(F.col("line"), "\n", -1).alias("_p"))
    rows = pieces.select(
        *kept, F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("_pos", "line")
    )
    rows = rows.withColumn("_last", F.col("_pos") == F.col("_n") - 1)
    return rows.where(F.col("_pos").isNotNull() & ~(F.col("_last") & (F.col("line") == "")))


def byte_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """Numbered lines of raw bytes; lines that are not UTF-8 are left out.

    Bytes travel as Latin-1, one character each, so splitting cannot alter them.
    """
    latin = df.withColumn(content, F.decode(F.col(content), "ISO-8859-1"))
    rows = document_lines(latin, content)
    raw = F.encode(F.col("line"), "ISO-8859-1").cast("string")
    return rows.withColumn("line", raw).where(F.is_valid_utf8("line"))


def grep(
    df: DataFrame,
    literal: str,
    policy: Policy = Policy(),
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """Lines holding ``literal``, redacted after the match on the raw line."""
    return grep_many(df, [literal], policy, path, text).drop("query")


def grep_many(
    df: DataFrame,
    literals: Sequence[str],
    policy: Policy = Policy(),
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """Several literals in one pass over a corpus; ``query`` names the literal.

    Documents without any literal are dropped before they are split, and paths the
    policy blocks before their text is looked at.  A line is redacted once, however
    many literals it holds.
    """

    def holds_any(column: str) -> Column:
        tests = [F.contains(F.col(column), F.lit(literal)) for literal in literals]
        return reduce(lambda a, b: a | b, tests)

    rows = df.where(block_rule(F.col(path), policy).isNull()).where(holds_any(text))
    rows = document_lines(rows, text).where(holds_any("line"))
    rows = rows.withColumnRenamed("line", "_raw")
    rows = with_redaction(rows, "_raw", "line", prefixes=policy.path_prefixes)
    rows = rows.withColumn("redactions", count_redactions(F.col("_raw"), F.col("line")))
    hit = F.concat_ws(":", F.col(path), F.col("line_no").cast("string"), F.col("line"))
    listed = F.array(*[F.lit(literal) for literal in literals])
    found = F.filter(listed, lambda q: F.contains(F.col("_raw"), q))
    rows = rows.withColumn("hit", hit).withColumn("query", F.explode(found))
    return rows.drop("_raw")


def head_tail(
    hits: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    line: str,
    limit: int = GREP_MAX_LINES,
) -> DataFrame:
    """First and last hits of each group, with what was left out between them.

    The hits are written once and read by three branches.  Both ends are rank
    filters, which Spark applies inside every task before it shuffles, so a group
    of any size sends at most ``limit`` rows per task; totals are plain sums.
    """
    head, tail = limit // 2, limit - limit // 2
    size = F.octet_length(line).cast("bigint")
    hits = cut_lineage(hits.select(*by, *order, line).withColumn("_size", size))
    totals = hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        (F.sum("_size") + F.count(F.lit(1))).alias("_bytes"),
    )
    up = Window.partitionBy(*by).orderBy(*order)
    down = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    first = hits.withColumn("_rank", F.row_number().over(up)).where(F.col("_rank") <= limit)
    last = hits.withColumn("_rank", F.row_number().over(down)).where(F.col("_rank") <= tail)
    first = first.join(totals, list(by)).where(
        (F.col("_total") <= limit) | (F.col("_rank") <= head)
    )
    last = last.join(totals, list(by)).where(F.col("_total") > limit)
    last = last.withColumn("_rank", F.col("_total") - F.col("_rank") + 1)
    kept = first.unionByName(last)
    group = Window.partitionBy(*by)
    kept_bytes = F.sum(F.col("_size") + 1).over(group)
    cut = F.col("_total") > limit
    zero = F.lit(0).cast("bigint")
    return kept.select(
        *by,
        F.col("_rank").cast("bigint").alias("rn"),
        F.col(line).alias("line"),
        F.when(cut, F.col("_total") - limit).otherwise(zero).alias("omitted_lines"),
        F.when(cut, F.col("_bytes") - kept_bytes).otherwise(zero).alias("omitted_bytes"),
    )


def cut_list_text(kept: DataFrame, by: Sequence[str], limit: int = GREP_MAX_LINES) -> DataFrame:
    """The bounded text of each group of :func:`head_tail`, at most ``limit`` lines."""
    half = limit // 2
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda e: e["line"]
    )
    grouped = kept.groupBy(*by).agg(
        ordered.alias("_lines"),
        F.max("omitted_lines").alias("omitted_lines"),
        F.max("omitted_bytes").alias("omitted_bytes"),
    )
    marker = F.concat(
        F.lit("\n... [TRUNCATED: omitted "),
        F.col("omitted_lines").cast("string"),
        F.lit(" lines ("),
        F.col("omitted_bytes").cast("string"),
        F.lit(" bytes)] ...\n"),
    )
    text = F.when(
        F.col("omitted_lines") > 0,
        F.concat(
            F.array_join(F.slice("_lines", 1, half), "\n"),
            marker,
            F.array_join(F.slice("_lines", half + 1, limit), "\n"),
        ),
    ).otherwise(F.array_join("_lines", "\n"))
    return grouped.select(*by, "omitted_lines", "omitted_bytes", text.alias("text"))


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Stored lines: the newline belongs to its line and starts no new one."""
    unfinished = F.when(F.endswith(text, F.lit("\n")), F.lit(0)).otherwise(F.lit(1))
    return (
        F.when(text == "", F.lit(0)).otherwise(newline_count(text) + unfinished).cast("bigint")
    )


def indexable(text: Column, limits: StoragePolicy = StoragePolicy()) -> Column:
    """Whether a stream keeps within the byte and line limits of the store."""
    return (F.octet_length(text) <= limits.max_stream_bytes) & (
        line_count(text) <= MAX_INDEX_ENTRIES
    )


def line_index(
    rows: DataFrame,
    limits: StoragePolicy = StoragePolicy(),
    keep: Sequence[str] = (),
    cluster: Sequence[str] = (),
) -> DataFrame:
    """``(run_id, stream, text)`` as indexed lines with byte offsets.

    The shuffle moves whole streams, before they are split; the split rows are then
    already where the window wants them.  A window group is one stream, which the
    limits keep to a bounded size.  ``cluster`` names kept columns, each the same for all
    of a run, that decide where its lines go instead of the run itself.
    """
    rows = rows.select("run_id", "stream", *keep, "text").where(indexable(F.col("text"), limits))
    rows = rows.repartition(*(cluster or ("run_id", "stream")))
    rows = rows.withColumnRenamed("text", "line")
    lines = _split_lines(rows, ["run_id", "stream", *keep]).withColumnRenamed("line", "text")
    ending = F.when(F.col("_last"), F.lit("")).otherwise(F.lit("\n"))
    lines = lines.select(
        "run_id", "stream", *keep,
        F.col("_pos").cast("bigint").alias("line_no"),
        (F.octet_length("text") + F.octet_length(ending)).cast("bigint").alias("byte_len"),
        "text",
        line_checksum(F.concat(F.col("text"), ending)).alias("checksum"),
    )
    before = (
        Window.partitionBy(*cluster, "run_id", "stream")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("byte_len").over(before), F.lit(0).cast("bigint"))
    return lines.select(
        "run_id", "stream", *keep, "line_no", offset.alias("byte_offset"), "byte_len", "text",
        "checksum",
    )


def line_checksum(line: Column) -> Column:
    return F.sha2(line, 256)


def stored_line(text: Column, byte_len: Column) -> Column:
    """A line as it stood in the stream, with its newline if it had one."""
    return F.when(byte_len > F.octet_length(text), F.concat(text, F.lit("\n"))).otherwise(text)


def check_lines(lines: DataFrame) -> DataFrame:
    """Lines whose text no longer has the recorded checksum."""
    actual = line_checksum(stored_line(F.col("text"), F.col("byte_len")))
    return lines.withColumn("corrupt", actual != F.col("checksum"))


def check_index(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Compare each stream's index with its header ``(byte_len, line_count)``."""
    along = Window.partitionBy("run_id", "stream").orderBy("line_no")
    expected = F.lag(F.col("byte_offset") + F.col("byte_len")).over(along)
    steps = lines.select(
        "run_id", "stream", "line_no", "byte_offset", "byte_len",
        F.when(expected.isNull(), F.col("byte_offset") == 0)
        .otherwise((F.col("byte_offset") == expected) & (F.col("byte_len") > 0))
        .alias("_step_ok"),
    )
    found = steps.groupBy("run_id", "stream").agg(
        F.bool_and("_step_ok").alias("_steps_ok"),
        F.count(F.lit(1)).alias("_lines"),
        F.max("line_no").alias("_last"),
        F.sum("byte_len").alias("_bytes"),
    )
    zero = F.lit(0).cast("bigint")
    joined = headers.select("run_id", "stream", "byte_len", "line_count").join(
        found, ["run_id", "stream"], "full_outer"
    )
    ok = (
        F.coalesce("_steps_ok", F.lit(True))
        & (F.col("line_count") == F.coalesce("_lines", zero))
        & (F.col("line_count") == F.coalesce(F.col("_last") + 1, zero))
        & (F.col("byte_len") == F.coalesce("_bytes", zero))
    )
    return joined.select(
        "run_id", "stream", "byte_len", "line_count",
        F.coalesce(ok, F.lit(False)).alias("index_ok"),
    )
