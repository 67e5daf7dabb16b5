"""Literal search over stored lines by way of an index of their blocks.

Streams are indexed in blocks of lines.  Each block has a filter over the three-byte pieces of its text:
one bit a piece, so a literal with a piece whose bit is not set is in no line of the block.  Searches pick
their blocks by the filters, and only those blocks are read, each once for all searches that
want it, which one automaton looks for together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textwarden import policy as P
from textwarden.functions.shaping import match_excerpt
from textwarden.operators.lines import check_lines
from textwarden.operators.store import finish_search, resolve_status, valid_search
from textwarden.sources.checkpoints import cut_lineage
from textwarden.sources.manifests import Snapshot

BLOCK_LINES = 4096
#: Bits of a block's filter; as a power of two, and in 64-bit words.
BITS = 15
WORDS = 2**BITS // 64
#: Multiplier of the hash, the usual one of its kind: 2**32 by the golden ratio.
_GOLDEN = 2654435761
#: Searches that one task looks for in a block together; more are dealt over several tasks.
TOGETHER = 2000
#: Filters of this many blocks leave a task together.
EMIT = 256
#: Lines of blocks that are read in one call, so that small blocks share one.
CALL_LINES = 8_000
_KEY = ["run_id", "stream"]
#: Stands for the offset of a line that is not there.
_LOST = 2**62


def _positions(data: np.ndarray) -> np.ndarray:
    """The bit of each three-byte piece."""
    wide = data.astype(np.uint64)
    piece = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    return ((piece * np.uint64(_GOLDEN)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)


def literal_positions(literal: Column) -> Column:
    """The same bits for a literal; none for one of less than three bytes."""
    hexed = F.hex(literal.cast("binary"))
    size = F.octet_length(literal)
    at = F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))

    def position(i: Column) -> Column:
        piece = F.conv(F.substring(hexed, 2 * i + 1, F.lit(6)), 16, 10).cast("bigint")
        return F.shiftright((piece * F.lit(_GOLDEN)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - BITS)

    return F.array_distinct(F.transform(at, position))


def may_hold(trigrams: Column, positions: Column) -> Column:
    """Whether all of these bits are set in a block's filter."""

    def is_set(p: Column) -> Column:
        word = F.get(trigrams, F.shiftright(p, 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int"))
        return bit.bitwiseAND(F.lit(1)) == 1

    return F.forall(positions, is_set)


def block_index(texts: DataFrame, keep: Sequence[str], size: int = BLOCK_LINES) -> DataFrame:
    """``(run_id, stream, text)`` to a row for each block of lines; one stream and EMIT filters are held at a time."""
    kept = ["run_id", "stream", *keep]
    names = [*kept, "block", "line_count", "byte_offset", "byte_len", "trigrams"]

    def emitted(batch: pa.RecordBatch, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        picked = [batch.column(c).take(pa.array(owner, pa.int64())) for c in kept]
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        flat = np.concatenate([r[4] for r in rows])
        filters = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * WORDS, pa.array(flat, pa.int64()))
        return pa.RecordBatch.from_arrays([*picked, *numbers, filters], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for at, text in enumerate(batch.column("text")):
                data = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
                ends = np.flatnonzero(data == 10) + 1
                if len(data) and (not len(ends) or ends[-1] < len(data)):
                    ends = np.append(ends, len(data))
                start = 0
                for first in range(0, len(ends), size):
                    lines = min(size, len(ends) - first)
                    stop = int(ends[first + lines - 1])
                    bits = np.zeros(2**BITS, dtype=bool)
                    for piece in range(start, stop, 1 << 20):
                        bits[_positions(data[piece : min(stop, piece + (1 << 20) + 2)])] = True
                    words = np.packbits(bits, bitorder="little").view("<i8")
                    owner.append(at)
                    rows.append((first // size, lines, start, stop - start, words))
                    start = stop
                    if len(rows) == EMIT:
                        yield emitted(batch, owner, rows)
                        owner, rows = [], []
            if rows:
                yield emitted(batch, owner, rows)

    types = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, "text").mapInArrow(
        run, f"{types}, block bigint, line_count bigint, byte_offset bigint, byte_len bigint, trigrams array<bigint>"
    )


_SEARCH = ("search", "literal", "start_line", "base", "first_line", "line_count")
_LINE = ("line_no", "text", "byte_offset", "byte_len", "corrupt")
_EVENT = "search bigint, line_no bigint, text string, kind string"


def _scan(max_matches: int, max_scan_bytes: int):
    """The lines of some blocks, each against all searches dealt to its part.

    Events are hits (at most a page of them a search), the first line beyond the scan budget, and damage:
    a line with another checksum, or one that is missing.
    """

    def one(searches: list[tuple], first: int, count: int, rows: list[tuple]) -> list[tuple]:
        import ahocorasick

        out: list[tuple] = []
        rows.sort(key=lambda r: r[0])
        columns = [list(c) for c in zip(*rows)] or [[], [], [], [], []]
        numbers = columns[0]
        missing = sorted(set(range(first, first + count)) - set(numbers))
        automaton, owners = ahocorasick.Automaton(), {}
        found = dict.fromkeys((s[0] for s in searches), 0)
        for search in searches:
            owners.setdefault(search[1], []).append(search)
        for literal in owners:
            automaton.add_word(literal, literal)
        automaton.make_automaton()
        for number in missing:
            out += [(s, number, None, "damage") for s, _, start, _ in searches if number >= start]
        stopped = set()
        budgets = [s for s in searches if s[3] + max_scan_bytes < columns[2][-1] + columns[3][-1]] if numbers else []
        for number, text, offset, size, corrupt in zip(*columns):
            if corrupt:
                out += [(s, number, None, "damage") for s, _, start, base in searches if number >= start and offset - base <= max_scan_bytes]
                continue
            for s, _, start, base in budgets:
                if number >= start and s not in stopped and offset + size - base > max_scan_bytes:
                    stopped.add(s)
                    # The stop lies here if the lines before this block kept within the budget.
                    if offset - base <= max_scan_bytes:
                        out.append((s, number, None, "over"))
            for literal in {literal for _, literal in automaton.iter(text)}:
                for s, _, start, base in owners[literal]:
                    if number >= start and found[s] < max_matches and offset + size - base <= max_scan_bytes:
                        found[s] += 1
                        out.append((s, number, text, "hit"))
        return out

    def run(key, wanted: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        blocks: dict[tuple, tuple[int, int, list[tuple], list[tuple]]] = {}
        names = ("run_id", "stream", "block", "part")
        for *place, search, literal, start, base, first, count in zip(*[wanted[c].tolist() for c in (*names, *_SEARCH)]):
            blocks.setdefault(tuple(place), (first, count, [], []))[2].append((search, literal, start, base))
        for *place, number, text, offset, size, corrupt in zip(*[lines[c].tolist() for c in (*names, *_LINE)]):
            if tuple(place) in blocks:
                blocks[tuple(place)][3].append((number, text, offset, size, corrupt))
        for first, count, searches, rows in blocks.values():
            out += one(searches, first, count, rows)
        return pd.DataFrame(out, columns=["search", "line_no", "text", "kind"])

    return run


def search_store(
    spark: SparkSession,
    snapshot: Snapshot,
    requests: DataFrame,
    now: str | Column,
    max_matches: int = P.MAX_MATCHES,
    max_scan_bytes: int = P.MAX_SCAN_BYTES,
) -> DataFrame:
    """Literal search in stored lines: one row per hit, or one per request without.

    As :func:`textwarden.operators.store.search`, but for what is not read: damage in a block
    that cannot hold the literal goes unnoticed. Equal searches are one; searches of one stream share the
    reading of a block. Blocks are read by date and bucket folders, which the plan prunes by those of
    the wanted runs.
    """
    place = ["commit", "created_date", "bucket"]
    runs = snapshot.table(spark, "runs")
    headers = runs.select(
        "run_id", "schema_version", "created_at", "expires_at", *place,
        F.col("stdout").alias("_out"), F.col("stderr").alias("_err"),
    )
    found = resolve_status(valid_search(requests), headers, snapshot.tombstone_table(spark), now)
    facts = F.when(F.col("stream") == "stdout", F.col("_out")).otherwise(F.col("_err"))
    found = found.withColumns({"status": F.coalesce("error", "status"), "_lines": facts["line_count"], "_bytes": facts["byte_len"]})
    found = cut_lineage(found.select("request_id", *_KEY, "literal", "start_line", "status", "_lines", "_bytes", *place))
    asked = ["run_id", "stream", "literal", "start_line"]
    searches = found.where((F.col("status") == "active") & (F.col("start_line") < F.col("_lines")))
    searches = searches.groupBy(*asked).agg(*[F.first(c).alias(c) for c in ("_lines", "_bytes", *place)])
    searches = cut_lineage(searches.withColumn("search", F.monotonically_increasing_id()))
    # The filters make the sides of the joins below selective, so that folders are pruned by them.
    some = searches.where(F.col("start_line") >= 0)
    lines = snapshot.table(spark, "lines")
    zero = F.lit(0).cast("bigint")
    if searches.where((F.col("start_line") > 0) & (F.col("_bytes") > max_scan_bytes)).isEmpty():
        # The budget cannot end within any stream, wherever the scan of it starts.
        based = some.withColumn("base", F.when(F.col("start_line") > 0, F.col("_bytes")).otherwise(zero))
    else:
        heads = lines.select(*place, *_KEY, F.col("line_no").alias("start_line"), F.col("byte_offset").alias("base"))
        later = some.where(F.col("start_line") > 0).join(heads, [*place, *_KEY, "start_line"], "left")
        # Where the first line is lost there is nothing to measure from; its block is read, and tells.
        based = some.where(F.col("start_line") == 0).withColumn("base", zero).unionByName(
            later.withColumn("base", F.coalesce("base", F.lit(_LOST)))
        )
        based = cut_lineage(based).where(F.col("start_line") >= 0)
    blocks = snapshot.table(spark, "blocks").withColumnsRenamed({"byte_offset": "_at", "byte_len": "_size"})
    positions = literal_positions(F.col("literal"))
    first_line = F.col("block") * BLOCK_LINES
    begun = (first_line + F.col("line_count") > F.col("start_line")) & (F.col("_at") - F.col("base") <= max_scan_bytes)
    ends = (F.col("_at") + F.col("_size") - F.col("base") > max_scan_bytes) | (F.col("base") == _LOST)
    wanted = (
        based.withColumn("_p", positions)
        .join(blocks, [*place, *_KEY])
        .where(begun & (ends | may_hold(F.col("trigrams"), F.col("_p"))))
        .select(*place, *_KEY, "block", "search", "literal", "start_line", "base", first_line.alias("first_line"), "line_count")
    )
    wanted = cut_lineage(wanted)
    many = wanted.groupBy(*place, *_KEY, "block").agg(
        F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("_groups"), (F.max("line_count") + F.count(F.lit(1))).alias("_n")
    )
    many = cut_lineage(many).where(F.col("_groups") > 0)
    # A call costs about as much as the scan of a hundred lines; blocks are dealt by hash to calls of so many lines.
    calls = 1 + int((many.agg(F.sum(F.col("_groups") * F.col("_n"))).first()[0] or 0) // CALL_LINES)
    many = many.drop("_n")
    key = [*_KEY, "block", "part"]
    dealt = wanted.join(many, [*place, *_KEY, "block"]).withColumn("part", F.pmod(F.hash("search"), F.col("_groups")))
    read = check_lines(
        lines.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES).cast("bigint")).join(many, [*place, *_KEY, "block"])
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    call = F.pmod(F.xxhash64(*key), F.lit(calls)).alias("call")
    dealt = dealt.select(*key, *_SEARCH, call)
    read = read.select(*key, *_LINE, call)
    events = dealt.groupBy("call").cogroup(read.groupBy("call")).applyInPandas(_scan(max_matches, max_scan_bytes), _EVENT)
    rank = F.row_number().over(Window.partitionBy("search").orderBy("line_no"))
    page = cut_lineage(events.withColumn("_rank", rank).where(F.col("_rank") <= max_matches))
    page = page.join(searches.select("search", "literal"), "search")
    kind = F.col("kind")
    hits = page.where(kind == "hit").select(
        "search", (F.col("line_no") + 1).alias("line"), match_excerpt(F.col("text"), F.col("literal")).alias("content")
    )
    sums = page.groupBy("search").agg(
        F.bool_or(kind == "damage").alias("_corrupt"),
        F.min(F.when(kind == "over", F.col("line_no"))).alias("_stop"),
        F.count_if(kind == "hit").alias("_hits"),
        F.max(F.when(kind == "hit", F.col("line_no"))).alias("_last"),
    )
    state = found.join(searches.select(*asked, "search"), asked, "left").join(sums, "search", "left")
    state = state.withColumn("search", F.when(F.col("status") == "active", F.col("search")))
    return finish_search(state, hits, "search", max_matches)
