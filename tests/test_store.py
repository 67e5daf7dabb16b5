"""The published store: commit, crash, removal, pruned retrieval, indexed search."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import NOW, RUN, greedy, no_tombstones, plan_of
from textwarden.operators import block_search, commit as C, quota, removal, serving, store
from textwarden.operators.lines import line_index
from textwarden.policy import Policy, StoragePolicy
from textwarden.sources import manifests
from textwarden.sources.captures import streams
from textwarden.sources.manifests import ConcurrentCommit, latest

col = F.col
DAY = 86_400
RUNS = "run_id string, tenant string, arrival bigint, command_kind string, argv array<string>, no_store boolean, created_at bigint, stdout string, stderr string"


def run(n, text="one\ntwo\n", tenant="t", arrival=None, argv=("cat", "a.txt"), no_store=False, created=NOW, err="", run_id=None):
    return (run_id or RUN(n), tenant, n if arrival is None else arrival, "cat", list(argv), no_store, created, text, err)


def runs(spark, rows):
    return spark.createDataFrame(rows, RUNS)


def put(spark, root, rows, now=NOW, limits=StoragePolicy(), **more):
    snapshot, receipts = C.commit(spark, str(root), runs(spark, rows), now, limits, buckets=4, **more)
    return snapshot, {(r.run_id, r.arrival): (r.reason, r.expires_at) for r in receipts.collect()}


def asked(spark, snapshot, ids, now=NOW, start=0, lines=50):
    rows = spark.createDataFrame([(i, r, "stdout", start, lines) for i, r in enumerate(ids)], "request_id int, run_id string, stream string, start_line bigint, lines int")
    got = serving.retrieve_store(spark, snapshot, rows, F.lit(now))
    return [r.status for r in got.orderBy("request_id").collect()]


def test_receipts_say_what_retrieval_finds(spark, tmp_path):
    limits = StoragePolicy(max_stream_bytes=3000, max_records=4, max_total_bytes=60_000)
    _, first = put(spark, tmp_path, [run(1), run(2, tenant="u")], limits=limits)
    assert {r[0] for r in first.values()} == {"stored"}
    rows = [
        run(1, arrival=10),  # stored before
        run(3, arrival=2), run(3, arrival=3, text="again"), run(3, arrival=3, text="again"),  # sent three times
        run(4, text="x" * 3001), run(5, err="y" * 3001),  # oversize streams
        run(6, argv=("cat", ".env")),  # never ran
        run(7, no_store=True), run(0, run_id="no-id"),
        run(8, text="é\r\ntoken=abc\rend"), run(9, text=""), run(10), run(11, tenant="u"),  # 10 is one too many
    ]
    snapshot, got = put(spark, tmp_path, rows, limits=limits)
    until = NOW + DAY
    assert got == {
        (RUN(1), 10): ("storage_error", None), (RUN(3), 2): ("stored", until), (RUN(3), 3): ("storage_error", None),
        (RUN(4), 4): ("quota_exceeded", None), (RUN(5), 5): ("quota_exceeded", None), (RUN(7), 7): ("no_store", None),
        ("no-id", 0): ("storage_error", None), (RUN(8), 8): ("stored", until), (RUN(9), 9): ("stored", until),
        (RUN(10), 10): ("quota_exceeded", None), (RUN(11), 11): ("stored", until),
    }
    kept = {1, 2, 3, 8, 9, 11}
    assert asked(spark, snapshot, [RUN(i) for i in range(1, 12)]) == ["active" if i in kept else "not_found" for i in range(1, 12)]
    lines = snapshot.table(spark, "lines").where(col("run_id") == RUN(8)).orderBy("line_no").collect()
    assert [(r.text, r.byte_offset) for r in lines] == [("é", 0), ("token=[REDACTED_SECRET]", 3), ("end", 27)]
    assert sum(p.runs for p in snapshot.parts) == 6 and sum(p.lines for p in snapshot.parts) == snapshot.table(spark, "lines").count()
    used = {r.tenant: r.records for r in store.usage(snapshot.table(spark, "runs"), "tenant").collect()}
    assert used == {"t": 4, "u": 2}


@pytest.mark.parametrize("stage", ["blocks", "runs", "publish"])
def test_a_crash_between_the_writes_leaves_nothing_visible(spark, tmp_path, monkeypatch, stage):
    before, _ = put(spark, tmp_path, [run(1)])
    write = C.write_table

    def dies(rows, root, name, mark):
        if name == stage:
            raise OSError("lost")
        write(rows, root, name, mark)

    with monkeypatch.context() as patch:
        patch.setattr(C, "write_table", dies)
        if stage == "publish":
            patch.setattr(C, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(spark, tmp_path, [run(2), run(3, created=NOW - DAY // 2)])
    assert latest(spark, str(tmp_path)) == before
    assert asked(spark, before, [RUN(1), RUN(2)]) == ["active", "not_found"]
    after, got = put(spark, tmp_path, [run(2), run(3, created=NOW - DAY // 2)])
    assert {r[0] for r in got.values()} == {"stored"}
    assert manifests.vacuum(spark, str(tmp_path)) > 0
    assert manifests.vacuum(spark, str(tmp_path)) == 0
    assert asked(spark, latest(spark, str(tmp_path)), [RUN(1), RUN(2), RUN(3)]) == ["active"] * 3


def test_of_two_writers_one_is_told(spark, tmp_path):
    before, _ = put(spark, tmp_path, [run(1)])
    manifests.publish(spark, before, before.parts, None)
    with pytest.raises(ConcurrentCommit):
        manifests.publish(spark, before, (), None)
    assert latest(spark, str(tmp_path)).parts == before.parts


def test_sweep_makes_room_and_empty_commits_publish_nothing(spark, tmp_path):
    limits = StoragePolicy(max_records=1, ttl_seconds=100, tombstone_ttl_seconds=50)
    first, _ = put(spark, tmp_path, [run(1)], limits=limits)
    _, got = put(spark, tmp_path, [run(2, created=NOW + 99)], now=NOW + 99, limits=limits)
    assert got == {(RUN(2), 2): ("quota_exceeded", None)} and latest(spark, str(tmp_path)) == first
    after, got = put(spark, tmp_path, [run(2, created=NOW + 100)], now=NOW + 100, limits=limits)
    assert got == {(RUN(2), 2): ("stored", NOW + 200)}
    assert asked(spark, after, [RUN(1), RUN(2)], now=NOW + 100) == ["expired", "active"]
    assert asked(spark, after, [RUN(1), RUN(2)], now=NOW + 150) == ["not_found", "active"]
    none, got = put(spark, tmp_path, [], now=NOW + 100, limits=limits)
    assert got == {} and none == after


def _modified(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_deleted_runs_leave_the_disk_and_other_dates_are_not_touched(spark, tmp_path):
    rows = [run(i, text=f"secret word {i}\nmore\n", created=NOW + DAY * (i % 3), err="e\n") for i in range(30)]
    before, _ = put(spark, tmp_path, rows, limits=StoragePolicy(ttl_seconds=7 * DAY))
    files = _modified(tmp_path)
    ids = [RUN(i) for i in (0, 3, 6, 1)] + [RUN(77), RUN(0)]
    requests = spark.createDataFrame([(i,) for i in ids], "run_id string")
    after, outcome = removal.delete(spark, before, requests, NOW)
    assert {r.run_id: r.status for r in outcome.collect()} == {**{RUN(i): "deleted" for i in (0, 3, 6, 1)}, RUN(77): "not_found"}
    third = [p for p in files if f"created_date={sorted({q.created_date for q in before.parts})[2]}" in str(p)]
    assert third and all(p.exists() and _modified(tmp_path)[p] == files[p] for p in third)
    for name in ("runs", "lines", "blocks"):
        everything = spark.read.parquet(f"{tmp_path}/{name}")  # whatever lies on the disk
        assert everything.where(col("run_id").isin(ids)).count() == 0
        assert everything.select("run_id").distinct().count() == 26
    assert asked(spark, after, [RUN(0), RUN(3), RUN(4), RUN(77)]) == ["deleted", "deleted", "active", "not_found"]
    again, outcome = removal.delete(spark, after, requests, NOW + 5)
    assert again == after and {r.status for r in outcome.collect()} == {"already_gone", "not_found"}
    # Once its tombstone is over, a deleted run does not come back.
    assert asked(spark, after, [RUN(0)], now=NOW + DAY + 1) == ["not_found"]


def test_purge_counts_and_clears(spark, tmp_path):
    limits = StoragePolicy(ttl_seconds=100, tombstone_ttl_seconds=100)
    rows = [run(i, created=NOW + 50 * (i % 3)) for i in range(9)]
    before, _ = put(spark, tmp_path, rows, limits=limits)
    at, removed = removal.purge(spark, before, NOW + 100, limits=limits)
    assert removed == 3 and sum(p.runs for p in at.parts) == 6 and at.tombstone_table(spark).count() == 3
    at, removed = removal.purge(spark, at, NOW + 200, limits=limits)
    assert removed == 6 + 3 and at.parts == () and at.tombstone_table(spark).count() == 6
    more, _ = put(spark, tmp_path, [run(20, created=NOW + 210)], now=NOW + 210, limits=limits)
    done, removed = removal.purge(spark, more, NOW + 210, expired_only=False, limits=limits)
    assert removed == 1 + 7 and done.parts == () and done.tombstone_table(spark).isEmpty()
    assert not list(tmp_path.glob("lines/*/*/*/*.parquet"))


def test_sweep_in_batches(spark, tmp_path):
    before, _ = put(spark, tmp_path, [run(i, created=NOW + i) for i in range(6)], limits=StoragePolicy(ttl_seconds=10))
    after = removal.expire(spark, before, NOW + 100, at_most=4)
    assert sorted(r.run_id for r in after.table(spark, "runs").collect()) == [RUN(4), RUN(5)]


def test_retrieval_prunes_folders_and_hashes_only_what_it_returns(spark, tmp_path):
    rows = [run(i, text="".join(f"line {k} of {i}\n" for k in range(200)), created=NOW + DAY * (i % 3)) for i in range(60)]
    snapshot, _ = put(spark, tmp_path, rows, limits=StoragePolicy(ttl_seconds=7 * DAY))
    requests = spark.createDataFrame([(1, RUN(7), "stdout", 10, 2)], "request_id int, run_id string, stream string, start_line bigint, lines int")
    got = serving.retrieve_store(spark, snapshot, requests, F.lit(NOW))
    assert "line 10 of 7\nline 11 of 7\n" in got.collect()[0].content
    plan = plan_of(got).splitlines()
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "line_no" in line)
    assert "dynamicpruning" in plan[scan]
    # The hash of a line is computed above the join with the requests.
    hashed = max(i for i, line in enumerate(plan[:scan]) if "sha2" in line)
    assert any("Join" in line for line in plan[hashed:scan])
    read = [m for m in _metrics(got, "lines") if m[0] == "number of partitions read"]
    assert read and all(int(v) <= 1 for _, v in read)


def _metrics(df, table):
    """The metrics of the scans of a table in a plan that has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec" and f"/{table}" in node.relation().location().rootPaths().mkString(","):
            each = node.metrics().iterator()
            while each.hasNext():
                pair = each.next()
                metric = pair._2()
                found.append((str(metric.name().get()) if metric.name().isDefined() else pair._1(), metric.value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def _same_as_scan(spark, snapshot, requests, **limits):
    names = ("request_id", "status", "line", "content", "scan_truncated", "next_line", "next_cursor")
    indexed = block_search.search_store(spark, snapshot, requests, F.lit(NOW), **limits).select(*names)
    plain = store.search(requests, snapshot.table(spark, "runs"), no_tombstones(spark), snapshot.table(spark, "lines"), F.lit(NOW), **limits).select(*names)
    key = lambda r: tuple(str(x) for x in r)
    a, b = sorted(indexed.collect(), key=key), sorted(plain.collect(), key=key)
    assert a == b
    return a


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    draw = random.Random(8)
    words = ["needle", "hay", "é中", "x" * 50, "on", "a", "in a haystack"]
    def text(n):
        return "".join(" ".join(draw.choice(words) for _ in range(draw.randrange(4))) + f" {i}\n" for i in range(n))
    rows = [run(1, text=text(9000) + "the quick brown fox\n", err=text(100)), run(2, text=text(4096)), run(3, text=text(4097)[:-1]), run(4, text=""), run(5, text="\n" * 5000), run(6, text="short"), run(7, text=text(5000))]
    return put(spark, tmp_path_factory.mktemp("store"), rows, limits=StoragePolicy(max_total_bytes=10**9))[0]


@pytest.mark.parametrize("limits", [{}, {"max_matches": 7, "max_scan_bytes": 3000}, {"max_scan_bytes": 70_000}, {"max_matches": 1}])
def test_indexed_search_finds_what_a_scan_finds(spark, searched, limits):
    asked = []
    for i, literal in enumerate(["needle", "needle 8999", "中", "é中 4096", "o", "", "absent word", "x" * 60, "haystack 40"]):
        for n in range(1, 9):
            asked.append((100 * i + n, RUN(n), "stderr" if n == 1 and i % 2 else "stdout", literal, 0))
            asked.append((100 * i + 20 + n, RUN(n), "stdout", literal, 4095 if n % 2 else 3))
    asked += [(5000 + k, RUN(1), "stdout", "needle", 0) for k in range(50)]
    rows = spark.createDataFrame(asked, "request_id int, run_id string, stream string, literal string, at bigint")
    cursor = store.make_cursor(col("run_id"), col("stream"), col("literal"), col("at"))
    rows = rows.withColumn("cursor", F.when(col("at") > 0, cursor)).drop("at")
    found = _same_as_scan(spark, searched, rows, **limits)
    assert {r.status for r in found} == {"active", "invalid_request", "not_found"}


def test_blocks_that_cannot_hold_the_literal_are_not_read(spark, searched):
    blocks = searched.table(spark, "blocks")
    literals = spark.createDataFrame([("quick brown",), ("no such words",), ("zq",), ("é中",)], "literal string")
    pairs = literals.join(blocks.where((col("run_id") == RUN(1)) & (col("stream") == "stdout")))
    held = pairs.where(block_search.may_hold(col("trigrams"), block_search.literal_positions(col("literal"))))
    got = {(r.literal, r.block) for r in held.collect()}
    assert {b for lit, b in got if lit == "quick brown"} == {2}
    assert not any(lit == "no such words" for lit, _ in got) and {b for lit, b in got if lit == "zq"} == {0, 1, 2}
    assert {b for lit, b in got if lit == "é中"} == {0, 1, 2}


def test_damaged_and_lost_lines_are_noticed_by_search(spark, searched, monkeypatch):
    table = manifests.Snapshot.table

    def damaged(self, session, name, parts=None):
        rows = table(self, session, name, parts)
        if name != "lines":
            return rows
        rows = rows.where(~((col("run_id") == RUN(2)) & (col("line_no") == 17)))
        return rows.withColumn("text", F.when((col("run_id") == RUN(7)) & (col("line_no") == 17), "other").otherwise(col("text")))

    rows = [(i, RUN(i), "stdout", "needle", None) for i in (1, 2, 7)]
    requests = spark.createDataFrame(rows, "request_id int, run_id string, stream string, literal string, cursor string")
    monkeypatch.setattr(manifests.Snapshot, "table", damaged)
    got = block_search.search_store(spark, searched, requests, F.lit(NOW), max_matches=10_000).select("request_id", "status").distinct()
    assert {r.request_id: r.status for r in got.collect()} == {1: "active", 2: "corrupt", 7: "corrupt"}


def test_one_scan_for_many_searches_of_a_run(spark, searched, monkeypatch):
    monkeypatch.setattr(block_search, "TOGETHER", 100)
    rows = [(i, RUN(1), "stdout", f"needle {i % 700}", None) for i in range(1500)]
    requests = spark.createDataFrame(rows, "request_id int, run_id string, stream string, literal string, cursor string")
    _same_as_scan(spark, searched, requests)
    plan = plan_of(block_search.search_store(spark, searched, requests, F.lit(NOW)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quota_of_a_hot_tenant_in_one_job(spark):
    """Few rows come to the walk, which is what a walk over all of them gives."""
    draw = random.Random(4)
    limits = StoragePolicy(max_records=5, max_total_bytes=900)
    rows = [("hot", i, draw.choice([10, 200, 400, 1000]) + draw.randrange(9)) for i in range(20_000)] + [(None, 1, 5)]
    df = spark.createDataFrame(rows, "tenant string, arrival bigint, bytes bigint")
    thin = quota._thinned(df.repartition(8).select("tenant", "arrival", "bytes"), 5)
    assert thin.count() < 1000
    got = {(r.tenant, r.arrival): r.within_quota for r in quota.admit(df.withColumn("stream_bytes", col("bytes")), limits=limits).collect()}
    wanted = greedy([r for r in rows if r[0]], limits)
    assert {k: v for k, v in got.items() if k[0]} == wanted
    assert quota.admit(df.limit(0).withColumn("stream_bytes", col("bytes")), limits=limits).collect() == []


def test_line_index_by_folders_is_the_same_index(spark):
    rows = spark.createDataFrame([(RUN(i), "a\nb\nc", "", i % 3) for i in range(20)], "run_id string, stdout string, stderr string, bucket int")
    texts = streams(rows, "bucket")
    plain, placed = line_index(texts), line_index(texts, keep=["bucket"], cluster=["bucket"]).drop("bucket")
    assert plain.exceptAll(placed).isEmpty() and placed.exceptAll(plain).isEmpty()
    assert plan_of(line_index(texts, keep=["bucket"], cluster=["bucket"])).count("Exchange") == 1


def test_block_filters_leave_a_task_in_small_batches(spark):
    import pyarrow as pa

    from textwarden.operators import block_search

    class Frame:
        schema = spark.createDataFrame([], "run_id string, stream string, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    n = 3 * block_search.EMIT + 7
    batch = pa.RecordBatch.from_pydict({"run_id": [str(i) for i in range(n)], "stream": ["stdout"] * n, "text": ["one\ntwo\nthree"] * n})
    out = list(block_search.block_index(Frame(), [], 2)(iter([batch])))
    assert max(b.num_rows for b in out) <= block_search.EMIT and sum(b.num_rows for b in out) == 2 * n
    assert [r for b in out for r in b.column("run_id").to_pylist()] == [str(i // 2) for i in range(2 * n)]


def test_one_call_scans_many_blocks():
    import pandas as pd

    from textwarden.operators import block_search

    place = ["run_id", "stream", "block", "part", "call"]
    wanted = pd.DataFrame([("a", "stdout", 0, 0, 0, 1, "x", 0, 0, 0, 2), ("b", "stdout", 0, 0, 0, 2, "x", 1, 0, 0, 3)], columns=[*place, *block_search._SEARCH])
    rows = [("b", 0, "x"), ("a", 1, "ax"), ("b", 1, "bx"), ("a", 0, "-")]
    lines = pd.DataFrame([(r, "stdout", 0, 0, 0, n, t, 3 * n, 3, False) for r, n, t in rows], columns=[*place, *block_search._LINE])
    events = block_search._scan(10, 1000)((0,), wanted, lines)
    assert sorted(map(tuple, events.astype(object).where(events.notna(), None).values)) == [(1, 1, "ax", "hit"), (2, 1, "bx", "hit"), (2, 2, None, "damage")]


def test_few_refused_rows_do_not_move_the_texts(spark):
    from textwarden.operators.commit import kept_rows

    staged = spark.range(100).selectExpr("id AS _row", "'text' AS stdout")
    for stored in (97, 3, 0, 100):
        decided = staged.selectExpr("_row", f"CASE WHEN _row < {stored} THEN 'stored' ELSE 'no_store' END AS reason")
        kept = kept_rows(staged, decided)
        assert sorted(r["_row"] for r in kept.collect()) == list(range(stored))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert ("LeftAnti" if stored > 50 else "LeftSemi") in plan or stored in (0, 100)
