"""Vector codes and centroid clustering against plain versions, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from tests.llm.brute import clustered, coded
from textwarden.llm import centroids, vector_codes
from textwarden.llm.centroids import Cells, cluster, nearest
from textwarden.llm.vector_codes import Gnat, compress

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster int, cells binary, v int, n int, error long, rid int"
BAD = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [float("inf")] + [0.0] * 7, 1), (903, [None] * 8, 1), (904, [], 1), (905, [0.5] * 7, 1)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "own", 0, None, 7, 8, 9, 10) for i, v, label in rows], SCHEMA)


def _rows(seed, n=150, dim=8):
    draw = np.random.default_rng(seed)
    rows = [(3 * i + 5, draw.normal(size=dim).astype(np.float32).tolist(), [None, 0, 1][i % 3]) for i in range(n)]
    # Ties, copies of vectors under other ids, repeated rows, an id with two vectors, a null id.
    rows += [(1000 + i, rows[i][1], 2) for i in range(20)] + rows[:5] + [(5, rows[9][1], 0), (None, rows[3][1], 0)]
    return rows + [(2000 + i, [float(x) / 256 for x in draw.integers(-2, 3, size=dim)], None) for i in range(60)]


def _whole(v):
    return [math.floor(256 * x) for x in v]


@pytest.mark.parametrize("entries, rounds", [(16, 2), (64, 1), (3, 0)])
def test_codes_against_plain_version(spark, entries, rounds):
    rows = _rows(1)
    got, books = compress(_frame(spark, rows + BAD), parts=4, entries=entries, rounds=rounds)
    wanted, plain = coded([(i, _whole(v), label) for i, v, label in rows], 4, entries, rounds)
    assert [b.tolist() for b in books] == plain
    found = got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == wanted
    text = ",".join(str(x) for b in plain for e in b for x in e)
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_few_vectors_and_none(spark):
    rows = [(4, [0.5] * 8, None), (2, [0.25] * 8, None)]
    got = sorted(tuple(r)[:4] for r in compress(_frame(spark, rows), parts=4)[0].select("vec_id", "code", "error", "label_error").collect())
    assert got == [(2, "00000000", 0, 0), (4, "01010101", 0, 0)]
    for none in ([], BAD[:5], [(None, [1.0] * 8, 0)]):
        out, books = compress(_frame(spark, none), parts=4)
        assert out.collect() == [] and books == []
        assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_far_components_are_refused(spark):
    with pytest.raises(Exception, match="components beyond"):
        compress(_frame(spark, [(1, [3e5] * 8, 0)]), parts=4)[0].collect()


def test_access_tree_finds_what_a_scan_finds_with_less_work():
    draw = np.random.default_rng(2)
    for size, spread, dim in ((64, 200, 4), (64, 2, 4), (1, 5, 2), (5, 5, 2), (256, 30, 3), (40, 1, 1)):
        entries = draw.integers(-spread, spread + 1, size=(size, dim))
        queries = np.concatenate([draw.integers(-2 * spread, 2 * spread + 1, size=(2000, dim)), entries])
        tree = Gnat(entries)
        place, distance = tree.nearest(queries)
        table = ((queries[:, None].astype(np.int64) - entries) ** 2).sum(axis=2)
        assert (place == table.argmin(axis=1)).all() and (distance == table.min(axis=1)).all()
        if size == 256:
            assert tree.measured < table.size / 2
    # Borders of ranges met exactly, and distances that doubles cannot hold.
    big = np.array([[2**31, 0], [2**31, 1], [-(2**31), 0], [0, 2**31 - 1], [0, 2**31]] * 3, dtype=np.int64) // 2
    place, distance = Gnat(big, degree=2, leaf=1).nearest(big)
    table = ((big[:, None] - big) ** 2).sum(axis=2)
    assert (place == table.argmin(axis=1)).all() and (distance == 0).all()


@pytest.mark.parametrize("bits, clusters", [(2, 7), (7, 40)])
def test_clusters_against_plain_version(spark, bits, clusters):
    rows = _rows(4)
    got = cluster(_frame(spark, rows + BAD), dim=8, clusters=clusters, rounds=4, bits=bits)
    wanted, plain = clustered([(i, _whole(v)) for i, v, _ in rows], clusters, 4, 2)
    found = got.collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == wanted
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in plain]
    assert all(r["centroid_sha256"] == digest[r["cluster"]] for r in found)


def test_clusters_of_few_vectors_and_none(spark):
    same = [(i, [0.5] * 8, None) for i in range(6)]
    got = cluster(_frame(spark, same), dim=8, clusters=4).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0)] * 6
    for none in ([], BAD[:5], [(None, [1.0] * 8, 0)]):
        out = cluster(_frame(spark, none), dim=8)
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "cluster", "distance"]


def test_cells_tell_most_centroids_apart():
    draw = np.random.default_rng(5)
    centers = draw.normal(scale=60, size=(20, 32))
    vectors = np.floor(centers[draw.integers(0, 20, size=3000)] + draw.normal(scale=12, size=(3000, 32))).astype(np.int64)
    cells = Cells(vectors.min(axis=0), vectors.max(axis=0), vectors.mean(axis=0), vectors.std(axis=0))
    centroids_ = np.floor(centers).astype(np.int64)
    numbers, tables = cells.number(vectors), cells.tables(centroids_)
    exact = ((vectors[:, None] - centroids_) ** 2).sum(axis=2)
    k = len(centroids_)
    interval = sum(table[numbers[:, d]] for d, table in enumerate(tables))
    assert (interval[:, :k] <= exact).all() and (exact <= interval[:, k:]).all()
    chosen, fetched = nearest(numbers, lambda rows: vectors[rows], tables, centroids_)
    assert (chosen == exact.argmin(axis=1)).all()
    assert fetched < len(vectors) / 10


def test_round_sends_a_row_for_each_entry_only(spark):
    """What leaves a task does not grow with its rows."""
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist(), 0) for i in range(400)]
    table = _frame(spark, rows).selectExpr("vec_id", "transform(embedding, x -> bigint(floor(256 * x))) v").coalesce(1)
    first = [r["v"] for r in table.orderBy("vec_id").limit(10).collect()]
    books = vector_codes.train(table, first, 4, 1)
    assert len(vector_codes._sums(table, books)) <= 40
    cells = Cells(*(np.full(8, x) for x in (-2000, 2000, 0, 300)))
    moved = centroids._moved(centroids._approximated(table, 8, cells), 8, cells, np.array(first))
    assert moved.shape == (10, 8)
