"""Near duplicates: repeated ids, long texts, empty tables, regions that pivots divide."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import linked_groups
from textwarden.llm import jaccard_join
from textwarden.llm.jaccard_join import near_duplicates


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, 1, "own") for i, t in rows], "doc_id long, text string, region int, n int, digest string")


def _family(draw, members, length, edits, first_id=0):
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(length)]
    out = []
    for k in range(members):
        copy = list(base)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(length)] = draw.choice(vocabulary)
        out.append((first_id + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_families_are_divided_by_pivots(spark, monkeypatch, size, percent):
    """Tight and loose families, small limits: cells, several levels and blocks all come into play."""
    draw = random.Random(size)
    rows = _family(draw, 120, 150, 3) + _family(draw, 120, 150, 14, 1000) + _family(draw, 60, 40, 9, 2000)
    monkeypatch.setattr(jaccard_join, "WORK", 40_000)
    monkeypatch.setattr(jaccard_join, "BLOCK_WORK", 400_000)
    levels = []
    divide = jaccard_join._divide
    monkeypatch.setattr(jaccard_join, "_divide", lambda *a: levels.append(a[-1]) or divide(*a))
    got = {r["doc_id"]: tuple(r) for r in near_duplicates(_docs(spark, rows), size=size, percent=percent).collect()}
    assert got == linked_groups(rows, size, percent)
    assert levels


def test_a_family_is_dealt_over_many_tasks(spark, monkeypatch):
    """Whether by cells or by blocks, no task joins more than a part of it, and members are not copied for each pair."""
    monkeypatch.setattr(jaccard_join, "WORK", 200_000)
    monkeypatch.setattr(jaccard_join, "BLOCK_WORK", 400_000)
    most, pairs, written = [], [], []
    join, cut = jaccard_join._join_groups, jaccard_join.cut_lineage

    def counted(rows, keys, percent):
        most.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return join(rows, keys, percent)

    def watched(df):
        out = cut(df)
        if out.columns == ["region", "inner", "i", "j"]:
            pairs.append(out.count())
        if "shingles" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_join_groups", counted)
    monkeypatch.setattr(jaccard_join, "cut_lineage", watched)
    rows = _family(random.Random(2), 600, 100, 30)
    near_duplicates(_docs(spark, rows)).collect()
    assert max(most) <= 150 and sum(pairs) > 20 and max(written) <= 600


def test_a_passage_that_many_documents_hold_makes_no_large_region(spark, monkeypatch):
    """Half of each text is common to all: windows connect them, whole sets do not, and near copies are found all the same."""
    draw = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(str(draw.randrange(10**6)) for _ in range(40))} {passage}") for i in range(120)]
    rows += [(1000 + i, f"{t} end") for i, t in rows[:30]] + [(2000 + i, f"start {t}") for i, t in rows[20:40]]
    monkeypatch.setattr(jaccard_join, "WORK", 4_000)
    large, looser = [], []
    divide, tighter = jaccard_join._divide, jaccard_join._tighter
    monkeypatch.setattr(jaccard_join, "_divide", lambda *a: large.append(a[1].count()) or divide(*a))
    monkeypatch.setattr(jaccard_join, "_tighter", lambda *a: looser.append(a[0].count()) or tighter(*a))
    got = {r["doc_id"]: tuple(r) for r in near_duplicates(_docs(spark, rows)).collect()}
    assert got == linked_groups(rows)
    assert looser and max(looser) > 100 and large == []


def test_sizes_far_apart_connect_nothing(spark):
    """The shingles that short and long sets need are the same; their sizes alone rule links out. An id may have two sets."""
    import numpy as np

    short, long, other = range(1, 21), range(1, 41), range(21, 41)
    rows = [(1, short), (2, short), (3, long), (4, long), (5, other), (6, other), (7, range(100, 130)), (7, range(200, 260)), (8, range(200, 260)), (9, range(100, 130)), (10, range(300, 310))]
    frame = spark.createDataFrame([(i, bytearray(np.array(s, dtype=np.int64).tobytes())) for i, s in rows], "doc_id long, shingles binary")
    got = {r["doc_id"]: r["region"] for r in jaccard_join._tighter(frame, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}


def test_an_id_with_many_texts_is_one_node(spark, monkeypatch):
    """Rows do not multiply: as many sets are made as there are texts."""
    draw = random.Random(7)
    words = [f"x{i}" for i in range(400)]
    text = " ".join(draw.choice(words) for _ in range(60))
    other = " ".join(draw.choice(words) for _ in range(50))
    rows = [(5, f"{text} {' '.join(words[:k])}") for k in range(20)] + [(5, text)] * 7 + [(9, text), (2, other), (11, other + " more"), (5, other)]
    made = []
    sets = jaccard_join._sets

    def counted(docs, size):
        out = sets(docs, size)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_sets", counted)
    got = near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(made) <= 2 * len(rows)
    # One id for all: 5 is linked with 9 by one text, and with 2 and 11 by another.
    assert {r["doc_id"]: r["component_id"] for r in got} == {5: 2, 9: 2, 2: 2, 11: 2}


def test_very_long_and_empty_texts_and_no_rows(spark):
    draw = random.Random(3)
    words = [str(draw.randrange(10**6)) for _ in range(60_000)]
    edited = list(words)
    for at in range(0, 60_000, 400):
        edited[at] = "other"
    rows = [(4, " ".join(words)), (7, " ".join(edited)), (1, ""), (2, None), (3, " ".join(words[:30_000]))]
    docs = _docs(spark, [*rows, (None, "no id")])
    assert {r["doc_id"]: tuple(r) for r in near_duplicates(docs).collect()} == linked_groups(rows)
    none = near_duplicates(docs.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "n_shingles", "component_id"]


def test_tables_behind_the_result_are_let_go(spark):
    import os

    from textwarden.sources.checkpoints import shared_dir

    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    rows = _family(random.Random(4), 50, 60, 2)
    assert near_duplicates(_docs(spark, rows)).count() == 50
    # Only narrow tables are left: ids, sizes, digests and links.
    left = [f for f in set(os.listdir(folder)) - before if f.startswith(("cut-", "blocks-"))]
    assert left
    for name in left:
        assert not {"text", "first", "own", "shingles", "s"} & set(spark.read.parquet(f"{folder}/{name}").columns)


def test_texts_are_filtered_also_by_large_tables_of_ids(spark, monkeypatch, tmp_path):
    """Spark leaves filters out where the ids are above a limit; 1 byte stands for that here."""
    limit, small = "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "spark.sql.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k) for k in (limit, small)}
    plans, cut = [], jaccard_join.cut_lineage
    monkeypatch.setattr(jaccard_join, "cut_lineage", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    _docs(spark, _family(random.Random(3), 12, 60, 1)).write.parquet(f"{tmp_path}/docs")
    try:
        spark.conf.set(limit, "1b")
        spark.conf.set(small, "-1")
        near_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
        assert spark.conf.get(limit) == "1b"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert any("might_contain" in plan for columns, plan in plans if columns == ["doc_id", "text"])
