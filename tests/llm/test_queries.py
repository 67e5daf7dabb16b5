"""Registered queries of the subpackage against their SQL, and those without SQL against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textwarden.llm.jaccard_join import near_duplicates
from textwarden.llm.queries import ORACLES, QUERIES
from tests.llm.brute import linked_groups
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, tiny, name):
    ok, note = compare(spark, con, tiny, name, QUERIES[name], ORACLES[name])
    assert ok, note


def _documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_jaccard_join_matches_all_pairs(spark, tiny):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op3_jaccard_join"](spark, tiny).collect()}
    assert got == linked_groups(_documents(spark, tiny))


def test_sentencepiece_matches_library(spark, tiny):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op7_sentencepiece"](spark, tiny).collect()}
    for doc_id, text in _documents(spark, tiny):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        raw = np.array(ids, dtype="<u4").tobytes()
        sums = [hashlib.sha256(x).hexdigest() for x in (raw, library.decode(ids).encode())]
        assert got[doc_id] == (doc_id, len(ids), *sums)


def test_token_files_match_library(spark, tiny):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op8_token_files"](spark, tiny).collect()}
    start = 0
    for doc_id, text in sorted(_documents(spark, tiny)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[doc_id] == (doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_toxicity_on_held_out_rows(spark):
    """sf0.01 has enough labels to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    scored = QUERIES["op6_toxicity"](spark, sf_dir)
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert wrong <= 0.08 * len(rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.02 * len(rows)


def test_pipeline_stage_by_stage(spark, tiny):
    """Each stage's decisions, taken again by hand from what it was given."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    (_, toxic), (_, lines), (_, groups), (_, mixed), (_, last) = corpus_pipeline.STAGES
    one = toxic(spark, docs, tiny)
    assert one.columns == columns
    assert ids(one) == ids(QUERIES["op6_toxicity"](spark, tiny).where("predicted = 0"))
    two = lines(spark, one, tiny)
    assert two.columns == columns and ids(two) == ids(one)
    assert two.where(F.col("n_chars") != F.length("text")).count() == 0
    three = groups(spark, two, tiny)
    wanted = linked_groups([tuple(r) for r in two.select("doc_id", "text").collect()], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert three.columns == columns and ids(three) == {i for i, (_, _, c) in wanted.items() if i == c}
    four = mixed(spark, three, tiny)
    assert four.columns == columns and ids(four) <= ids(three)
    five = last(spark, four, tiny)
    assert ids(five) == ids(four) and five.count() == four.count()
    assert corpus_pipeline.run(spark, tiny).count() == five.count()


def test_pipeline_groups_near_copies_between_80_and_90(spark, tiny):
    """Edited words and appended passages, against all pairs at five words and 80 %."""
    import random

    draw = random.Random(9)
    fresh = lambda n: [f"v{draw.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(12):
        text = fresh(200)
        edited = list(text)
        for at in (20, 60, 100, 140):
            edited[at] = "other"
        texts = [text, edited, text + fresh(40), text + fresh(70), text[:170]]
        rows += [(5 * k + i, " ".join(t)) for i, t in enumerate(texts)]
    wanted, strict = linked_groups(rows, 5, 80), linked_groups(rows)
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), tiny).collect()
    assert {r["doc_id"] for r in got} == {i for i, (_, _, c) in wanted.items() if i == c}
    assert len(got) < sum(i == c for i, (_, _, c) in strict.items())


def test_pipeline_takes_odd_documents(spark, tiny):
    """Nulls in every column, empty texts, repeated rows and further columns."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(30).withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit(None).cast("long"))
    docs = docs.withColumn("topic", F.lit("own")).withColumn("__key", F.lit(1)).withColumn("n_lines", F.lit(2))
    nulls = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    empty = docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(10**9))
    docs = docs.unionByName(nulls).unionByName(nulls).unionByName(empty).unionByName(docs.limit(3))
    given = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = stage(spark, given, tiny)
        assert k == len(corpus_pipeline.STAGES) - 1 or given.columns == docs.columns
        given.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tiny).count() == 0


def test_near_duplicates_in_divided_regions(spark):
    """A small leaf sends a family of near copies through pivots, cells and blocks."""
    import random

    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    family = [draw.choice(vocabulary) for _ in range(120)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = []
    for k in range(90):
        copy = list(family)
        for _ in range(draw.randrange(0, 6)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        rows.append((3 * k, " ".join(copy)))
        rows.append((3 * k + 1, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 40))) + " " + passage))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO\n"), (1005, "one"), (1006, rows[0][1])]
    got = {r["doc_id"]: tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=3000).collect()}
    assert got == linked_groups(rows)
