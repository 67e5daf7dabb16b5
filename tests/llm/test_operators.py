"""Edge cases of the operators: nulls, empty and long texts, ties, repeats, empty tables, further columns."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import best_products
from textwarden.llm import common, line_dedup, mixing, quality, token_files, tokenize_pieces, toxicity, url_filter, vector_search, warc
from textwarden.llm.components import components

VECTORS = "vec_id long, embedding array<float>, score string, rank int"


def _top(spark, rows, k=3):
    df = spark.createDataFrame([(i, v, "own", 0) for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in vector_search.top_products(df, F.col("vec_id") % 5 == 0, k).collect())


def test_top_products_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 40)
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=6) * draw.choice([0.01, 1.0, 1.1, 30.0])).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(300, [0.0] * 6), (301, [0.5] * 3), (305, [0.25] * 3), (310, [])]
    bad = [(400, None), (405, [float("nan")] * 6), (410, [float("inf")] * 6), (415, [None] * 6), (None, [1.0] * 6)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    assert _top(spark, rows + bad + rows[:3]) == best_products(whole, lambda i: i % 5 == 0, 3)


def test_top_products_of_repeated_queries(spark, monkeypatch):
    """The k-th best of most queries lies outside the seed block, and every query row is there six times."""
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 100)
    draw = np.random.default_rng(6)
    # Of one length, so in one bucket.
    rows = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(draw.normal(size=(300, 6)))]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    assert _top(spark, rows + 5 * rows[::5], 5) == best_products(whole, lambda i: i % 5 == 0, 5)


def test_top_products_prunes_without_loss():
    draw = np.random.default_rng(4)
    vectors = draw.integers(-200, 200, size=(500, 16))
    bucket = vector_search.Bucket(np.arange(500), vectors)
    for q in draw.integers(-200, 200, size=(20, 16)):
        scores = vectors @ q
        for rank in (1, 5, 50, 400):
            limit = float(np.sort(scores)[-rank])
            kept = bucket.survivors(q, limit)
            if kept is not None:
                assert set(np.flatnonzero(scores >= limit)) <= set(bucket.ids[kept].tolist())


def test_top_products_of_nothing(spark):
    assert _top(spark, []) == []
    assert _top(spark, [(5, [1.0])]) == []


def test_digest_array_confirms_strings(tmp_path):
    rules = [(f"h{i}.org/{'a' * (i % 4)}", "block" if i % 2 else "allow") for i in range(60)] + [("org/", "allow")]
    weak = lambda text: len(text) % 3  # noqa: E731  all digests collide
    (tmp_path / "x").write_bytes(url_filter.build_index(rules, weak))
    array = url_filter.DigestArray(str(tmp_path / "x"), weak)
    for host, path in [("h7.org", "/aaab"), ("x.h7.org", "/aaa"), ("h7.org", "/a"), ("h7.orgs", "/"), ("org", ""), ("a.b", "/")]:
        fits = [(len(r), r, v) for r, v in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        assert array.judge([host], [path]) == [max(fits)[1:] if fits else (None, None)]


def test_filter_urls_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org", "x?u=http://example.org/es/", "a://b.com/de/1://org/", "http://u@example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, __judged string")
    got = [tuple(r) for r in url_filter.filter_urls(pages.drop("__judged"), url_filter.RULES).orderBy("page_id").drop("page_id", "url").collect()]
    none = ("", "", None, "allow")
    assert got == [
        none, none, none, none,
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "", None, "allow"),
        ("example.org", "/es/", "example.org/es/", "block"), ("b.com", "/de/1://org/", "com/de/", "block"),
        ("u@example.org:80", "/es/", None, "allow"),
    ]
    assert url_filter.filter_urls(pages.limit(0).drop("__judged"), []).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 520)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert got == {n: root(n) for n in parent}


def _texts(spark, texts):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string")


def test_quality_edges(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None), ("", "a"), (" \n \n", "a"), ("a b c a b c", "a"), ("x\nx\n\nx", None), (words, "a"), ("é# $$", "a"), ("a a a a " * 30000, "a")]
    got = {r["doc_id"]: r for r in quality.quality_rules(_texts(spark, rows)).collect()}
    seen = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for _, r in sorted(got.items())]
    assert seen == [
        (0, 0, 0, 0, 0, False), (0, 0, 0, 0, 0, False), (0, 0, 0, 0, 0, False), (6, 6, 0, 0, 6, False), (3, 3, 0, 2, 0, False),
        (60, sum(len(f"w{i}") for i in range(60)), 0, 0, 0, True), (2, 4, 3, 0, 0, False), (120000, 120000, 0, 0, 120000, False),
    ]
    assert quality.quality_rules(_texts(spark, rows).limit(0)).count() == 0


def test_quality_removes_frequent_lines(spark):
    # Digits count alike, so lines differ by letters.
    body = lambda k: " ".join("abcdefghij"[k] * (i + 1) for i in range(60))
    shared = " ".join("z" * (i + 1) for i in range(70))
    rows = [(f"{body(k)}\n  {shared.upper()}", "a") for k in range(4)] + [(f"{body(9)}\nother", "a"), (f"{body(8)}\n{shared}", "b")]
    got = [r["kept"] for r in quality.quality_rules(_texts(spark, rows), max_docs=3).orderBy("doc_id").collect()]
    assert got == [False] * 4 + [True, True]


def test_quality_returns_texts_without_frequent_lines(spark):
    rows = [(f"own {'abcdef'[k]}\n MENU  {k}\n\nend {'abcdef'[k]}", "a") for k in range(5)] + [("menu 7", "a"), ("menu 7\nx", "b"), (None, "a"), ("", "a")]
    out = quality.quality_rules(_texts(spark, rows), max_docs=3).orderBy("doc_id")
    assert out.columns[:3] == ["doc_id", "text", "source"]
    got = [(r["text"], r["n_words"], r["words_left"]) for r in out.collect()]
    assert got == [(f"own {'abcdef'[k]}\n\nend {'abcdef'[k]}", 6, 4) for k in range(5)] + [("", 2, 0), ("menu 7\nx", 3, 3), (None, 0, 0), ("", 0, 0)]


def test_line_dedup_edges(spark):
    rows = [(f"menu\nown {k}\n  menu", "a") for k in range(12)] + [(None, "a"), ("", None), ("menu", "b"), ("menu\n\n", "a")]
    got = [tuple(r)[1:2] + tuple(r)[3:] for r in line_dedup.drop_boilerplate(_texts(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(f"own {k}", 3, 2) for k in range(12)] + [(None, 0, 0), ("", 0, 0), ("menu", 1, 0), ("\n", 1, 1)]
    assert line_dedup.drop_boilerplate(_texts(spark, rows).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    """Line frequencies count documents: sixty copies of a row make none of its lines frequent."""
    words = " ".join(f"{chr(97 + i % 26)}{'x' * i}" for i in range(60))
    df = spark.createDataFrame([(7, words, "a")] * 60 + [(8, "other", "a"), (None, words, "a"), (None, words, "a")], "doc_id long, text string, source string")
    judged = quality.quality_rules(df, max_docs=2).where("doc_id = 7").distinct().collect()
    assert [(r["text"], r["words_left"], r["kept"]) for r in judged] == [(words, 60, True)]
    assert quality.quality_rules(df, max_docs=1).where("kept").count() == 0
    assert line_dedup.drop_boilerplate(df, min_pages=3).where("n_dropped > 0").count() == 0
    assert line_dedup.drop_boilerplate(df, min_pages=2).where("n_dropped > 0").count() == 62


def test_frequent_lines_do_not_depend_on_the_size_of_the_host(spark):
    rows = [(f"menu\nown {chr(97 + i % 26) * (1 + i // 26)}", "a") for i in range(6)] + [(f"page {'z' * (i + 1)}", "a") for i in range(900)]
    assert quality.quality_rules(_texts(spark, rows), max_docs=5).where("words_left < n_words").count() == 6


def test_added_columns_take_the_place_of_clashing_ones(spark):
    """Names of added columns, in any case, and names that operators use inside."""
    rows = [(i, "menu\nown", "s", f"k{i}", "h", "g", "w", "x", "r") for i in range(12)]
    schema = "doc_id long, text string, source string, Kept string, host string, gone string, n_words string, N_LINES string, rest string"
    df = spark.createDataFrame(rows, schema)
    judged = quality.quality_rules(df, max_docs=3)
    assert judged.columns == ["doc_id", "text", "source", "host", "gone", "N_LINES", "rest", *quality.ADDED]
    assert [tuple(r)[1:7] for r in judged.collect()] == [("", "s", "h", "g", "x", "r")] * 12
    cleaned = line_dedup.drop_boilerplate(df)
    assert cleaned.columns == ["doc_id", "text", "source", "Kept", "host", "gone", "n_words", "rest", "n_lines", "n_dropped"]
    assert {tuple(r)[1:3] + tuple(r)[4:] for r in cleaned.collect()} == {("", "s", "h", "g", "w", "r", 2, 2)}


def test_clashing_columns_of_filters_and_mixture(spark):
    df = spark.createDataFrame([(i, "http://a.org/x", "a b", "src0", "en", "h", "t", 9, "j") for i in range(6)] * 2,
                               "doc_id long, url string, text string, source string, lang string, host string, topic string, Score int, judged string")
    judged = url_filter.filter_urls(df, url_filter.RULES)
    assert judged.columns == ["doc_id", "url", "text", "source", "lang", "topic", "Score", "judged", "host", "path", "rule", "verdict"]
    assert {tuple(r)[5:] for r in judged.collect()} == {("t", 9, "j", "a.org", "/x", "org/", "allow")}
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "url", "text", "source", "lang", "host", "Score", "judged", "n_tokens", "topic", "probability", "sampled"]
    assert {(r["host"], r["n_tokens"], r["topic"]) for r in mixed.collect()} == {("h", 2, "note")}
    scored = toxicity.score_toxicity(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert scored.columns == ["doc_id", "url", "text", "source", "lang", "host", "topic", "judged", "held_out", "score", "predicted", "restored_hits"]
    assert scored.count() == 12 and len({r["score"] for r in scored.collect()}) == 1
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0
    long = spark.createDataFrame([("http://a.org/" + "x" * 100_000,)], "url string")
    assert url_filter.filter_urls(long, url_filter.RULES).first()["rule"] == "org/"


def test_mixing_matches_sql_with_unnamed_languages(spark, tmp_path):
    import duckdb

    langs = ["en", "de", "fr", "es", None, "xx", "it"]
    rows = [(i, "w " * (5 + i % 90) + ("|" if i % 7 == 0 else ""), f"src{i % 3}", langs[i * i % 11 % 7]) for i in range(500)] + [(600, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    mine = mixing.op9(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({mixing.SQL})").fetchall()
    assert {r[0]: r for r in map(tuple, mine.collect())} == {r[0]: r for r in theirs}
    assert all(p > 0 for (*_, p, _) in theirs)


def test_raking_reaches_marginals():
    cells = np.random.default_rng(1).integers(1, 1000, size=(3, 4, 2)).astype(float)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    raked = mixing.rake(cells, targets, 60)
    for axis, shares in enumerate(targets):
        assert np.allclose(raked.sum(axis=tuple(i for i in range(3) if i != axis)), shares)
    cells[0] = 0
    assert np.allclose(mixing.rake(cells, targets, 60).sum(axis=(1, 2)), [0, 0.6, 0.4])
    assert mixing.rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)]).sum() == 0


def test_mix_edges(spark):
    rows = [(i, "a b c", "src0" if i % 3 else None, "en" if i % 2 else None) for i in range(400)] + [(None, None, None, None), (7, "", "x", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and max(r["probability"] for r in out) == 1.0
    assert all(r["probability"] == 0 for r in out if r["lang"] in (None, "xx"))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_draws_unnamed_languages(spark):
    """They keep their share of the tokens, however small; with HELD or without, named ones are drawn alike where they are alone."""
    langs = ["en", "de", "fr", "es"] * 24 + [None, None, "xx", ""]
    rows = [(i, "a b c", "src0" if i % 3 else "x", lang) for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(df, mixing.ALL_LANGUAGES).collect()
    weight = {lang: sum(r["probability"] for r in out if r["lang"] == lang) for lang in {*langs}}
    assert all(r["probability"] > 0 for r in out)
    other = weight[None] + weight["xx"] + weight[""]
    assert math.isclose(other / sum(weight.values()), 0.04, rel_tol=1e-3)
    assert math.isclose(weight["en"] / weight["es"], 0.58 / 0.12, rel_tol=1e-3)
    named = df.where("doc_id < 96")
    assert mixing.mix(named, mixing.ALL_LANGUAGES).collect() == mixing.mix(named).collect()
    only = df.where("doc_id >= 96")
    assert all(r["probability"] > 0 for r in mixing.mix(only, mixing.ALL_LANGUAGES).collect())


def test_pipeline_mixes_documents_without_language(spark, tiny):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "a b c", "src0" if i % 3 else "x", None if i % 3 == 1 else "en") for i in range(300)], "doc_id long, text string, source string, lang string")
    assert corpus_pipeline.mixture(spark, docs, tiny).where("lang IS NULL").count() > 0


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    long_text = "é\r\n\r\n" + "x y z " * 40_000
    rows = [(i, f"http://h/{i}", f"<p>{'lorem ipsum ' * (i % 7 + 9)}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "a\r\nb c", ""), (102, "u", long_text), (99, "u", long_text), (98, "v", "short"), (97, "v", "short"), (None, "n", "null id " * 30)]
    got = sorted((tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    import hashlib

    wanted = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = min((i for i, _, h in rows if i is not None and (h or "") == (html or "")), default=None)
        revisit = len(raw) >= 100 and page_id is not None and page_id != first
        wanted.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(wanted, key=str)


def test_archive_layout():
    records = [warc.record(str(i), "u", f"<html>{'same words ' * 30}{i}</html>".encode(), 0, "d", None) for i in range(300)]
    raw = b"".join(warc.archive(records))
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and list(warc.read_archive(raw)) == records
    few = b"".join(warc.archive(records[:1]))
    assert list(warc.read_archive(few)) == records[:1] and list(warc.read_archive(b"")) == []


@pytest.mark.parametrize("high", [1, 2, 50_000, 2**32, 2**60, 2**63])
def test_packing_round_trip(high):
    draw = np.random.default_rng(high % 1000)
    for n in (0, 1, 59, 60, 61, 1000):
        ids = draw.integers(0, high, n, dtype=np.uint64)
        ids[draw.random(n) < 0.5] //= np.uint64(max(1, high // 3))
        assert (token_files.unpack(token_files.pack(ids), n) == ids).all()
    assert len(token_files.pack(np.zeros(1200, dtype=np.uint64))) == 20


def test_token_file_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 7)
    docs = [np.arange(n, dtype="<u4") * 17 % 50_000 for n in (3, 0, 30, 1, 7, 0)]
    raw = b"".join(token_files.file_parts([len(d) for d in docs], np.concatenate(docs)))
    assert [d.tolist() for d in token_files.read_documents(raw)] == [d.tolist() for d in docs]


ODD = list("abcDE éÉß ñ'sdt  \t\n\r\x0b\x1c\x1f\x85\xa0 ▁..,!<|>$1029ªµº×÷İſΣς中文😀é́ａ\x00")
ODD += ["<|endoftext|>", "<s>", "</s>", "'s", "'LL", "don't", "word", "WORD", " ", "  ", "\n\n", "▁▁"]


def _odd_texts(n):
    draw = random.Random(3)
    return ["".join(draw.choice(ODD) for _ in range(draw.randrange(0, 40))) for _ in range(n)] + ["", " ", "\n", "▁", " ▁", "long " * 30_000]


def test_word_coder_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder, texts = Tokenizer.from_file(path), token_files.WordCoder(path, 500), _odd_texts(3000)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_chunk_coder_is_the_library():
    coder = tokenize_pieces.ChunkCoder(public_tokenizers.path("piece_bpe_32k.model"), 500)
    assert coder.chunked
    texts = _odd_texts(3000)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == coder.library.encode(texts)


def test_tokenizers_take_nulls_and_repeats(spark):
    rows = [(3, "b"), (None, None), (3, "a"), (2**62 + 1, ""), (-5, "x y"), (None, "z")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, n_tokens string")
    files = token_files.token_files(df, public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in files] == [None, None, -5, 3, 3, 2**62 + 1]
    assert files[-1]["start"] + 1 == sum(r["n_tokens"] for r in files)
    pieces = tokenize_pieces.encode_and_decode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(map(str, (r["doc_id"] for r in pieces))) == sorted(map(str, (r[0] for r in rows)))
    assert token_files.token_files(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.Decoder(toxicity.count_grams(docs, "text"))


@pytest.mark.parametrize("seen", ["1d10t", "idi0t", "stuuupid", "s t u p i d", "l.o.s.e.r", "m0r0n", "tr@sh", "cl0wn", "p4th3t1c", "stupiiiid", "$tupid", "w-o-r-t-h-l-e-s-s"])
def test_restoring(decoder, seen):
    meant = {"1d10t": "idiot", "idi0t": "idiot", "l.o.s.e.r": "loser", "m0r0n": "moron", "tr@sh": "trash", "cl0wn": "clown", "p4th3t1c": "pathetic", "w-o-r-t-h-l-e-s-s": "worthless"}
    assert meant.get(seen, "stupid") in decoder.restore(f"the {seen} of it").split()


def test_restoring_parts_spaced_letters_and_chains(decoder):
    words = {"you": 90, "are": 80, "a": 99, "and": 99, "the": 99, "house": 50, "stupid": 5, "idiot": 5, "worthless": 3}
    parting = toxicity.Decoder(np.exp(np.array(decoder.log)), words)
    spaced = lambda text: " ".join(text.replace(" ", ""))
    assert parting.restore("so y o u s t u p i d it is").split() == ["so", "you", "stupid", "it", "is"]
    text = "you are a worthless idiot and the house and the house and you are a stupid idiot and you are the house"
    assert len(text.replace(" ", "")) > 64 and parting.restore(spaced(text)) == text
    assert {"stupid", "idiot"} <= set(parting.restore(spaced("you are stup1d and a 1d10t")).split())
    assert "idiot" in parting.restore("and.the.house." * 8 + "1d10t").split()
    assert "stupid" in decoder.both("s t u p i d " * 20 + "x").split("\n")[1]
    # Long words are decoded as short ones are.
    assert decoder.decode("th3h0us3" * 40) == "thehouse" * 40


def test_restoring_leaves_plain_text(decoder):
    for text in ("", "The house of the and.", "und die Straße, für dich", "ww w", "a b c"):
        assert decoder.restore(text) == text
    assert decoder.both("well-known").startswith("well-known\n")
    assert isinstance(decoder.restore("aaa!" * 50_000 + " 1d10t " * 10), str)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate([None, "", "fine words"] * 5)], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, odd).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), odd).count() == 0


def test_toxicity_learns_from_every_label(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'word' AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 9 = 0 AS int) AS toxic")
    learned = docs.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert learned > 12_500
    assert toxicity.labelled(docs, labels, "doc_id", "text").count() == learned
    assert toxicity.labelled(docs, labels, "doc_id", "text", 100).count() == 100


@pytest.mark.parametrize("pairs", [5, 1_000_000])
def test_toxicity_companions_and_hits_by_hand(spark, monkeypatch, pairs):
    monkeypatch.setattr(toxicity, "PAIRS", pairs)
    draw = np.random.default_rng(2)
    names = [f"w:{c}{i}word" for i, c in enumerate("aaabbbccddefgh")] + ["s:rare"]
    # The first four come together; some rows of an id hold a feature twice.
    held = [(int(i % 4 > 0), sorted({int(x) for x in draw.integers(0, 15, 6)} | ({0, 3, 6, 8} if i % 3 == 0 else set()))) for i in range(60)]
    times = [[1 + (i + k) % 2 for k in range(len(h))] for i, (_, h) in enumerate(held)]
    toxic = [[(n, t) for n, t in zip(h, often)] for (label, h), often in zip(held, times) if label == 1]
    total = {i: sum(t for doc in toxic for n, t in doc if n == i) for i in range(15)}
    best = [(f, total[i], 100 if i == 5 else 0) for i, f in enumerate(names)]
    crowds = {}
    for i in range(15):
        with_i = [(dict(doc)[i], doc) for doc in toxic if i in dict(doc)]
        n = sum(sum(m * dict(doc).get(j, 0) for m, doc in with_i) >= toxicity.MOST * total[i] for j in range(15) if names[j][2:6] != names[i][2:6])
        if n and i != 5:
            crowds[i] = n
    df = spark.createDataFrame([(label, h, t) for (label, h), t in zip(held, times)], "toxic int, name array<int>, times array<bigint>")
    assert toxicity.companions(df, best) == crowds
    model, chosen = toxicity.Model(names[:5], []), names[:5]
    hits = [(min(3, len(set(h) & set(range(5)))), label == 1) for label, h in held]
    assert sorted(toxicity.by_hits(df, best, chosen)) == sorted((*k, hits.count(k)) for k in set(hits) if k[0])
    assert model.words == {n[2:] for n in names[:5]}


def test_toxicity_moves_labelled_texts_only(spark, monkeypatch, tmp_path):
    """Texts are filtered by the ids before they are shuffled, also where the ids could be broadcast."""
    plans, cut = [], toxicity.cut_lineage
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)], "doc_id long, toxic int")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    names = [k for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold")]
    before = [spark.conf.get(k) for k in names]
    rows = toxicity.labelled(docs, labels, "doc_id", "text").collect()
    wanted = docs.join(labels, "doc_id").where(~toxicity.held_out(F.col("doc_id"))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, wanted))
    assert "might_contain" in plans[-1] and "BroadcastHashJoin" not in plans[-1]
    assert [spark.conf.get(k) for k in names] == before


def test_texts_go_to_workers_in_small_batches(spark):
    """Arrow batches of 10,000 texts took an executor of the pipeline over its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(3000).coalesce(1)
    sizes = lambda: [r["n"] for r in rows.mapInPandas(lambda batches: (b[:1].assign(n=len(b))[["n"]] for b in batches), "n long").collect()]
    with pytest.raises(KeyError), common.small_batches(spark):
        found = sizes()
        raise KeyError
    assert max(found) <= common.BATCH and sum(found) == 3000
    assert spark.conf.get(name) == before
    docs = spark.createDataFrame([(1, "so it is"), (2, "not so")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for out in (
        tokenize_pieces.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True),
        toxicity.score_toxicity(docs, labels).select("doc_id", "score", "restored_hits"),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchEvalPython") == 1 and "Arrow" not in plan and "InPandas" not in plan
    assert spark.conf.get(name) == before


def test_sentencepiece_table_is_small():
    """Markers and spaces share entries, whose keys take a byte a character; tables of other operators go, its own stay."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["so it  is", "▁so▁▁it is", "▁", " ", "a\n▁b\n c ▁ d▁", "▁ so  it▁\n\n▁"]
    toxicity._decoder(np.zeros((29, 29, 29)).tobytes())
    code = tokenize_pieces.coder(model)
    assert toxicity._decoder.cache_info().currsize == 0 and tokenize_pieces.coder(model) is code
    assert code.chunked
    got = [np.frombuffer(raw, dtype="<u4").tolist() for raw in code.encode(texts)]
    assert got == [library.encode(t) for t in texts]
    assert code.table and all(chunk.isascii() for chunk in code.table)
