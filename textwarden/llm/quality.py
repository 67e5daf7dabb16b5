"""Quality rules from single texts and from line frequencies across documents; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import handed_back, numbered, staged, without_space, words
from textwarden.sources.checkpoints import cut_lineage

#: Words below which, and the percentage of repeated words above which, a text fails by itself.
MIN_WORDS, MAX_REPEATED = 50, 50
#: A line goes when more documents of its host than these hold it.
MAX_DOCS = 50
#: The percentage of its words that a document must keep.
MIN_LEFT = 50
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"


def _line_keys(text: Column) -> Column:
    """The hash of every line without regard to case, digits and white space; all blank lines have that of the empty one.

    The text is brought to its normal form as a whole; only trimming is done line by line.
    """
    normal = F.translate(F.lower(text), "123456789", "000000000")
    lines = F.split(F.regexp_replace(normal, r"[\x20\x09\x0B-\x0D]+", " "), "\n")
    return F.transform(lines, lambda line: F.xxhash64(F.trim(line)))


def base_measures(docs: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Three-word windows are compared by a 64-bit hash. Only texts that repeat one pay
    for sorting windows with their places; the covered words then follow from the
    distances between neighbouring places.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda line: without_space(line) != "")
    out = staged(docs, "__words", words(F.col(text)))
    n = F.size("__words")
    at = lambda i: F.get(F.col("__words"), i)
    windows = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    out = staged(out.withColumn("n_words", n.cast("long")), "__windows", windows).drop("__words")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(
        repeats, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    out = staged(out, "__placed", placed).drop("__windows")
    near = lambda i: F.get(F.col("__placed"), i)["h"]
    twice = F.filter(
        "__placed", lambda x, i: F.coalesce(near(i - 1) == x["h"], F.lit(False)) | F.coalesce(near(i + 1) == x["h"], F.lit(False))
    )
    out = staged(out, "__starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__placed")
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    out = out.withColumns(
        {
            "word_chars": F.length(without_space(full)).cast("long"),
            "n_symbols": (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__starts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """host, line: the lines that more than max_docs documents of the host hold, of (doc, host, lines).

    Distinct documents are counted: a document that is there many times counts once. The
    first shuffle is by host, line and document, so that no host and no line is one task's.
    """
    held = lines.select("doc", "host", F.explode("lines").alias("line")).distinct()
    return held.groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") > max_docs).select("host", "line")


#: What quality_rules adds to the rows.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")


def quality_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: int = MIN_LEFT,
) -> DataFrame:
    """The rows, their texts without frequent lines, with the base measures, words_left and kept.

    Base measures are those of the whole text; words_left counts what remains in the text
    that is returned. Texts without a frequent line, null ones included, stay as they are.

    A line is frequent when more than max_docs distinct documents of the host hold it, however
    large the host. A document is depleted when less than min_left percent of its words remain
    once the frequent lines of its host are out. Kept are documents that neither fail by
    themselves nor are depleted. Null and empty texts have no words and fail; null hosts
    form one host, together with the empty name. Rows that share an id are one document in
    the counts, as are rows without one; each is judged by its own text. Input
    columns of the names of the added ones are replaced by these.

    The texts' lines are hashed once, into a narrow table. Frequent lines meet it by host and line, in a
    join that Spark broadcasts while they are few and whose hot lines AQE splits beyond that; a text
    then gets only those that it holds itself, as one row for each host and hash of a text (texts that
    share a hash share that list, which is right for both, as it holds frequent lines of the host only).
    These rows grow with the corpus, so the join that brings them to the texts is a shuffle at every size.
    """
    rows, names = numbered(docs)
    body = F.col(names[text])
    keyed = rows.withColumns({"host": F.coalesce(F.col(names[host]).cast("string"), F.lit("")), "node": F.xxhash64(body)})
    keys = F.array_remove(F.array_distinct(_line_keys(body)), F.xxhash64(F.lit("")))
    keys = keyed.select(F.col(names[doc_id]).alias("doc"), "host", "node", keys.alias("lines"))
    lines = cut_lineage(keys.where(F.size("lines") > 0))
    hot = cut_lineage(frequent_lines(lines, max_docs))
    hits = lines.select("host", "node", F.explode("lines").alias("line")).join(hot, ["host", "line"])
    gone = cut_lineage(hits.groupBy("host", "node").agg(F.collect_set("line").alias("gone")))
    out = base_measures(keyed.join(gone.hint("merge"), ["host", "node"], "left"), names[text])
    out = staged(out, "keys", F.when(F.col("gone").isNotNull(), _line_keys(body)))
    rest = F.filter(F.split(body, "\n"), lambda line, i: ~F.array_contains("gone", F.get("keys", i)))
    out = staged(out, "rest", F.when(F.col("gone").isNotNull(), F.array_join(rest, "\n")).otherwise(body))
    # Only texts that lost a line are split into words again.
    left = F.when(F.col("gone").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("rest"))))
    out = out.withColumn("words_left", left.cast("long"))
    kept = ~F.col("base_failed") & (100 * F.col("words_left") >= min_left * F.col("n_words"))
    return handed_back(out.withColumn("kept", kept), names, ADDED, {text: "rest"})


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs).drop("text", "source")


SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
base AS (
  SELECT doc_id, host, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM docs
),
lines AS (
  SELECT doc_id, host, line FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
normal AS (
  SELECT doc_id, host, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key
  FROM lines
),
hot AS (SELECT host, key FROM normal GROUP BY ALL HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
gone AS (SELECT doc_id, sum(n) AS gone FROM normal JOIN hot USING (host, key) GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) >= 3)
),
twice AS (
  SELECT doc_id, i FROM windows JOIN (
    SELECT doc_id, a, b, c FROM windows GROUP BY ALL HAVING count(*) > 1
  ) USING (doc_id, a, b, c)
),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id
),
measured AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(n_words - coalesce(gone, 0) AS BIGINT) AS words_left
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
),
failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND 100 * words_left >= {MIN_LEFT} * n_words AS kept FROM failed
"""
