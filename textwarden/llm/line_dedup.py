"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import handed_back, numbered
from textwarden.sources.checkpoints import cut_lineage

#: Of a host's pages, the share above which a line is boilerplate, and the pages that must hold it at least.
MAX_RATIO, MIN_PAGES = 0.02, 10


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines: the keys of the lines on more than max_ratio of the host's pages, of (page, host, text).

    Distinct pages are counted, over all rows. Within a host more than max_ratio * pages pages
    hold each such line, so a host has at most (lines a page) / max_ratio of them.
    """
    totals = pages.select("page", "host").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: F.trim(line) != "")
    seen = (
        pages.select("page", "host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("held"))
        .where(F.col("held") >= min_pages)
    )
    return (
        seen.join(totals, "host")
        .where(F.col("held") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """The rows with boilerplate lines taken out of `text`, plus n_lines and n_dropped.

    A line is what stands between line feeds, compared without outer spaces by its
    64-bit hash; blank lines neither count nor go. A line is boilerplate on a host when
    at least min_pages of the host's pages, and more than max_ratio of them, hold it
    (rows that share an id are one page, as are rows without one).
    Null hosts form one host, together with the empty name. A null text stays null
    with 0 lines, an empty one stays empty; a text whose lines all go becomes empty.
    Input columns named n_lines or n_dropped are replaced by these.

    The texts are not shuffled while the table of boilerplate is small enough for
    Spark to broadcast it; beyond that AQE splits hot hosts of the join.
    """
    rows, names = numbered(docs)
    body = F.col(names[text])
    rows = rows.withColumn("host", F.coalesce(F.col(names[host]).cast("string"), F.lit("")))
    pages = rows.select(F.col(names[doc_id]).alias("page"), "host", body.alias("text"))
    hot = cut_lineage(boilerplate(pages, max_ratio, min_pages)).withColumnRenamed("lines", "hot")
    joined = rows.join(hot, "host", "left")
    split = F.split(body, "\n")
    kept = F.filter(split, lambda line: (F.trim(line) == "") | ~F.array_contains("hot", _key(line)))
    count = lambda lines: F.coalesce(
        F.size(F.filter(lines, lambda line: F.trim(line) != "")).cast("long"), F.lit(0)
    )
    number = F.when(body.isNull(), F.lit(0).cast("long")).otherwise(count(split))
    touched = F.col("hot").isNotNull() & body.isNotNull()
    after = F.when(touched, F.array_join(kept, "\n")).otherwise(body)
    dropped = F.when(touched, count(split) - count(kept)).otherwise(F.lit(0).cast("long"))
    out = joined.select(*names.values(), after.alias("after"), number.alias("n_lines"), dropped.alias("n_dropped"))
    return handed_back(out, names, ("n_lines", "n_dropped"), {text: "after"})


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


SQL = f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
lines AS (
  SELECT doc_id, host, line, pos
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages)
),
totals AS (SELECT host, count(DISTINCT doc_id) AS pages FROM pages GROUP BY host),
held AS (
  SELECT host, trim(line, ' ') AS key, count(DISTINCT doc_id) AS held
  FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL
),
hot AS (
  SELECT host, key FROM held JOIN totals USING (host)
  WHERE held >= {MIN_PAGES} AND held > CAST({MAX_RATIO} AS DOUBLE) * pages
),
judged AS (
  SELECT l.doc_id, l.line, l.pos, trim(l.line, ' ') <> '' AS counts, h.key IS NOT NULL AS goes
  FROM lines l LEFT JOIN hot h ON l.host = h.host AND trim(l.line, ' ') = h.key
),
built AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text,
         count(*) FILTER (counts) AS n_lines, count(*) FILTER (goes) AS n_dropped
  FROM judged GROUP BY doc_id
)
SELECT p.doc_id, b.text, coalesce(b.n_lines, 0) AS n_lines, coalesce(b.n_dropped, 0) AS n_dropped
FROM pages p LEFT JOIN built b USING (doc_id)
"""
