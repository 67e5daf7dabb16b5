"""From documents to token ids: toxic documents go, then boilerplate lines, then near copies; the rest is mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.jaccard_join import near_duplicates
from textwarden.llm.line_dedup import drop_boilerplate
from textwarden.llm.mixing import ALL_LANGUAGES, mix
from textwarden.llm.tokenize_pieces import encode_and_decode
from textwarden.llm.toxicity import score_toxicity
from textwarden.sources.checkpoints import cut_lineage


#: Near copies share this percentage of their shingles of so many words; op3's own contract is stricter.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer does not predict to be toxic; it learns from the labels of those given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return score_toxicity(rows, labels).where("predicted = 0").select("doc.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate on their source; n_chars follows the text."""
    names = ("doc_id", "text", "source")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *[F.col(c).alias(c) for c in names])
    out = drop_boilerplate(rows)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return out.select(*[new.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id. Rows without an id stay.

    Of rows that share that id the least stays, as JSON text. Ids alone tell whether there are any, so
    that documents are grouped only then.
    """
    groups = near_duplicates(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = cut_lineage(groups.where("doc_id <> component_id").select("doc_id").distinct())
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return stay
    row = F.struct(*docs.columns)
    once = stay.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.unionByName(stay.where("doc_id IS NULL"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn into the mixture; other languages than the named ones, and none, keep their share."""
    names = ("doc_id", "text", "source", "lang")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *[F.col(c).alias(c) for c in names])
    return mix(rows, ALL_LANGUAGES).where("sampled").select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_and_decode(docs, model, keep_ids=True).drop("decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mixture),
    ("SentencePiece", encoded),
]

#: The toxicity model and SentencePiece cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as a table and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
