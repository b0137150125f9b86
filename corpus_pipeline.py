"""The corpus pipeline: documents in, clean encoded documents out. Each stage works on all that the one before it kept.

All stages but the last return the columns of documents, whatever else these are called, and leave the rows they keep in
no fixed order. Null and empty texts are not toxic, near no other, hold no test item and no secret, and encode to no
pieces, so they stay. Rows with a null doc_id are never dropped as near duplicates; as toxic each row is judged by its own
text; with decontamination they go if any of them holds a test item. Rows that repeat a doc_id count as one document for
near duplicates and decontamination: all of them stay or go. Ties between near duplicates go to the smallest doc_id. Texts
of any length are read whole. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, minhash, pieces, secret_scan, toxicity
from quillspan.llm.common import free, written
from quillspan.llm.queries import tokenizer_path


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 over five-word shingles, the document with the smallest id stays."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    (gone,) = free(docs.columns, "gone_id")
    dropped = found.where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or 13 words of one, go."""
    return decontaminate.decontaminated(docs, _benchmark(spark, sf_dir))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    out = secret_scan.masked(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of its pieces."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

#: trained scores and piece searches are beyond SQL: the stages are tested one by one against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
