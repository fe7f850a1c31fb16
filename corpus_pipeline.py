"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Documents without any letter go, then toxic ones, then near copies but one of each group; what is left has
its personal data replaced and is packed into token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import langid, ngram_join, packing, pii, toxicity
from rankweave.llm.common import stage, unused


#: Most rows of an Arrow batch between Spark and Python: documents are long, and both sides hold batches whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, where it has more; results are the same with any number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keep_columns(docs: DataFrame, names: tuple[str, ...], judge) -> DataFrame:
    """The rows that ``judge`` keeps of ``docs``, with the columns of ``docs``, those too that are called like one of the ``names`` it makes."""
    own = [c for c in docs.columns if c.lower() in names]
    held = dict(zip(own, unused(docs, *(f"own_{c}" for c in own)), strict=True))
    return judge(docs.withColumnsRenamed(held)).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told; ``und`` ones (null, empty, no letter) are rejected."""
    small_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return keep_columns(docs, ("lang_pred", "score"), lambda df: langid.identify(df, model).where(F.col("lang_pred") != langid.UNKNOWN))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are likelier not toxic, by a model of the labelled documents among them."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_columns(docs, ("severity", "grade", "toxic"), lambda df: toxicity.grade(df, model).where(~F.col("toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles with a Jaccard similarity of 0.75 link: the one with the least doc_id."""
    small_batches(spark)
    return ngram_join.keep_one(docs, words=5, percent=75)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind and n_chars counted anew."""
    small_batches(spark)
    (spans,) = unused(docs, "pii_spans")
    out = pii.redact(pii.find_pii(docs, spans_col=spans), spans_col=spans)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: No SQL: classifiers and packing cannot be expressed in it; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
