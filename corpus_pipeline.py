"""Training-data pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` has the columns of
``documents`` (doc_id, text, lang, source, n_chars), and all stages but the
last return those. Each is written as Parquet and read again as the next one's
input.

- ``toxicity`` drops documents that the classifier gives ``REJECT`` or more, the
  score from which operator 2 calls a document toxic.
- ``near_dedup`` keeps one row, that of the smallest doc_id, of each group of
  documents whose five-word shingles have a similarity of 0.8 or more.
- ``substring_dedup`` removes passages of 50 bytes and more that an earlier
  document has. A character of which some bytes would stay stays whole; a
  document of which nothing stays keeps an empty text; n_chars follows.
- ``packing`` packs what is left into sequences of 2048 tokens.

Defined results: null texts count as empty; rows are told apart by all their
values, so of rows of one doc_id each is kept or dropped by its own text, and of
equal rows one stays; a null doc_id comes after all others; other columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import packing, simhash, suffix_dedup, toxicity
from threadloom.llm.common import ensure_checkpoint_dir, table
from threadloom.llm.queries import vocab_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score from which a document is rejected.
REJECT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.labelled_sample(docs, labels, toxicity.learnable()))
    return toxicity.score_column(docs.select(COLUMNS), model, name="_toxicity").filter(F.col("_toxicity") < REJECT).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs.select(COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocab_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_repeats), ("packing", pack)]

#: Training, SimHash and tokenization are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
