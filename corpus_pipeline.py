"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next one's docs. All but the last keep the columns of docs. Stages work on every row and the
whole text that the stage before kept:

1. language: documents whose language can't be told (margin too narrow, or no letters) go;
2. toxicity: documents scored 0.5 or more go;
3. near-dedup: SimHash fingerprints find candidates; of each group of near copies (five-word shingles,
   similarity 0.8 or more, tested exactly) the document with the smallest id stays;
4. mixing: documents are repeated or left out so that sources meet their target weights;
5. BPE: each document that the mix takes is encoded; its ids and their number come out.

Defined cases: null texts, empty ones and texts without a letter go in stage 1; texts of any length are
read whole; of rows that repeat an id one stays (stage 3), rows without an id are no copies of others and
all stay; a null source is a source of its own; ties go to the smaller id; columns that documents have
beyond the given ones, whatever their names, come through to stage 4, and stage 5 keeps source; an empty
table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, language, mixing, simhash, toxicity
from docketry.llm.common import drop_folder, free_name, modest_batches, remainder, shared_folder, vocabulary
from docketry.llm.queries import toxicity_model


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    content = language.learn(docs, remainder("doc_id", 3) != 1)
    found = free_name(docs.columns, "_found")
    return docs.withColumn(found, language.judged(F.col("text"), content)).filter(F.col(f"{found}.accepted")).drop(found)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity_model(spark, sf_dir), free_name(docs.columns, "_score")
    return docs.withColumn(score, toxicity.scored(F.col("text"), model)).filter(F.col(score) < 0.5).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"), lambda e: (e.n_tokens, e.ids), "n_tokens long, ids array<int>", keep=("source",))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: Compression, a fitted classifier and connected components have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What lies between is kept in the session's shared folder, and deleted once the next stage is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
