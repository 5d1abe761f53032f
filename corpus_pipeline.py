"""A training-corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

toxicity and decontamination drop documents, line dedup drops lines (of a source, as a site), near-dedup keeps one
document of each group, and the last stage encodes what is left. run() feeds each stage what the one before it
kept, through Parquet in the shared folder.

All stages but the last return the columns of documents. Null texts count as empty; rows without doc_id are judged by
the other stages but are never dropped as copies; of rows that repeat, one stays; different texts under one doc_id are
judged apart; a null source is a source of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import bpe, line_dedup, similar, toxicity, winnow
from lagweave.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A source mixes many sites, so a line that one of its templates repeats is on a smaller share of its documents than
#: a site's own lines are on the site's pages: a twentieth counts.
SOURCE_RATIO = 0.05
#: No SQL for trained models and components of near copies; tests/llm compare run() with brute force.
ORACLE_SQL = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_boilerplate(docs, ratio=SOURCE_RATIO, host="source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.bpe(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
