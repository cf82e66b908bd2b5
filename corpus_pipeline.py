"""From raw documents to token ids: five stages, each of which reads what the one before kept.

1. language ID: documents that no wanted language claims go.
2. SimHash near-dedup: of each group linked by fingerprints, or by a five-word similarity of 0.8 or more, the document with
   the smallest id stays.
3. substring dedup: words of passages that also start earlier are cut; a document that loses all its words goes.
4. mixing: sources are brought to their target weights with whole documents, which may come twice or not at all.
5. BPE: each document of the mix is encoded, and decoded again.

Cases: null, empty and letterless texts go in stage 1; a null lang or source is no evidence, and the null source comes last in
stage 4; rows that repeat a doc_id or have none are documents of their own, told apart by their texts; of rows that repeat both,
one stays in stage 2; very long texts are taken whole by every stage; n_chars changes only where words were cut; further columns
pass through stages 1 to 4, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import bpe, language_id, mixing, near_copies, substring_dedup
from vigilspark.llm.queries import TOKENIZER
from vigilspark.llm.util import discard, fresh_path
from vigilspark.shipping import ship


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.accepted_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_copies.distinct_documents(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = substring_dedup.remove_repeats(docs, outputs=("n_words", "n_removed", "kept_text"))
    left = cut.where("n_words = 0 or n_removed < n_words")
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return left.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language ID", identify_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("source mix", mix_sources),
    ("BPE", encode),
]

#: Fingerprints by XXH64 and BPE have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
