"""From raw documents to packed token ids, in five stages.

Each stage takes all that its predecessor kept.  run() writes every stage's
result to the shared folder and reads it back, so that a lost executor costs no
more than the stage at hand.  Mixing takes 1.35 times the tokens there are, with
weights close to the natural ones, so that small leaves repeat and hardly any document is left out.

There is no ORACLE_SQL: SQL expresses neither the fitted classifier nor the
tokenizer; tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scenequery.llm import common, decontaminate, minhash, mixing, quality, tokens

ORACLE_SQL = None
MIX = {"share": 1.35, "alpha": 0.9, "max_epochs": 4}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, common.table(common.session(spark), sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    return minhash.keep(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(common.session(spark), sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, **MIX)


def token_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    common.session(spark)
    return tokens.read(tokens.write(docs, tokenizer, end_id=2))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontaminate", uncontaminated_documents),
    ("mixing", mixed_documents),
    ("tokens", token_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
