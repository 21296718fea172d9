"""The training-data pipeline: documents through five operators in order.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that ``run`` writes as Parquet and reads back as the
next stage's ``docs``.  All stages but the last return the columns of
documents; the last one adds the tokens of the texts that are left.

Defined results: language identification drops null texts, texts without a
letter and those it predicts with a score below ``language_id.MIN_SCORE``, and
fills a null lang with the prediction; a document without an id is never linked
or matched, so no other stage can drop it; of rows that repeat an id SimHash
near-dedup keeps one for each group of near copies they lead, and
decontamination judges their texts one by one; empty tables pass through; extra
columns of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe_tree, language_id, pii_anchors, simhash_vptree, template_decontam
from corpusmill.llm.common import spill_table, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told, or not with confidence;
    fill a null lang with the prediction."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash_vptree.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, verbatim or re-parameterised."""
    return template_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; ``n_chars`` becomes the length of the masked text."""
    masked = pii_anchors.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, decode the ids and keep both outcomes' proof: doc_id,
    n_tokens, ids, ids_sha256 and decoded_sha256."""
    return bpe_tree.bpe_round_trip(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

# no SQL: the language machines, the fingerprints and BPE are not expressible
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spill_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
