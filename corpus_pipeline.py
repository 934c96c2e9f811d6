"""A corpus pipeline over the table documents: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes what its predecessor kept, as read back from Parquet. All but the last
return the columns of documents: the first three drop rows, the fourth rewrites texts. The
last returns the token counts and digests of every document left.

Rows are told apart by doc_id and text, null or not, so a decision about one row never touches
another with the same id. Rows that agree in both are one document and share its fate. Columns
beside doc_id, text, lang and source are carried along, whatever their names. An empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from repairlens.llm import language, near_dedup, secrets, shared, word_bpe
from repairlens.llm import decontaminate as leaks

#: Rows to drop are broadcast up to so many, counted first; more are joined by sort and merge.
DROPPED_BROADCAST = 200_000

#: Texts whose shingle sets have this Jaccard similarity or more are near copies.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: also null and empty texts, and texts without letters. A null lang or source is missing evidence."""
    judged = language.identify(language.evidence(docs))
    return shared.without(docs, judged.where("NOT kept").select("id", "row"), DROPPED_BROADCAST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group. Texts without words and rows with a null id stay."""
    judged = near_dedup.judged(shared.keyed(docs), percent=NEAR_PERCENT)
    return shared.without(docs, judged.where("NOT kept").select("id", "row"), DROPPED_BROADCAST)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, rows with a null id among them. Null and empty texts hold none."""
    judged = leaks.judged(shared.keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shared.without(docs, judged.where("contaminated").select("id", "row"), DROPPED_BROADCAST)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret span by a mark; null texts stay null."""
    return secrets.redact(docs, secrets.find_secrets(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document left, one row each; null and empty texts have no tokens."""
    return word_bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode_tokens),
]

#: The first stage fits a text model and the second looks for components: no SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with shared.scratch():  # what a stage wrote besides its result goes when the result is there
            docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
