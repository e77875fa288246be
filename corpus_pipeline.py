"""A corpus from documents to token ids: language, quality, near duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's docs. Every stage but the last returns the columns of documents. A document read more than once in the
mixture is a row for each time.

Defined results: a null or empty text, and one without a letter, has no language and goes in the first stage. Nulls in
other columns do no harm: a null doc_id is no near duplicate of anything, a null source is a source of its own. Repeated rows
of one doc_id and text stay together: they are one document, kept or dropped in all its rows. Very long texts are read whole. Extra
columns are dropped. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard, langid, mixing, quality
from ledgerloom.llm.common import discard, held_out, materialise, table

#: A text whose language the model is less sure of than this is rejected, as is one without a language.
LEAST_LANGUAGE_SCORE = 0.45
#: A text scored lower than this is rejected.
LEAST_QUALITY = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a sure language."""
    model = langid.fit(docs.where(~held_out()))
    found = langid.predict(docs, model, keep=COLUMNS[:1] + COLUMNS[2:] + ("text",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality model accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = quality.score(docs, model, keep=COLUMNS[:1] + COLUMNS[2:] + ("text",))
    return found.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near duplicates; one without a key stays."""
    groups = jaccard.components_of(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads each source as often as the mixture says: every document once at least."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every reading."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: SQL cannot express the language and quality models; tests/llm/test_brute.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
