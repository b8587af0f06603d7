"""The training-data pipeline over `documents`: each stage applies one operator, and its decisions take effect.

A stage takes (spark, docs, sf_dir) and returns the rows that the next one works on; all but the last
return the columns of documents.  run() writes each stage's result as Parquet to the shared folder and
reads it again, so a lost executor never costs more than the stage at hand.  A stage's input is deleted once
its result is written.

All stages take null texts and ids, repeated rows, empty tables, extra columns with any names (they come along,
but for the last stage) and texts of any length; what each does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import languageid, ngramjoin, packing, qualityclassifier, secrets
from parley.llm.common import deleted, saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those of no language in particular, go.

    A row without an id stays if its text has a language; repeated rows stay or go alike.  With nothing to
    learn from, every document goes.
    """
    return languageid.accepted(docs, languageid.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 0 go.

    Null and empty texts are scored as texts without features; repeated rows stay or go alike.  Without labels
    of both kinds the share of label 1 is every score.
    """
    return qualityclassifier.accepted(docs, qualityclassifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays: shingles of five words, 0.8 alike.

    Of rows that repeat an id one stays; null and empty texts and rows without an id are linked with nothing and
    stay.  Ties go to the least id.
    """
    return ngramjoin.one_of_each(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, with n_chars counted anew; every row stays, null texts as they are."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 4096 tokens: a row for each piece; a null or empty text is one piece of one id."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]

#: SQL can't express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        if k:
            deleted(before)
    out = saved(STAGES[-1][1](spark, docs, sf_dir))
    deleted(docs)
    return out
