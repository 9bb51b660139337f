"""The corpus pipeline: documents to packed training sequences, one stage after another.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, llr, packing, parity
from quire.llm.shared import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts whose language the byte network identifies, rows and columns as they are.

    Null and empty texts go, and those whose best probability is under ``langid.MIN_PROB``. Rows that repeat are judged each, rows
    without id too; texts are read whole, however long. Without any labelled text all texts stay; an empty table stays empty.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts whose n-gram log-likelihood ratio reaches the threshold (or equals it), rows and columns as they are.

    Null and blank texts go. Rows that repeat are judged each, rows without id too; texts are read whole. Without labels of both kinds
    among the documents every text with a word or mark stays; an empty table stays empty.
    """
    return llr.keep_good(docs, llr.fit(docs, table("labels", spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of similar texts, the one of least id; columns as they are.

    Texts without a word and rows without id belong to no group and stay. Rows that repeat id and text leave one; an id of several
    texts is judged text by text. Texts are compared whole; an empty table stays empty.
    """
    return parity.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place what is left in sequences of ``packing.CAPACITY`` words, see :func:`quire.llm.packing.pack`: no row is lost.

    Texts without a word have a row without a sequence, longer ones than a sequence a row per piece; rows that repeat and rows
    without id are placed each, equal sizes by id; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]

#: The first two stages are learned models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table("documents", spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
