"""From documents to token files: the stages of a corpus run.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of documents, whatever they are called and whichever others there are; the last
returns a row per document of the token tables. Texts are read whole, however long. An empty table
stays empty, and gives no token tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, mixing, near_dedup, quality_rules, token_tables
from weftline.llm.common import keep_rows, materialise, release, workspace
from weftline.llm.queries import table, tokenizer_path
from weftline.scratch import scoped


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go. Rows are judged one by one, so repeated rows stay or go
    together. Without labels only the base rules reject.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays (five-word shingles, similarity 0.8).

    Rows with one doc_id are one document: rows that the table repeats stay together. A null doc_id, and
    a text without words, is linked with nothing and stays.
    """
    found = near_dedup.near_duplicates(docs)
    return keep_rows(docs, found.filter(~F.col("kept")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go.

    Null and empty texts contain nothing and stay. Equal rows are judged alike, null doc_ids included.
    An empty benchmark removes nothing.
    """
    return keep_rows(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens (KEEP) whose sources, languages and fitted topics have the target shares, as far as tokens allow.

    Null sources and languages are categories of their own. Rows of one doc_id draw one number. Where no
    text has a word nothing stays.
    """
    return mixing.sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token tables of what is left; a row per document, read back from them.

    Null and empty texts have the end id alone; repeated rows are written as often as they come.
    """
    return token_tables.tokenize_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Thresholds from binomial tails, MinHash components and tokenizer ids are not for SQL; tests/llm
#: compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    path = workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with scoped(spark):  # what a stage wrote on its way goes once its result is written
            docs = materialise(stage(spark, docs, sf_dir), f"{path}/{name}")
        release(spark)
    name, stage = STAGES[-1]  # the token tables stay
    return materialise(stage(spark, docs, sf_dir), f"{path}/{name}")
