"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
gives what it reads back to the next, so a stage's lineage never reaches behind its input. All stages but the last
return the columns of documents.

Cases, for all stages but the last: a null or empty text has no words, so quality_rules drops it; rows that share a doc_id and
repeated rows each stand or fall by their own text in quality_rules and with their doc_id in the stages after it; null doc_ids are
compared like others; null sources and languages are groups of their own; extra columns are passed on; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspan.llm import decontamination, mixing, near_dup, quality, token_output
from inkspan.llm.common import cut
from inkspan.llm.queries import table, tokenizer_path

END_ID = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the outlier test reject go. A null text fails; repeated rows get one verdict."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: five words, 0.8. Rows that share
    that doc_id stay together; documents without words are like no other and stay."""
    return near_dup.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, with all rows of their doc_id."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for; rows that share a doc_id and source alike."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of token ids; a row for each document in them, so repeats are written as often as they come."""
    return token_output.token_output(docs, tokenizer_path(), END_ID)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: Neither near-dedup nor tokenisation can be said in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None
