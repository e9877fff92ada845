"""A training corpus from raw documents: each stage calls one operator of ``tracelake.llm`` on all that is left.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, line_dedup, mixing, simhash, toxicity_nnpu
from tracelake.llm.common import table
from tracelake.llm.queries import TOXIC, vocabulary
from tracelake.scratch import Owner, cut, drop


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go; null and empty texts score like a text without marks and stay."""
    model = toxicity_nnpu.fit(docs, table(spark, sf_dir, "labels"))
    name = "toxic score"
    while name in docs.columns:
        name += "_"
    return toxicity_nnpu.score(docs, model, name=name).where(F.col(f"`{name}`") < TOXIC).select(*_own(docs))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; every document stays, with its new length. Null texts stay null."""
    out = line_dedup.dedup_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id. Documents with a null id all stay."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and parts of documents, so that the sources' words come near their targets. Documents without words go."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids of every text, and digests of ids and of the decoded text; a null text counts as empty."""
    return bpe.digests(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near-dedup", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: The learned and the tokenizing stages cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. When a stage's rows are written, the tables that it and the stage before left are deleted, and
    no others, so runs may go side by side. The last stage's input stays for the result, and belongs to the caller's owner."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with Owner() as own:
            made = stage(spark, docs, sf_dir)
        before, docs = docs, cut(made)
        own.release(spark)
        if i:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
