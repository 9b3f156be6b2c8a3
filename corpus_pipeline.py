"""Corpus pipeline: language identification, toxicity, near duplicates, benchmark decontamination, byte-pair encoding.

Each stage works on all rows that the one before kept; what it returns is written as Parquet and read again. All but the last return
the columns of documents. Rows with equal ids are separate rows. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe_automaton, decontamination, language_id, near_duplicates, toxicity
from cuelake.llm.columns import free_name, read_table
from cuelake.llm.scratch import Scratch

#: SQL can express none of the learnt stages.
ORACLE_SQL = None


def _names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _marked(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, named: an id that is never null, and a hash of the text. They tell rows apart.

    A row without an id gets one from its text, from 2 ** 62 on, so that it comes after other ids and equal texts share it.
    """
    own = free_name(docs.columns)
    text = free_name([*docs.columns, own])
    made = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return docs.withColumns({own: F.coalesce("doc_id", made), text: F.xxhash64("text")}), own, text


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified: text with letters that is not far from all learnt languages.

    Null and empty texts and those without a letter go. Each row is judged by its text alone, so repeated rows stay or go together.
    Extra columns stay as they are, whatever their names.
    """
    model = language_id.fit(language_id.training_rows(docs).withColumn("text", F.lower("text")), "text", "lang", "doc_id")
    result = free_name(docs.columns)
    found = docs.withColumn(result, language_id.identified(F.col("text"), model, spark))
    return found.where(~F.col(f"{result}.rejected")).select(*_names(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier does not call toxic; it learns from labelled rows that are not held out.

    Texts without words, null too, stay. Each row is judged by its text alone, so repeated rows stay or go together. Extra columns
    stay as they are, whatever their names.
    """
    model = toxicity.fit_labelled(docs, read_table(spark, sf_dir, "labels"))
    result = free_name(docs.columns)
    found = docs.withColumn(result, toxicity.scored(F.col("text"), model, spark))
    return found.where(F.col(f"{result}.predicted") == 0).select(*_names(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id.

    Documents without words are in no group and stay. A row without an id comes after all others. Repeated rows, of one id and one
    text, stay or go together; rows of one id with different texts are judged apart. Extra columns stay as they are.
    """
    marked, own, text = _marked(docs)
    found = near_duplicates.near_duplicates(marked, own, "text", near_duplicates.Settings(words=5, percent=80), mark=text)
    dropped = found.where(F.col("component_id") != F.col(own)).select(own, text).distinct()
    return marked.join(dropped, [own, text], "left_anti").select(*_names(docs))


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that leak no benchmark item, judged by their texts; equal texts stay or go together.

    Null and blank texts stay, and so does everything if there is no item. Rows need no id. Extra columns stay as they are.
    """
    marked, own, text = _marked(docs)
    key = free_name(marked.columns)
    keyed = marked.withColumn(key, F.struct(own, text))
    leaked = decontamination.leaks(keyed, read_table(spark, sf_dir, "benchmark"), id_col=key).select(f"{key}.*").distinct()
    return marked.join(leaked, [own, text], "left_anti").select(*_names(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hashes of the ids and of the text that they decode to.

    Null and empty texts have no ids. Each row is encoded, repeated ones too; of other columns only doc_id is kept.
    """
    return bpe_automaton.encode(docs, keep=("doc_id",))


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", not_leaked),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
