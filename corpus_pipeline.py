"""From raw documents to training sequences: five stages, each one operator over all its predecessor kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last
returns the packed pieces. A stage's result is written as Parquet and read again before the next one.

Cases: as in the operators; every stage takes an empty table and gives an empty one, and extra columns of the
documents come through the first four stages unchanged. Rows that repeat a doc_id share its fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import lang_cnn, line_dedup, phrase_index, setsketch, vector_packing
from lodestrata.llm.common import Scratch, default_tokenizer, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network finds in no language: null, without a letter, or no language has half of the probability."""
    return lang_cnn.keep_identified(docs, lang_cnn.fit(docs, held_out=None), least=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier document has too; every document stays."""
    return line_dedup.dedup_lines(docs, least_chars=10, least_docs=2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, a similarity of 0.8 or more."""
    return setsketch.drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have ten words in a row of a benchmark item."""
    return phrase_index.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(docs, default_tokenizer(), end_id=1)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs


#: Trained and tokenized stages can't be put in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None
