"""The training-data operators as named queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lang_cnn, line_dedup, mpeg_audio, phrase_index, rendezvous, repair_grammar, setsketch, subword_quality, vector_packing, wrapper_html
from .common import default_tokenizer, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op4_near_duplicates": setsketch.ORACLE,
    "op5_decontamination": phrase_index.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_rendezvous": rendezvous.ORACLE,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_repair_tokens(spark, sf_dir):
    return repair_grammar.grammar_tokens(read_table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2)[1]


@query
def op2_mpeg_audio(spark, sf_dir):
    return mpeg_audio.text_features(read_table(spark, sf_dir, "documents"))


@query
def op3_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subword_quality.fit(docs, read_table(spark, sf_dir, "labels"), target="quality", held_out=0)
    return subword_quality.score_documents(docs, model)


@query
def op4_near_duplicates(spark, sf_dir):
    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op5_decontamination(spark, sf_dir):
    return phrase_index.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


@query
def op6_html_text(spark, sf_dir):
    return wrapper_html.extract(read_table(spark, sf_dir, "pages"))


@query
def op7_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return lang_cnn.language_report(docs)


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


@query
def op9_rendezvous(spark, sf_dir):
    equal = {shard: 1.0 for shard in range(8)}
    return rendezvous.assign(read_table(spark, sf_dir, "documents"), equal, grown=equal | {8: 1.0})


@query
def op10_vector_packing(spark, sf_dir):
    return vector_packing.pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1)
