"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tracewell.llm import conversation_trie, decontaminate, lexical_search, lm_scoring, ngram_join, ogg, packing, quality_rules, source_mixing, token_counts, token_files, toxicity, url_filter
from tracewell.llm.common import table

#: The id that ends a document.
END = 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("char_divergence", "word_divergence")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END).drop("ids")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.run(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_url_filter_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query under the name that it had while op8_url_filter stopped at the fourth segment."""
    return op8_url_filter(spark, sf_dir)


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_token_files, op4_lm_scoring, op5_token_counts, op6_packing, op7_source_mixing, op8_url_filter, op9_ogg, op10_ngram_join, op11_lexical_search, op12_decontamination, op13_conversation_trie)}

#: Registered besides the ten.
VARIANTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_url_filter_whole": op8_url_filter_whole}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle(),
    "op4_lm_scoring": lm_scoring.oracle(),
    "op7_source_mixing": source_mixing.oracle(),
    "op8_url_filter": url_filter.oracle(),
    "op10_ngram_join": ngram_join.oracle(),
    "op11_lexical_search": lexical_search.oracle(),
    "op12_decontamination": decontaminate.oracle(),
    "op13_conversation_trie": conversation_trie.oracle(),
}
