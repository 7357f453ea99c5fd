"""The corpus pipeline: toxicity, quality rules, near duplicates, mixing, packing.

Each stage takes all rows that the one before kept, written as Parquet and read again. A stage's
folder is removed when the next one is written; the last, which the result is read from, stays.

Defined cases, for every stage: a null text counts as an empty one, and a null doc_id, lang or source
as a value of its own. An empty table gives an empty table with the same columns. Very long texts are
treated whole. Repeated rows are judged alike. Columns that documents has besides its own go through all stages
but the last unchanged, whatever their names. What each stage adds to this:

    toxicity        rows are rejected from a score of 0.7; a document without text is not toxic by
                    its text and has the score of an empty one
    quality_rules   documents of fewer than 50 words go, so empty ones do too
    ngram_join      repeated rows, and texts without words, are copies of each other; the one with the
                    least doc_id stays, of ties the one with the least hash of its columns
    source_mixing   a row that is taken k times is k rows; empty texts, of size 0, are never taken
    packing         a row is one document, however often it occurs; of these columns it returns doc_id
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import ngram_join, packing, quality_rules, source_mixing, toxicity
from tracewell.llm.common import remove, shared_dir, table

#: The id that ends a document.
END = 2
#: What a sequence of the corpus may hold besides its tokens: documents, and the attention cost of one whole sequence.
MOST_DOCS = 16
MOST_COST = int(packing.cost_of(packing.LENGTH))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity model, fitted to the labelled ones among them, does not reject."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rules and whose histograms are near those of their language."""
    return quality_rules.keep(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class."""
    return ngram_join.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as their sources' targets take them, texts whole."""
    return source_mixing.mix(docs, cut_texts=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 1024 tokens."""
    return packing.run(docs, public_tokenizers.path("byte_bpe_50k.json"), END, max_docs=MOST_DOCS, max_cost=MOST_COST)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", by_quality_rules),
    ("ngram_join", one_of_near_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: The toxicity model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
