"""A training corpus from raw documents: toxic ones dropped, near copies and repeated passages removed, personal values replaced, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotweave.llm import jaccard, packing, pii, suffix_dedup, toxicity
from spotweave.llm.queries import PSEUDONYM_KEY, tokenizer_file
from spotweave.llm.store import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones scores below one half."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles of Jaccard 0.8 or more."""
    return jaccard.one_per_component(docs, n=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut; documents that lose all words go."""
    return suffix_dedup.without_repeats(docs)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become format-preserving pseudonyms."""
    return pii.pseudonymize(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("pii", replace_personal),
    ("best_fit_packing", pack),
]

#: No stage but the fourth could be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
