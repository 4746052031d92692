"""The corpus pipeline: five stages over ``documents``, each a table that the next one reads.

Every stage works on all that its predecessor kept, and its decisions take
effect: toxic documents go, one document of each near-duplicate group stays,
benchmark passages are cut out (documents mostly made of them go), secrets are
replaced, and the last stage samples to target weights. All but the last return
the columns of ``documents``.

Defined cases: an empty table gives an empty one; null, empty and very long texts,
repeated rows and extra columns of any name pass as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, secrets, simhash, toxicity
from tessera.session import release, stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id stays."""
    return simhash.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten or more words of a benchmark item, and whole shorter items of any length, are cut out; documents mostly made of them go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.train(spark, docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens fit the target weights of sources, languages and topics."""
    return mixing.sample(docs)


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("decontamination", benchmark), ("secrets", secret_scan), ("mixing", mixed)]

#: A trained model, a suffix automaton and iterative fitting can't be written as one statement; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
