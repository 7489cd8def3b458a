"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Null, empty and letterless texts end
at the first stage, as no language can be told; an empty table gives empty results throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenmark.llm.common import discard, discard_since, mark, written
from tenmark.llm.decontaminate import decontaminated
from tenmark.llm.language import fit_languages, identified
from tenmark.llm.near_duplicates import deduplicated
from tenmark.llm.packing import best_fit_packing
from tenmark.llm.registry import table, vocabulary
from tenmark.llm.secrets import redacted

#: A classifier, a graph search and a packing decide here; SQL has none of them.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; the model learns from the labelled ones among them."""
    return identified(docs, fit_languages(docs, F.col("lang").isNotNull()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (similarity 0.8 or more) connect, the smallest id stays."""
    return deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of the benchmark cover a twentieth of the words or more go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, ``n_chars`` follows its text."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids; one row per piece."""
    return best_fit_packing(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table. What a stage wrote on its way goes once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        start, before = mark(), docs
        docs = written(stage(spark, docs, sf_dir), name)
        discard_since(start, keep=docs)
        if stage is not STAGES[0][1]:
            discard(before)
    return docs
