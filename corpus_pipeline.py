"""A training corpus from documents, in five stages.

Each stage takes all rows that the one before kept. A language must be found; lines that resemble earlier ones go, and
documents that lose all their lines with them; of near-duplicates the document with the least id stays; documents that hold
a benchmark passage go; what is left is sampled to the target mix. All stages but the last return the columns of documents,
n_chars being counted anew where lines went. Nulls, repeated rows and further columns are treated as the operators say.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm import decontamination, language, linededup, mixing, resemblance, simhash
from platter.llm.common import checkpoint_folder, fresh, table
from platter.llm.queries import MIX_SHARE, MIX_TARGETS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    went = fresh(docs, "removed_lines")
    found = linededup.dedup(docs, percent=80, min_chars=1, removed_col=went)
    found = found.filter((F.size(went) == 0) | F.rlike("text", F.lit("[^ \\t-\\r]")))
    n_chars = F.when(F.size(went) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Linked are fingerprints of at most three different bits, and texts whose five-word shingles have a Jaccard of 0.8 or more."""
    return simhash.keep_first(docs, shingle=3, alike=resemblance.links(docs, percent=80, shingle=5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their tokens and the probability that they were sampled with."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = mixing.mix(plain, MIX_TARGETS, MIX_SHARE).filter("mix.kept")
    return found.select(*plain.columns, F.col("mix.topic").alias("topic"), F.col("mix.tokens").alias("n_tokens"), F.round("mix.probability", 6).alias("probability"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]

#: Trained models and fuzzy keys are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; those of each stage are stored in the shared folder before the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
