"""The training-data pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm import line_dedup, mixing, near_dedup, packing, toxicity
from skybias.llm.tables import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score rejects go; the model is fitted on the labelled documents of the input."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of like lines stays; a document that loses all its lines goes."""
    rows = line_dedup.without_emptied(line_dedup.dedup_lines(docs))
    return rows.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    gone = stored(near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL expresses none of the learnt, hashed and tokenised stages; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
