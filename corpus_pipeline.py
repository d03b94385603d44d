"""From raw documents to a training mix: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm import decontamination, exact_dedup, mixing, quality, simhash
from codescope.llm.tables import aside, table
from codescope.plans.lineage import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    columns, (docs, given_back) = docs.columns, aside(docs, ["p_text", "p_page", "p_quality"])
    kept = quality.scored(docs, model).where(F.col("p_quality") >= quality.KEEP)
    return given_back(kept.drop("p_text", "p_page", "p_quality")).select(columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each set of equal texts."""
    return exact_dedup.first_of_each(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return simhash.first_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered from one; those it takes never are left out.

    The number is called ``copy``, with as many underscores behind as make it differ from the columns of ``docs``.
    """
    number = "copy"
    while number in (c.lower() for c in docs.columns):
        number += "_"
    columns, (docs, given_back) = docs.columns, aside(docs, ["size", "source_size", "target", "repeats"])
    mix = mixing.mixed(docs).where("repeats > 0")
    numbered = mix.withColumn(number, F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return given_back(numbered.drop("size", "source_size", "target", "repeats")).select(*columns, number)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: A classifier that is trained here decides what the first stage keeps, which SQL cannot say.
ORACLE_SQL = None
