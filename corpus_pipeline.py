"""The corpus pipeline: documents in, a mix of clean, distinct, uncontaminated documents out.

Each stage reads all that the stage before kept. All but the last return the columns of ``documents``, whatever others
there are besides doc_id, text, lang and source and whatever they are called. In every stage any column may be null, texts
may be empty or of any length, rows may repeat, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, lines, mixing, quality, simhash
from lodestone.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those without an id or without words are never rejected."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines are cut from the texts; a source's pages of one language are a site. A null text stays null.

    A source mixes languages, and a template line of one of them may be rare among all pages of the source.
    """
    return lines.drop_boilerplate_lines(docs, F.struct("source", "lang"), counts=None)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id, null last. Null texts are equal to empty ones."""
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go; those without an id stay."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many copies of each document are taken, with what it was decided on; every document has a row."""
    return mixing.mix(docs).select("doc_id", "source", F.col("size"), "source_size", "target", "copies", "taken")


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the classifier, the fingerprints or the alignment; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order, each over what the one before kept; for odd rows see the module's docstring."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
