"""From raw documents to packed token ids, stage by stage.

Each stage is written and read again, so a lost executor costs no more than the work
of the stage it was lost in.

Defined results, for every stage: extra columns go along (the last returns its own
columns); a NULL or empty text is neither toxic nor contaminated nor a near duplicate,
has no words for the mix to take, and is the end id alone when packed; a row with a
NULL id is judged by its text, and as a near duplicate goes if a row with an id is in
its group; rows with the same id and text are one document for near duplicates and
single rows elsewhere; a NULL source is a source of its own; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsengine.llm import decontamination, mixing, near_duplicates, packing, toxicity
from tsengine.llm.common import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't find toxic."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles."""
    return near_duplicates.keep_first(docs, near_duplicates.Spec(shingle=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares."""
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Learned scores, hashes and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs
