"""From `documents` to a mixed training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs; all but the last
return the columns of docs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, mix_sources, near_dedup, substring_dedup, tables


#: Tables that the stage before has written besides its result.
_left: list[str] = []


def _stage(run):
    """A stage that begins by removing what the one before has left: its result has been written, and read again as docs."""

    @functools.wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in tables.unused(spark, _left, docs):
            tables.drop(spark, path)
            _left.remove(path)
        with tables.recorded() as made:
            out = run(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return staged


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters, or too doubtful, go."""
    model = language_id.learn(docs)
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("row")), model, F.col("row.text"), declared=F.col("row.lang"), host=F.col("row.source"))
    return found.where("accepted").select("row.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return near_dedup.keep_one(docs)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds; a text that loses nothing stays as it is."""
    wrapped = docs.select("doc_id", "text", F.struct(*docs.drop("text").columns).alias("row"))
    cut, lost = substring_dedup.dedup_substrings(wrapped), F.col("n_removed") > 0
    made = {
        "text": F.when(lost, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(lost, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return cut.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark items to a twentieth of their words or more."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their places in the mix of sources."""
    return mix_sources.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mix_sources", mix),
]

#: Language models, signatures and their classes are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between two stages is a table in the shared folder, and what a stage has written besides goes with it.

    Defined results: a document without letters in its text, or with a null or
    empty one, has no language and goes in the first stage, so no later one
    sees a null text; a null doc_id, lang or source stays a value like others
    (documents with a null id are no near duplicates and lose no passages);
    rows that repeat an id are one document to near-dedup, of which one row
    stays; columns beyond those of `documents` go through every stage, but
    those named source_block, slot and position are replaced in the last; an
    empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
