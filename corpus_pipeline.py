"""The corpus pipeline: from raw documents to packed sequences in five stages.

Each stage takes the session, the documents that the one before kept, and the folder of the tables; its result is written
as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import ENTRIES, SPACE, register, table
from trackloom.llm.linededup import without_spread_lines
from trackloom.llm.mixing import mixed_documents
from trackloom.llm.packing import pack, token_pieces
from trackloom.llm.queries import toxicity_model
from trackloom.llm.simhash import one_of_each_group
from trackloom.llm.toxicity import with_toxicity
from trackloom.session import fresh_path, remove, scope

#: A document goes as toxic from this score.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score. The model is learnt from the labelled rows of the tables, not from ``docs``."""
    return with_toxicity(docs, toxicity_model(spark, sf_dir)).where(F.col("score") < TOXIC).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeats of lines found on many sites; the first document with a line keeps it.

    ``n_chars`` follows the text. A document of which no line with a word is left goes: each of its lines stands in a document
    that stays. One that loses nothing stays, even if it is empty.
    """
    done = without_spread_lines(docs)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(f"[^{SPACE[1:]}"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights; a document that is taken twice is there twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packing)]
#: No SQL can tell toxic documents by compression; the tests hold each stage against brute force.
ORACLE_SQL = None


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way, and the result of the stage before it, goes when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


__all__ = ["ENTRIES", "ORACLE_SQL", "STAGES", "run"]
