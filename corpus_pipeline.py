"""The corpus pipeline: toxicity filter, near-duplicate groups, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that
the stage before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import chosen_path, packing, rlz, toxicity
from skyloom.llm.common import discard, id_key, load, materialize
from skyloom.llm.queries import WORD_BPE

#: SQL can't express a learned score, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class of near-duplicates: the one with the least doc_id.

    Documents without a word stay. Of rows with the same id and text, one stays.
    """
    classes = chosen_path.link_classes(docs)
    # An id stays if it is its class's name; with several texts under one id, all that name one do.
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(id_key().alias("__id")).distinct()
    out = docs.withColumn("__id", id_key()).join(kept, "__id", "left_semi")
    return out.dropDuplicates(["__id", "text"]).drop("__id")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a window of 20 words repeats from earlier text go; n_chars follows the text.

    Columns with the names of the operator's counts are passed through like any other.
    """
    held = {c: f"__{c}" for c in ("n_words", "n_removed") if c in docs.columns}
    out = rlz.dedup(docs.withColumnsRenamed(held)).drop("n_words", "n_removed")
    out = out.withColumnsRenamed({b: a for a, b in held.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, WORD_BPE, end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written result of the one before.

    A stage's table is deleted once the next one is written; the last stage keeps what it reads.
    """
    docs = load(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if held is not None:
            discard(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
