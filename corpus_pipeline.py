"""From documents to packed training sequences.

Each stage works on all that the stage before kept; ``run`` writes every result
as Parquet into the shared folder and reads it again, and removes it once the
next one is written.  Null and empty texts are clean documents of no lines and
shingles; they pass all stages and are packed as their end id.  Null ids pass
too.  An empty table gives no pieces.  Further columns stay up to packing.  No stage has SQL: scores,
set joins, alignments and token ids lie beyond it, so ``ORACLE_SQL`` is None and
the operators are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, op2_toxicity, op3_line_dedup, op4_decontam, op5_ngram_join, op6_packing


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the documents given."""
    model = op2_toxicity.fit(op2_toxicity.training_rows(docs, common.read_table(spark, sf_dir, "labels")))
    return op2_toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one; n_chars follows the text."""
    out = op3_line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group.

    Repeated rows of one id and text stay once; further texts under the id of a
    survivor stay too, as they are other documents; rows with a null id all stay.
    """
    kept = op5_ngram_join.ngram_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    key = common.free_name(docs, "text_key")
    once = docs.join(kept, "doc_id", "left_semi").withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return once.select(docs.columns).union(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op4_decontam.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all remaining documents."""
    return op6_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.dropped(before)
        before = docs
    return docs
