"""Token counts by heap-and-linked-list byte-pair merging.

Null and empty texts count 0.  Every row of the input gives one row; repeated
rows and null ids are kept as they are.  Other columns of the input are left
out.  The operator is a map without any shuffle: a task holds one Arrow batch of
texts, very long ones whole, and a table of words of bounded size, in which each
word is merged once and then looked up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, words

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row."""
    path = tokenizer_file or bpe.tokenizer_path(TOKENIZER)
    common.small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        counter = bpe.batch_counter(path)
        for b in batches:
            _, at = words.raw(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(counter.count(b.column(1)))], ["id", "n_bytes", "n_tokens"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    out = src.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return out.select(out["id"].alias(id_col), "n_bytes", "n_tokens", (out["n_tokens"] > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
