"""Python workers, which Spark reuses, do not carry the tables of one stage into the next."""

import time

import pytest

from graphloom.llm import bpe, op2_toxicity, op3_line_dedup, op6_packing


def held(spark) -> int:
    """Token tables that workers hold."""

    def probe(batches):
        import pyarrow as pa

        list(batches)
        time.sleep(0.05)
        yield pa.RecordBatch.from_arrays([pa.array([bpe.batch_coder.cache_info().currsize])], ["n"])

    return spark.range(64, numPartitions=64).mapInArrow(probe, "n long").groupBy().sum().first()[0]


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup"])
def test_token_tables_go(spark, stage):
    docs = spark.createDataFrame([(i, f"some words of text {i}\nand a line {i % 7}") for i in range(640)], "doc_id long, text string").repartition(64).localCheckpoint()
    assert op6_packing.pack(docs).count() >= 640
    assert held(spark) > 0
    if stage == "toxicity":
        assert op2_toxicity.score_toxicity(docs, op2_toxicity.lexicon_model()).groupBy().sum("score").first()[0] is not None
    else:
        op3_line_dedup.removed_lines(docs)
    assert held(spark) == 0


def test_coder_table_follows_its_words():
    import pyarrow as pa

    coder = bpe.BatchCoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = [f"word{i} of text{i} and number {i}" for i in range(9000)]
    got = coder.encode(pa.array(texts))
    assert got == [coder.one.encode(t) for t in texts]
    held = sum(x.nbytes for x in vars(coder).values() if hasattr(x, "nbytes"))
    assert held < 64 << 20  # a slot for each id that a word may have would take 138 MB
