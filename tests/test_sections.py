"""Sections are written by the tasks that hold the rows and read once; small ones share a task."""

import pytest
from pyspark.sql import DataFrame

from graphloom.sources import index_files as ix


def test_writing_deals_nothing_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: pytest.fail("rows are made twice and shuffled"))
    df = spark.range(90, numPartitions=45).selectExpr("id", "if(id % 2 = 0, 'a', 'b') AS kind")
    ix.save(f"{tmp_path}/i", {"edges": df})
    t = ix.load(spark, f"{tmp_path}/i")["edges"]
    assert sorted(t.collect()) == sorted(df.collect()) and t.rdd.getNumPartitions() == 1  # 90 sections
    b = ix.load(spark, f"{tmp_path}/i", {"edges": ["b"]})["edges"]
    assert sorted(b.collect()) == sorted(df.where("kind = 'b'").collect())


def test_every_section_is_in_one_partition():
    sections = [(f"{k}", "x", rows, "") for k, rows in enumerate([1, ix.TASK_ROWS + 5, 7, ix.TASK_ROWS - 7, 1] * 10)]
    parts = ix.SectionReader("", sections, False, None).partitions()
    assert [s.name for p in parts for s in p.sections] == [s[0] for s in sections]
    assert all(len(p.sections) == 1 or sum(s.rows for s in p.sections) <= ix.TASK_ROWS for p in parts) and len(parts) < len(sections)
    assert len(ix.SectionReader("", sections, True, None).partitions()) == len(sections)
