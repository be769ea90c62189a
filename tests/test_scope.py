"""Searches that are cancelled or run out of time end and leave nothing; others give the same rows inside a scope."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graphs
from graphloom.operators import traverse as tr
from graphloom.sources.tables import Scope, Stopped, shared_dir


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("Calls").alias("kind"))


def tables_of(scope):
    return os.path.exists(scope.folder.removeprefix("file:"))


@pytest.mark.parametrize("how", ["deadline", "cancel"])
def test_a_long_path_stops(spark, how):
    edges = chain(spark, 100_000)
    scope = Scope(spark, 3 if how == "deadline" else None)
    if how == "cancel":
        threading.Timer(3, scope.cancel).start()
    at = time.time()
    with pytest.raises(Stopped, match="within 3 seconds" if how == "deadline" else "cancelled"), scope:
        graphs.shortest_path(edges, 0, 99_999, max_depth=100_000)
    assert time.time() - at < 20 and scope.tables > 0
    assert not tables_of(scope)
    assert spark.range(3).count() == 3  # the session goes on


def test_a_running_job_is_interrupted(spark):
    slow = spark.range(8, numPartitions=8).select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)").alias("x"))
    scope, at = Scope(spark, 2), time.time()
    with pytest.raises(Stopped), scope:
        slow.collect()
    assert time.time() - at < 30 and not tables_of(scope)


def test_same_rows_inside_and_out(spark):
    edges = chain(spark, 6).union(spark.createDataFrame([(3, 1, "Calls")], "src long, dst long, kind string"))
    nodes = spark.range(7).select("id", F.lit("Function").alias("kind"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("q"), "id").alias("qualified_name"), F.lit("f").alias("file"))
    work = lambda: (graphs.shortest_path(edges, 0, 5).collect(), sorted(graphs.impact(nodes, edges, 4).collect()), sorted(tr.strong_components(edges.select("src", "dst")).collect()))
    with Scope(spark, 600) as scope:
        inside = work()
    assert inside == work() and tables_of(scope)
    scope.drop()
    assert not tables_of(scope)


def test_other_errors_stay_and_leave_nothing(spark):
    with pytest.raises(ValueError, match="nodes visited"), Scope(spark) as scope:
        graphs.shortest_path(chain(spark, 50), 0, 49, max_depth=50, max_visited=2)
    assert not tables_of(scope) and os.path.isdir(shared_dir(spark).removeprefix("file:"))


def test_work_after_a_cancel_does_not_start(spark):
    scope = Scope(spark)
    scope.cancel()
    with pytest.raises(Stopped), scope:
        tr.strong_components(chain(spark, 3).select("src", "dst"))
    assert scope.tables == 0
