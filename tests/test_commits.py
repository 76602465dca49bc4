"""Bucketed tables and commits: whole results, untouched buckets, interrupted runs and second writers."""

import threading

import pytest
from pyspark.sql import functions as F

from citewell.operators import incremental
from citewell.sources import commits as K

SCHEMA = "id long, source string, text string, created_at timestamp, updated_at timestamp"


def day(month):
    return F.lit(f"2024-0{month}-01 00:00:00").cast("timestamp")


def rows(spark, ids, text):
    return spark.createDataFrame([(i, f"s{i % 3}", f"{text}{i}") for i in ids], "id long, source string, text string")


@pytest.fixture
def log(spark, tmp_path):
    commits = K.Commits(spark, f"file://{tmp_path}/store")
    stage = K.upsert(commits, "chunks", rows(spark, range(200), "a"), ["id"], day(1), SCHEMA, 16)
    assert commits.commit(0, [stage]) == 1
    return commits


def as_set(df):
    return {tuple(r) for r in df.select("id", "source", "text", F.col("created_at").cast("string"), F.col("updated_at").cast("string")).collect()}


def test_upsert_and_prune_equal_the_whole_table_rewrite(spark, log):
    new = rows(spark, [*range(5), 900, 901], "b")
    stored = log.read("chunks")
    want = incremental.prune(incremental.upsert(stored, new, ["id"], day(2)), rows(spark, [*range(0, 200, 2), 900, 901], "k").select("id"), {"source": "s1"})
    want = as_set(want)
    stage = K.upsert(log, "chunks", new, ["id"], day(2), SCHEMA, 16)
    stage = K.prune(log, "chunks", rows(spark, [*range(0, 200, 2), 900, 901], "k").select("id"), {"source": "s1"}, ["id"], staged=stage)
    before = as_set(log.read("chunks"))
    assert log.commit(1, [stage]) == 2
    assert as_set(log.read("chunks")) == want
    assert as_set(log.read("chunks", number=1)) == before  # readers of the earlier commit are not disturbed


def test_untouched_buckets_are_neither_read_nor_written(spark, log):
    one = rows(spark, [7], "b")
    touched = K.touched_buckets(one, ["id"], 16)
    assert len(touched) == 1
    stored = log.read("chunks", buckets=touched)
    assert stored.inputFiles() and all(f"/bucket={touched[0]}/" in f for f in stored.inputFiles())
    stage = K.upsert(log, "chunks", one, ["id"], day(2), SCHEMA, 16)
    assert set(stage.parts) == set(touched)
    before = log.state()[1]["chunks"]["parts"]
    log.commit(1, [stage])
    after = log.state()[1]["chunks"]["parts"]
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    assert log.read("chunks").count() == 200


def test_a_small_increment_leaves_the_stored_side_in_place(spark, log):
    new, stored = spark.range(7, 8).select("id", F.lit("s1").alias("source"), F.lit("b").alias("text")), log.read("chunks")
    met = stored.join(new.select("id", F.struct("source", "text").alias("_new")), ["id"], "left")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_run_that_dies_leaves_all_tables_as_they_were(spark, log):
    log.commit(1, [K.upsert(log, "maps", rows(spark, range(9), "m"), ["id"], day(1), SCHEMA, 4)])
    chunks, maps = as_set(log.read("chunks")), as_set(log.read("maps"))
    K.upsert(log, "chunks", rows(spark, range(50), "new"), ["id"], day(2), SCHEMA, 16)
    K.upsert(log, "maps", rows(spark, range(50), "new"), ["id"], day(2), SCHEMA, 4)
    broken = rows(spark, range(9), "x").withColumn("text", F.raise_error(F.lit("third write")))
    with pytest.raises(Exception, match="third write"):
        K.upsert(log, "sources", broken, ["id"], day(2), SCHEMA, 4)
    assert as_set(log.read("chunks")) == chunks and as_set(log.read("maps")) == maps
    assert log.sweep() >= 2 and as_set(log.read("chunks")) == chunks


def test_the_second_of_two_writers_fails(spark, log):
    a = K.upsert(log, "chunks", rows(spark, [1], "a2"), ["id"], day(2), SCHEMA, 16)
    b = K.upsert(log, "chunks", rows(spark, [1], "b2"), ["id"], day(2), SCHEMA, 16)
    assert log.commit(1, [a]) == 2
    with pytest.raises(K.Conflict):
        log.commit(1, [b])
    assert log.read("chunks").where("id = 1").first()["text"] == "a21"


def test_of_many_writers_at_once_one_wins(spark, log):
    stages = [K.upsert(log, "chunks", rows(spark, [1], f"w{i}-"), ["id"], day(2), SCHEMA, 16) for i in range(4)]
    won = []

    def run(stage):
        try:
            won.append((log.commit(1, [stage]), stage))
        except K.Conflict:
            pass

    threads = [threading.Thread(target=run, args=(s,)) for s in stages]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.numbers() == [1, 2]


def test_empty_increments_and_tables(spark, log):
    empty = rows(spark, [], "x")
    assert log.commit(1, [K.upsert(log, "chunks", empty, ["id"], day(2), SCHEMA, 16)]) == 2
    assert log.read("chunks").count() == 200
    cleared = K.prune(log, "chunks", empty.select("id"), {"source": "s1"}, ["id"])
    log.commit(2, [cleared])
    assert log.read("chunks").where("source = 's1'").count() == 0 and log.read("chunks").count() == 133
    assert log.read("none", SCHEMA).count() == 0
    with pytest.raises(ValueError, match="no table"):
        log.read("none")
