"""The upsert stream: batches that run again, late duplicates, buckets that a batch doesn't touch."""

import os

from pyspark.sql import functions as F

from cutweave.streaming import streams as S

SCHEMA = "id long, created_at long, best_score double"


def state(spark, path):
    return sorted(map(tuple, S.read_history(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()))


def files(folder):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet") and "_batches" not in d}


def test_batches_that_run_again_and_untouched_buckets(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert state(spark, path) == []
    S.merge_batch(rows(*((i, 10, 1.0) for i in range(40))), 0, path, 8)
    first = files(path)
    S.merge_batch(rows((3, 20, 2.0), (99, 5, 9.0), (3, 15, 7.0)), 1, path, 8)
    once, held = state(spark, path), files(path)
    assert dict((r[0], r[1:]) for r in once)[3] == (20, 2.0) and len(once) == 41
    touched = {r[0] for r in spark.createDataFrame([(3,), (99,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    for name, at in first.items():
        if int(name.split("bucket=")[1].split("/")[0]) not in touched:
            assert held[name] == at  # the same file as before
    S.merge_batch(rows((3, 20, 2.0), (99, 5, 9.0), (3, 15, 7.0)), 1, path, 8)  # as after a lost driver
    assert state(spark, path) == once and len(files(path)) == len(held)
    S.merge_batch(rows((3, 12, 4.0), (4, 10, 1.0)), 2, path, 8)  # late, and a duplicate
    assert state(spark, path) == once
    S.merge_batch(rows(), 3, path, 8)
    assert state(spark, path) == once


def test_a_batch_without_its_marker_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "history")
    S.merge_batch(spark.createDataFrame([(1, 1, 1.0)], SCHEMA), 0, path, 4)
    S.merge_batch(spark.createDataFrame([(1, 2, 2.0)], SCHEMA), 1, path, 4)
    S.remove(spark, f"{path}/_batches/batch=1")
    assert state(spark, path) == [(1, 1, 1.0)]


def test_stream_is_the_batch_twin(spark, tmp_path):
    rows = [(i % 7, i * 3 % 50, float(i)) for i in range(60)]
    rows += rows[:20]  # duplicates, in later files too
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(source)
    path = str(tmp_path / "out")
    for _ in range(2):  # nothing new the second time
        S.stream_upsert_history(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source), path, str(tmp_path / "cp"), 4).awaitTermination()
    best = {}
    for i, at, _ in rows:
        best[i] = max(best.get(i, -1), at)
    assert [r[:2] for r in state(spark, path)] == sorted(best.items())
