"""Structured Streaming twins of the history and resource operators, over files that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cutweave.operators.reports import upsert_history
from cutweave.session import discard, materialise, remove

OBSERVER = "run_id string, generation int, max_generation int, best_fitness double, metrics map<string,double>"
RESOURCE = "server string, ts timestamp, cpu double, memory double, gpu double"


def parse_observer(lines: DataFrame) -> DataFrame:
    """Observer rows from JSON lines; lines without a generation are skipped. fitness: best_fitness, or the metric."""
    r = lines.select(F.from_json("value", OBSERVER).alias("r")).select("r.*").where("generation is not null")
    return r.withColumn("fitness", F.coalesce("best_fitness", F.expr("metrics['fitness']")))


def stream_observer(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder of JSON-lines files as they come; the source's checkpoint remembers what was read."""
    return parse_observer(spark.readStream.text(path))


def stream_running_best(rows: DataFrame, side: str = "min") -> DataFrame:
    """run_id, best, generation so far; state is one row a run. For output modes update and complete."""
    best = F.min if side == "min" else F.max
    return rows.groupBy("run_id").agg(best("fitness").alias("best"), F.max("generation").alias("generation"))


def resource_windows(points: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, server, n and means in tumbling windows of event time; points later than ``late`` are dropped when the
    input streams."""
    p = points.withWatermark("ts", late) if points.isStreaming else points
    return p.groupBy(F.window("ts", size).alias("w"), "server").agg(F.count("*").alias("n"), F.avg("cpu").alias("cpu"), F.avg("memory").alias("memory"), F.avg("gpu").alias("gpu")).select(F.col("w.start").alias("start"), "server", "n", "cpu", "memory", "gpu")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The n of the folders ``name=n`` in a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x.removeprefix(f"{name}=")) for x in found if x.startswith(f"{name}="))


def _held(spark: SparkSession, path: str, before: int, buckets: list[int] | None = None) -> list[str]:
    """The newest version under ``before`` of each bucket."""
    out = []
    for b in _numbers(spark, path, "bucket") if buckets is None else buckets:
        older = [v for v in _numbers(spark, f"{path}/bucket={b}", "version") if v < before]
        out += [f"{path}/bucket={b}/version={older[-1]}"] if older else []
    return out


def merge_batch(batch: DataFrame, n: int, path: str, buckets: int) -> None:
    """Put a batch's rows into the history at ``path``, which lies in ``buckets`` by a hash of the id: buckets that the batch
    touches get a version n, the others keep their files. Run again it makes the same version anew, from the one before;
    versions before that are deleted. A marker, written last, makes the batch visible."""
    spark, schema = batch.sparkSession, batch.schema
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    new = materialise(batch.withColumn("bucket", bucket), "batch")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as buckets, at most
    for b in touched:
        remove(spark, f"{path}/bucket={b}/version={n}")
    held = _held(spark, path, n, touched)
    before = spark.read.schema(schema).parquet(*held) if held else batch.sparkSession.createDataFrame([], schema)
    merged = upsert_history(before, new.drop("bucket")).withColumn("bucket", bucket).withColumn("version", F.lit(n))
    merged.repartition("bucket").write.mode("append").partitionBy("bucket", "version").parquet(path)
    spark.range(0).write.mode("overwrite").parquet(f"{path}/_batches/batch={n}")
    for b in touched:
        for v in [v for v in _numbers(spark, f"{path}/bucket={b}", "version") if v < n][:-1]:
            remove(spark, f"{path}/bucket={b}/version={v}")
    discard(new)


def read_history(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The history as of the last whole batch."""
    batches = _numbers(spark, f"{path}/_batches", "batch")
    held = _held(spark, path, batches[-1] + 1) if batches else []
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def stream_upsert_history(rows: DataFrame, path: str, checkpoint: str, buckets: int = 16, late: str = "30 days"):
    """Keep at ``path`` the latest row of each id of a stream (id, created_at in seconds, more); returns the started query.
    ``read_history`` reads it. Rows that repeat an id and its created_at within ``late`` of the newest are dropped as they
    come, and rows later than that; each batch rewrites the buckets it touches."""
    once = rows.withColumn("_at", F.timestamp_seconds("created_at")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["id", "created_at"]).drop("_at")
    return once.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, n, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Drain a stream of files into a table at ``path`` and return it. Update and complete modes keep the last batch's
    result by batch folder; the returned table is the final state."""
    spark = df.sparkSession
    if mode == "append":
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)
    last: list[int] = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        last.append(n)

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/batch={last[-1]}") if last else spark.createDataFrame([], df.schema)
