"""Graphs and logs derived from the driver's tables: parts sold in one order are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutweave.session import dealt

FILTERS = {"sparse": "l_returnflag = 'R' and l_quantity >= 40", "disc": "l_discount >= 0.09", "ret": "l_returnflag = 'R'", "all": "true"}

#: Order lines whose links one task makes, where there are many.
LINES = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def copart(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Distinct (src < dst) of parts that share an order, within a filter on its lines."""
    lines = table(spark, sf, "lineitem")
    parts = lines.count() // LINES
    li = dealt(lines.where(FILTERS[kind]).select("l_orderkey", "l_partkey"), parts, "l_orderkey").distinct()
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("src")), li.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return dealt(a.join(b, "l_orderkey").where("src < dst").select("src", "dst"), parts, "src").distinct()


def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    """node, label (brand number mod 5), split by thirds of a hash."""
    from cutweave.functions.rand import u

    p = table(spark, sf, "part")
    r = u("split", F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("node"), (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 5).alias("label"), F.when(r < 0.4, "train").when(r < 0.6, "val").otherwise("test").alias("split"))


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    """node, feat, value: one-hot of size bucket (0-4) and brand number (5 on)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.floor((F.col("p_size") - 1) / 10).cast("int").alias("s"), (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") + 5).alias("b"))
    return p.select("node", F.explode(F.array("s", "b")).alias("feat")).select("node", "feat", F.lit(1.0).alias("value"))


def communities(spark: SparkSession, sf: str, column: str) -> DataFrame:
    """node, comm: parts grouped by the number in p_brand, or by the rank of p_type's hash text."""
    p = table(spark, sf, "part")
    c = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long") if column == "p_brand" else F.conv(F.substring(F.md5(F.col("p_type").cast("binary")), 1, 6), 16, 10).cast("long")
    return p.select(F.col("p_partkey").alias("node"), c.alias("comm"))


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """run_id, generation (from 1), metrics of a run: fitness (whole number) and iter_ms; from events by user and type."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").select(F.concat_ws("|", F.concat(F.lit("alg"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")), F.col("event_type")).alias("run_id"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("fitness"), F.col("value").alias("iter_ms"))
    return e.withColumn("generation", F.row_number().over(W.partitionBy("run_id").orderBy("ts", "event_id")))


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    """call_id, iter (hours since the first of January 2024), worker, compute_ms, overhead_ms, failed, retries."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("call_id"), ((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("long").alias("iter"), (F.col("user_id") % 8).alias("worker"), F.col("value").alias("compute_ms"), F.get_json_object("props", "$.k").cast("double").alias("overhead_ms"), (F.col("event_type") == "error").alias("failed"), (F.col("user_id") % 3).alias("retries"))
