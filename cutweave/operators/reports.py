"""Run histories, reports, trends, benchmark checks and call statistics. Each takes and returns tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

REPORT = "run_id string, algorithm_id string, dataset string, resolved_mode string, remote boolean, best_fitness double, iter_seconds double, iter_avg_ms double, started_at timestamp"


def running_best(history: DataFrame, side: str = "min") -> DataFrame:
    """history and best: the best fitness of its run so far."""
    w = W.partitionBy("run_id").orderBy("generation").rowsBetween(W.unboundedPreceding, 0)
    return history.withColumn("best", (F.min if side == "min" else F.max)("fitness").over(w))


def best_generation(history: DataFrame, side: str = "min", secondary: str = "iter_ms") -> DataFrame:
    """run_id, generation, fitness, secondary of the best generation, the first on ties."""
    s = F.struct(F.col("fitness") if side == "min" else (-F.col("fitness")).alias("fitness"), "generation")
    return history.groupBy("run_id").agg(F.min_by(F.struct("generation", "fitness", secondary), s).alias("b")).select("run_id", "b.*")


def convergence_curves(history: DataFrame) -> DataFrame:
    """run_id, fitness, iter_ms: arrays in the order of generations."""
    g = history.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("generation", "fitness", "iter_ms"))).alias("r"))
    return g.select("run_id", F.transform("r", lambda x: x["fitness"]).alias("fitness"), F.transform("r", lambda x: x["iter_ms"]).alias("iter_ms"))


def run_summary(history: DataFrame) -> DataFrame:
    """run_id, iterations, seconds, avg_ms, throughput (iterations a second; null without time)."""
    g = history.groupBy("run_id").agg(F.count("*").alias("iterations"), (F.sum("iter_ms") / 1000).alias("seconds"))
    return g.withColumn("avg_ms", F.col("seconds") / F.col("iterations") * 1000).withColumn("throughput", F.when(F.col("seconds") > 0, F.col("iterations") / F.col("seconds")))


def load_run_reports(lines: DataFrame) -> DataFrame:
    """Rows of REPORT from JSON lines (value); lines that aren't JSON, or lack algorithm_id or dataset, are skipped."""
    r = lines.select(F.from_json("value", REPORT, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return r.where("algorithm_id is not null and dataset is not null")


def _key():
    return F.concat_ws("|", "algorithm_id", "dataset", "resolved_mode", F.when(F.col("remote"), "1").otherwise("0"))


def run_trends(rows: DataFrame, last_n: int = 20) -> DataFrame:
    """key, runs, mean_ms, mean_fitness, regressions, last_run over each key's last ``last_n`` runs (20 if under 1)."""
    r = rows.withColumn("key", _key()).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("started_at"), F.desc("run_id")))).where(F.col("n") <= (last_n if last_n > 0 else 20))
    reg = F.count_if("regressed") if "regressed" in rows.columns else F.lit(0).cast("long")
    return r.groupBy("key").agg(F.count("*").alias("runs"), F.avg("iter_avg_ms").alias("mean_ms"), F.avg("best_fitness").alias("mean_fitness"), reg.alias("regressions"), F.min_by("run_id", "n").alias("last_run"))


def benchmark_compare(rows: DataFrame, threshold: float = 0.25) -> DataFrame:
    """run_id, key, unit, ratio, regressed, best_iter_avg_ms, best_iter_seconds, last_iter_avg_ms, last_iter_seconds.

    A run's mean milliseconds against the best of the key's earlier runs; its seconds against theirs where it has no
    milliseconds, or they have none (or 0); never one unit against the other. A run without either has no unit and no ratio,
    and is no regression. Both bests, this run's included, are kept apart.
    """
    w = W.partitionBy("key").orderBy("started_at", "run_id")
    before, until = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumn("key", _key()).withColumn("ms0", F.min("iter_avg_ms").over(before)).withColumn("s0", F.min("iter_seconds").over(before))
    r = r.withColumn("best_iter_avg_ms", F.min("iter_avg_ms").over(until)).withColumn("best_iter_seconds", F.min("iter_seconds").over(until))
    r = r.withColumn("unit", F.when(F.col("iter_avg_ms").isNotNull() & (F.col("ms0") > 0), "ms").when(F.col("iter_seconds").isNotNull() & (F.col("s0") > 0), "s"))
    share = lambda now, best: F.try_divide(F.col(now) - F.col(best), F.col(best))
    r = r.withColumn("ratio", F.when(F.col("unit") == "ms", share("iter_avg_ms", "ms0")).when(F.col("unit") == "s", share("iter_seconds", "s0")))
    return r.select("run_id", "key", "unit", "ratio", F.coalesce(F.col("ratio") > threshold, F.lit(False)).alias("regressed"), "best_iter_avg_ms", "best_iter_seconds", F.col("iter_avg_ms").alias("last_iter_avg_ms"), F.col("iter_seconds").alias("last_iter_seconds"))


def upsert_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row an id: the latest created_at, a new row over an old one on ties."""
    u = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return u.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("created_at"), F.desc("_n")))).where("_r = 1").drop("_n", "_r")


def page_history(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    return rows.orderBy("created_at", "id").offset(offset).limit(limit)


def delete_history(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def latest_state(states: DataFrame) -> DataFrame:
    """algorithm, dataset and the columns of the row of the newest updated_at, the greatest task_id on ties."""
    rest = [c for c in states.columns if c not in ("algorithm", "dataset")]
    return states.groupBy("algorithm", "dataset").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "task_id")).alias("s")).select("algorithm", "dataset", "s.*")


def resource_rows(snapshots: DataFrame) -> DataFrame:
    """server, cpu, memory, gpu_count, gpu_util: the mean of GPUs' numeric use, null without any. ``gpus``: an array of
    structs with util."""
    util = F.filter(F.transform("gpus", lambda g: g["util"]), lambda x: x.isNotNull())
    mean = F.when(F.size(util) > 0, F.aggregate(util, F.lit(0.0), lambda a, x: a + x) / F.size(util))
    return snapshots.select("server", "cpu", "memory", F.coalesce(F.size("gpus"), F.lit(0)).cast("long").alias("gpu_count"), mean.alias("gpu_util"))


def comm_stats(calls: DataFrame) -> DataFrame:
    """rank, op, total, calls, avg by (rank, op), by rank and overall, one rollup; nulls stand for all."""
    return calls.rollup("rank", "op").agg(F.sum("ms").alias("total"), F.count("*").alias("calls"), F.avg("ms").alias("avg"))


def comm_overall(calls: DataFrame) -> DataFrame:
    """One row: the mean over ranks other than 0."""
    return calls.where("rank <> 0").agg(F.avg("ms").alias("avg"), F.count("*").alias("calls"))


def iteration_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("iter").agg(F.sum("compute_ms").alias("compute"), F.sum("overhead_ms").alias("overhead"), F.max("compute_ms").alias("max_compute"), F.max("overhead_ms").alias("max_overhead"), F.countDistinct("worker").alias("workers"), F.count("*").alias("calls"))


def overhead_guard(iters: DataFrame, window: int = 5, ratio: float = 1.5, least_calls: int = 8) -> DataFrame:
    """iter, ratio, tripped: overhead over compute in the last ``window`` iterations. Rows are iterations, a small table;
    windows go by run where there is a run_id."""
    by = W.partitionBy("run_id" if "run_id" in iters.columns else F.lit(0)).orderBy("iter").rowsBetween(-(window - 1), 0)
    r = iters.withColumn("ratio", F.try_divide(F.sum("overhead").over(by), F.sum("compute").over(by))).withColumn("n", F.sum("calls").over(by))
    return r.select("iter", "ratio", ((F.col("ratio") > ratio) & (F.col("n") >= least_calls)).alias("tripped"))


def stragglers(calls: DataFrame, factor: float = 2.5, floor_ms: float = 500.0) -> DataFrame:
    """iter, worker, total, median: workers whose total passes max(floor, factor x median) of an iteration that has two
    positive totals or more."""
    t = calls.groupBy("iter", "worker").agg(F.sum(F.col("compute_ms") + F.col("overhead_ms")).alias("total"))
    m = t.where("total > 0").groupBy("iter").agg(F.percentile("total", 0.5).alias("median"), F.count("*").alias("n")).where("n >= 2")
    return t.join(m, "iter").where(F.col("total") > F.greatest(F.lit(floor_ms), factor * F.col("median"))).select("iter", "worker", "total", "median")


def recovery_percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, p50, p95, max by nearest rank: the value of rank round(p (n - 1)), from 0."""
    w = W.partitionBy(key)
    r = rows.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("r") == F.rint(F.lit(p) * (F.col("n") - 1)).cast("long"), F.col(value)))
    return r.groupBy(key).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def transport_rates(calls: DataFrame) -> DataFrame:
    """worker, failure_rate, retries_per_call, mean_recovery (of failed calls' overhead; null without any)."""
    return calls.groupBy("worker").agg(F.avg(F.col("failed").cast("double")).alias("failure_rate"), F.avg("retries").alias("retries_per_call"), F.avg(F.when(F.col("failed"), F.col("overhead_ms"))).alias("mean_recovery"))


def worker_stats(calls: DataFrame) -> DataFrame:
    """worker, phase, total, avg, share of the worker's total."""
    long = calls.select("worker", "compute_ms", "overhead_ms").unpivot("worker", ["compute_ms", "overhead_ms"], "phase", "ms")
    g = long.groupBy("worker", "phase").agg(F.sum("ms").alias("total"), F.avg("ms").alias("avg"))
    return g.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy("worker")))


def export_report(history: DataFrame, side: str = "min") -> DataFrame:
    """run_id, report: JSON of best fitness, its generation, iterations, timing and history; and, where ``history`` has
    them, the gene and the metrics of the best generation (best_gene, metrics: JSON text or a map)."""
    s, b, c = run_summary(history), best_generation(history, side), convergence_curves(history)
    j = s.join(b.select("run_id", "generation", F.col("fitness").alias("best_fitness")), "run_id").join(c.select("run_id", F.col("fitness").alias("history")), "run_id")
    more = [x for x in ("best_gene", "metrics") if x in history.columns]
    if more:
        j = j.join(history.select("run_id", "generation", *more), ["run_id", "generation"], "left")
    return j.select("run_id", F.to_json(F.struct("best_fitness", "generation", "iterations", "history", *more)).alias("report"), "seconds", "avg_ms")
