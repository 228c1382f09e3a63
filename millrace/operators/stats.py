"""Statistics relations: worker series, averages, imbalance, locality, query summaries.

Samples are samples(worker, sample_no, t_ms, metrics...). Windows run within one worker or
one sample; neither grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def downsample(rows: DataFrame, k: int, metrics: list[str], row_no: str = "row_no") -> DataFrame:
    """Averages of each k rows in a row; the last block may be short."""
    block = F.floor(F.col(row_no) / k).cast("long").alias("block")
    return rows.groupBy(block).agg(*[F.avg(m).alias(m) for m in metrics])


def normalised_series(samples: DataFrame, metrics_ns: list[str]) -> DataFrame:
    """Milliseconds per second of wall time since the worker's previous sample (the first sample has none)."""
    order = Window.partitionBy("worker").orderBy("sample_no")
    rows = samples.withColumn("dt_ms", F.col("t_ms") - F.lag("t_ms").over(order))
    return rows.where("dt_ms > 0").select("worker", "sample_no", "dt_ms", *[(F.col(m) / 1e6 * 1000 / F.col("dt_ms")).alias(m) for m in metrics_ns])


def worker_times_ms(samples: DataFrame, metrics_ns: list[str]) -> DataFrame:
    return samples.select("worker", "sample_no", "t_ms", *[(F.col(m) / 1e6).alias(m) for m in metrics_ns])


def cross_worker_average(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Average per sample number over all workers; stops at the shortest series, sample 0 is left out."""
    workers = samples.select("worker").distinct().agg(F.count(F.lit(1)).alias("workers"))  # one row
    rows = samples.where("sample_no > 0").groupBy("sample_no").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return rows.join(F.broadcast(workers)).where("n = workers").select("sample_no", *metrics)


def imbalance_series(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Per sample the mean and largest deviation from the workers' average, in percent of it."""
    mean = Window.partitionBy("sample_no")
    rows = samples.select("sample_no", *[(F.abs(F.avg(m).over(mean) - F.col(m)) / F.avg(m).over(mean) * 100).alias(m) for m in metrics])
    return rows.groupBy("sample_no").agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("avg", F.avg), ("max", F.max))])


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def query_totals(stats: DataFrame) -> DataFrame:
    """Derived columns of per-query counters; zero where there were no supersteps. workers: how many computed."""
    local, steps, w = F.col("local_supersteps"), F.col("supersteps"), F.col("workers")
    unique = (steps - local) / w + local
    return stats.select(
        "query_id", (F.col("messages_local") + F.col("messages_unicast") + F.col("messages_broadcast")).alias("messages_total"),
        (ratio(local, steps) * 100).alias("local_ratio"), F.when(steps > 0, unique).otherwise(0.0).alias("supersteps_unique"),
        (ratio(local, unique) * 100).alias("local_ratio_unique"), (F.col("compute_time") + F.col("finish_time")).alias("time_sum"),
    )


def trailing_locality(samples: DataFrame, workers: int, window_ms: int = 40_000) -> DataFrame:
    """LSRU per sample: local / (non-local per worker + local) over the trailing window of (t_ms, supersteps, local_supersteps)."""
    w = Window.partitionBy("part_of_log").orderBy("t_ms").rangeBetween(-window_ms, 0) if "part_of_log" in samples.columns else Window.orderBy("t_ms").rangeBetween(-window_ms, 0)
    local, steps = F.sum("local_supersteps").over(w), F.sum("supersteps").over(w)
    return samples.select("t_ms", ratio(local, (steps - local) / workers + local).alias("lsru"))


def query_summary(supersteps: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query_hash, supersteps, vertices, work): one row per query of a run's metrics."""
    rows = supersteps.groupBy("query_id").agg(F.count(F.lit(1)).alias("supersteps"), F.max("touched").alias("vertices"), F.sum("active").alias("work"))
    return queries.select("query_id", query_hash(F.col("source"), F.col("target")).alias("query_hash")).join(rows, "query_id", "left")


def batch_steps(supersteps: DataFrame, batch: int) -> DataFrame:
    """A run's metrics as the per-query statistics of its batch, step by step."""
    return supersteps.select(F.lit(batch).alias("batch"), "query_id", "superstep", "active", "touched_new", "touched", "wall_ms")


def durations(supersteps: DataFrame) -> DataFrame:
    """(query_id, duration_ms, mean_step_ms) of a run: the wall time of the steps that a query took part in."""
    return supersteps.groupBy("query_id").agg(F.sum("wall_ms").alias("duration_ms"), F.avg("wall_ms").alias("mean_step_ms"))


def query_hash(source: Column, target: Column) -> Column:
    """31 (31 + source) + target in wrapping 32-bit arithmetic."""
    x = (source + 31) * 31 + target
    return (F.pmod(x + 2**31, F.lit(2**32)) - 2**31).cast("int")


def query_groups(queries: DataFrame) -> DataFrame:
    """Queries with one hash, in id order."""
    rows = queries.select(query_hash(F.col("source"), F.col("target")).alias("query_hash"), "query_id")
    return rows.groupBy("query_hash").agg(F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("query_ids"))


def local_supersteps(scopes: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, supersteps, local): a superstep is local when the vertices first reached in it share one part."""
    rows = scopes.join(parts, "id").groupBy("query_id", "first_step").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("supersteps"), F.count_if(F.col("lo") == F.col("hi")).alias("local"))
