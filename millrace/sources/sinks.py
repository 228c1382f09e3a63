"""Outputs: vertex files, components, paths, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.settings import Settings
from millrace.sources.readers import id_hash


def vertex_lines(values: DataFrame, value: str = "value") -> DataFrame:
    """(query_id, line): id, tab, value; rows without a value are left out."""
    return values.where(F.col(value).isNotNull()).select("query_id", F.concat_ws("\t", F.col("id").cast("string"), F.col(value).cast("string")).alias("line"))


def write_vertices(values: DataFrame, path: str, value: str = "value") -> None:
    """One folder of text files per query; what was there is replaced."""
    vertex_lines(values, value).write.mode("overwrite").partitionBy("query_id").text(path)


def sp_value(state: DataFrame) -> DataFrame:
    """State of a marked shortest-path run with its text value pre:dist:later:onpath (later is always false here)."""
    return state.withColumn("value", F.concat_ws(":", F.col("pre").cast("string"), F.col("dist").cast("string"), F.lit("false"), F.col("on_path").cast("string")))


def path_lines(paths: DataFrame) -> DataFrame:
    """(query_id, step, line) from target to source: vertex, tab, distance; the last line is the source alone."""
    last = F.col("dist") == 0
    return paths.select("query_id", "step", F.when(last, F.col("vertex").cast("string")).otherwise(F.concat_ws("\t", F.col("vertex").cast("string"), F.col("dist").cast("string"))).alias("line"))


def path_values(state: DataFrame) -> DataFrame:
    """What a shortest-path query puts out of its state: the vertices on the path alone."""
    return sp_value(state.where("on_path"))


def write_setup(spark: SparkSession, settings: Settings, path: str, notes: dict[str, str] | None = None) -> None:
    """The settings of a run, and notes on it, as key = value lines."""
    rows = [(line,) for line in [*settings.lines(), *(f"{k} = {v}" for k, v in (notes or {}).items())]]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def merged_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, level) of all log files of a folder in line order; lines start with their time."""
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    level = F.regexp_extract("line", r"\b(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\b", 1)
    return rows.withColumn("level", F.when(level != "", level)).orderBy("line")


def level_counts(log: DataFrame) -> DataFrame:
    return log.where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def component_lines(sizes: DataFrame) -> DataFrame:
    return sizes.select(F.concat_ws("\t", F.col("component").cast("string"), F.col("n").cast("string")).alias("line"))


def write_csv(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").csv(path, sep=";", header=True)


def vertex_sample(vertices: DataFrame, one_in: int) -> DataFrame:
    """About 1 in `one_in` vertices, chosen by a hash of the id (the same in every run and partitioning)."""
    return vertices.where(F.pmod(id_hash("id", "sample"), F.lit(one_in)) == 0)
