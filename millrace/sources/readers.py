"""Graph, workload, configuration and statistics readers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.settings import Settings

# The separators of the text adjacency format id[,value]|dst[,w];dst[,w]...
VERTEX_SEPARATOR, FIELD_SEPARATOR, EDGE_SEPARATOR = "|", ",", ";"


def parse_adjacency(lines: DataFrame, column: str = "value") -> Graph:
    """Graph of text lines id[,value]|dst[,w];dst[,w]...

    A line without | has no edges; a vertex without value has a null default_value, an
    edge without one a null weight; blank lines are skipped. Casts are strict: a line
    that doesn't parse fails the job.
    """
    rows = lines.where(F.trim(F.col(column)) != "").select(F.split(F.col(column), r"\|", 2).alias("p"))
    head = F.split(F.col("p")[0], FIELD_SEPARATOR, 2)
    rows = rows.select(F.trim(head[0]).cast("long").alias("id"), F.get(head, F.lit(1)).alias("default_value"), F.get("p", F.lit(1)).alias("rest"))
    one = F.split(F.col("e"), FIELD_SEPARATOR, 2)
    edges = rows.where("rest is not null").select(F.col("id").alias("src"), F.explode(F.filter(F.split("rest", EDGE_SEPARATOR), lambda x: F.trim(x) != "")).alias("e"))
    edges = edges.select("src", F.trim(one[0]).cast("long").alias("dst"), F.trim(F.get(one, F.lit(1))).cast("double").alias("weight"))
    return Graph.of(rows.select("id", "default_value"), edges)


def read_adjacency(spark: SparkSession, path: str) -> Graph:
    return parse_adjacency(spark.read.text(path))


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def adjacency_lines(graph: Graph) -> DataFrame:
    """(id, line) in the text adjacency format, edges ordered by target and weight."""
    edge = F.concat(F.col("e.dst").cast("string"), F.when(F.col("e.weight").isNotNull(), F.concat(F.lit(","), _number(F.col("e.weight")))).otherwise(""))
    listed = graph.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("es"))
    text = F.array_join(F.transform("es", lambda e: F.concat(e["dst"].cast("string"), F.when(e["weight"].isNotNull(), F.concat(F.lit(","), _number(e["weight"]))).otherwise(""))), EDGE_SEPARATOR)
    rows = graph.vertices.select("id").join(listed, F.col("id") == F.col("src"), "left")
    return rows.select("id", F.concat(F.col("id").cast("string"), F.when(F.size("es") > 0, F.concat(F.lit(VERTEX_SEPARATOR), text)).otherwise("")).alias("line"))


def _parse_binary(data: bytes, coordinates: bool) -> Iterator[tuple]:
    """Big-endian: int32 n, then n times int32 id, [float64 lat, float64 lon,] int32 degree, degree times (int32, float64)."""
    (n,) = struct.unpack_from(">i", data)
    head = struct.Struct(">iddi" if coordinates else ">ii")
    edge = struct.Struct(">id")
    at = 4
    for _ in range(n):
        row = head.unpack_from(data, at)
        at += head.size
        vid, degree = row[0], row[-1]
        lat, lon = (row[1], row[2]) if coordinates else (None, None)
        edges = [edge.unpack_from(data, at + k * edge.size) for k in range(degree)]
        at += degree * edge.size
        yield vid, lat, lon, [d for d, _ in edges], [w for _, w in edges]
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes are left after {n} vertices")


def read_binary(spark: SparkSession, path: str, coordinates: bool) -> Graph:
    """Graph of binary files: the raw road network (with coordinates) or partition files (without)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for data in pdf["content"]:
                part: list[tuple] = []
                for row in _parse_binary(bytes(data), coordinates):
                    part.append(row)
                    if len(part) == 20_000:
                        yield pd.DataFrame(part, columns=["id", "lat", "lon", "dst", "w"])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["id", "lat", "lon", "dst", "w"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, lat double, lon double, dst array<long>, w array<double>")
    keep = ["id", "lat", "lon"] if coordinates else ["id"]
    edges = rows.select(F.col("id").alias("src"), F.explode(F.arrays_zip("dst", "w")).alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.w").alias("weight"))
    return Graph.of(rows.select(*keep), edges)


def binary_bytes(vertices: list[tuple], coordinates: bool) -> bytes:
    """The binary form of [(id, lat, lon, [(dst, w), ...]), ...]; for fixtures and export of one partition."""
    out = [struct.pack(">i", len(vertices))]
    for vid, lat, lon, edges in vertices:
        out.append(struct.pack(">iddi", vid, lat, lon, len(edges)) if coordinates else struct.pack(">ii", vid, len(edges)))
        out += [struct.pack(">id", d, w) for d, w in edges]
    return b"".join(out)


def id_hash(column: str, salt: str) -> Column:
    """60 bits of the MD5 of salt:id, a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(column).cast("string"))), 1, 15), 16, 10).cast("long")


def assign_tags(vertices: DataFrame, probability: float, n_tags: int) -> DataFrame:
    """vertices with tag 0 to n_tags - 1, or -1: the same whatever the partitioning."""
    h = F.pmod(id_hash("id", "tagged"), F.lit(1_000_000))
    tag = F.when(h < F.lit(round(probability * 1_000_000)), F.pmod(id_hash("id", "tag"), F.lit(n_tags))).otherwise(-1)
    return vertices.withColumn("tag", tag.cast("long"))


def read_hotspots(spark: SparkSession, sizes: str, coordinates: str, first: int) -> DataFrame:
    """(spot, name, size, lat, lon) of the first rows of name;size in the file's order, with coordinates joined by lower-cased name."""
    size = spark.read.csv(sizes, sep=";", schema="name string, size int").withColumn("m", F.monotonically_increasing_id())
    size = _file_rows(size).where(F.col("row_no") < first)
    coords = spark.read.csv(coordinates, sep=";", schema="name string, lat double, lon double").select(F.lower("name").alias("key"), "lat", "lon")
    rows = size.select(F.lower("name").alias("key"), "name", "size", "row_no").join(coords, "key")
    # At most `first` rows are left; spots without coordinates leave no gap in the numbers.
    return rows.select((F.row_number().over(Window.orderBy("row_no")) - 1).alias("spot"), "name", "size", "lat", "lon")


@dataclass(frozen=True)
class Command:
    """One line of a workload plan: start (source, target), wait (ms) or waitall."""

    kind: str
    source: int | None = None
    target: int | None = None
    ms: int | None = None


def parse_workload(lines: list[str]) -> list[Command]:
    """Commands of a tab-separated plan; unknown lines are left out, as the plan's reader only warns of them."""
    out = []
    for line in lines:
        f = line.rstrip("\r\n").split("\t")
        if f[0] == "start" and len(f) >= 3:
            out.append(Command("start", int(f[1]), int(f[2])))
        elif f[0] == "wait" and len(f) >= 2:
            out.append(Command("wait", ms=int(f[1])))
        elif f[0] == "waitall":
            out.append(Command("waitall"))
    return out


def batches(commands: list[Command], most: int = Settings.max_parallel_queries) -> list[tuple[int, int, int, int]]:
    """(query_id, batch, source, target): ids in file order, at most `most` queries at once; waitall ends a batch."""
    out, batch, inside = [], 0, 0
    for c in commands:
        if c.kind == "waitall" and inside:
            batch, inside = batch + 1, 0
        if c.kind == "start":
            if inside == most:
                batch, inside = batch + 1, 0
            out.append((len(out), batch, c.source, c.target))
            inside += 1
    return out


def read_workload(spark: SparkSession, path: str, most: int = Settings.max_parallel_queries) -> DataFrame:
    lines = [r[0] for r in spark.read.text(path).collect()]  # a plan is a small control file
    return spark.createDataFrame(batches(parse_workload(lines), most), "query_id int, batch int, source long, target long")


def read_stats_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, metrics...) of one ;-separated file of doubles with a header (a trailing ; is allowed).

    Rows are numbered within their piece of the file and shifted by the sizes of the pieces
    before, of which there is one row each.
    """
    raw = spark.read.csv(path, sep=";", header=True)
    names = [c for c in raw.columns if not c.startswith("_c") and c.strip()]
    rows = raw.select(F.monotonically_increasing_id().alias("m"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return _file_rows(rows).select("row_no", *names)


def _file_rows(rows: DataFrame) -> DataFrame:
    """rows with a column m of increasing ids, numbered 0, 1, ... in that order as row_no."""
    piece, within = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit(2**33 - 1))
    sizes = rows.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("piece", F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("piece", piece).join(before, "piece").withColumn("row_no", (F.col("before") + within).cast("long"))


def column_dataset(samples: DataFrame, column: str, factor: float = 1.0, name: str | None = None, start_row: int = 0) -> DataFrame:
    return samples.where(F.col("row_no") >= start_row).select("row_no", (F.col(column) * factor).alias(name or column))


def value_at(samples: DataFrame, column: str, row: int) -> float | None:
    found = samples.where(F.col("row_no") == row).select(column).first()
    return found[0] if found else None
