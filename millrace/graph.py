"""The property graph: two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bucketed, folders, materialise


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


@dataclass(frozen=True)
class Graph:
    """vertices(id, ...) and directed edges(src, dst, weight); parallel edges are kept.

    Ids are longs; weight may be null in graphs without edge values. Edges to or from ids
    that are no vertices are allowed: what they would carry is dropped (see known()).
    """

    vertices: DataFrame
    edges: DataFrame
    closed: bool = False  # every edge joins two vertices
    derived: bool = False  # the vertices are the ends of the edges
    layout: DataFrame | None = None  # (id, part); the edges then have their source's part and lie on disk by it

    @classmethod
    def of(cls, vertices: DataFrame | None, edges: DataFrame) -> Graph:
        """Casts to the schema; without vertices, the ends of edges are the vertices."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(None).cast("double"))
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
        if vertices is None:
            return cls(_ends(edges), edges, True, True)
        rest = [c for c in vertices.columns if c != "id"]
        return cls(vertices.select(F.col("id").cast("long").alias("id"), *rest), edges)

    def known(self) -> Graph:
        """Only edges between vertices: a message to an unknown id would be dropped."""
        if self.closed:
            return self
        ids = self.vertices.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return Graph(self.vertices, edges.select("src", "dst", "weight"), True)

    def materialised(self) -> Graph:
        """The graph on disk. Its edges are bucketed by source: a join on src shuffles the other side only."""
        edges = bucketed(self.edges.select("src", "dst", "weight"), "src", "edges")
        vertices = _ends(edges) if self.derived else self.vertices
        return Graph(materialise(vertices, "vertices"), edges, self.closed, self.derived)

    def laid_out(self, parts: DataFrame) -> Graph:
        """The graph with its edges on disk by their source's part of parts(id, part).

        A superstep joins on part and source, and Spark reads only those parts' folders
        that senders lie in; a query whose scope is one part reads one part.
        """
        graph = self.known()
        layout = materialise(graph.vertices.select("id").join(parts.select("id", F.col("part").cast("int").alias("part")), "id", "left").select("id", F.coalesce("part", F.lit(0)).alias("part")), "layout")
        placed = graph.edges.select("src", "dst", "weight").join(layout.withColumnRenamed("id", "src"), "src")
        return Graph(graph.vertices, folders(placed, "part", "edges-by-part"), True, self.derived, layout)

    def symmetric(self) -> Graph:
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return Graph(self.vertices, self.edges.select("src", "dst", "weight").unionByName(back), self.closed, self.derived)

    def out_degree(self) -> DataFrame:
        deg = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(deg, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def in_degree(self) -> DataFrame:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).out_degree()

    def check_weights(self) -> None:
        """Shortest paths need weights that aren't null or negative."""
        if not self.edges.where("weight is null or weight < 0 or isnan(weight)").isEmpty():
            raise ValueError("an edge weight is null, negative or not a number")
