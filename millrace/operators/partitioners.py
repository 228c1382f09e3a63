"""Vertex partitioners: each gives (id, part) for parts 0 to k - 1."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.runtime import materialise


def numbered(ids: DataFrame) -> DataFrame:
    """(id, row) with rows 0, 1, ... in id order, without gathering the ids in one task.

    Ids are dealt by range; each range's rows are numbered by a window of their own and
    shifted by the sizes of the ranges before (one row a range).
    """
    parts = materialise(ids.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("p")), "ranges")
    sizes = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("p", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    return parts.withColumn("within", within).join(shift, "p").select("id", (F.col("within") + F.col("before")).cast("long").alias("row"))


def hashed(graph: Graph, k: int) -> DataFrame:
    return graph.out_degree().select("id", F.pmod(F.col("id") * 31 + F.col("degree"), F.lit(k)).cast("int").alias("part"))


def ranges(graph: Graph, k: int) -> DataFrame:
    """ceil(n / k) consecutive vertices each, in id order."""
    rows = numbered(graph.vertices)
    n = graph.vertices.count()
    return rows.select("id", F.floor(F.col("row") / max(1, -(-n // k))).cast("int").alias("part"))


def blocks(graph: Graph, size: int) -> DataFrame:
    """(id, block): blocks of `size` vertices in id order."""
    return numbered(graph.vertices).select("id", F.floor(F.col("row") / size).cast("long").alias("block"))


def block_continuous(graph: Graph, k: int, size: int) -> DataFrame:
    """Block i goes to part min(i div (blocks div k), k - 1); too few blocks are refused."""
    n_blocks = -(-graph.vertices.count() // size)
    if n_blocks < k:
        raise ValueError(f"{n_blocks} blocks for {k} parts")
    return blocks(graph, size).select("id", F.least(F.floor(F.col("block") / (n_blocks // k)), F.lit(k - 1)).cast("int").alias("part"))


def block_roundrobin(graph: Graph, k: int, size: int) -> DataFrame:
    return blocks(graph, size).select("id", (F.col("block") % k).cast("int").alias("part"))


def _nearest(places: DataFrame, spots: DataFrame, in_range: Column) -> DataFrame:
    """(id, spot): the best spot by (not in range, squared distance, spot). spots is a short list, at most a few hundred rows."""
    listed = [r.asDict() for r in spots.select("spot", "size", "lat", "lon").collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1000 spots")
    array = F.array(*[F.struct(F.lit(s["spot"]).cast("int").alias("spot"), F.lit(float(s["size"])).alias("size"), F.lit(s["lat"]).cast("double").alias("lat"), F.lit(s["lon"]).cast("double").alias("lon")) for s in listed])

    def rank(s: Column) -> Column:
        d = (F.col("lat") - s["lat"]) * (F.col("lat") - s["lat"]) + (F.col("lon") - s["lon"]) * (F.col("lon") - s["lon"])
        return F.struct((~in_range(d, s["size"])).alias("out"), d.alias("d2"), s["spot"].alias("spot"))

    return places.select("id", F.array_min(F.transform(array, rank))["spot"].alias("spot"))


def _pack(chosen: DataFrame, k: int) -> DataFrame:
    """Spots in order, each to the part with the fewest vertices so far (ties: smallest part)."""
    loads, to = [0] * k, {}
    for r in chosen.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).orderBy("spot").collect():  # one row a spot
        part = loads.index(min(loads))
        to[r["spot"]] = part
        loads[part] += r["n"]
    if not to:
        return chosen.select("id", F.lit(0).alias("part"))
    return chosen.select("id", F.create_map(*[F.lit(x) for kv in to.items() for x in kv])[F.col("spot")].cast("int").alias("part"))


def hotspot_of(places: DataFrame, spots: DataFrame, spot_range: float) -> DataFrame:
    """(id, spot): nearest of the spots whose size/range the squared distance doesn't exceed, else nearest of all."""
    return _nearest(places, spots, lambda d, size: d <= size / spot_range)


def closest_city_of(places: DataFrame, spots: DataFrame) -> DataFrame:
    return _nearest(places, spots, lambda d, size: F.lit(True))


def hotspot(places: DataFrame, spots: DataFrame, k: int, spot_range: float) -> DataFrame:
    return _pack(hotspot_of(places, spots, spot_range), k)


def closest_city(places: DataFrame, spots: DataFrame, k: int) -> DataFrame:
    return _pack(closest_city_of(places, spots), k)


def ldg(graph: Graph, k: int) -> DataFrame:
    """Linear deterministic greedy: vertices in id order, each to the part that maximises neighbours there times free share.

    One pass over one ordered stream, sequential by definition; its memory is the
    assignment of the vertices seen so far, 12 bytes each in numpy terms. Ties go to the
    smaller part, then the smaller number.
    """
    n = graph.vertices.count()
    listed = graph.edges.groupBy("src").agg(F.collect_set("dst").alias("near"))
    rows = graph.vertices.select("id").join(listed, F.col("id") == F.col("src"), "left").select("id", "near")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_of: dict[int, int] = {}
        loads, cap = [0] * k, max(1.0, n / k)
        for pdf in pdfs:
            out = []
            for vid, near in zip(pdf["id"], pdf["near"], strict=True):
                here = [0] * k
                for x in near if near is not None else ():
                    p = part_of.get(int(x))
                    if p is not None:
                        here[p] += 1
                best = max(range(k), key=lambda p: (here[p] * (1 - loads[p] / cap), -loads[p], -p))
                part_of[int(vid)] = best
                loads[best] += 1
                out.append(best)
            yield pd.DataFrame({"id": pdf["id"], "part": out})

    return rows.repartition(1).sortWithinPartitions("id").mapInPandas(run, "id long, part int")
