"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import delete, materialise, remember, store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for every node on an edge; root is the component's smallest node.

    The edges should be stored. Before the rounds every task replaces its edges by stars
    around the smallest node that they connect. Each round is an aggregation and an equi-join
    whose rows don't exceed the edges; both sides of a join are stored tables, so that Spark
    may split a node with very many edges. The number of rounds grows with the logarithm of
    the longest path. Self-loops give single-node components; an empty table gives none.
    Nothing is collected but one count and checksum a round.
    """
    spark = edges.sparkSession
    read = lambda place, like: spark.read.schema(like.schema).parquet(place)
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    lone = materialise(pairs.where("u = v").select("u").distinct(), "star-lone")
    first = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInPandas(_stars, "u long, v long").distinct()
    place = store(first, "star-edges")
    e, seen = read(place, first), None
    for _ in range(most):
        # Large star: every larger neighbour v of u moves to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low_at = store(low, "star-low")
        big = both.where("v > u").join(read(low_at, low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big_at = store(big, "star-big")
        big = read(big_at, big)
        # Small star: every smaller neighbour of u, and u, move to the smallest neighbour of u.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        least_at = store(least, "star-least")
        least = read(least_at, least)
        small = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        after = store(made, "star-edges")
        delete(spark, place, low_at, big_at, least_at)
        place, e = after, read(after, made)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    remember(place)
    # Every edge is now (node, root); roots and nodes without an edge to another name themselves.
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    alone = lone.join(found.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return found.union(alone)


#: Edges that a task connects among themselves at a time.
_AT_ONCE = 500_000


def _stars(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) as edges from each node to the smallest that the edges at hand connect it to."""
    held: list[np.ndarray] = []

    def star() -> pd.DataFrame:
        ends = np.concatenate(held)
        names, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        root = np.arange(len(names))
        while True:  # the smallest label of each edge's ends, then shortcuts, until nothing moves
            low = np.minimum(root[at[:, 0]], root[at[:, 1]])
            new = root.copy()
            for side in (0, 1):
                np.minimum.at(new, root[at[:, side]], low)
            while (new[new] != new).any():
                new = new[new]
            new = new[root]
            if (new == root).all():
                break
            root = new
        some = root != np.arange(len(names))
        return pd.DataFrame({"u": names[some], "v": names[root[some]]})

    for pdf in pdfs:
        held.append(pdf[["u", "v"]].to_numpy(np.int64))
        if sum(map(len, held)) >= _AT_ONCE:
            yield star()
            held.clear()
    if held:
        yield star()
