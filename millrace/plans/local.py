"""Local mode: a small graph is searched inside tasks, one query a task, without jobs between supersteps.

The caller asks for it with a bound on the edges that a task may hold. The rounds are those
of the superstep engine, so the state, each vertex's first and last step and the metrics
are the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.runtime import materialise

STATE = "query_id int, id long, dist double, pre long, zero int, goal long, hit boolean, active boolean, first_step int, last_step int"
STEPS = "superstep int, active_rows long, touched_new long, touched long, wall_ms double"


def fits(graph: Graph, most: int) -> bool:
    return graph.edges.limit(most + 1).count() <= most


class _Held:
    """The graph as arrays: vertices in id order, their tags, edges sorted by source."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, tags: np.ndarray | None):
        self.ids, self.dst, self.weight, self.tags = ids, np.searchsorted(ids, dst), weight, tags
        self.start = np.searchsorted(src, np.append(ids, np.iinfo(np.int64).max))


def _rounds(g: _Held, source: int, goal: int | None, prune: bool) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """State columns and steps of one query; goal is a vertex, or a tag where the graph has tags."""
    n = len(g.ids)
    dist, pre, zero = np.full(n, np.inf), np.full(n, -1, np.int64), np.zeros(n, np.int32)
    first, last, active = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.zeros(n, bool)
    hit = np.zeros(n, bool) if goal is None else (g.ids == goal if g.tags is None else g.tags == goal)
    at = int(np.searchsorted(g.ids, source))
    steps: list[tuple] = []
    if at < n and g.ids[at] == source:
        dist[at], first[at], last[at], active[at] = 0, 0, 0, True
    step, began = 0, time.time()
    while len(act := np.flatnonzero(active)):
        steps.append((step, len(act), int((first == step).sum()), int((first >= 0).sum()), (time.time() - began) * 1000))
        began = time.time()
        reached = dist[hit].min(initial=np.inf)
        senders = act[dist[act] <= reached] if prune else act
        count = g.start[senders + 1] - g.start[senders]
        edge = np.repeat(g.start[senders] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        src, dst, w = np.repeat(senders, count), g.dst[edge], g.weight[edge]
        new, flat, by = dist[src] + w, (w == 0).astype(np.int32), g.ids[src]
        order = np.lexsort((by, flat, new, dst))
        order = order[np.r_[True, dst[order][1:] != dst[order][:-1]]] if len(order) else order
        u, new, flat, by = dst[order], new[order], flat[order], by[order]
        closer = new < dist[u]  # also where it has no distance yet
        better = closer | ((new == dist[u]) & (flat == 0) & ((zero[u] == 1) | (by < pre[u])))
        take = u[better]
        dist[take], zero[take], pre[take] = new[better], flat[better], by[better]
        active[:] = False
        active[u[closer]] = True
        step += 1
        first[u[first[u] < 0]] = step
        last[active] = step
    touched = first >= 0
    columns = {"id": g.ids, "dist": dist, "pre": pre, "zero": zero, "hit": hit, "first_step": first, "last_step": last}
    return {k: v[touched] for k, v in columns.items()}, steps


def search(graph: Graph, queries: DataFrame, prune: bool = True, tags: DataFrame | None = None) -> tuple[DataFrame, list[tuple]]:
    """The state and the steps of queries(query_id, source, target) over a graph that fits; with tags(id, tag), target is a tag."""
    spark = graph.edges.sparkSession
    graph = graph.known()
    edges = graph.edges.select("src", "dst", "weight").toPandas().sort_values("src", kind="stable")
    ids = np.sort(graph.vertices.select("id").distinct().toPandas()["id"].to_numpy(np.int64))
    of = None
    if tags is not None:
        rows = tags.select("id", "tag").toPandas()
        of = np.full(len(ids), np.iinfo(np.int64).min)
        rows = rows[rows["id"].isin(ids)]
        of[np.searchsorted(ids, rows["id"].to_numpy(np.int64))] = rows["tag"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(_Held(ids, edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64), edges["weight"].to_numpy(float), of))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for q, source, target in zip(pdf["query_id"], pdf["source"], pdf["target"], strict=True):
                goal = None if pd.isna(target) else int(target)
                state, steps = _rounds(held.value, int(source), goal, prune)
                if len(state["id"]):
                    rows = pd.DataFrame(state).assign(query_id=q, goal=goal, active=False).astype({"goal": "Int64"})
                    yield rows[[c.split()[0] for c in STATE.split(", ")]].assign(**dict.fromkeys(("superstep", "active_rows", "touched_new", "touched", "wall_ms")))
                    rows = pd.DataFrame(steps, columns=[c.split()[0] for c in STEPS.split(", ")]).assign(query_id=q)
                    yield rows.reindex(columns=[c.split()[0] for c in f"{STATE}, {STEPS}".split(", ")])

    asked = queries.select(F.col("query_id").cast("int").alias("query_id"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
    both = materialise(asked.repartition("query_id").mapInPandas(run, f"{STATE}, {STEPS}"), "local-search")
    steps = both.where("superstep is not null").select("superstep", "query_id", "active_rows", "touched_new", "touched", "wall_ms").orderBy("superstep", "query_id").collect()
    return both.where("id is not null").select([c.split()[0] for c in STATE.split(", ")]), [tuple(r) for r in steps]


def walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Path rows of one query's state, from its goal back to its source."""
    rows = {int(i): (d, int(p)) for i, d, p in zip(pdf["id"], pdf["dist"], pdf["pre"], strict=True)}
    goal, out = pdf["goal"].iloc[0], []
    at = -1 if pd.isna(goal) else int(goal)
    while at in rows:
        out.append((pdf["query_id"].iloc[0], len(out), at, rows[at][0]))
        at = rows[at][1]
    return pd.DataFrame(out, columns=["query_id", "step", "vertex", "dist"])
