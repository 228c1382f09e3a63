"""Running a workload plan: admission in batches, each batch one run of the superstep engine; repartitioning between batches."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.operators import querycut, stats
from millrace.plans import programs
from millrace.plans.supersteps import Run
from millrace.runtime import materialise
from millrace.settings import Settings


def answer(graph: Graph, queries: DataFrame, local_edges: int = 0) -> tuple[DataFrame, DataFrame, Run]:
    """Of one batch: the paths, (query_id, source, target, dist) with a null dist where there is no path, and the run."""
    done = programs.shortest_paths(graph, queries.select("query_id", "source", "target"), local_edges=local_edges)
    walked = programs.paths(done, queries.select("query_id", "target"))
    dist = done.state.where("id = goal").select("query_id", "dist")
    return walked, queries.select("query_id", "source", "target").join(dist, "query_id", "left"), done


def _batches(plan: DataFrame, most: int) -> list[int]:
    """The plan's batches in order; one of more than `most` queries is refused."""
    rows = plan.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()
    for r in rows:
        if r["n"] > most:
            raise ValueError(f"batch {r['batch']} has {r['n']} queries, and {most} are admitted at once")
    if not rows:
        raise ValueError("the plan starts no query")
    return [r["batch"] for r in rows]


def run_workload(graph: Graph, plan: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths, summaries and scopes of plan(query_id, batch, source, target); a batch starts when the one before has ended."""
    done = _run(graph.known().materialised(), plan, settings or Settings(), None)
    return done.paths, done.sums, done.scopes


@dataclass
class AdaptiveRun:
    """What a workload with repartitioning leaves: results, the last parts, and what was decided after each batch.

    log rows: (batch, locality, worst, mean, cost_before, moved, cost_after, fired); the
    costs are those of the recent queries' scopes on the parts.
    """

    paths: DataFrame
    sums: DataFrame
    scopes: DataFrame
    steps: DataFrame
    parts: DataFrame | None = None
    log: list[tuple] = field(default_factory=list)

    LOG = "batch int, locality double, worst double, mean double, cost_before long, moved long, cost_after long, fired boolean"

    def decisions(self) -> DataFrame:
        return self.paths.sparkSession.createDataFrame(self.log, self.LOG)


def run_adaptive(graph: Graph, plan: DataFrame, parts: DataFrame, k: int, settings: Settings | None = None) -> AdaptiveRun:
    """run_workload over a graph laid out by parts(id, part) of 0 to k - 1, which moves vertices between batches.

    After a batch the scopes of the recent queries are cut into chunks, queries that share
    vertices are clustered, a local search places the clusters, and if the trigger fires
    the plan is carried out and the graph laid out anew.
    """
    settings = settings or Settings()
    return _run(graph.known().materialised(), plan, settings, Adaptive(materialise(parts.select("id", F.col("part").cast("int").alias("part")), "parts"), k, settings))


class Adaptive:
    """The deciding service: remembers recent scopes and the current parts."""

    def __init__(self, parts: DataFrame, k: int, settings: Settings):
        self.parts, self.k, self.settings = parts, k, settings
        self.trigger = querycut.MoveTrigger(settings)
        self.history: list[tuple[float, list[int], DataFrame]] = []  # when, queries, their scopes

    def remember(self, touched: DataFrame, queries: list[int], now_ms: float) -> None:
        s = self.settings
        self.history.append((now_ms, queries, touched.select("query_id", "id")))
        recent = [h for h in self.history if h[0] >= now_ms - s.query_cut_window_ms]
        while len(recent) > 1 and sum(len(h[1]) for h in recent) > s.query_cut_max_queries:
            recent.pop(0)
        self.history = recent

    def scopes(self) -> DataFrame:
        rows = self.history[0][2]
        for _, _, more in self.history[1:]:
            rows = rows.unionByName(more)
        return rows

    def cost(self, touched: DataFrame) -> int:
        return int(querycut.cut_cost(touched, self.parts).agg(F.sum("separated")).first()[0] or 0)

    def decide(self, touched: DataFrame) -> list[querycut.Move]:
        """Moves for the scopes, or none where too few vertices would go."""
        s = self.settings
        sampled = touched if s.intersect_sampling <= 1 else touched.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(s.intersect_sampling)) == 0)
        factor = max(1, s.intersect_sampling)
        chunks = querycut.intersect_chunks(sampled, min_size=max(1, s.query_cut_min_chunk // factor))
        # At most intersect_chunk_limit chunks reach the driver, the largest ones; the rest joins them.
        top = [(frozenset(r["queries"]), r["n"]) for r in querycut.top_chunks(chunks, 4 * s.intersect_chunk_limit).collect()]
        merged = querycut.merge_chunks(top, s.intersect_chunk_limit)
        sizes: dict[int, int] = {}
        overlap: dict[tuple[int, int], int] = {}
        for members, n in merged:
            for a in members:
                sizes[a] = sizes.get(a, 0) + n * factor
                for b in members:
                    if a < b:
                        overlap[a, b] = overlap.get((a, b), 0) + n * factor
        if not sizes:
            return []
        clusters = dict(enumerate(querycut.cluster_queries(sizes, overlap, s.clusters_per_worker * self.k + s.clusters_additional)))
        of = touched.sparkSession.createDataFrame([(q, c) for c, members in clusters.items() for q in members], "query_id int, cluster int")
        spread = querycut.per_part(touched.join(F.broadcast(of), "query_id").select(F.col("cluster").alias("query_id"), "id").distinct(), self.parts)
        n = {c: [0] * self.k for c in clusters}
        for r in spread.collect():  # clusters x parts
            n[r["query_id"]][r["part"]] = r["n"]
        free = [0] * self.k
        for r in self.parts.join(touched.select("id").distinct(), "id", "left_anti").groupBy("part").count().collect():
            free[r["part"]] = r["count"]
        start = querycut.Placement(n, free)
        end, steps = querycut.iterated_local_search(
            start, s.max_imbalance, s.ils_iterations, len(self.history), s.greedy_iterations, s.balance_first, s.move_budget_ms or None, s.greedy_ms or None
        )
        moved = sum(max(0, b - a) for c in n for a, b in zip(n[c], end.n[c], strict=True))
        return querycut.plan_moves(steps, start, clusters) if moved >= s.min_move_vertices else []

    def carry_out(self, touched: DataFrame, moves: list[querycut.Move]) -> int:
        """Moves vertices; returns how many."""
        before = self.parts
        for m in moves:
            self.parts = querycut.migrate(touched, self.parts, list(m.include), list(m.tolerate), m.source, m.target)
        self.parts = materialise(self.parts, "parts")
        return self.parts.join(before.withColumnRenamed("part", "was"), "id").where("part <> was").count()

    def after(self, batch: int, done: Run, queries: list[int], now_ms: float) -> tuple | None:
        """The log row of a finished batch; parts are new if it fired and moved anything."""
        self.remember(done.touched(), queries, now_ms)
        touched = self.scopes()
        ratio = stats.local_supersteps(done.touched(), self.parts).agg(F.sum("supersteps").alias("n"), F.sum("local").alias("local")).first()
        remote = (ratio["n"] or 0) - (ratio["local"] or 0)
        unique = remote / self.k + (ratio["local"] or 0)
        locality = (ratio["local"] or 0) / unique if unique else 0.0
        factors = [r["factor"] for r in querycut.imbalance(self.parts.join(touched.select("id").distinct(), "id", "left_semi"), self.k).collect()]
        worst, mean = max(factors), math.fsum(factors) / len(factors)
        before = self.cost(touched)
        moves = self.decide(touched)
        fired = self.trigger.fires(bool(moves), len(queries), locality, worst, mean)
        moved = self.carry_out(touched, moves) if fired else 0
        return batch, locality, worst, mean, before, moved, self.cost(touched), fired


def _run(graph: Graph, plan: DataFrame, settings: Settings, adaptive: Adaptive | None) -> AdaptiveRun:
    paths, sums, scopes, steps, log, clock = [], [], [], [], [], 0.0
    placed = graph.laid_out(adaptive.parts) if adaptive else graph
    local_edges = settings.local_edges if settings.local_query_execution and adaptive is None else 0
    for batch in _batches(plan, settings.max_parallel_queries):
        mine = plan.where(F.col("batch") == batch)
        p, s, done = answer(placed, mine, local_edges)
        paths.append(p)
        sums.append(s)
        scopes.append(done.touched())
        steps.append(stats.batch_steps(done.supersteps(), batch))
        if adaptive:
            clock += sum({r[0]: r[5] for r in done.steps}.values())
            log.append(adaptive.after(batch, done, [r[0] for r in mine.select("query_id").collect()], clock))  # an admitted batch
            if log[-1][5]:
                placed = graph.laid_out(adaptive.parts)
    together = [_union(x) for x in (paths, sums, scopes, steps)]
    return AdaptiveRun(*together, adaptive.parts if adaptive else None, log)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
