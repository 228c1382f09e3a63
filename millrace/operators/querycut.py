"""Query-aware repartitioning: overlap of query scopes, clustering, local search, migration.

Scopes are touched(query_id, id); parts are (id, part). Everything up to the summaries is
DataFrames; the summaries (queries x queries, clusters x parts: at most a few hundred rows,
bounded by the history limit) are optimised on the driver.
"""

from __future__ import annotations

import random
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.settings import Settings


def recent_queries(history: DataFrame, now_ms: int, window_ms: int, most: int) -> DataFrame:
    """Of history(query_id, finished_ms) the queries inside the time window, the newest `most`."""
    rows = history.where((F.col("finished_ms") >= now_ms - window_ms) & (F.col("finished_ms") <= now_ms))
    return rows.orderBy(F.desc("finished_ms"), F.desc("query_id")).limit(most)


def intersect_chunks(touched: DataFrame, factor: int = 1, min_size: int = 1) -> DataFrame:
    """(queries, n): vertices by the exact set of queries that touched them, n scaled by the sampling factor.

    With a factor above 1, one vertex in `factor` is counted, chosen by a hash of its id.
    """
    rows = touched.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(factor)) == 0) if factor > 1 else touched
    sets = rows.groupBy("id").agg(F.array_sort(F.collect_set("query_id")).alias("queries"))
    return sets.groupBy("queries").agg((F.count(F.lit(1)) * factor).alias("n")).where(F.col("n") >= min_size)


def top_chunks(chunks: DataFrame, k: int) -> DataFrame:
    return chunks.orderBy(F.desc("n"), "queries").limit(k)


def merge_chunks(chunks: list[tuple[frozenset, int]], limit: int) -> list[tuple[frozenset, int]]:
    """While there are more than `limit`, the smallest joins the chunk B with the best |A and B| / |B|."""
    left = sorted(((frozenset(q), n) for q, n in chunks), key=lambda c: (c[1], sorted(c[0])))
    while len(left) > max(1, limit):
        q, n = left.pop(0)
        best = max(range(len(left)), key=lambda i: (len(q & left[i][0]) / len(left[i][0]), left[i][1]))
        left[best] = (left[best][0], left[best][1] + n)
        left.sort(key=lambda c: (c[1], sorted(c[0])))
    return sorted(left, key=lambda c: (-c[1], sorted(c[0])))


def query_overlap(chunks: DataFrame) -> DataFrame:
    """(q1, q2, n) for q1 < q2: vertices that both touched, from the chunks.

    The pairs come from each chunk's own query set, whose length the history limit bounds.
    """
    pair = F.flatten(F.transform("queries", lambda a: F.transform(F.filter("queries", lambda b: b > a), lambda b: F.struct(a.alias("q1"), b.alias("q2")))))
    return chunks.select(F.explode(pair).alias("p"), "n").groupBy("p.q1", "p.q2").agg(F.sum("n").alias("n"))


def cluster_queries(sizes: dict[int, int], overlap: dict[tuple[int, int], int], target: int, least: float = 0.2) -> list[list[int]]:
    """Agglomerative: merges the pair with the largest overlap / mean size until `target` are left or it is below `least`.

    Overlaps of a merged cluster are the larger of its parts'. Ties go to the smaller ids.
    """
    members = {q: [q] for q in sizes}
    size = dict(sizes)
    shared = {tuple(sorted(p)): n for p, n in overlap.items()}
    while len(members) > max(1, target) and shared:
        score = lambda p: shared[p] / max(1e-9, (size[p[0]] + size[p[1]]) / 2)
        best = min(shared, key=lambda p: (-score(p), p))
        if score(best) < least:
            break
        a, b = best
        members[a] += members.pop(b)
        size[a] += size.pop(b)
        merged: dict[tuple[int, int], int] = {}
        for (x, y), n in shared.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                key = (min(x, y), max(x, y))
                merged[key] = max(n, merged.get(key, 0))
        shared = merged
    return sorted(sorted(m) for m in members.values())


def per_part(touched: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, part, n)"""
    return touched.join(parts, "id").groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("n"))


def cut_cost(touched: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, separated): touched vertices that aren't on the query's largest part."""
    return per_part(touched, parts).groupBy("query_id").agg((F.sum("n") - F.max("n")).alias("separated"))


def query_locality(touched: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, largest_part, locality): the part with most of the query's vertices (ties: smallest) and its share."""
    rows = per_part(touched, parts).groupBy("query_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", -F.col("part"))).alias("top"))
    return rows.select("query_id", (-F.col("top")["col2"]).alias("largest_part"), (F.col("top")["n"] / F.col("total")).alias("locality"))


def imbalance(parts: DataFrame, k: int) -> DataFrame:
    """(part, n, factor) for all k parts: |n - avg| / avg with the integer average."""
    spark = parts.sparkSession
    counts = spark.range(k).select(F.col("id").cast("int").alias("part")).join(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "left")
    counts = counts.select("part", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.floor(F.sum("n") / k).alias("avg"))  # one row
    return counts.join(F.broadcast(total)).select("part", "n", F.when(F.col("avg") > 0, F.abs(F.col("n") - F.col("avg")) / F.col("avg")).otherwise(0.0).alias("factor"))


@dataclass
class Placement:
    """n[cluster][part] vertices; free[part] vertices that no query touched. Small enough for the driver."""

    n: dict[int, list[int]]
    free: list[int]

    def cost(self) -> int:
        return sum(sum(row) - max(row) for row in self.n.values())

    def loads(self) -> list[int]:
        return [f + sum(row[p] for row in self.n.values()) for p, f in enumerate(self.free)]

    def worst(self) -> float:
        loads = self.loads()
        avg = sum(loads) // len(loads)
        return max(abs(x - avg) / avg for x in loads) if avg else 0.0

    def moved(self, cluster: int, source: int, target: int) -> Placement:
        n = {c: list(row) for c, row in self.n.items()}
        n[cluster][target] += n[cluster][source]
        n[cluster][source] = 0
        return Placement(n, self.free)


def _moves(p: Placement) -> list[tuple[int, int, int]]:
    k = len(p.free)
    return [(c, a, b) for c, row in sorted(p.n.items()) for a in range(k) if row[a] for b in range(k) if a != b]


def _greedy(p: Placement, limit: float, steps: list, most: int, until: float) -> Placement:
    for _ in range(most):
        best = None
        for move in _moves(p):
            if time.monotonic() > until:
                return p
            q = p.moved(*move)
            if q.cost() < p.cost() and q.worst() <= max(limit, p.worst()) and (best is None or (q.cost(), q.worst()) < (best[0].cost(), best[0].worst())):
                best = (q, move)
        if best is None:
            return p
        p = best[0]
        steps.append(("greedy", *best[1], p.cost(), p.worst()))
    return p


def iterated_local_search(
    start: Placement, limit: float = 0.5, iterations: int = 50, seed: int = 0, greedy_iterations: int = 500, balance_first: bool = True,
    budget_ms: float | None = None, greedy_ms: float | None = None,
) -> tuple[Placement, list[tuple]]:
    """Balances, then alternates greedy descent and perturbation; accepts what is cheaper and balanced.

    Perturbation unites a random cluster on its largest part. Returns the best placement
    and the steps (kind, cluster, source, target, cost, worst imbalance). The cost never
    ends above that of the balanced start. Time limits, where given, end the search and
    each descent early; without them the result depends on the seed alone.
    """
    rng, steps, p = random.Random(seed), [], start
    end = time.monotonic() + budget_ms / 1000 if budget_ms is not None else float("inf")
    until = lambda: min(end, time.monotonic() + greedy_ms / 1000) if greedy_ms is not None else end
    while balance_first and p.worst() > limit:
        loads = p.loads()
        high = loads.index(max(loads))
        options = [q for q in ((p.moved(*m), m) for m in _moves(p) if m[1] == high) if q[0].worst() < p.worst()]
        if not options:
            break
        p, move = min(options, key=lambda o: (o[0].worst(), o[0].cost()))
        steps.append(("balance", *move, p.cost(), p.worst()))
    best = _greedy(p, limit, steps, greedy_iterations, until())
    for _ in range(iterations if best.n else 0):
        if time.monotonic() > end:
            break
        c = rng.choice(sorted(best.n))
        row, q = best.n[c], best
        home = row.index(max(row))
        for a in range(len(row)):
            if a != home and q.n[c][a]:
                q = q.moved(c, a, home)
        q = _greedy(q, limit, [], greedy_iterations, until())
        if q.cost() < best.cost() and q.worst() <= max(limit, best.worst()):
            best = q
            steps.append(("perturb", c, -1, home, best.cost(), best.worst()))
    return best, steps


@dataclass(frozen=True)
class Move:
    """Vertices of the included queries go from source to target, unless a query that is neither included nor tolerated touched them."""

    source: int
    target: int
    include: tuple[int, ...]
    tolerate: tuple[int, ...] = ()


def plan_moves(steps: list[tuple], start: Placement, clusters: dict[int, list[int]]) -> list[Move]:
    """Moves of a search's steps: where each cluster's vertices of each part end up.

    Queries that leave the same source for another target are tolerated there.
    """
    to = {c: list(range(len(row))) for c, row in start.n.items()}
    for kind, cluster, source, target, *_ in steps:
        for a, at in enumerate(to[cluster]):
            if kind == "perturb" or at == source:
                to[cluster][a] = target
    pairs: dict[tuple[int, int], list[int]] = {}
    leaving: dict[int, set[int]] = {}
    for c, ends in sorted(to.items()):
        for a, b in enumerate(ends):
            if a != b and start.n[c][a]:
                pairs.setdefault((a, b), []).extend(clusters[c])
                leaving.setdefault(a, set()).update(clusters[c])
    return [Move(a, b, tuple(sorted(q)), tuple(sorted(leaving[a] - set(q)))) for (a, b), q in sorted(pairs.items())]


def migrate(touched: DataFrame, parts: DataFrame, include: list[int], tolerate: list[int], source: int, target: int, min_move: int = 0) -> DataFrame:
    """parts after moving, from source to target, vertices of the included queries that no other query touched.

    Queries in `tolerate` don't hold a vertex back. Nothing moves if fewer than min_move would.
    """
    wanted = touched.where(F.col("query_id").isin(include)).select("id").distinct()
    held = touched.where(~F.col("query_id").isin(include + tolerate)).select("id").distinct()
    moving = parts.where(F.col("part") == source).join(wanted, "id", "left_semi").join(held, "id", "left_anti").select("id", F.lit(target).alias("to"))
    if min_move and moving.limit(min_move).count() < min_move:
        return parts
    return parts.join(moving, "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part"))


@dataclass
class MoveTrigger:
    """Whether a new decision is carried out, and what it remembers from one to the next.

    It is when locality is low or has changed much since the last time, when an imbalance
    exceeds its limit by more than a margin, or when extra shots are left; a shot is spent
    where nothing else speaks for a move, and low or changed locality grants new ones.
    """

    settings: Settings
    last_locality: float = 0.0
    shots_left: int = 0

    def fires(self, new_decision: bool, active: int, locality: float, worst: float, mean: float) -> bool:
        s = self.settings
        if not (new_decision and s.move_enabled and active == s.max_parallel_queries):
            return False
        change = locality - self.last_locality
        by_locality = locality < s.locality_low or change < s.locality_drop or change > s.locality_rise
        by_imbalance = worst > s.max_imbalance + s.max_imbalance_margin or mean > s.mean_imbalance + s.mean_imbalance_margin
        if not (by_locality or by_imbalance or self.shots_left > 0):
            return False
        if by_locality:
            self.last_locality, self.shots_left = locality, s.extra_shots
        elif not by_imbalance:
            self.shots_left -= 1
        return True


def steps_within(supersteps: DataFrame, window_ms: float) -> int:
    """How many of a run's last supersteps ended within the last window_ms of its time."""
    took = supersteps.groupBy("superstep").agg(F.max("wall_ms").alias("ms"))  # one row a step
    after = F.sum("ms").over(Window.orderBy(F.desc("superstep"))) - F.col("ms")
    return took.select((after <= window_ms).cast("int").alias("inside")).agg(F.sum("inside")).first()[0] or 0


def recently_active(state: DataFrame, now_step: int, window: int) -> DataFrame:
    """Vertices that were active in the last `window` supersteps."""
    return state.where(F.col("last_step") >= now_step - window).select("id").distinct()
