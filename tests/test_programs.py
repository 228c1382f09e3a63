"""Hand-made graphs, and random ones against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.plans import programs, supersteps, workload
from millrace.plans.supersteps import VertexProgram
from millrace.settings import Settings
from millrace.sources import sinks


def graph(spark, edges, ids=None):
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    v = spark.createDataFrame([(i,) for i in ids], "id long") if ids is not None else None
    return Graph.of(v, e)


def paths(spark, g, pairs, local_edges):
    q = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "query_id int, source long, target long")
    walked, sums, _ = workload.answer(g, q, local_edges)
    found = {}
    for r in walked.orderBy("query_id", "step").collect():
        found.setdefault(r["query_id"], []).append((r["vertex"], r["dist"]))
    return found, {r["query_id"]: r["dist"] for r in sums.collect()}


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_micro_graphs(spark, local_edges):
    edges = [
        (1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0),  # diamond: the smaller predecessor wins
        (11, 12, 10.0), (11, 13, 1.0), (13, 12, 1.0),  # a later, better value
        (21, 22, 5.0), (21, 22, 3.0),  # parallel edges
        (31, 32, 1.0), (32, 33, 1.0), (33, 31, 1.0), (35, 99, 1.0),  # a cycle; an edge to no vertex
        (41, 42, 0.0), (42, 41, 0.0), (41, 43, 0.0), (42, 43, 0.0),  # zero weights make no cycle of predecessors
    ]
    ids = [1, 2, 3, 4, 11, 12, 13, 21, 22, 31, 32, 33, 34, 35, 41, 42, 43]
    found, dist = paths(spark, graph(spark, edges, ids), [(1, 4), (11, 12), (21, 22), (31, 34), (35, 99), (2, 2), (41, 43), (31, 33)], local_edges)
    assert found[0] == [(4, 2.0), (2, 1.0), (1, 0.0)]
    assert found[1] == [(12, 2.0), (13, 1.0), (11, 0.0)]
    assert found[2] == [(22, 3.0), (21, 0.0)]
    assert 3 not in found and dist[3] is None
    assert 4 not in found and dist[4] is None
    assert found[5] == [(2, 0.0)]
    assert found[6][0] == (43, 0.0) and found[6][-1] == (41, 0.0)
    assert found[7] == [(33, 2.0), (32, 1.0), (31, 0.0)]


def dijkstra(edges, source):
    out, best, heap = {}, {source: 0.0}, [(0.0, source)]
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for u, w in out.get(v, []):
            if d + w < best.get(u, 1e18):
                best[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return best


def test_random_graph_batch_equals_single_queries_and_dijkstra(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 20))) for _ in range(90)]
    g = graph(spark, edges, range(30))
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(6)]
    steps, dist = paths(spark, g, pairs, 0)
    assert (steps, dist) == paths(spark, g, pairs, 1000)
    for q, (a, b) in enumerate(pairs):
        assert dist[q] == dijkstra(edges, a).get(b)
        for (v, d), (u, e) in zip(steps.get(q, []), steps.get(q, [])[1:], strict=False):
            assert min(w for x, y, w in edges if (x, y) == (u, v)) == d - e
    assert paths(spark, g, pairs[:1], 0)[0].get(0) == steps.get(0)


def test_nearest_tag_ties_and_source(spark):
    g = graph(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 2.0), (3, 5, 1.0)], range(1, 7))
    tags = spark.createDataFrame([(3, 7), (4, 7), (1, 8), (6, 9)], "id long, tag long")
    q = spark.createDataFrame([(0, 1, 7), (1, 1, 8), (2, 1, 9)], "query_id int, source long, tag long")
    for local_edges in (0, 100):
        found = {r["query_id"]: (r["vertex"], r["dist"]) for r in programs.nearest_tagged(g, q, tags, local_edges).collect()}
        assert found == {0: (3, 2.0), 1: (1, 0.0)}


def test_throttling_changes_no_result(spark):
    rng = random.Random(8)
    g = graph(spark, [(rng.randrange(12), rng.randrange(12), float(rng.randrange(1, 9))) for _ in range(40)], range(12))
    q = spark.createDataFrame([(0, 0, 7)], "query_id int, source long, target long")
    plain = programs.shortest_paths(g, q, False, 0).state.select("id", "dist", "pre")
    slow = programs.shortest_paths(g, q, False, 0, step_factor=2.0).state.select("id", "dist", "pre")
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in slow.collect()}


def test_pagerank_keeps_dangling_loss_and_zero_in_degree(spark):
    g = graph(spark, [(1, 2, None), (2, 3, None), (3, 2, None)], [1, 2, 3, 4])
    got = {r["id"]: r["rank"] for r in programs.pagerank(g, iterations=30, every=7).collect()}
    rank = dict.fromkeys([1, 2, 3, 4], 0.25)
    for _ in range(30):
        rank = {1: 0.15 / 4, 2: 0.15 / 4 + 0.85 * (rank[1] + rank[3]), 3: 0.15 / 4 + 0.85 * rank[2], 4: 0.15 / 4}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in rank)


def test_weak_and_directed_labels(spark):
    g = graph(spark, [(2, 1, None), (3, 2, None), (8, 9, None)], [1, 2, 3, 5, 8, 9])
    assert {r["id"]: r["component"] for r in programs.components(g).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8}
    assert {r["id"]: r["label"] for r in programs.directed_min_label(g).collect()} == {1: 1, 2: 2, 3: 3, 5: 5, 8: 8, 9: 8}
    assert {(r["component"], r["n"]) for r in programs.component_sizes(g).collect()} == {(1, 3), (5, 1), (8, 2)}


def test_long_chain_component(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    g = graph(spark, [(ids[i], ids[i + 1], None) for i in range(n - 1)])
    assert [r[0] for r in programs.components(g).select("component").distinct().collect()] == [0]


def test_weights_are_checked(spark):
    q = spark.createDataFrame([(0, 1, 2)], "query_id int, source long, target long")
    for w in (-1.0, None):
        with pytest.raises(ValueError):
            programs.shortest_paths(graph(spark, [(1, 2, w)]), q)


def test_hops_metrics(spark):
    g = graph(spark, [(1, 2, None), (2, 3, None), (1, 3, None)], [1, 2, 3])
    run = programs.frontier_hops(g, spark.createDataFrame([(0, 1, 3)], "query_id int, source long, target long"))
    assert {(r["id"], r["hops"]) for r in run.state.collect()} == {(1, 0), (2, 1), (3, 1)}
    assert [(r["superstep"], r["active"], r["touched_new"]) for r in run.supersteps().orderBy("superstep").collect()] == [(0, 1, 1), (1, 2, 2)]
    assert run.touched().where(F.col("first_step") == 1).count() == 2


def test_messages_to_unknown_vertices_are_dropped(spark):
    g = graph(spark, [(1, 2, 1.0), (1, 99, 1.0), (98, 2, 0.0), (2, 99, 1.0)], [1, 2])
    q = spark.createDataFrame([(0, 1, 99), (1, 1, 2), (2, 98, 2)], "query_id int, source long, target long")
    for local_edges in (0, 100):
        _, sums, done = workload.answer(g, q, local_edges)
        assert {r["query_id"]: r["dist"] for r in sums.collect()} == {0: None, 1: 1.0, 2: None}
        assert {(r["query_id"], r["id"]) for r in done.state.collect()} == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert {r["id"] for r in programs.frontier_hops(g, q).state.collect()} == {1, 2}
    tags = spark.createDataFrame([(99, 5), (2, 6)], "id long, tag long")
    t = spark.createDataFrame([(0, 1, 5), (1, 1, 6)], "query_id int, source long, tag long")
    for local_edges in (0, 100):
        assert {tuple(r) for r in programs.nearest_tagged(g, t, tags, local_edges).collect()} == {(1, 2, 1.0)}


@pytest.mark.parametrize("seed", range(3))
def test_local_mode_equals_supersteps(spark, seed):
    """State, scopes and metrics, with zero weights, ties, unknown ids and unreachable targets."""
    rng = random.Random(seed)
    edges = [(rng.randrange(26), rng.randrange(26), float(rng.choice([0, 1, 1, 2, 5]))) for _ in range(70)]
    g = graph(spark, edges, range(24))
    q = spark.createDataFrame([(i, rng.randrange(25), rng.choice([None, *range(25)])) for i in range(5)], "query_id int, source long, target long")
    tags = spark.createDataFrame([(i, i % 4) for i in range(0, 24, 3)], "id long, tag long")
    t = spark.createDataFrame([(i, rng.randrange(24), i) for i in range(4)], "query_id int, source long, tag long")

    def seen(done, columns):
        state = {tuple(r) for r in done.state.select("query_id", "id", *columns, "first_step", "last_step").collect()}
        steps = sorted((r["superstep"], r["query_id"], r["active"], r["touched_new"], r["touched"]) for r in done.supersteps().collect())
        return state, steps

    for prune in (True, False):
        one, two = (programs.shortest_paths(g, q, prune, local_edges) for local_edges in (0, 1000))
        assert two.local and not one.local
        assert seen(one, ["dist", "pre", "zero", "goal"]) == seen(two, ["dist", "pre", "zero", "goal"])
        walked = [{tuple(r) for r in programs.paths(x, q.where("target is not null")).collect()} for x in (one, two)]
        assert walked[0] == walked[1]
    one, two = (programs.nearest_tag_run(g, t, tags, local_edges) for local_edges in (0, 1000))
    assert seen(one, ["dist", "pre", "hit"]) == seen(two, ["dist", "pre", "hit"])


def test_paths_are_marked_in_a_second_phase(spark):
    g = graph(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 1.0), (4, 5, 1.0), (3, 6, 2.0)], range(1, 8))
    q = spark.createDataFrame([(0, 1, 6), (1, 1, 7), (2, 2, 2)], "query_id int, source long, target long")
    done = programs.shortest_paths(g, q, mark=True)
    assert {(r["query_id"], r["id"]) for r in done.state.where("on_path").collect()} == {(0, 1), (0, 2), (0, 3), (0, 6), (2, 2)}
    assert {r["value"] for r in sinks.path_values(done.state.where("query_id = 0")).collect()} == {"-1:0.0:false:true", "1:1.0:false:true", "2:2.0:false:true", "3:4.0:false:true"}
    plain = programs.shortest_paths(g, q).state.select("query_id", "id", "dist", "pre")
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in done.state.select("query_id", "id", "dist", "pre").collect()}


class Rumour(VertexProgram):
    """Writes to a vertex that no edge leads to, wakes chosen vertices in step 2 and all in a second phase."""

    name = "rumour"
    values = ["heard", "rounds"]

    def __init__(self):
        self.phase = 0

    def start(self, graph, queries):
        return queries.select("query_id", F.col("source").alias("id"), F.lit(1).alias("heard"), F.lit(0).alias("rounds"))

    def letters(self, senders):
        return senders.where(F.col("src_id") < 4).select("query_id", (F.col("src_id") + 2).alias("id"), F.lit(1).alias("n"))

    def combine(self):
        return [F.sum("n").alias("n")]

    def apply(self):
        woken = F.coalesce(F.col("was_active"), F.lit(False)).cast("int")
        return [(F.coalesce("heard", F.lit(0)) + F.coalesce("in_n", F.lit(0))).alias("heard"), (F.coalesce("rounds", F.lit(0)) + woken).alias("rounds")]

    def active(self):
        return F.col("in_any").isNotNull() & (F.lit(self.phase) == 0)

    def wake(self, step, state):
        return state.where("id = 0").select("query_id", "id") if step == 2 else None

    def next_phase(self, state):
        self.phase += 1
        return state.select("query_id", "id") if self.phase == 1 else None


def test_letters_waking_and_phases(spark):
    q = spark.createDataFrame([(0, 0, 0)], "query_id int, source long, target long")
    done = supersteps.run(Rumour(), graph(spark, [(0, 1, None)], [0, 1, 2, 4]), q)
    # 0 writes to 2, 2 to 4; woken in step 2, 0 writes again; in the second phase all three are active once, and 0 and 2 write.
    assert {(r["id"], r["heard"], r["rounds"]) for r in done.state.collect()} == {(0, 1, 3), (2, 3, 3), (4, 3, 3)}
    assert [(r["superstep"], r["active"]) for r in done.supersteps().orderBy("superstep").collect()] == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1), (5, 3)]


def test_long_path_in_few_jobs(spark):
    n = 37
    g = graph(spark, [(i, i + 1, 1.0) for i in range(n)], range(n + 1))
    q = spark.createDataFrame([(0, 0, n), (1, 3, 5), (2, 5, 3)], "query_id int, source long, target long")
    done = programs.shortest_paths(g, q, local_edges=0)
    got = sorted(tuple(r) for r in programs.paths(done, q).collect())
    assert got == sorted([(0, n - i, i, float(i)) for i in range(n + 1)] + [(1, 2 - i, 3 + i, float(i)) for i in range(3)])
    rows = lambda run: {tuple(r) for r in run.state.collect()}
    assert rows(done) == rows(supersteps.run(programs.ShortestPaths(), g, q, merge_every=2))  # however often the deltas are merged


def test_pagerank_with_hubs_apart(spark):
    rng = random.Random(4)
    edges = [(0, i, None) for i in range(1, 30)] + [(rng.randrange(30), rng.randrange(30), None) for _ in range(60)]
    g = graph(spark, edges, range(30))
    plain = {r["id"]: r["rank"] for r in programs.pagerank(g, 8, every=3).collect()}
    apart = {r["id"]: r["rank"] for r in programs.pagerank(g, 8, every=3, hub=10).collect()}
    assert plain.keys() == apart.keys() and all(abs(plain[i] - apart[i]) < 1e-12 for i in plain)


def test_adaptive_workload(spark):
    """Two groups of queries over two rings, dealt badly: the moves bring each ring to one part; answers stay the same."""
    ring = lambda a, n: [(a + i, a + (i + 1) % n, 1.0) for i in range(n)] + [(a + (i + 1) % n, a + i, 1.0) for i in range(n)]
    g = graph(spark, ring(0, 12) + ring(100, 12))
    parts = g.vertices.select("id", (F.floor(F.col("id") / 3) % 2).alias("part"))
    rows = [(i, i // 4, 100 * (i % 2) + i, 100 * (i % 2) + (i + 5) % 12) for i in range(8)]
    plan = spark.createDataFrame(rows, "query_id int, batch int, source long, target long")
    given = Settings(max_parallel_queries=4, intersect_sampling=1, query_cut_min_chunk=1, min_move_vertices=1, clusters_per_worker=1, max_imbalance=1.0, move_budget_ms=0, greedy_ms=0)
    done = workload.run_adaptive(g, plan, parts, 2, given)
    log = [r.asDict() for r in done.decisions().orderBy("batch").collect()]
    assert log[0]["fired"] and log[0]["moved"] > 0 and log[0]["cost_after"] < log[0]["cost_before"]
    assert log[1]["locality"] > log[0]["locality"]
    assert {tuple(r) for r in done.paths.collect()} == {tuple(r) for r in workload.run_workload(g, plan, given)[0].collect()}
    assert done.steps.where("batch = 1").select("query_id").distinct().count() == 4
    with pytest.raises(ValueError):
        workload.run_workload(g, plan, Settings(max_parallel_queries=2))


def test_layout_prunes_parts(spark):
    g = graph(spark, [(i, i + 1, 1.0) for i in range(20)], range(21))
    placed = g.laid_out(g.vertices.select("id", (F.col("id") / 7).cast("int").alias("part")))
    q = spark.createDataFrame([(0, 0, 4)], "query_id int, source long, target long")
    assert [r["dist"] for r in workload.answer(placed, q)[1].collect()] == [4.0]
    assert len([r for r in placed.edges.select("part").distinct().collect()]) == 3
    assert {tuple(r) for r in programs.components(placed).collect()} == {(i, 0) for i in range(21)}
