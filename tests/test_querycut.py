import random

from millrace.graph import Graph
from millrace.operators import partitioners, querycut, stats
from millrace.settings import Settings


def test_local_search_joins_what_belongs_together():
    # Two workers of 10000 vertices, two queries, each with 5000 vertices on either worker.
    start = querycut.Placement({0: [5000, 5000], 1: [5000, 5000]}, [0, 0])
    best, steps = querycut.iterated_local_search(start, 0.5)
    assert start.cost() == 10_000 and best.cost() == 0 and best.worst() <= 0.5 and steps


def test_local_search_never_ends_worse():
    rng = random.Random(3)
    for _ in range(10):
        start = querycut.Placement({c: [rng.randrange(100) for _ in range(3)] for c in range(4)}, [rng.randrange(200) for _ in range(3)])
        balanced = [s for s in querycut.iterated_local_search(start, 0.6, 0)[1] if s[0] == "balance"]
        best, _ = querycut.iterated_local_search(start, 0.6)
        assert best.cost() <= (balanced[-1][4] if balanced else start.cost())
        assert best.worst() <= max(0.6, balanced[-1][5] if balanced else start.worst())


def test_clusters_and_chunks():
    assert querycut.cluster_queries({0: 10, 1: 10, 2: 10}, {(0, 1): 8, (1, 2): 1}, 1) == [[0, 1], [2]]
    assert querycut.cluster_queries({0: 10, 1: 10, 2: 10}, {(0, 1): 8, (1, 2): 5}, 1) == [[0, 1, 2]]
    merged = querycut.merge_chunks([(frozenset({1}), 5), (frozenset({1, 2}), 9), (frozenset({3}), 7)], 2)
    assert merged == [(frozenset({1, 2}), 14), (frozenset({3}), 7)]


def test_trigger_table():
    given = Settings()
    fresh = lambda last=0.5, shots=0: querycut.MoveTrigger(given, last, shots)
    # decision, active, locality, worst, mean: fires?
    for row, want in [
        ((True, 16, 0.29, 0.0, 0.0), True),  # low
        ((True, 16, 0.39, 0.0, 0.0), True),  # fallen by more than 0.10
        ((True, 16, 0.53, 0.0, 0.0), True),  # risen by more than 0.02
        ((True, 16, 0.51, 0.0, 0.0), False),
        ((True, 16, 0.51, 0.79, 0.44), False),  # under limit and margin
        ((True, 16, 0.51, 0.81, 0.0), True),
        ((True, 16, 0.51, 0.0, 0.46), True),
        ((False, 16, 0.1, 1.0, 1.0), False),
        ((True, 15, 0.1, 1.0, 1.0), False),
    ]:
        assert fresh().fires(*row) is want, row
    assert not querycut.MoveTrigger(Settings(move_enabled=False)).fires(True, 16, 0.1, 1.0, 1.0)
    t = fresh()
    assert t.fires(True, 16, 0.2, 0.0, 0.0) and (t.last_locality, t.shots_left) == (0.2, 3)
    t = fresh(0.5, 2)
    assert t.fires(True, 16, 0.5, 0.9, 0.0) and t.shots_left == 2  # an imbalance spends no shot
    assert [t.fires(True, 16, 0.5, 0.0, 0.0) for _ in range(3)] == [True, True, False] and t.shots_left == 0


def test_moves_follow_the_search():
    start = querycut.Placement({0: [5, 3], 1: [2, 9], 2: [4, 0]}, [0, 0])
    steps = [("greedy", 0, 1, 0, 0, 0.0), ("perturb", 1, -1, 1, 0, 0.0), ("balance", 2, 0, 1, 0, 0.0)]
    moves = querycut.plan_moves(steps, start, {0: [10, 11], 1: [12], 2: [13]})
    assert moves == [querycut.Move(0, 1, (12, 13)), querycut.Move(1, 0, (10, 11))]


def test_search_limits():
    start = querycut.Placement({0: [5000, 5000], 1: [5000, 5000]}, [0, 0])
    assert querycut.iterated_local_search(start, budget_ms=0)[0].cost() == start.cost()
    assert querycut.iterated_local_search(start, iterations=0, greedy_iterations=0)[0].cost() == start.cost()


def test_migration_keeps_small_moves_away(spark):
    touched = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "query_id int, id long")
    parts = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id long, part int")
    assert {tuple(r) for r in querycut.migrate(touched, parts, [0], [], 0, 1).collect()} == {(1, 1), (2, 0), (3, 0)}
    assert {tuple(r) for r in querycut.migrate(touched, parts, [0], [1], 0, 1).collect()} == {(1, 1), (2, 1), (3, 0)}
    assert {tuple(r) for r in querycut.migrate(touched, parts, [0], [], 0, 1, min_move=2).collect()} == {(1, 0), (2, 0), (3, 0)}


def test_ldg_and_partition_independence(spark):
    edges = [(a, b) for c in (0, 10) for a in range(c, c + 5) for b in range(c, c + 5) if a != b]
    g = Graph.of(None, spark.createDataFrame(edges, "src long, dst long"))
    part = {r["id"]: r["part"] for r in partitioners.ldg(g, 2).collect()}
    assert len({part[i] for i in range(5)}) == 1 and len({part[i] for i in range(10, 15)}) == 1 and part[0] != part[10]
    many = Graph.of(None, g.edges.repartition(9))
    assert {r["id"]: r["part"] for r in partitioners.ldg(many, 2).collect()} == part
    rows = {r["id"]: r["row"] for r in partitioners.numbered(spark.range(100).toDF("id").repartition(6)).collect()}
    assert rows == {i: i for i in range(100)}


def test_query_hash_wraps(spark):
    q = spark.createDataFrame([(0, 2_000_000_000, 5), (1, 3, 4)], "query_id int, source long, target long")
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    got = {r["query_ids"]: r["query_hash"] for r in stats.query_groups(q).collect()}
    assert got == {"0": wrap(31 * (31 + 2_000_000_000) + 5), "1": 31 * 34 + 4}


def test_steps_within_a_window(spark):
    rows = spark.createDataFrame([(0, 1, 5.0), (1, 1, 4.0), (1, 2, 4.0), (2, 1, 3.0)], "superstep int, query_id int, wall_ms double")
    assert [querycut.steps_within(rows, ms) for ms in (0, 2.9, 3.0, 7.0, 100)] == [1, 1, 2, 3, 3]
