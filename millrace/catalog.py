"""The engine's queries over the driver tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.operators import partitioners, querycut, stats
from millrace.plans import programs, workload
from millrace.runtime import materialise, table
from millrace.settings import Settings
from millrace.sources import readers, sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PAIRS = [(0, 0, 7), (1, 3, 11), (2, 20, 5), (3, 1, 1)]
BATCH = [(i, (i * 5) % 25, (i * 7 + 3) % 25) for i in range(16)]
TAGGED = [(0, 0, 3), (1, 7, 1), (2, 12, 2), (3, 24, 4)]
ROUNDS = 24  # nations less one


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


def _queries(spark: SparkSession, rows: list[tuple], last: str = "target") -> DataFrame:
    return spark.createDataFrame(rows, f"query_id int, source long, {last} long")


def _distances_sql(edges: str, rows: list[tuple], rounds: int = ROUNDS) -> str:
    """CTEs e, q, bf and d(query_id, v, dist): Bellman-Ford in rounds."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}),
q(query_id, src, dst) AS (VALUES {_values(rows)}),
bf(k, query_id, v, dist) AS (
  SELECT 0, query_id, CAST(src AS BIGINT), CAST(0 AS DOUBLE) FROM q
  UNION ALL
  SELECT k, query_id, v, min(dist) FROM (
    SELECT k + 1 AS k, query_id, v, dist FROM bf WHERE k < {rounds}
    UNION ALL
    SELECT k + 1, bf.query_id, e.dst, bf.dist + e.w FROM bf JOIN e ON e.src = bf.v WHERE k < {rounds})
  GROUP BY k, query_id, v),
d AS MATERIALIZED (SELECT query_id, v, dist FROM bf WHERE k = {rounds})"""


def _paths_sql(edges: str, rows: list[tuple], rounds: int = ROUNDS) -> str:
    return f"""{_distances_sql(edges, rows, rounds)},
pre AS MATERIALIZED (
  SELECT d.query_id, d.v, min(p.v) AS pre FROM d JOIN q USING (query_id) JOIN e ON e.dst = d.v
  JOIN d p ON p.query_id = d.query_id AND p.v = e.src AND p.dist + e.w = d.dist WHERE d.v <> q.src GROUP BY 1, 2),
walk(query_id, step, vertex) AS (
  SELECT q.query_id, 0, CAST(q.dst AS BIGINT) FROM q JOIN d ON d.query_id = q.query_id AND d.v = q.dst
  UNION ALL
  SELECT w.query_id, w.step + 1, pre.pre FROM walk w JOIN pre ON pre.query_id = w.query_id AND pre.v = w.vertex),
path AS (SELECT w.query_id, w.step, w.vertex, d.dist FROM walk w JOIN d ON d.query_id = w.query_id AND d.v = w.vertex)"""


# -- shortest paths ----------------------------------------------------------------------


@query(_distances_sql(tables.NATION_SQL, PAIRS) + " SELECT query_id, v AS id, dist FROM d")
def sssp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.nation_trade(spark, sf_dir).materialised()
    return programs.shortest_paths(graph, _queries(spark, PAIRS), prune=False).state.select("query_id", "id", "dist")


@query(_distances_sql(tables.NATION_SQL, PAIRS) + " SELECT q.query_id, q.src AS source, q.dst AS target, d.dist FROM q LEFT JOIN d ON d.query_id = q.query_id AND d.v = q.dst")
def sp_target_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.answer(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, PAIRS))[1]


@query(_paths_sql(tables.NATION_SQL, PAIRS) + " SELECT query_id, step, vertex, dist FROM path")
def sp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.answer(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, PAIRS))[0]


@query(_paths_sql(tables.NATION_SQL, PAIRS) + """ SELECT query_id, step, CASE WHEN dist = 0 THEN CAST(vertex AS VARCHAR) ELSE vertex || chr(9) || CAST(dist AS VARCHAR) END AS line
FROM (SELECT query_id, step, vertex, CAST(dist AS BIGINT) AS dist FROM path)""")
def sp_path_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = workload.answer(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, PAIRS))[0]
    return sinks.path_lines(walked.withColumn("dist", F.col("dist").cast("long")))


@query(_paths_sql(tables.NATION_SQL, BATCH) + " SELECT query_id, step, vertex, dist FROM path")
def sp_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full batch of concurrent queries over the whole trade graph."""
    return workload.answer(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, BATCH))[0]


#: Suppliers' vertices of the customer graph, which has every line as an edge both ways, and the rounds in which its SQL settles.
SUPPLIERS = [(0, 3, 7), (1, 5, 3), (2, 7, 15), (3, 9, 9)]
SETTLED = 40
_BOTH_WAYS = f"SELECT src, dst, CAST(w AS DOUBLE) AS w FROM ({tables.CUST_SUPP_SQL}) UNION ALL SELECT dst, src, CAST(w AS DOUBLE) FROM ({tables.CUST_SUPP_SQL})"
LOCAL = 200_000


def _customer_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return tables.cust_supp(spark, sf_dir).materialised().symmetric().materialised()


@query(_distances_sql(_BOTH_WAYS, SUPPLIERS, SETTLED) + " SELECT query_id, v AS id, dist FROM d")
def customer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances over a graph that grows with the tables."""
    return programs.shortest_paths(_customer_graph(spark, sf_dir), _queries(spark, SUPPLIERS), prune=False).state.select("query_id", "id", "dist")


@query(_paths_sql(_BOTH_WAYS, SUPPLIERS, SETTLED) + " SELECT query_id, step, vertex, dist FROM path")
def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned searches with their paths over the same graph."""
    return workload.answer(_customer_graph(spark, sf_dir), _queries(spark, SUPPLIERS))[0]


@query(_distances_sql(tables.NATION_SQL, PAIRS) + " SELECT query_id, v AS id, dist FROM d")
def sssp_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.nation_trade(spark, sf_dir).materialised()
    return programs.shortest_paths(graph, _queries(spark, PAIRS), prune=False, local_edges=LOCAL).state.select("query_id", "id", "dist")


@query(_paths_sql(tables.NATION_SQL, BATCH) + " SELECT query_id, step, vertex, dist FROM path")
def sp_batch_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.answer(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, BATCH), LOCAL)[0]


@query(_distances_sql(tables.NATION_SQL, PAIRS) + " SELECT query_id, v AS id, dist FROM d")
def sssp_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far vertices wait; the step is a mean edge's weight."""
    graph = tables.nation_trade(spark, sf_dir).materialised()
    factor = graph.edges.agg(F.avg("weight")).first()[0]
    return programs.shortest_paths(graph, _queries(spark, PAIRS), prune=False, step_factor=factor).state.select("query_id", "id", "dist")


@query(_paths_sql(tables.NATION_SQL, PAIRS) + """ SELECT p.query_id, p.vertex AS id, coalesce(pre.pre, -1) || ':' || CAST(p.dist AS BIGINT) || ':false:true' AS value
FROM path p LEFT JOIN pre ON pre.query_id = p.query_id AND pre.v = p.vertex""")
def sp_on_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the vertices on each path put out, marked by a second phase."""
    done = programs.shortest_paths(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, PAIRS), mark=True)
    return sinks.path_values(done.state.withColumn("dist", F.col("dist").cast("long"))).select("query_id", "id", "value")


_INNER = f"SELECT * FROM ({tables.NATION_SQL}) WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)"


@query(_distances_sql(_INNER, PAIRS) + " SELECT query_id, v AS id, dist FROM d WHERE v IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)")
def absent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances where the nations of a region are no vertices although edges name them: what is sent to them is dropped."""
    graph = tables.nation_trade(spark, sf_dir)
    graph = Graph.of(graph.vertices.where("tag <> 3"), graph.edges).materialised()
    return programs.shortest_paths(graph, _queries(spark, PAIRS), prune=False).state.select("query_id", "id", "dist")


PLAN = ["start\t0\t7\tfirst", "start\t3\t11", "wait\t10", "waitall", "start\t20\t5", "note", "start\t1\t1"]


@query(_paths_sql(tables.NATION_SQL, PAIRS) + " SELECT query_id, step, vertex, dist FROM path")
def workload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload plan in batches of at most two."""
    rows = readers.batches(readers.parse_workload(PLAN), 2)
    plan = spark.createDataFrame(rows, "query_id int, batch int, source long, target long")
    return workload.run_workload(tables.nation_trade(spark, sf_dir), plan)[0]


@query("SELECT * FROM (VALUES (0, 0, 0, 7), (1, 0, 3, 11), (2, 1, 20, 5), (3, 1, 1, 1)) t(query_id, batch, source, target)")
def workload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(readers.batches(readers.parse_workload(PLAN), 2), "query_id int, batch int, source long, target long")


@query(_distances_sql(tables.NATION_SQL, TAGGED) + """ SELECT query_id, v AS vertex, dist FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY d.dist, d.v) AS k FROM d JOIN q USING (query_id) JOIN nation ON n_nationkey = d.v WHERE n_regionkey = q.dst) WHERE k = 1""")
def nearest_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.nation_trade(spark, sf_dir).materialised()
    return programs.nearest_tagged(graph, _queries(spark, TAGGED, "tag"), graph.vertices.select("id", "tag"))


@query(ORACLE_SQL["nearest_tag"])
def nearest_tag_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.nation_trade(spark, sf_dir).materialised()
    return programs.nearest_tagged(graph, _queries(spark, TAGGED, "tag"), graph.vertices.select("id", "tag"), LOCAL)


_HOPS = f"""WITH RECURSIVE e AS MATERIALIZED ({tables.NATION_SQL}),
q(query_id, src, dst) AS (VALUES {_values(PAIRS)}),
b(query_id, v, hops) AS (
  SELECT query_id, CAST(src AS BIGINT), 0 FROM q
  UNION
  SELECT b.query_id, e.dst, b.hops + 1 FROM b JOIN e ON e.src = b.v WHERE b.hops < {ROUNDS}),
h AS (SELECT query_id, v AS id, min(hops) AS hops FROM b GROUP BY 1, 2)"""


def _hops(spark: SparkSession, sf_dir: str):
    return programs.frontier_hops(tables.nation_trade(spark, sf_dir).known().materialised(), _queries(spark, PAIRS))


@query(_HOPS + " SELECT query_id, id, hops FROM h")
def frontier_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir).state.select("query_id", "id", "hops")


@query(_HOPS + " SELECT query_id, 31 * (31 + src) + dst AS query_hash, max(hops) + 1 AS supersteps, count(*) AS vertices, count(*) AS work FROM h JOIN q USING (query_id) GROUP BY 1, 2")
def query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.query_summary(_hops(spark, sf_dir).supersteps(), _queries(spark, PAIRS))


@query(_HOPS + " SELECT hops AS superstep, query_id, count(*) AS active, sum(count(*)) OVER (PARTITION BY query_id ORDER BY hops)::BIGINT AS touched FROM h GROUP BY 1, 2")
def superstep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir).supersteps().select("superstep", "query_id", "active", "touched")


@query(_HOPS + ", last AS (SELECT max(hops) AS m FROM h) SELECT DISTINCT id FROM h, last WHERE hops >= m - 1")
def recently_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _hops(spark, sf_dir).state
    now = state.agg(F.max("last_step")).first()[0]
    return querycut.recently_active(state, now, 1)


@query(_HOPS + ", s AS (SELECT query_id, hops, min(id % 4) AS lo, max(id % 4) AS hi FROM h GROUP BY 1, 2) SELECT query_id, count(*) AS supersteps, count(*) FILTER (lo = hi) AS local FROM s GROUP BY 1")
def local_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _hops(spark, sf_dir)
    return stats.local_supersteps(done.touched(), done.state.select("id").distinct().select("id", (F.col("id") % 4).alias("part")))


# -- PageRank, components, labels -----------------------------------------------------------


@query(f"""WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT user_id AS id FROM events), n AS (SELECT count(*) AS n FROM v),
e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM ({tables.USER_FLOW_SQL})),
r(k, id, rank) AS (
  SELECT 0, id, 1.0::DOUBLE / n FROM v, n
  UNION ALL
  SELECT k, id, 0.15::DOUBLE / max(n) + 0.85::DOUBLE * sum(s) FROM (
    SELECT k + 1 AS k, id, 0::DOUBLE AS s FROM r WHERE k < 30
    UNION ALL
    SELECT k + 1, e.dst, rank / deg FROM r JOIN e ON e.src = r.id WHERE k < 30), n
  GROUP BY k, id)
SELECT id, round(rank, 9) AS rank FROM r WHERE k = 30""")
def pagerank_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.pagerank(tables.user_flow(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


_WCC = f"""WITH RECURSIVE e0 AS ({tables.CUST_SUPP_SQL}),
e AS MATERIALIZED (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0),
c(k, id, label) AS (
  SELECT 0, id, id FROM (SELECT DISTINCT src AS id FROM e)
  UNION ALL
  SELECT k, id, min(label) FROM (
    SELECT k + 1 AS k, id, label FROM c WHERE k < {ROUNDS}
    UNION ALL
    SELECT k + 1, e.dst, c.label FROM c JOIN e ON e.src = c.id WHERE k < {ROUNDS})
  GROUP BY k, id),
w AS (SELECT id, label AS component FROM c WHERE k = {ROUNDS})"""


@query(_WCC + " SELECT id, component FROM w")
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.components(tables.cust_supp(spark, sf_dir).materialised())


@query(_WCC + " SELECT component, count(*) AS n FROM w GROUP BY 1")
def wcc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.component_sizes(tables.cust_supp(spark, sf_dir).materialised())


@query(_WCC + " SELECT component || chr(9) || count(*) AS line FROM w GROUP BY component")
def wcc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.component_lines(programs.component_sizes(tables.cust_supp(spark, sf_dir).materialised()))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({tables.USER_FLOW_SQL})),
c(id, label) AS (SELECT DISTINCT user_id, user_id FROM events UNION SELECT e.dst, c.label FROM c JOIN e ON e.src = c.id)
SELECT id, min(label) AS label FROM c GROUP BY id""")
def directed_min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.directed_min_label(tables.user_flow(spark, sf_dir))


# -- degrees, formats -------------------------------------------------------------------------


@query(f"WITH e AS ({tables.SUPP_PART_SQL}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, count(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.supp_part(spark, sf_dir).out_degree()


@query(f"WITH e AS ({tables.SUPP_PART_SQL}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, count(src) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.supp_part(spark, sf_dir).in_degree()


_LINES = f"""WITH e AS ({tables.NATION_SQL}),
a AS (SELECT src, string_agg(dst || ',' || CAST(w AS BIGINT), ';' ORDER BY dst, w) AS t FROM e GROUP BY src)
SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey || coalesce('|' || t, '') AS line FROM nation LEFT JOIN a ON src = n_nationkey"""


@query(_LINES)
def adjacency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.adjacency_lines(tables.nation_trade(spark, sf_dir))


@query(f"SELECT src, dst, w AS weight FROM ({tables.NATION_SQL})")
def adjacency_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after writing the text format and reading it again."""
    lines = readers.adjacency_lines(tables.nation_trade(spark, sf_dir))
    return readers.parse_adjacency(materialise(lines.select(F.col("line").alias("value")), "lines")).edges


@query(_distances_sql(tables.NATION_SQL, PAIRS) + " SELECT query_id, v || chr(9) || CAST(dist AS BIGINT) AS line FROM d")
def vertex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = programs.shortest_paths(tables.nation_trade(spark, sf_dir).materialised(), _queries(spark, PAIRS), prune=False).state
    return sinks.vertex_lines(state.withColumn("value", F.col("dist").cast("long")))


# -- partitioners ---------------------------------------------------------------------------


_VERTICES = f"e AS ({tables.SUPP_PART_SQL}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


@query(f"WITH {_VERTICES} SELECT id, CAST((id * 31 + count(src)) % 8 AS INTEGER) AS part FROM v LEFT JOIN e ON src = id GROUP BY id")
def part_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.hashed(tables.supp_part(spark, sf_dir), 8)


@query(f"WITH {_VERTICES}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row, count(*) OVER () AS n FROM v) SELECT id, CAST(row // CAST(ceil(n / 8) AS BIGINT) AS INTEGER) AS part FROM r")
def part_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.ranges(tables.supp_part(spark, sf_dir), 8)


_BLOCKS = f"WITH {_VERTICES}, r AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS block, CAST(ceil(count(*) OVER () / 50) AS BIGINT) AS n FROM v)"


@query(_BLOCKS + " SELECT id, CAST(least(block // (n // 4), 3) AS INTEGER) AS part FROM r")
def part_block_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.block_continuous(tables.supp_part(spark, sf_dir), 4, 50)


@query(_BLOCKS + " SELECT id, CAST(block % 4 AS INTEGER) AS part FROM r")
def part_block_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.block_roundrobin(tables.supp_part(spark, sf_dir), 4, 50)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the parts table laid out on a grid of whole numbers."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), (key * 37 % 101).cast("double").alias("lat"), (key * 61 % 103).cast("double").alias("lon"))


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(key.cast("int").alias("spot"), (key * 400 + 100).alias("size"), (key * 23 % 101).cast("double").alias("lat"), (key * 41 % 103).cast("double").alias("lon"))


_PLACES = """WITH p AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 101 AS DOUBLE) AS lat, CAST(p_partkey * 61 % 103 AS DOUBLE) AS lon FROM part),
s AS (SELECT r_regionkey AS spot, r_regionkey * 400 + 100 AS size, CAST(r_regionkey * 23 % 101 AS DOUBLE) AS lat, CAST(r_regionkey * 41 % 103 AS DOUBLE) AS lon FROM region),
d AS (SELECT id, spot, size, (p.lat - s.lat) * (p.lat - s.lat) + (p.lon - s.lon) * (p.lon - s.lon) AS d2 FROM p, s)"""


@query(_PLACES + " SELECT id, spot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, spot) AS k FROM d) WHERE k = 1")
def part_closest_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.closest_city_of(_places(spark, sf_dir), _spots(spark, sf_dir))


@query(_PLACES + " SELECT id, spot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT d2 <= size / 2.0, d2, spot) AS k FROM d) WHERE k = 1")
def part_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.hotspot_of(_places(spark, sf_dir), _spots(spark, sf_dir), 2.0)


@query(_PLACES.replace("WITH p", "WITH RECURSIVE p", 1) + """,
c AS (SELECT id, spot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT d2 <= size / 2.0, d2, spot) AS k FROM d) WHERE k = 1),
n AS MATERIALIZED (SELECT spot, count(*) AS n, row_number() OVER (ORDER BY spot) AS k FROM c GROUP BY spot),
l(k, loads, spot, part) AS (
  SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT), 0, 0], CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
  UNION ALL
  SELECT l.k + 1, list_transform(l.loads, lambda x, i: x + CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN n.n ELSE 0 END), n.spot, CAST(list_position(l.loads, list_min(l.loads)) - 1 AS INTEGER)
  FROM l JOIN n ON n.k = l.k + 1)
SELECT id, part FROM c JOIN l USING (spot)""")
def part_hotspot_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.hotspot(_places(spark, sf_dir), _spots(spark, sf_dir), 3, 2.0)


@query()
def part_ldg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioners.ldg(tables.cust_supp(spark, sf_dir).symmetric(), 4)


# -- query cut ------------------------------------------------------------------------------


_TOUCHED = "SELECT DISTINCT s_nationkey % 6 AS query_id, o_custkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of six queries: the customers who bought from a group of nations."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select((F.col("s_nationkey") % 6).alias("query_id"), F.col("o_custkey").alias("id")).distinct()


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (key * key % 7 % 4).cast("int").alias("part"))


_CHUNKS = f"WITH t AS ({_TOUCHED}), c AS (SELECT list_sort(list(query_id)) AS queries FROM t GROUP BY id), k AS (SELECT queries, count(*) AS n FROM c GROUP BY 1)"
_PARTS = "(SELECT c_custkey AS id, CAST(c_custkey * c_custkey % 7 % 4 AS INTEGER) AS part FROM customer)"


@query(_CHUNKS + " SELECT array_to_string(queries, ',') AS queries, n FROM k WHERE n >= 2")
def intersect_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querycut.intersect_chunks(_touched(spark, sf_dir), min_size=2).select(F.array_join(F.transform("queries", lambda x: x.cast("string")), ",").alias("queries"), "n")


@query(_CHUNKS + " SELECT array_to_string(queries, ',') AS queries, n FROM k ORDER BY n DESC, k.queries LIMIT 10")
def top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = querycut.top_chunks(querycut.intersect_chunks(_touched(spark, sf_dir)), 10)
    return rows.select(F.array_join(F.transform("queries", lambda x: x.cast("string")), ",").alias("queries"), "n")


@query(f"WITH t AS ({_TOUCHED}) SELECT a.query_id AS q1, b.query_id AS q2, count(*) AS n FROM t a JOIN t b ON a.id = b.id AND a.query_id < b.query_id GROUP BY 1, 2")
def query_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querycut.query_overlap(querycut.intersect_chunks(_touched(spark, sf_dir)))


_PER_PART = f"WITH t AS ({_TOUCHED}), p AS (SELECT query_id, part, count(*) AS n FROM t JOIN {_PARTS} USING (id) GROUP BY 1, 2)"


@query(_PER_PART + " SELECT query_id, CAST(sum(n) - max(n) AS BIGINT) AS separated FROM p GROUP BY 1")
def cut_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querycut.cut_cost(_touched(spark, sf_dir), _parts(spark, sf_dir))


@query(_PER_PART + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, part) AS k, sum(n) OVER (PARTITION BY query_id) AS total FROM p) SELECT query_id, part AS largest_part, round(n / total, 9) AS locality FROM r WHERE k = 1")
def query_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querycut.query_locality(_touched(spark, sf_dir), _parts(spark, sf_dir)).withColumn("locality", F.round("locality", 9))


@query(f"WITH c AS (SELECT part, count(*) AS n FROM {_PARTS} GROUP BY 1), w AS (SELECT CAST(range AS INTEGER) AS part, coalesce(n, 0) AS n FROM range(4) LEFT JOIN c ON part = range), a AS (SELECT sum(n) // 4 AS avg FROM w) SELECT part, n, round(abs(n - avg) / avg, 9) AS factor FROM w, a")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querycut.imbalance(_parts(spark, sf_dir), 4).withColumn("factor", F.round("factor", 9))


@query(f"""WITH t AS ({_TOUCHED}) SELECT id, CASE WHEN part = 1 AND id IN (SELECT id FROM t WHERE query_id IN (0, 1)) AND id NOT IN (SELECT id FROM t WHERE query_id NOT IN (0, 1, 2)) THEN 3 ELSE part END AS part FROM {_PARTS}""")
def migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querycut.migrate(_touched(spark, sf_dir), _parts(spark, sf_dir), [0, 1], [2], 1, 3)


def _clusters(spark: SparkSession, sf_dir: str) -> list[list[int]]:
    touched = materialise(_touched(spark, sf_dir), "touched")
    sizes = {r[0]: r[1] for r in touched.groupBy("query_id").count().collect()}  # one row a query
    overlap = {(r[0], r[1]): r[2] for r in querycut.query_overlap(querycut.intersect_chunks(touched)).collect()}
    return querycut.cluster_queries(sizes, overlap, 3)


@query()
def query_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, members in enumerate(_clusters(spark, sf_dir)) for q in members], "cluster int, query_id int")


@query()
def ils_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterated local search over three query clusters on four parts."""
    of = {q: i for i, members in enumerate(_clusters(spark, sf_dir)) for q in members}
    touched, parts = _touched(spark, sf_dir), _parts(spark, sf_dir)
    cluster = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("query_id")]
    rows = touched.select(cluster.alias("query_id"), "id").distinct()
    n = {c: [0] * 4 for c in set(of.values())}
    for r in querycut.per_part(rows, parts).collect():  # clusters x parts
        n[r["query_id"]][r["part"]] = r["n"]
    free = [0] * 4
    for r in parts.join(touched.select("id"), "id", "left_anti").groupBy("part").count().collect():
        free[r["part"]] = r["count"]
    start = querycut.Placement(n, free)
    steps = querycut.iterated_local_search(start)[1]
    return spark.createDataFrame([(0, "start", -1, -1, -1, start.cost(), start.worst()), *[(i + 1, *s) for i, s in enumerate(steps)]], "step int, kind string, cluster int, source int, target int, cost long, worst double")


@query()
def adaptive_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision over the six scopes, carried out: each query's separated vertices before and after."""
    given = Settings(intersect_sampling=1, query_cut_min_chunk=1, min_move_vertices=1, clusters_per_worker=1, max_imbalance=3.0, move_budget_ms=0, greedy_ms=0)
    touched, decider = materialise(_touched(spark, sf_dir), "touched"), workload.Adaptive(materialise(_parts(spark, sf_dir), "parts"), 4, given)
    before = querycut.cut_cost(touched, decider.parts).withColumnRenamed("separated", "before")
    decider.carry_out(touched, decider.decide(touched))
    return before.join(querycut.cut_cost(touched, decider.parts).withColumnRenamed("separated", "after"), "query_id")


@query("SELECT o_orderkey AS query_id, epoch_ms(o_orderdate) AS finished_ms FROM orders WHERE epoch_ms(o_orderdate) BETWEEN 880000000000 - 20000000000 AND 880000000000 ORDER BY 2 DESC, 1 DESC LIMIT 128")
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("finished_ms"))
    return querycut.recent_queries(history, 880_000_000_000, 20_000_000_000, 128)


# -- statistics -----------------------------------------------------------------------------


_HASH = "CAST((((o_custkey * 1000003 + 31) * 31 + o_orderkey + 2147483648) % 4294967296) - 2147483648 AS INTEGER)"


def _hash_groups(orders: DataFrame) -> DataFrame:
    return stats.query_groups(orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") * 1000003).alias("source"), F.col("o_orderkey").alias("target")))


@query(f"WITH h AS (SELECT o_orderkey AS query_id, {_HASH} AS query_hash FROM orders) SELECT query_hash, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS query_ids FROM h GROUP BY 1")
def query_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_groups(table(spark, sf_dir, "orders"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the samples of four workers."""
    w = F.pmod("user_id", F.lit(4)).cast("int")
    rows = table(spark, sf_dir, "events").select(w.alias("worker"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), "event_id", "value", (F.col("event_type") == "error").cast("long").alias("local"))
    return rows.withColumn("sample_no", F.row_number().over(Window.partitionBy("worker").orderBy("t_ms", "event_id")) - 1)


_SAMPLES = """WITH s AS (SELECT CAST(user_id % 4 AS INTEGER) AS worker, epoch_us(ts) // 1000 AS t_ms, event_id, value, CAST(event_type = 'error' AS BIGINT) AS local,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS sample_no FROM events)"""


@query("SELECT event_id // 100 AS block, round(avg(value), 6) AS value FROM events GROUP BY 1")
def downsample_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.downsample(table(spark, sf_dir, "events"), 100, ["value"], "event_id").withColumn("value", F.round("value", 6))


@query(_SAMPLES + """, r AS (SELECT t_ms, worker, sum(local) OVER w AS local, count(*) OVER w AS steps FROM s WINDOW w AS (PARTITION BY worker ORDER BY t_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
SELECT t_ms, round(CASE WHEN (steps - local) / 4.0 + local > 0 THEN local / ((steps - local) / 4.0 + local) ELSE 0 END, 9) AS lsru FROM r""")
def trailing_window_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select("t_ms", F.col("worker").alias("part_of_log"), F.lit(1).alias("supersteps"), F.col("local").alias("local_supersteps"))
    return stats.trailing_locality(rows, 4, 3_600_000).withColumn("lsru", F.round("lsru", 9))


@query(_SAMPLES + """, d AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY worker ORDER BY sample_no) AS dt_ms FROM s)
SELECT worker, sample_no, dt_ms, round(value * 1e6 / 1e6 * 1000 / dt_ms, 6) AS busy FROM d WHERE dt_ms > 0""")
def worker_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("busy", F.col("value") * 1e6)
    return stats.normalised_series(rows, ["busy"]).withColumn("busy", F.round("busy", 6))


@query(_SAMPLES + " SELECT sample_no, round(avg(value), 6) AS value FROM s WHERE sample_no > 0 GROUP BY 1 HAVING count(*) = 4")
def cross_worker_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cross_worker_average(_samples(spark, sf_dir), ["value"]).withColumn("value", F.round("value", 6))


@query(_SAMPLES + """, d AS (SELECT sample_no, abs(avg(value) OVER (PARTITION BY sample_no) - value) / avg(value) OVER (PARTITION BY sample_no) * 100 AS x FROM s)
SELECT sample_no, round(avg(x), 6) AS avg_value, round(max(x), 6) AS max_value FROM d GROUP BY 1""")
def imbalance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.imbalance_series(_samples(spark, sf_dir), ["value"]).select("sample_no", F.round("avg_value", 6).alias("avg_value"), F.round("max_value", 6).alias("max_value"))


@query("""WITH q AS (SELECT user_id AS query_id, count(*) AS steps, count(*) FILTER (event_type = 'error') AS local, sum(event_id) AS compute FROM events GROUP BY 1),
u AS (SELECT *, (steps - local) / 4.0 + local AS uniq FROM q)
SELECT query_id, CAST(3 * steps AS BIGINT) AS messages_total, round(100.0 * local / steps, 6) AS local_ratio, uniq AS supersteps_unique, round(100.0 * local / uniq, 6) AS local_ratio_unique, CAST(compute + steps AS BIGINT) AS time_sum FROM u""")
def query_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns of per-query counters, with events standing in for supersteps."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.count(F.lit(1)).alias("supersteps"), F.count_if(F.col("event_type") == "error").alias("local_supersteps"), F.sum("event_id").alias("compute_time"))
    rows = rows.select("*", F.lit(4).alias("workers"), F.col("supersteps").alias("messages_local"), F.col("supersteps").alias("messages_unicast"), F.col("supersteps").alias("messages_broadcast"), F.col("supersteps").alias("finish_time"))
    return stats.query_totals(rows).withColumns({c: F.round(c, 6) for c in ("local_ratio", "local_ratio_unique")})


@query(f"WITH {_VERTICES} SELECT id FROM v WHERE CAST('0x' || substr(md5('sample:' || id), 1, 15) AS BIGINT) % 10 = 0")
def vertex_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vertex_sample(tables.supp_part(spark, sf_dir).vertices, 10)


@query(f"""WITH {_VERTICES} SELECT id, CASE WHEN CAST('0x' || substr(md5('tagged:' || id), 1, 15) AS BIGINT) % 1000000 < 100000
  THEN CAST('0x' || substr(md5('tag:' || id), 1, 15) AS BIGINT) % 5 ELSE -1 END AS tag FROM v""")
def tag_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.assign_tags(tables.supp_part(spark, sf_dir).vertices, 0.1, 5)


__all__ = ["Graph", "ORACLE_SQL", "QUERIES"]
