"""The vertex programs: shortest paths, nearest tag, PageRank, components, directed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.operators.components import connected_components
from millrace.plans import local
from millrace.plans.supersteps import Run, VertexProgram, run
from millrace.runtime import bucketed, materialise


class ShortestPaths(VertexProgram):
    """Label-correcting distances from each query's source, pruned at its target.

    queries(query_id, source, target or null). A row holds dist and pre, the smallest
    predecessor among those on a shortest path (-1 at the source). zero tells that the
    last edge weighs 0; such an edge never replaces a predecessor at an equal distance,
    so that predecessors form no cycle. Once the target (or a vertex with the query's
    tag) has a distance, senders beyond it stop.

    With `mark` a second phase follows: reached targets send a letter to their predecessor,
    that to its own, and so on; on_path tells who lies on a query's path.
    """

    name = "shortest-paths"

    def __init__(self, prune: bool = True, step_factor: float | None = None, mark: bool = False):
        self.prune, self.step_factor, self.mark, self.marking = prune, step_factor, mark, False
        self.values = ["dist", "pre", "zero", "goal", *(["on_path"] if mark else [])]

    def start(self, graph: Graph, queries: DataFrame) -> DataFrame:
        rows = queries.select("query_id", F.col("source").cast("long").alias("id"), F.col("target").cast("long").alias("goal"))
        rows = rows.join(graph.vertices.select("id"), "id", "left_semi")
        marks = [F.lit(False).alias("on_path")] if self.mark else []
        return rows.select("query_id", "id", F.lit(0.0).alias("dist"), F.lit(-1).cast("long").alias("pre"), F.lit(0).alias("zero"), "goal", *marks)

    def message(self) -> list[Column] | None:
        if self.marking:
            return None
        return [F.struct((F.col("src_dist") + F.col("weight")).alias("dist"), (F.col("weight") == 0).cast("int").alias("zero"), F.col("src_id").alias("pre"), F.col("src_goal").alias("goal")).alias("best")]

    def letters(self, senders: DataFrame) -> DataFrame | None:
        return senders.where("src_pre >= 0").select("query_id", F.col("src_pre").alias("id"), F.lit(True).alias("mark")) if self.marking else None

    def combine(self) -> list[Column]:
        return [F.max("mark").alias("mark")] if self.marking else [F.min("best").alias("best")]

    def _better(self) -> Column:
        new = F.col("in_best")
        equal = (new["dist"] == F.col("dist")) & (new["zero"] == 0) & ((F.col("zero") == 1) | (new["pre"] < F.col("pre")))
        return F.col("in_any").isNotNull() & (F.col("dist").isNull() | (new["dist"] < F.col("dist")) | equal)

    def apply(self) -> list[Column]:
        if self.marking:
            return [*[F.col(c) for c in self.values if c != "on_path"], (F.col("on_path") | F.col("was_active") | F.col("in_any").isNotNull()).alias("on_path")]
        take = self._better()
        rest = [F.coalesce(c, F.col(f"in_best.{c}")).alias(c) for c in self.values[3:] if c != "on_path"]
        marks = [F.coalesce("on_path", F.lit(False)).alias("on_path")] if self.mark else []
        return [F.when(take, F.col(f"in_best.{c}")).otherwise(F.col(c)).alias(c) for c in ("dist", "pre", "zero")] + rest + marks

    def active(self) -> Column:
        if self.marking:
            return F.col("in_any").isNotNull()
        return F.col("in_any").isNotNull() & (F.col("dist").isNull() | (F.col("in_best.dist") < F.col("dist")))

    def aggregate(self) -> list[Column]:
        return [F.min(F.when(F.col("id") == F.col("goal"), F.col("dist"))).alias("reached")]

    def fold(self, before: dict, now: dict) -> dict:
        """Distances only fall, so the least so far is the least of all."""
        known = [x for x in (before.get("reached"), now.get("reached")) if x is not None]
        return {"reached": min(known, default=None)}

    def hold(self, step: int) -> Column | None:
        """Far vertices wait until the steps have caught up with their distance; results don't change."""
        return None if self.step_factor is None or self.marking else F.col("dist") > (step + 1) * self.step_factor

    def bound(self) -> Column | None:
        return (F.col("dist") <= F.col("agg_reached")) | F.col("agg_reached").isNull() if self.prune and not self.marking else None

    def next_phase(self, state: DataFrame) -> DataFrame | None:
        if not self.mark or self.marking:
            return None
        self.marking = True
        return state.where("id = goal").select("query_id", "id")


def shortest_paths(graph: Graph, queries: DataFrame, prune: bool = True, local_edges: int = 0, step_factor: float | None = None, mark: bool = False) -> Run:
    """Distances of queries(query_id, source, target) over a graph of checked weights.

    A graph of at most local_edges edges is searched inside tasks, in the same rounds (0:
    never). step_factor throttles far vertices; mark adds on_path to the state.
    """
    graph.check_weights()
    if step_factor is None and not mark and local_edges and local.fits(graph, local_edges):
        state, steps = local.search(graph, queries, prune)
        return Run(graph.edges.sparkSession, state.drop("hit"), steps, local=True)
    return run(ShortestPaths(prune, step_factor, mark), graph, queries)


def paths(done: Run, targets: DataFrame) -> DataFrame:
    """(query_id, step, vertex, dist) from each target back to its source; step 0 is the target.

    done is a run of shortest_paths, targets(query_id, target) has a row per admitted
    query. An unreached target has no rows. Predecessors are followed by doubling: a level
    holds for every touched vertex the one 2^k steps before it, so a path of n steps takes
    about 2 log2(n) jobs.
    """
    if done.local:  # a query's state is no larger than the small graph
        return done.state.select("query_id", "id", "dist", "pre", "goal").groupBy("query_id").applyInPandas(local.walk, "query_id int, step int, vertex long, dist double")
    reached = done.state.select("query_id", "id", "dist", "pre")
    at = targets.select("query_id", F.col("target").cast("long").alias("id")).join(reached.select("query_id", "id"), ["query_id", "id"], "left_semi")
    at = materialise(at.select("query_id", "id", F.lit(0).alias("step")), "path-0")
    wanted = at.select("query_id").distinct()
    up = materialise(reached.where("pre >= 0").join(wanted, "query_id", "left_semi").select("query_id", "id", F.col("pre").alias("up")), "up-0")
    levels: list[DataFrame] = []
    while not up.isEmpty():
        levels.append(up)
        then = up.select("query_id", F.col("id").alias("up"), F.col("up").alias("further"))
        up = materialise(up.join(then, ["query_id", "up"]).select("query_id", "id", F.col("further").alias("up")), f"up-{len(levels)}")
    for k in reversed(range(len(levels))):
        more = at.join(levels[k], ["query_id", "id"]).select("query_id", F.col("up").alias("id"), (F.col("step") + 2**k).alias("step"))
        at = materialise(at.unionByName(more), "path")
    return at.join(reached.select("query_id", "id", "dist"), ["query_id", "id"]).select("query_id", "step", F.col("id").alias("vertex"), "dist")


class NearestTag(ShortestPaths):
    """Shortest paths to any vertex with the query's tag; senders beyond the nearest hit stop.

    Edges carry their target's tag, so a vertex learns with its first message whether it is a hit.
    """

    name = "nearest-tag"

    def __init__(self, tags: DataFrame):
        super().__init__(True)
        self.values = ["dist", "pre", "zero", "goal", "hit"]
        self.tags = tags

    def start(self, graph: Graph, queries: DataFrame) -> DataFrame:
        rows = super().start(graph, queries.select("query_id", "source", F.col("tag").alias("target")))
        return rows.join(self.tags.select("id", "tag"), "id", "left").select(*["query_id", "id", *self.values[:4]], F.coalesce(F.col("tag") == F.col("goal"), F.lit(False)).alias("hit"))

    def edges(self, graph: Graph) -> DataFrame:
        tagged = graph.edges.select("src", "dst", "weight").join(self.tags.select(F.col("id").alias("dst"), "tag"), "dst", "left")
        return bucketed(tagged, "src", "tagged_edges")

    def message(self) -> list[Column]:
        hit = F.coalesce(F.col("tag") == F.col("src_goal"), F.lit(False))
        return [F.struct((F.col("src_dist") + F.col("weight")).alias("dist"), (F.col("weight") == 0).cast("int").alias("zero"), F.col("src_id").alias("pre"), F.col("src_goal").alias("goal"), hit.alias("hit")).alias("best")]

    def aggregate(self) -> list[Column]:
        return [F.min(F.when(F.col("hit"), F.col("dist"))).alias("reached")]


def nearest_tag_run(graph: Graph, queries: DataFrame, tags: DataFrame, local_edges: int = 0) -> Run:
    """The run behind nearest_tagged; `hit` marks vertices with the query's tag."""
    graph.check_weights()
    if local_edges and local.fits(graph, local_edges):
        state, steps = local.search(graph, queries.select("query_id", "source", F.col("tag").alias("target")), True, tags)
        return Run(graph.edges.sparkSession, state, steps, local=True)
    return run(NearestTag(tags), graph, queries)


def nearest_tagged(graph: Graph, queries: DataFrame, tags: DataFrame, local_edges: int = 0) -> DataFrame:
    """(query_id, vertex, dist) of the vertex with the query's tag nearest to its source, ties to the smallest id.

    queries(query_id, source, tag), tags(id, tag) with one tag a vertex. A tagged source
    counts. A query whose tag can't be reached has no row.
    """
    hits = nearest_tag_run(graph, queries, tags, local_edges).state.where("hit")
    best = hits.groupBy("query_id").agg(F.min(F.struct("dist", "id")).alias("b"))
    return best.select("query_id", F.col("b.id").alias("vertex"), F.col("b.dist").alias("dist"))


class DirectedMinLabel(VertexProgram):
    """label(v) = smallest id with a directed path to v, v itself included."""

    name = "min-label"
    values = ["label"]

    def start(self, graph: Graph, queries: DataFrame) -> DataFrame:
        return graph.vertices.select(F.lit(0).alias("query_id"), "id", F.col("id").alias("label"))

    def message(self) -> list[Column]:
        return [F.col("src_label").alias("label")]

    def combine(self) -> list[Column]:
        return [F.min("label").alias("label")]

    def apply(self) -> list[Column]:
        return [F.least("label", "in_label").alias("label")]

    def active(self) -> Column:
        return F.col("in_label") < F.col("label")


def directed_min_label(graph: Graph) -> DataFrame:
    one = graph.vertices.sparkSession.createDataFrame([(0,)], "query_id int")
    return run(DirectedMinLabel(), graph, one).state.select("id", "label")


class Hops(VertexProgram):
    """Supersteps after which each vertex is first reached from a query's source (breadth first)."""

    name = "hops"
    values = ["hops"]

    def start(self, graph: Graph, queries: DataFrame) -> DataFrame:
        rows = queries.select("query_id", F.col("source").cast("long").alias("id")).join(graph.vertices.select("id"), "id", "left_semi")
        return rows.select("query_id", "id", F.lit(0).alias("hops"))

    def message(self) -> list[Column]:
        return [(F.col("src_hops") + 1).alias("hops")]

    def combine(self) -> list[Column]:
        return [F.min("hops").alias("hops")]

    def apply(self) -> list[Column]:
        return [F.least("hops", "in_hops").alias("hops")]

    def active(self) -> Column:
        return F.col("hops").isNull()


def frontier_hops(graph: Graph, queries: DataFrame) -> Run:
    return run(Hops(), graph, queries)


def pagerank(graph: Graph, iterations: int = 30, damping: float = 0.85, every: int = 5, hub: int = 1_000_000) -> DataFrame:
    """(id, rank): fixed iterations, every vertex sends each time; dangling mass is lost.

    Rank starts at 1/N and becomes (1 - damping)/N + damping * sum of rank/out-degree of
    the in-neighbours. Lineage is cut every few iterations. Edges and vertices are bucketed
    by id, so that an iteration shuffles sums only; the edges of sources with more than
    `hub` of them are kept apart, spread over all tasks, and get their few ranks by a join
    of its own.
    """
    graph = graph.known()
    links = graph.edges.select("src", "dst")
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = materialise(links.join(degree, "src"), "links")
    hubs = materialise(links.where(F.col("degree") > hub).select("src").distinct(), "hubs")
    any_hub = not hubs.isEmpty()
    near = bucketed(links.where(F.col("degree") <= hub), "src", "links")
    ids = bucketed(graph.vertices.select("id"), "id", "ids")
    n = ids.count()
    rank = ids.select("id", F.lit(1.0 / n if n else 0.0).alias("rank"))
    for step in range(1, iterations + 1):
        mine = rank.withColumnRenamed("id", "src")
        sent = near.join(mine, "src").select("dst", (F.col("rank") / F.col("degree")).alias("x"))
        if any_hub:
            far = links.where(F.col("degree") > hub).hint("rebalance").join(mine.join(hubs, "src", "left_semi"), "src")
            sent = sent.unionByName(far.select("dst", (F.col("rank") / F.col("degree")).alias("x")))
        sums = sent.groupBy("dst").agg(F.sum("x").alias("s"))
        rank = ids.join(sums, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / n if n else 0.0) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if step == iterations:
            rank = materialise(rank, "rank")
        elif step % every == 0:
            rank = bucketed(rank, "id", "rank")
    return rank


def components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id of each weak component."""
    graph = graph.known()
    found = connected_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def component_sizes(graph: Graph) -> DataFrame:
    return components(graph).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
