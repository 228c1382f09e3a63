"""The superstep engine: all queries of a batch advance together, as rows of one job.

State is keyed (query_id, id). A superstep joins the active rows with the edges, combines
what arrives at each (query_id, vertex), and merges it into the state; a query ends when
none of its rows is active. Vertices without a state row have the program's default.
Messages to ids that are no vertices are dropped. The driver sees one row per query and step.

On disk the state is a table and a few deltas, the last of which holds the rows that the
last step touched. A step looks up only the rows that it sends to, and writes only those
and the ones that sent, so its cost follows the frontier; every few steps the deltas are
merged into one table, and what they replace is deleted.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.runtime import delete, remember, store


class VertexProgram:
    """Hooks of a vertex program, as builders of columns and small DataFrames.

    values:      names of the state's value columns
    start():     (query_id, id, *values) of the vertices that compute in step 0 and send
    message():   columns sent along an edge; src_* state columns, edge columns dst, weight
    letters():   further messages to any vertices: (query_id, id, message columns) of the
                 senders (query_id, src_id, src_*), or None
    combine():   aggregates of messages for one vertex, named like the message columns
    apply():     new value columns from the old ones and the inbox, in_* (null: no message)
    active():    whether the vertex sends in the next step
    wake():      who starts a step besides the active rows: None, "all" rows of the state,
                 or the rows (query_id, id) of a DataFrame
    bound():     filter on the senders, from the aggregator's columns (agg_*), or None
    hold():      rows that stay active but don't send in this step, or None
    aggregate(): aggregates over a query's state, available to the next step as agg_*
    fold():      the aggregates from those so far and those over the last step's rows alone,
                 where that can be told; else None, and they are taken over the whole state
    next_phase(): called when nothing is active: the rows (query_id, id) of the state that
                 start a further phase, or None to end; the program switches its hooks
    """

    name = "program"
    values: list[str] = []

    def start(self, graph: Graph, queries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def message(self) -> list[Column] | None:
        return None

    def letters(self, senders: DataFrame) -> DataFrame | None:
        return None

    def combine(self) -> list[Column]:
        raise NotImplementedError

    def apply(self) -> list[Column]:
        raise NotImplementedError

    def active(self) -> Column:
        raise NotImplementedError

    def wake(self, step: int, state: DataFrame) -> DataFrame | str | None:
        return None

    def bound(self) -> Column | None:
        return None

    def hold(self, step: int) -> Column | None:
        return None

    def aggregate(self) -> list[Column]:
        return []

    def fold(self, before: dict, now: dict) -> dict | None:
        return None

    def next_phase(self, state: DataFrame) -> DataFrame | None:
        return None

    def edges(self, graph: Graph) -> DataFrame:
        return graph.edges


@dataclass
class Run:
    """What a program's run left: the state, with first_step and last_step of each touched vertex, and its metrics."""

    spark: SparkSession
    state: DataFrame
    steps: list[tuple] = field(default_factory=list)
    local: bool = False

    METRICS = "superstep int, query_id int, active long, touched_new long, touched long, wall_ms double"

    def supersteps(self) -> DataFrame:
        return self.spark.createDataFrame(self.steps, self.METRICS)

    def touched(self) -> DataFrame:
        """The scope of each query: every vertex that was ever active, with its first step."""
        return self.state.select("query_id", "id", "first_step")


def _woken(state: DataFrame, who: DataFrame | str | None) -> DataFrame:
    """The state with further rows active."""
    if who is None:
        return state
    if isinstance(who, str):
        if who != "all":
            raise ValueError(who)
        return state.withColumn("active", F.lit(True))
    marks = who.select("query_id", "id").distinct().withColumn("woken", F.lit(True))
    return state.join(marks, ["query_id", "id"], "left").withColumn("active", F.col("active") | F.coalesce("woken", F.lit(False))).drop("woken")


class _State:
    """The stored state: a table and deltas over it. Only the newest one's rows may be active."""

    KEY = ["query_id", "id"]

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.places, self.tables = spark, name, [], []

    def put(self, rows: DataFrame) -> None:
        self.places.append(store(rows, self.name))
        self.tables.append(self.spark.read.schema(rows.schema).parquet(self.places[-1]))

    def replace(self, rows: DataFrame) -> None:
        """rows, made from this state, take its place."""
        before, self.places, self.tables = self.places, [], []
        self.put(rows)
        delete(self.spark, *before)

    def latest(self) -> DataFrame:
        return self.tables[-1]

    def view(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows as they are now, or those of `keys`."""
        if len(self.tables) == 1:
            return self.tables[0] if keys is None else self.tables[0].join(keys, self.KEY, "left_semi")
        rows = None
        for age, df in enumerate(self.tables):
            if keys is not None:
                df = df.join(keys, self.KEY, "left_semi")
            df = df.withColumn("age", F.lit(age))
            rows = df if rows is None else rows.unionByName(df)
        columns = self.tables[0].columns
        newest = rows.groupBy(*self.KEY).agg(F.max_by(F.struct(*columns), "age").alias("row"), F.max("age").alias("age"))
        active = F.col("row.active") & (F.col("age") == len(self.tables) - 1)
        return newest.select(*[active.alias(c) if c == "active" else F.col(f"row.{c}").alias(c) for c in columns])


def run(program: VertexProgram, graph: Graph, queries: DataFrame, max_steps: int = 10_000, merge_every: int = 8) -> Run:
    spark = graph.edges.sparkSession
    graph = graph if graph.closed else graph.known().materialised()  # once, not in every step
    edges = program.edges(graph)
    began = time.time()
    state = _State(spark, program.name)
    state.put(program.start(graph, queries).withColumns({"active": F.lit(True), "first_step": F.lit(0), "last_step": F.lit(0)}))
    steps: list[tuple] = []
    touched: dict[int, int] = {}
    told: dict[int, dict] = {}

    def counted(step: int) -> list:
        """One row per query that the last step touched."""
        names = program.aggregate()
        counts = [F.count_if("active").alias("active"), F.count_if(F.col("first_step") == step).alias("new")]
        foldable = bool(names) and program.fold({}, {}) is not None
        seen = state.latest().groupBy("query_id").agg(*counts, *(program.aggregate() if foldable else [])).collect()
        rows = seen if foldable or not names else state.view().groupBy("query_id").agg(*program.aggregate()).collect()
        for r in rows if names else []:
            now = {k: v for k, v in r.asDict().items() if k not in ("query_id", "active", "new")}
            told[r["query_id"]] = program.fold(told.get(r["query_id"], {}), now) if foldable else now
        return seen

    for step in range(max_steps):
        who = program.wake(step, state.view())
        if who is not None:
            state.replace(_woken(state.view(), who))
        seen = counted(step)
        for r in seen:
            touched[r["query_id"]] = touched.get(r["query_id"], 0) + r["new"]
        if not any(r["active"] for r in seen):
            who = program.next_phase(state.view())
            if who is None:
                break
            state.replace(_woken(state.view(), who))
            seen = counted(step)
            if not any(r["active"] for r in seen):
                break
        wall = (time.time() - began) * 1000
        steps += [(step, r["query_id"], r["active"], r["new"], touched[r["query_id"]], wall) for r in sorted(seen, key=lambda r: r["query_id"]) if r["active"]]
        began = time.time()
        hold = program.hold(step)
        acting = state.latest().where("active")
        senders = acting if hold is None else acting.where(~hold)
        bound = program.bound()
        if bound is not None:
            rows = [(q, *values.values()) for q, values in sorted(told.items())]
            names = list(next(iter(told.values())))
            kinds = state.latest().groupBy("query_id").agg(*program.aggregate()).schema
            limits = spark.createDataFrame(rows, kinds).select("query_id", *[F.col(n).alias(f"agg_{n}") for n in names])
            senders = senders.join(F.broadcast(limits), "query_id").where(bound)  # one row per admitted query
        senders = senders.select("query_id", F.col("id").alias("src_id"), *[F.col(v).alias(f"src_{v}") for v in program.values])
        sent = []
        if program.message() is not None:
            from_, on = senders, F.col("src_id") == F.col("src")
            if graph.layout is not None and "part" in edges.columns:
                from_ = senders.join(graph.layout.select(F.col("id").alias("src_id"), F.col("part").alias("src_part")), "src_id")
                on = on & (F.col("src_part") == F.col("part"))
            sent.append(from_.join(edges, on).select("query_id", F.col("dst").alias("id"), *program.message()))
        letters = program.letters(senders)
        if letters is not None:
            sent.append(letters.join(graph.vertices.select("id"), "id", "left_semi"))
        inbox = sent[0] if len(sent) == 1 else sent[0].unionByName(sent[1])
        inbox = inbox.groupBy("query_id", "id").agg(*program.combine())
        inbox = inbox.select("query_id", "id", *[F.col(c).alias(f"in_{c}") for c in inbox.columns if c not in ("query_id", "id")], F.lit(True).alias("in_any"))
        place = store(inbox, f"{program.name}-inbox")  # read for the look-up and for the merge
        inbox = spark.read.schema(inbox.schema).parquet(place)
        keys = inbox.select("query_id", "id").union(acting.select("query_id", "id")).distinct()
        both = state.view(keys).withColumnRenamed("active", "was_active").join(inbox, ["query_id", "id"], "full_outer")
        active = F.coalesce(program.active(), F.lit(False))
        if hold is not None:
            active = active | F.coalesce(F.col("was_active") & hold, F.lit(False))
        applied = both.select("query_id", "id", *program.apply(), active.alias("active"), "first_step", "last_step")
        applied = applied.select(
            "query_id", "id", *program.values, "active", F.coalesce("first_step", F.lit(step + 1)).alias("first_step"),
            F.when(F.col("active"), F.lit(step + 1)).otherwise(F.coalesce("last_step", F.lit(step + 1))).alias("last_step"),
        )
        state.put(applied)
        delete(spark, place)
        if len(state.tables) > merge_every:
            state.replace(state.view())
    else:
        raise RuntimeError(f"{program.name} is still active after {max_steps} supersteps")
    if len(state.tables) > 1:
        state.replace(state.view())
    remember(state.places[0])
    return Run(spark, state.tables[0], steps)
