"""Online arrival of queries as a stream: every micro-batch is admitted and answered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.graph import Graph
from millrace.plans import workload
from millrace.runtime import scratch
from millrace.settings import Settings

SCHEMA = "query_id int, batch int, source long, target long"


def serve(arrivals: DataFrame, graph: Graph, answered: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Starts a stream over arrivals(query_id, source, target); answered(paths, epoch) gets each micro-batch's paths.

    A micro-batch larger than the admission limit is answered in several runs. What a
    micro-batch has written for itself goes when answered() returns, which must have
    stored or collected the paths by then. The checkpoint makes the source exactly-once;
    answered() may see an epoch again after a failure and should overwrite by epoch.
    """
    settings = settings or Settings()
    ready = graph.known().materialised()

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("query_id", "source", "target")
        if rows.isEmpty():
            return
        # A micro-batch of queries is a control message, small as the plans that it replaces.
        order = Window.orderBy("query_id")
        numbered = rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / settings.max_parallel_queries).cast("int"))
        with scratch(ready.edges.sparkSession):
            answered(workload.run_workload(ready, numbered, settings)[0], epoch)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
