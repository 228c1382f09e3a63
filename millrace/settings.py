"""The settings that runs are driven by."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# The names under which configuration files know the settings.
FILE_NAMES = {
    "MAX_PARALLEL_QUERIES": "max_parallel_queries",
    "QueryGlobalBarrier": "query_global_barrier",
    "LocalQueryExecution": "local_query_execution",
    "SkipInactiveWorkers": "skip_inactive_workers",
    "VertexMoveEnabled": "move_enabled",
    "VERTEX_BARRIER_MOVE_ENABLED": "barrier_move_enabled",
    "SPDistStepFactor": "sp_dist_step_factor",
    "SearchNextTagTestMode": "search_next_tag",
    "SearchNextTagProbability": "search_next_tag_probability",
    "SearchNextTagNumTags": "search_next_tag_num_tags",
    "InputPartitioner": "input_partitioner",
    "PartitionsPerWorker": "partitions_per_worker",
    "HotspotPartitionerSpots": "hotspot_spots",
    "HotspotPartitionerRange": "hotspot_range",
    "IntersectSamplingFactor": "intersect_sampling",
    "IntersectChunkLimit": "intersect_chunk_limit",
    "QUERY_CUT_TIME_WINDOW": "query_cut_window_ms",
    "QUERY_CUT_MAX_QUERIES": "query_cut_max_queries",
    "QUERY_CUT_CHUNK_MIN_SIZE": "query_cut_min_chunk",
    "QUERY_CUT_KEEP_MIN_LOCALITY": "query_cut_keep_locality",
    "LsruThresholdLow": "locality_low",
    "LsruDeltaThresholdNeg": "locality_drop",
    "LsruDeltaThresholdPos": "locality_rise",
    "LsruExtraShots": "extra_shots",
    "LocalSuperstepTimeWindow": "locality_window_ms",
    "ActiveVertsTimeWindow": "active_window_ms",
    "VertexMaxActVertsImbalance": "max_imbalance",
    "VertexAvgActVertsImbalance": "mean_imbalance",
    "VertexMaxActVertsImbTrigger": "max_imbalance_margin",
    "VertexAvgActVertsImbTrigger": "mean_imbalance_margin",
    "VertexMoveMinMoveVertices": "min_move_vertices",
    "VertexMoveMaxILSIterations": "ils_iterations",
    "VertexMoveMaxGreedyIterations": "greedy_iterations",
    "VertexMoveMaxGreedyTime": "greedy_ms",
    "MASTER_QUERY_MOVE_CALC_TIMEOUT": "move_budget_ms",
    "QueryKeepLocalThreshold": "keep_local",
    "IlsBalanceFirst": "balance_first",
    "ClustersPerWorker": "clusters_per_worker",
    "ClustersAdditional": "clusters_additional",
}


@dataclass
class Settings:
    """Shipped values; overridden by name = value, by either name.

    A budget of 0 milliseconds means none. local_query_execution allows local mode for
    graphs of at most local_edges edges; skip_inactive_workers has no counterpart here.
    """

    max_parallel_queries: int = 16
    query_global_barrier: bool = False
    local_query_execution: bool = True
    skip_inactive_workers: bool = True
    local_edges: int = 0
    move_enabled: bool = True
    barrier_move_enabled: bool = True
    sp_dist_step_factor: float = 4.0
    search_next_tag: bool = True
    search_next_tag_probability: float = 0.00008
    search_next_tag_num_tags: int = 1
    input_partitioner: str = "Hashed"
    partitions_per_worker: int = 1
    hotspot_spots: int = 8
    hotspot_range: float = 50_000
    intersect_sampling: int = 100
    intersect_chunk_limit: int = 200
    query_cut_window_ms: int = 240_000
    query_cut_max_queries: int = 128
    query_cut_min_chunk: int = 100
    query_cut_keep_locality: float = 0.7
    locality_low: float = 0.3
    locality_drop: float = -0.10
    locality_rise: float = 0.02
    extra_shots: int = 3
    locality_window_ms: int = 30_000
    active_window_ms: int = 60_000
    max_imbalance: float = 0.50
    mean_imbalance: float = 0.25
    max_imbalance_margin: float = 0.30
    mean_imbalance_margin: float = 0.20
    min_move_vertices: int = 500
    ils_iterations: int = 50
    greedy_iterations: int = 500
    greedy_ms: int = 500
    move_budget_ms: int = 2000
    keep_local: float = 0.8
    balance_first: bool = True
    clusters_per_worker: int = 4
    clusters_additional: int = 0
    others: dict[str, str] = field(default_factory=dict)

    def override(self, lines: list[str], strict: bool = True) -> Settings:
        """Applies key = value lines; # starts a comment. Unknown keys are refused, or where not strict kept in others."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self) if f.name != "others"}
        for line in lines:
            key, eq, value = line.partition("#")[0].partition("=")
            if not eq:
                continue
            key, value = key.strip(), value.strip()
            name = FILE_NAMES.get(key, key)
            if name in kinds:
                setattr(self, name, value.lower() == "true" if kinds[name] is bool else kinds[name](value))
            elif strict:
                raise KeyError(key)
            else:
                self.others[key] = value
        return self

    def lines(self) -> list[str]:
        """All settings as key = value lines, under the files' names where there are any."""
        known = {v: k for k, v in FILE_NAMES.items()}
        show = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        return [f"{known.get(f.name, f.name)} = {show(getattr(self, f.name))}" for f in fields(self) if f.name != "others"] + [f"{k} = {v}" for k, v in self.others.items()]
