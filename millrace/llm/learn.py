"""What the trained operators share: the labelled sample, the split, single-task training."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; decides what may be learned from, never a score."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, parts: int, held: Callable[[Column], Column], most: int) -> DataFrame:
    """At most `most` labelled rows outside the held-out fold: (rank, label, text).

    The rows are those with the smallest hashes of their ids, the same in every run.
    Rows labelled twice count as 1 if any label says 1; null labels are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    marks = marks.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held(fold(F.col("doc_id"), parts)))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"), F.xxhash64("doc_id").alias("rank"))
    marks = marks.orderBy("rank", "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample has at most `most` rows of three numbers, a bound that doesn't grow with the tables.
    return texts.join(F.broadcast(marks), "doc_id").select("rank", "label", "text")


def trained(features: DataFrame, fit: Callable[[pd.DataFrame], dict]) -> dict:
    """fit() of all rows of the (bounded) features, run in one task; only the model comes to the driver."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(pdfs)
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["rank", "label", "x"])
        # Rows that share an id have one rank; their features tell them apart, so that every run trains in one order.
        rows["features"] = [hashlib.blake2b(np.ascontiguousarray(x).tobytes() if isinstance(x, np.ndarray) else bytes(x), digest_size=16).hexdigest() for x in rows["x"]]
        rows = rows.sort_values(["rank", "label", "features"], kind="stable", ignore_index=True).drop(columns="features")
        model = pickle.dumps(fit(rows))
        del rows, parts
        common.give_back()
        yield pd.DataFrame({"model": [model]})

    model = pickle.loads(features.repartition(1).mapInPandas(run, "model binary").first()[0])
    common.give_back()
    common.tidy(features.sparkSession)
    return model


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: dict[str, float] | None = None):
        self.p, self.rate, self.decay, self.t = params, rate, decay or {}, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay.get(k, 0.0) * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
