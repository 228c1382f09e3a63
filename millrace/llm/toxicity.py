"""Toxicity: a factorization machine over hashed terms.

Method: a document is the set of its terms, words and word beginnings of four to seven
letters (and each of them again where two or three distinct words have it), hashed into
2^20 places. Every place seen in the labelled sample is an input. A factorization machine
gives each a weight and a vector of `rank` factors; the logit is the bias, the weights and
the inner products of all pairs of terms that occur together, computed in linear time. It
is trained on the logistic loss: first by Adam on the places whose document frequency
differs most between the two labels (a z-score of at least `least_z`, at most `terms` of
them), then, from there, all places together by regularised sparse steps, so that terms
which are neutral alone or rare learn from what is left. Whole texts are scored.

Defined cases: null or empty texts have no terms and get the bias's score; texts without
a term of the sample likewise; repeated rows get equal scores; without labels, or with labels of
one kind only, the score is the smoothed share of label 1; an empty table gives an empty
result; labels, lang, source and doc_id are no inputs; other columns are ignored.

Scale: training sees at most `sample` labelled documents (a documented bound); scoring is
one pass without a shuffle, with a model of at most 2^20 places of 40 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

PLACES = 1 << 20
SAMPLE, TERMS, RANK, LEAST_Z = 8000, 2048, 8, 4.0
ALL_EPOCHS, ALL_STEPS, ALL_RATE, ALL_DECAY, EVEN = 2, 100, 0.1, 1e-3, 8
THRESHOLD, PARTS, HELD = 0.3, 4, 2
_WORD = re.compile(r"\w+")
_BEGINNINGS = (4, 5, 6, 7)
_TIMES = (1, 2, 3)


def terms_of(word: str) -> list[int]:
    """Hashed terms of one lower-cased word."""
    out = [xxhash.xxh3_64_intdigest(word) % PLACES]
    out += [xxhash.xxh3_64_intdigest("^" + word[:k]) % PLACES for k in _BEGINNINGS if len(word) > k]
    return out


def counted(place: int | np.ndarray, times: int) -> int | np.ndarray:
    """Place of the term 'this term, in at least so many distinct words'."""
    return place if times == 1 else (place * 2654435761 + times * 40503) % PLACES


def _places(text: str) -> np.ndarray:
    return _counted_places(np.array([t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)], np.int64)).astype(np.int32)


def _counted_places(raw: np.ndarray) -> np.ndarray:
    raw, n = np.unique(raw, return_counts=True)
    return np.unique(np.concatenate([counted(raw[n >= k], k) for k in _TIMES]))


def _features(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            yield pd.DataFrame({"rank": part["rank"], "label": part["label"], "x": [_places(text) for text in part["text"]]})


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    """Of 0/1 rows x."""
    s = x @ model["v"]
    return model["b"][0] + x @ model["w"] + 0.5 * ((s * s).sum(1) - x @ (model["v"] ** 2).sum(1))


def fit(rows: pd.DataFrame, terms: int = TERMS, rank: int = RANK, least_z: float = LEAST_Z, epochs: int = 40, batch: int = 128, seed: int = 7) -> dict:
    y = rows["label"].to_numpy(np.float32)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    prior = (pos + 0.5) / (len(y) + 1)
    b = np.array([np.log(prior / (1 - prior))], np.float32)
    if not pos or not neg:
        return {"place": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "v": np.zeros((0, rank), np.float32), "b": b}
    docs = [np.asarray(x, np.int32) for x in rows["x"]]  # distinct places
    with_pos, everywhere = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int32)
    for x, label in zip(docs, y, strict=True):
        everywhere[x] += 1
        if label:
            with_pos[x] += 1
    share = everywhere / len(y)
    z = (with_pos / pos - (everywhere - with_pos) / neg) / np.sqrt(np.maximum(share * (1 - share), 0.5 / len(y)) * (1 / pos + 1 / neg))
    order = np.argsort(-np.abs(z), kind="stable")[:terms]
    first = np.sort(order[(np.abs(z[order]) >= least_z) & (everywhere[order] >= 5)])
    column = np.full(PLACES, -1, np.int32)
    column[first] = np.arange(len(first))
    known = [c[c >= 0] for c in (column[x] for x in docs)]
    del share, z, order, column

    rng = np.random.default_rng(seed)
    p = {"w": np.zeros(len(first), np.float32), "v": rng.normal(0, 0.01, (len(first), rank)).astype(np.float32), "b": b}
    adam = learn.Adam(p, 0.02, {"w": 1e-4, "v": 1e-3})
    for _ in range(epochs):
        mix = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            at = mix[lo : lo + batch]
            xb = np.zeros((len(at), len(first)), np.float32)
            for k, row in enumerate(at):
                xb[k, known[row]] = 1
            s = xb @ p["v"]
            d = (learn.sigmoid(logits(p, xb)) - y[at]) / len(at)
            adam.step({"b": np.array([d.sum()], np.float32), "w": xb.T @ d, "v": xb.T @ (d[:, None] * s) - (xb.T @ d)[:, None] * p["v"]})
    place = np.flatnonzero(everywhere)
    at = np.searchsorted(place, first)
    w, v = np.zeros(len(place), np.float32), rng.normal(0, 0.01, (len(place), rank)).astype(np.float32)
    w[at], v[at] = p["w"], p["v"]
    model = {"place": place, "w": w, "v": v, "b": p["b"]}
    at = np.full(PLACES, -1, np.int32)
    at[place] = np.arange(len(place))
    _all_places(model, [at[x] for x in docs], y, rng, batch)
    return model


def _all_places(model: dict, rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, batch: int) -> None:
    """Goes on training the model, in place, on every place of the rows.

    A step touches only the places of its batch. Adagrad with a start of one: a step follows
    the gradient's size, so places in few documents don't outrun those in many. Documents of
    more than EVEN places count less, in proportion. Every row is seen ALL_EPOCHS times, in
    small samples more often, for ALL_STEPS steps at least.
    """
    w, v, b = model["w"], model["v"], model["b"]
    past_w, past_v = np.ones(len(w), np.float32), np.ones_like(v)
    size = np.array([len(x) for x in rows])
    some = np.flatnonzero(size)
    for _ in range(max(ALL_EPOCHS, -(-ALL_STEPS * batch // max(1, len(some))))):
        mix = rng.permutation(some)
        for lo in range(0, len(mix), batch):
            mine = mix[lo : lo + batch]
            flat, n = np.concatenate([rows[r] for r in mine]), size[mine]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            near = v[flat]
            s = np.add.reduceat(near, starts)
            logit = b[0] + np.add.reduceat(w[flat], starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((near * near).sum(1), starts))
            d = (learn.sigmoid(logit) - y[mine]) * np.minimum(1, EVEN / n)
            b -= ALL_RATE * d.mean()
            here, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, np.repeat(d, n))
            gv = np.stack([np.bincount(inverse, np.repeat(d * s[:, k], n)) for k in range(v.shape[1])], 1) - g[:, None] * v[here]
            g, gv = g + ALL_DECAY * w[here], gv + ALL_DECAY * v[here]
            past_w[here] += g * g
            past_v[here] += gv * gv
            w[here] -= ALL_RATE * g / np.sqrt(past_w[here])
            v[here] -= ALL_RATE * gv / np.sqrt(past_v[here])


class Scorer:
    MOST_WORDS = 100_000

    def __init__(self, model: dict):
        self.model = model
        self.column = np.full(PLACES, -1, np.int32)
        self.column[model["place"]] = np.arange(len(model["place"]))
        self.words: dict[str, tuple[int, ...]] = {}

    def columns(self, text: str) -> np.ndarray:
        raw: list[int] = []
        for w in set(_WORD.findall(text.lower())):
            mine = self.words.get(w)
            if mine is None:
                if len(self.words) >= self.MOST_WORDS:
                    self.words.clear()
                mine = self.words[w] = tuple(terms_of(w))
            raw.extend(mine)
        at = self.column[_counted_places(np.array(raw, np.int64))]
        return at[at >= 0]

    def score(self, text: str) -> float:
        at = self.columns(text)
        m = self.model
        v = m["v"][at]
        s = v.sum(0)
        return float(learn.sigmoid(m["b"][0] + m["w"][at].sum() + 0.5 * ((s * s).sum() - (v * v).sum())))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> dict:
    rows = learn.labelled_sample(docs, labels, column, PARTS, lambda k: k == HELD, sample)
    return learn.trained(rows.mapInPandas(_features, "rank long, label int, x array<int>"), fit)


def scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(held.value)
        return lambda texts: [[scorer.score(t) for t in texts]]

    return common.map_texts(docs, keep, "score double", start)


def with_verdict(df: DataFrame, held: Column) -> DataFrame:
    return df.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the score of its whole text."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return with_verdict(scored(docs, model, ["doc_id"]), learn.fold(F.col("doc_id"), PARTS) == HELD)
