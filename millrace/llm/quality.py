"""Quality: attention-based multiple-instance learning over passages.

Method: a text is a bag of passages of `PASSAGE` words. A passage is encoded from its
words' features (letter case, symbols, digits, punctuation, hashed shape and hashed
word, averaged), from how varied its words are and how often a word follows itself; a
tanh layer turns that into its embedding h. Gated attention gives each passage the weight
softmax(w . (tanh(V h) * sigmoid(U h))); the document is the weighted sum of embeddings,
and a logistic layer scores it. Only documents have labels; which passages matter is
learned through the attention. Gradients are written out, training is Adam in numpy.

Defined cases: null, empty and blank texts are one passage of zeros and are scored like
any other; repeated rows get equal scores; without labels, or with labels of one kind,
the score is the smoothed share of label 1; an empty table gives an empty result; labels,
lang, source and doc_id are no inputs; other columns are ignored.

Scale: training sees at most `SAMPLE` labelled documents (a documented bound); scoring is
one pass without a shuffle over whole texts, a bounded number of words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn
from .toxicity import with_verdict

PASSAGE, HIDDEN, ATTENTION = 64, 16, 8
SAMPLE, PARTS, HELD = 5000, 5, 0
_STATS, _SHAPES, _HASHED = 11, 16, 16
WIDTH = _STATS + _SHAPES + _HASHED + 4


def _shape(word: str) -> str:
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def word_vector(word: str) -> np.ndarray:
    x = np.zeros(_STATS + _SHAPES + _HASHED, np.float32)
    n = len(word)
    letters = sum(map(str.isalpha, word))
    upper = sum(map(str.isupper, word))
    x[:_STATS] = (
        n / 8, letters / n, upper > 1 and upper == letters, word[0].isupper(), sum(map(str.isdigit, word)) / n,
        1 - sum(map(str.isalnum, word)) / n, word.count("!") / n, word[-1] in ".?!", word[-1] in ",;:", letters == 0, not word.isascii(),
    )
    x[_STATS + xxhash.xxh3_64_intdigest(_shape(word)) % _SHAPES] = 1
    x[_STATS + _SHAPES + xxhash.xxh3_64_intdigest(word.lower()) % _HASHED] = 1
    return x


class Encoder:
    """Passages of texts; keeps the vectors of the words it has met, up to a fixed number."""

    MOST_WORDS = 200_000

    def __init__(self):
        self.at: dict[str, int] = {}
        self.vectors = np.zeros((1024, WIDTH - 4), np.float32)

    def _indexes(self, words: list[str]) -> np.ndarray:
        at = self.at
        for w in {w for w in words if w not in at}:
            if len(at) == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            at[w] = len(at)
            self.vectors[at[w]] = word_vector(w)
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def passages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all passages, and how many each text has (at least one)."""
        if len(self.at) > self.MOST_WORDS:
            self.__init__()
        split = [t.split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        x = np.zeros((int(n_passages.sum()), WIDTH), np.float32)
        if n_words.sum():
            index = self._indexes([w for words in split for w in words])
            first_passage = np.cumsum(n_passages) - n_passages
            within = np.arange(len(index)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
            passage = np.repeat(first_passage, n_words) + within // PASSAGE
            start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            size = np.diff(np.r_[start, len(index)]).astype(np.float32)
            mine = passage[start]
            for lo in range(0, len(start), 4096):  # a bounded piece of the word matrix at a time
                hi = min(lo + 4096, len(start))
                a, b = start[lo], start[hi] if hi < len(start) else len(index)
                x[mine[lo:hi], : WIDTH - 4] = np.add.reduceat(self.vectors[index[a:b]], start[lo:hi] - a, axis=0) / size[lo:hi, None]
            keys = np.sort(passage * (1 << 32) + index)
            distinct = np.bincount((keys[np.r_[True, keys[1:] != keys[:-1]]] >> 32), minlength=len(x))
            again = np.bincount(passage[1:][(index[1:] == index[:-1]) & (passage[1:] == passage[:-1])], minlength=len(x))
            total = np.bincount(passage, minlength=len(x))
            x[:, -4] = distinct / np.maximum(total, 1)
            x[:, -3] = again / np.maximum(total, 1)
            x[:, -2] = np.log1p(total) / 4
        x[:, -1] = np.repeat(np.log1p(n_passages) / 4, n_passages)
        return x, n_passages


def _forward(p: dict, x: np.ndarray, count: np.ndarray) -> dict:
    first = np.cumsum(count) - count
    bag = np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ p["W"] + p["a"])
    t, g = np.tanh(h @ p["V"]), learn.sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    alpha = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
    return {"first": first, "bag": bag, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": learn.sigmoid(z @ p["c"] + p["b"][0])}


def _gradients(p: dict, x: np.ndarray, f: dict, y: np.ndarray) -> dict:
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * p["c"]
    dzb, h, t, g, alpha = dz[f["bag"]], f["h"], f["t"], f["g"], f["alpha"]
    da = (dzb * h).sum(1)
    de = alpha * (da - np.add.reduceat(alpha * da, f["first"])[f["bag"]])
    dt = de[:, None] * p["w"] * g * (1 - t * t)
    dg = de[:, None] * p["w"] * t * g * (1 - g)
    dh = (alpha[:, None] * dzb + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "a": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (de[:, None] * t * g).sum(0), "c": f["z"].T @ d, "b": np.array([d.sum()], np.float32)}


def _features(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encoder = Encoder()
    for pdf in pdfs:
        for _, part in pdf.groupby(np.arange(len(pdf)) // 256):
            x, count = encoder.passages(list(part["text"]))
            yield pd.DataFrame({"rank": part["rank"].to_numpy(), "label": part["label"].to_numpy(), "x": [a.astype("<f4").tobytes() for a in np.split(x, np.cumsum(count)[:-1])]})


def fit(rows: pd.DataFrame, epochs: int = 25, batch: int = 64, seed: int = 11) -> dict:
    y = rows["label"].to_numpy(np.float32)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"W": draw(WIDTH, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": np.zeros(HIDDEN, np.float32), "b": np.array([np.log(prior / (1 - prior))], np.float32)}
    if 0 < y.sum() < len(y):
        bags = [np.frombuffer(x, "<f4").reshape(-1, WIDTH) for x in rows["x"]]
        everything = np.concatenate(bags)
        mean, std = everything.mean(0), everything.std(0) + 1e-3
        del everything
        bags = [(b - mean) / std for b in bags]
        adam = learn.Adam(p, 0.005, {"W": 1e-4, "c": 1e-4})
        for _ in range(epochs):
            mix = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                at = mix[lo : lo + batch]
                x, count = np.concatenate([bags[i] for i in at]), np.array([len(bags[i]) for i in at])
                adam.step(_gradients(p, x, _forward(p, x, count), y[at]))
    else:
        mean, std = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
    return {**p, "mean": mean, "std": std}


def scores(model: dict, encoder: Encoder, texts: list[str]) -> list[float]:
    out, part, size = [], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size > 500_000 or i == len(texts) - 1:
            x, count = encoder.passages(part)
            out += _forward(model, (x - model["mean"]) / model["std"], count)["p"].astype(float).tolist()
            part, size = [], 0
    return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> dict:
    rows = learn.labelled_sample(docs, labels, column, PARTS, lambda k: k == HELD, sample)
    return learn.trained(rows.mapInPandas(_features, "rank long, label int, x binary"), fit)


def scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        encoder = Encoder()
        return lambda texts: [scores(held.value, encoder, texts)]

    return common.map_texts(docs, keep, "score double", start)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the quality score of its whole text."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return with_verdict(scored(docs, model, ["doc_id"]), learn.fold(F.col("doc_id"), PARTS) == HELD)
