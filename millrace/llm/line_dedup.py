"""Line dedup through a sharded minimal perfect hash.

Method: every line of at least 10 code points has a key and a 128-bit key hash. One
aggregation gives each key hash its number of holders and its smallest doc_id; hashes
that occur in two documents or more are dealt to shards, and each shard becomes a minimal
perfect hash with compact arrays of fingerprints, counts and keepers. Lines don't meet
lines in a join: a line's hash is routed to its shard, where it probes the arrays, and
only lines to be dropped come out. A hash that occurs in one document needs no slot; the
fingerprint rejects it.

Defined cases: a null or empty text is one empty line and stays; lines whose key has
fewer than 10 code points always stay; a key that repeats inside one document only is
kept there each time, and in the smallest doc_id all its lines stay; rows with one doc_id
count as one document; rows with a null doc_id hold no key and lose no line; an empty
table gives an empty result; other columns are ignored.

Scale: shards hold about `per_shard` keys each and are probed by about `per_salt` lines, so
their number follows the data and their size doesn't. Lines stream past their shard's arrays. A shard with more lines
than most (a line that a third of all documents hold) is copied under several salts, in
proportion to its lines, and its probes are dealt over the copies; the numbers of copies
are joined to the lines, and nothing is collected but two counts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of the pair (a, b) under a seed."""
    x = a + np.uint64((int(_GOLD) * (2 * seed + 1)) & (2**64 - 1)) + ((b << np.uint64(seed % 31 + 1)) | (b >> np.uint64(63 - seed % 31))) * _MIX1
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit numbers, level by level.

    On each level the keys that are left fall into gamma * n places; those alone in their
    place settle there. A key's slot is the number of settled places before its own.
    """

    GAMMA, MOST = 2.0, 64

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        settled = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
        per_byte = np.array([bin(i).count("1") for i in range(256)], np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_byte[settled])])
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int64)
        self.all, self.per_byte = settled, per_byte

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(cls.MOST):
            if not len(a):
                break
            m = (int(cls.GAMMA * len(a)) + 8) // 8 * 8
            at = (_mix(a, b, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            a, b = a[left], b[left]
        if len(a):
            raise ValueError("the keys aren't distinct")
        return cls(sizes, bits)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that isn't in the set, any slot or -1."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            at = (_mix(a[todo], b[todo], level) % np.uint64(m)).astype(np.int64)
            byte, bit = self.starts[level] + (at >> 3), at & 7
            here = (self.all[byte] >> bit) & 1 == 1
            below = self.all[byte[here]] & ((1 << bit[here]) - 1).astype(np.uint8)
            out[todo[here]] = self.before[byte[here]] + self.per_byte[below]
            todo = todo[~here]
        return out


def pack_shard(a: np.ndarray, b: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> bytes:
    ph = PerfectHash.build(a, b)
    at = ph.slots(a, b)
    arrays = {"fingerprint": np.zeros(len(a), np.uint64), "count": np.zeros(len(a), np.int64), "keeper": np.zeros(len(a), np.int64)}
    arrays["fingerprint"][at], arrays["count"][at], arrays["keeper"][at] = b, count, keeper
    out = io.BytesIO()
    np.savez(out, sizes=np.array(ph.sizes, np.int64), lengths=np.array([len(x) for x in ph.bits], np.int64), bits=ph.all, **arrays)
    return out.getvalue()


class Shard:
    """A packed shard, ready to be probed."""

    def __init__(self, packed: bytes):
        z = np.load(io.BytesIO(packed))
        cut = np.cumsum(z["lengths"])[:-1]
        self.hash = PerfectHash([int(m) for m in z["sizes"]], np.split(z["bits"], cut))
        self.fingerprint, self.count, self.keeper = z["fingerprint"], z["count"], z["keeper"]

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in the shard; their counts and keepers (0 for the others)."""
        at = self.hash.slots(a, b)
        found = at >= 0
        found[found] = self.fingerprint[at[found]] == b[found]
        at = np.where(found, at, 0)
        return found, np.where(found, self.count[at], 0), np.where(found, self.keeper[at], 0)


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64)
    packed = pack_shard(a, b, pdf["n"].to_numpy(np.int64), pdf["keeper"].to_numpy(np.int64))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_lines": [int(pdf["n"].sum())], "packed": [packed]})


def _probe(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (shard, salt), the shard's arrays before the lines."""
    shard, at = None, None
    for pdf in pdfs:
        new = pdf["packed"].notna().to_numpy()
        where = pdf["shard"].to_numpy()
        for part in np.split(np.arange(len(pdf)), np.flatnonzero(new | np.r_[False, where[1:] != where[:-1]])):
            if not len(part):
                continue
            if new[part[0]]:
                shard, at = Shard(pdf["packed"].iloc[part[0]]), where[part[0]]
                part = part[1:]
            if not len(part) or at != where[part[0]]:  # a shard without a repeated key
                continue
            rows = pdf.iloc[part]
            doc = rows["doc_id"].to_numpy(np.int64)
            found, count, keeper = shard.probe(rows["h1"].to_numpy(np.int64).view(np.uint64), rows["h2"].to_numpy(np.int64).view(np.uint64))
            gone = found & (keeper != doc)
            if gone.any():
                rows = rows[gone]
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("int64"), "text_hash": rows["text_hash"].astype("int64"), "line": rows["line"].astype("int32"), "count": count[gone]})


def _keys(text: Column) -> Column:
    """Key of every line of the text."""
    return F.transform(F.split(common.ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, per_shard: int = 16_384, per_salt: int = 250_000) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept (the text that stays), and
    most: how many lines of the corpus have the key of the dropped line that is most frequent (0 without one)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.fold_null(F.col("text")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hashes = F.transform(_keys(F.col("text")), lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("line"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    lines = docs.where("doc_id is not null").select("doc_id", "text_hash", F.explode(F.filter(hashes, lambda x: x.isNotNull())).alias("l"))
    lines = common.materialise(lines.select("doc_id", "text_hash", "l.line", "l.h1", "l.h2"), "lines")

    keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    keys = common.materialise(keys.where("keeper <> last").drop("last"), "keys")
    shards = max(keys.count() // per_shard, lines.count() // per_salt) + 1
    shard = F.pmod(F.xxhash64("h2", "h1"), F.lit(shards)).cast("int").alias("shard")
    index = keys.select(shard, "h1", "h2", "n", "keeper").groupBy("shard").applyInPandas(_pack_group, "shard int, n_lines long, packed binary")
    index = common.materialise(index, "index")

    # Copies of a shard by its number of lines; of shards with more than one copy the lines must know the number.
    copies = F.col("n_lines").cast("long") / per_salt
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), copies.cast("int"))).alias("salt"), "packed")
    salts = common.materialise(index.where(copies >= 1).select("shard", (copies.cast("int") + 1).alias("copies")), "salts")
    nothing = [F.lit(0).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text_hash", "long"), ("line", "int"), ("h1", "long"), ("h2", "long"))]
    probes = lines.select(shard, "doc_id", "text_hash", "line", "h1", "h2").join(salts, "shard", "left")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"), F.lit(None).cast("binary").alias("packed"), "doc_id", "text_hash", "line", "h1", "h2")
    routed = arrays.select("shard", "salt", "packed", *nothing).unionByName(probes)
    routed = routed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("packed").isNull())
    drop = routed.mapInPandas(_probe, "doc_id long, text_hash long, line int, count long")
    drop = drop.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("drop"), F.max("count").alias("most"))

    split = F.split("text", "\n")
    out = docs.join(drop, ["doc_id", "text_hash"], "left").select("doc_id", "text", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"), F.coalesce("most", F.lit(0).cast("long")).alias("most"))
    kept = F.when(F.size("drop") == 0, F.col("text")).otherwise(common.let(split, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop")), lambda i: F.get(x, i)), "\n")))
    return out.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), kept.alias("kept"), "most")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its lines counted and the hash of the text that stays."""
    return line_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
keys AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, line, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN keys USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
