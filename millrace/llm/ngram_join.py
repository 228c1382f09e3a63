"""N-gram Jaccard self-join under several global token orders.

Method: a document is its set of distinct word shingles. For a Jaccard similarity of at
least t, two sets must share a token among the first n - ceil(t n) + 1 of each, whatever
the global order of the tokens. Each order is a filter of its own, and a pair is verified
only if it passes all of them, one after the other:
  order 1: rarest first within a pool, the tokens whose hash lies below a fixed share of all
           hashes; other tokens follow. A class whose prefix holds only tokens that no other
           class has can't link with any. That leaves few of the classes.
  order 2: rarest first over all tokens, counted anew among the classes that order 1 left.
  order 3: rarest first within another pool, counted among those that order 2 left; its
           prefix tokens are the index that brings classes together.
  order 4 to 6: by three other hashes. Classes that meet are held against each other by bit
           signatures of these prefixes; two without a common bit have no common token.
The size filter comes with them, and one by the parity of hashed tokens (two sets differ in
at least as many tokens as their parity bits do). Documents with equal sets are one class
and are joined as one. Verification counts shared tokens exactly.

Counting for orders 1 and 2 moves four bytes a token and a small number for its class, packed
by shard of the hash; equal tokens of a chunk of rows are sent once, so that a token in a
third of all documents is no hot key. A token is taken as shared where 32 bits of its hash
within the shard are; that can only keep a class that might have gone.

Skew: classes that share index tokens, at first or second hand, form clusters. A cluster is
joined as a whole or token by token, whichever copies fewer tokens; either is cut into
blocks of bounded numbers of classes and tokens whose pairs are dealt over tasks, and tokens with the
same holders are joined once. Pairs are formed inside tasks in
numpy and never become rows; classes that are connected already aren't compared again, and
a task returns only links that connect what it hasn't
connected yet, so at most one less than its documents. No pair is left out: each one
that shares an index token meets in a task.

Defined cases: a null, empty or blank text has no words, an empty set, and is linked with
nothing, not even with another empty one; fewer words than a shingle make one shingle of
all words; equal texts in many rows are one class; rows that share a doc_id but not a
text are told apart by their sets; null doc_ids are kept and never name a component
unless all its doc_ids are null; other columns are ignored. A class is told by 128 bits of
its set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.components import connected_components as components

from . import common

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, hashes: _WordHashes | None = None) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles. bytes.lower() and bytes.split() touch ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map((_WordHashes() if hashes is None else hashes).__getitem__, words)), np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _finish(out * _K[j % 5] + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def prefix_length(n: int, num: int, den: int) -> int:
    return n + num * -n // den + 1 if n else 0


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def _scan(docs: DataFrame, n: int, pool: float) -> DataFrame:
    """Of each row the set's size and identity (node, check), and its tokens in order 1's pool."""
    top = np.uint64(min(2**64 - 1, int(pool * 2**64)))

    def start():
        hashes = _WordHashes()

        def run(texts: list[str]) -> list[list]:
            sets = [shingles(text, n, hashes) for text in texts]
            names = [_identity(s) for s in sets]
            return [[len(s) for s in sets], [a for a, _ in names], [b for _, b in names], [s[: np.searchsorted(s, top, side="right")].tobytes() for s in sets]]

        return run

    return common.map_texts(docs, [c for c in docs.columns if c != "text"], "n int, node long, check long, tokens binary", start)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Of each row its class and whole set."""

    def start():
        hashes = _WordHashes()

        def run(texts: list[str]) -> list[list]:
            sets = [shingles(text, n, hashes) for text in texts]
            names = [_identity(s) for s in sets]
            return [[a for a, _ in names], [b for _, b in names], [len(s) for s in sets], [s.tobytes() for s in sets]]

        return run

    return common.map_texts(docs, [], "node long, check long, n int, tokens binary", start)


#: Tokens that one task counts, and tokens of one chunk of rows that are sorted by shard.
_SHARD_TOKENS, _CHUNK_TOKENS = 1_000_000, 500_000
_CELL = "shard int, token binary, own binary, names binary"


def _pack(shards: int):
    """Tokens of whole chunks of rows by shard: 32 bits of each, the place of its class among the names, and these names."""

    def cells(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        names = np.array([(a, b) for a, b, _ in rows], np.int64).reshape(-1, 2)
        tokens = np.concatenate([x for _, _, x in rows])
        own = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(x) for _, _, x in rows])
        shard = ((tokens >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        tokens, own, shard = tokens[order].astype(np.uint32), own[order], shard[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            both = np.unique(tokens[lo:hi].astype(np.uint64) << np.uint64(32) | own[lo:hi])
            part, mine = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
            # Of a token that three or more classes of the chunk share, two are enough to tell.
            more = np.zeros(len(part), bool)
            more[2:] = part[2:] == part[:-2]
            part, mine = part[~more], mine[~more]
            used, mine = np.unique(mine, return_inverse=True)
            small = np.uint16 if len(used) < 2**16 else np.uint32
            out.append((int(shard[lo]), part.tobytes(), bytes([np.dtype(small).itemsize]) + mine.astype(small).tobytes(), names[used].tobytes()))
        yield pd.DataFrame(out, columns=["shard", "token", "own", "names"])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for pdf in pdfs:
            for a, b, tokens in zip(pdf["node"].tolist(), pdf["check"].tolist(), pdf["tokens"], strict=True):
                if tokens and (a, b) not in held:
                    held[a, b] = np.frombuffer(tokens, np.uint64)
                    size += len(held[a, b])
                if size >= _CHUNK_TOKENS:
                    yield from cells([(*k, x) for k, x in held.items()])
                    held, size = {}, 0
        if held:
            yield from cells([(*k, x) for k, x in held.items()])
        held.clear()
        common.give_back()

    return run


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of (node, check) names, and where each row is among them."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    ranked = names[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)]
    row = np.empty(len(names), np.int64)
    row[order] = np.cumsum(new) - 1
    return ranked[new], row


_LONE = "part int, names binary, lone binary"


def _count_lone(parts: int):
    """Of one shard: how many tokens each class has alone, packed by part of the classes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["token"]])
        names = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["names"]]
        base = np.cumsum([0, *map(len, names)])
        own = np.concatenate([np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1).astype(np.int64) + b for x, b in zip(pdf["own"], base[:-1], strict=True)])
        del pdf
        names, row = _distinct(np.concatenate(names))  # a class that came with several chunks is one
        key = token.astype(np.uint64)
        key <<= np.uint64(32)
        key |= row[own].astype(np.uint64)
        del token, own, row
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        token, owner = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(2**32 - 1)).astype(np.int64)
        del key
        other = token[1:] != token[:-1]
        lone = np.bincount(owner[np.r_[True, other] & np.r_[other, True]], minlength=len(names))
        part = (names[:, 0] % parts).astype(np.int32)
        out = [(k, names[at].tobytes(), lone[at].astype(np.int32).tobytes()) for k in range(parts) if len(at := np.flatnonzero((part == k) & (lone > 0)))]
        del names, owner, token, other, part
        common.give_back()
        return pd.DataFrame(out, columns=["part", "names", "lone"])

    return run


def _sum_lone(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the classes: the shards' counts of each class together."""
    names, row = _distinct(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["names"]]))
    lone = np.bincount(row, np.concatenate([np.frombuffer(x, np.int32) for x in pdf["lone"]]), len(names))
    return pd.DataFrame({"node": names[:, 0], "check": names[:, 1], "lone": lone.astype(np.int64)})


def _classes(rows: DataFrame, num: int, den: int, shard_tokens: int) -> DataFrame:
    """(node, check, n, doc_id, alive) of each class with tokens: whether its prefix, rarest first, holds a shared token.

    rows: (node, check, n, tokens) and, where it has one, doc_id. Unshared tokens are the
    rarest; a class that has as many of them as its prefix is long has no others there.
    """
    total = rows.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    shards = total // 8 // shard_tokens + 1
    parts = shards // 2 + 1
    cells = rows.select("node", "check", "tokens").mapInPandas(_pack(shards), _CELL)
    lone = cells.groupBy("shard").applyInPandas(_count_lone(parts), _LONE).groupBy("part").applyInPandas(_sum_lone, "node long, check long, lone long")
    named = rows.select("node", "check", "n", F.col("doc_id") if "doc_id" in rows.columns else F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("lone"))
    both = named.where("n > 0").unionByName(lone.select("node", "check", F.lit(0).alias("n"), F.lit(None).cast("long").alias("doc_id"), "lone"))
    one = both.groupBy("node", "check").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.sum("lone").alias("lone"))
    return one.select("node", "check", "n", "doc_id", (F.col("lone") < _prefix(num, den)).alias("alive"))


def _prefix(num: int, den: int) -> Column:
    return F.expr(f"n - (cast(n as bigint) * {num} + {den - 1}) div {den} + 1")


def _ordered(survivors: DataFrame, num: int, den: int, pool: float) -> DataFrame:
    """(node, n, pooled, tokens): the tokens that order 3 may need, those of its pool first, as hashes that tell them."""
    top = np.uint64(min(2**64 - 1, int(pool * 2**64)))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for node, n, tokens in zip(pdf["node"].tolist(), pdf["n"].tolist(), pdf["tokens"], strict=True):
                h = np.sort(_hashed(np.frombuffer(tokens, np.uint64), 2))
                k = int(np.searchsorted(h, top, side="right"))
                out.append((node, n, k, h[: max(k, prefix_length(n, num, den))].view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "pooled", "tokens"])

    return survivors.select("node", "n", "tokens").mapInPandas(run, "node long, n int, pooled int, tokens array<long>")


def _hashed(s: np.ndarray, order: int) -> np.ndarray:
    """Another hash of each token, one to one."""
    return _finish(s * _K[order % 5] + _K[order - 1])


def first_tokens(s: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first `length` tokens of s under an order by hash."""
    keys = _hashed(s, order)
    return np.partition(keys, length - 1)[:length] if length < len(keys) else keys


def signatures(firsts: list[np.ndarray], words: int) -> np.ndarray:
    """64 * words bits for each array of tokens."""
    out = np.zeros((len(firsts), words), np.uint64)
    row = np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
    bit = np.concatenate(firsts) & np.uint64(64 * words - 1)
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


_PARITY_WORDS = 16


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """1,024 bits for each set, each the parity of how many tokens fall on it."""
    out = np.zeros((len(sets), _PARITY_WORDS), np.uint64)
    for row, s in zip(out, sets, strict=True):
        count = np.bincount((_hashed(s, 1) >> np.uint64(54)).astype(np.int64), minlength=64 * _PARITY_WORDS)
        row[:] = np.packbits((count & 1).astype(np.uint8)).view(np.uint64)
    return out


def _most_words(sizes: np.ndarray, num: int, den: int) -> int:
    """Words of a signature: about eight bits a token of a long prefix, 128 at most."""
    longest = prefix_length(int(np.percentile(sizes, 95)), num, den)
    return min(128, max(4, 1 << (longest // 8).bit_length()))


def links_within(nodes: list[int], sets: list[np.ndarray], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links among the classes of one task: all pairs, or those across sides 0 and 1 where both occur.

    Returns a forest that connects what links connect. Some classes are held against all
    others at a time, few at first: whatever they connect needn't be compared after that.
    """
    n = np.array([len(s) for s in sets])
    zero = [i for i, x in enumerate(side) if x == 0]
    one = [i for i, x in enumerate(side) if x == 1]
    left, right = (zero, one) if zero and one else (zero or one, zero or one)
    alike = left is right
    words = _most_words(n, num, den)
    orders = [signatures([first_tokens(s, order, prefix_length(len(s), num, den)) for s in sets], words) for order in (3, 4, 5)]
    parity = parities(sets)
    out, right, root = [], np.array(right), np.arange(len(sets))
    lo, width = 0, 1
    while lo < len(left):
        part = np.array(left[lo : lo + width])
        lo, width = lo + width, min(64, 4 * width)
        apart = root[part][:, None] != root[right][None, :]
        if alike:
            apart &= part[:, None] < right[None, :]
        at, to = np.nonzero(apart)
        i, j = part[at], right[to]
        fits = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
        i, j = i[fits], j[fits]
        # shared >= num / (num + den) of both sizes' sum, so the difference is at most (den - num) / (den + num) of it.
        differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
        fits = differ * (den + num) <= (n[i] + n[j]) * (den - num)
        i, j = i[fits], j[fits]
        for sig in orders:
            meet = np.zeros(len(i), bool)
            for w in range(words):
                meet |= (sig[i, w] & sig[j, w]) != 0
            i, j = i[meet], j[meet]
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, others = int(i[a]), j[a:b]
            while len(others := others[root[others] != root[x]]):
                y, others = int(others[0]), others[1:]
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if shared * den >= (len(sets[x]) + len(sets[y]) - shared) * num:
                    root[root == root[y]] = root[x]
                    out.append((nodes[x], nodes[y]))
    return out


def _join_task(num: int, den: int):
    """Rows come sorted by (task, i, j); each such group is joined on its own."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, found = [], None, []

        def close() -> None:
            if len(held) > 1:
                nodes, sides, sets = zip(*held, strict=True)
                found.extend(links_within(list(nodes), [np.frombuffer(s, np.uint64) for s in sets], list(sides), num, den))
            held.clear()

        for pdf in pdfs:
            for task, i, j, node, side, s in zip(pdf["task"].tolist(), pdf["i"].tolist(), pdf["j"].tolist(), pdf["node"].tolist(), pdf["side"].tolist(), pdf["tokens"], strict=True):
                if (task, i, j) != key:
                    close()
                    key = (task, i, j)
                held.append((node, side, s))
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found.clear()
        close()
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])
        common.give_back()

    return run, "a long, b long"


def _index(feats: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, token) of order 3's prefixes, without tokens that one class alone holds."""
    rows = feats.select("node", "n", "pooled", F.posexplode("tokens").alias("pos", "token"))
    # What is shuffled for every token is two numbers; a class's own numbers join the few tokens that are left.
    pool = rows.where("pos < pooled").select("node", "token")
    shared = common.materialise(pool.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    met = pool.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("met"))
    met = met.join(feats.select("node", "n", "pooled"), "node")
    # Tokens of the pool that nobody shares come first in the order; only what is left of the prefix needs rows.
    left = _prefix(num, den) - (F.col("pooled") - F.size("met"))
    met = met.withColumn("left", left).where("left > 0")
    inside = met.select("node", "n", F.explode(F.transform(F.slice("met", F.lit(1), F.col("left").cast("int")), lambda x: x["token"])).alias("token"))
    outside = rows.where((F.col("pos") >= F.col("pooled")) & (F.col("pos") < _prefix(num, den))).select("node", "n", "token")
    return inside.unionByName(outside)


def _deal(rows: DataFrame, block: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Which classes meet in which task: (task, i, j, node, side), and the classes that meet any.

    Classes that share index tokens, at first or second hand, are a cluster. A cluster is
    joined as a whole, cut into blocks of about `block` classes, or token by token, each
    token's holders cut into blocks: whichever takes fewer copies of sets. Dense clusters
    are joined whole; a large one that hangs together by few tokens is not.
    """
    cut = lambda count, tokens: F.greatest(F.ceil(count / block), F.ceil(tokens / block_tokens)).cast("int")
    holders = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2")).where("m > 1")
    # Of tokens with the same holders one is enough.
    tokens = holders.groupBy("m", "t", "x1", "x2").agg(F.min("token").alias("token"), F.min("first").alias("first"))
    tokens = tokens.select("token", "first", cut(F.col("m"), F.col("t")).alias("blocks"))
    held = common.materialise(rows.join(tokens, "token").select("token", "node", "n", "blocks", "first"), "held")
    near = components(held.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    size_of = held.groupBy("node").agg(F.first("n").alias("n"), F.sum(F.col("n") * F.col("blocks")).alias("by_token"))
    near = near.join(size_of, "node")
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"), F.sum("by_token").alias("by_token"))
    sizes = sizes.select("root", "t", "by_token", cut(F.col("m"), F.col("t")).alias("blocks"))
    sizes = sizes.select("root", "blocks", (F.col("t") * F.col("blocks") <= F.col("by_token")).alias("whole"))
    near = common.materialise(near.select("node", "root").join(sizes, "root"), "clusters")
    whole = near.where("whole").select(F.col("root").alias("task"), "node", "blocks", F.lit(-1).alias("kind"))
    parts = held.join(near.where("not whole").select("node"), "node", "left_semi").select(F.col("token").alias("task"), "node", "blocks", F.lit(0).alias("kind"))
    members = whole.unionByName(parts).withColumn("own", F.pmod(F.xxhash64("node", "task"), F.col("blocks")).cast("int"))
    pairs = members.select("task", "kind", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # Within one block the pairs are of one side; across two, the sides are the two blocks. Negative i: a whole cluster's.
    pairs = pairs.select(
        "task", F.when(F.col("kind") < 0, -1 - F.least("own", "other")).otherwise(F.least("own", "other")).alias("i"), F.greatest("own", "other").alias("j"),
        "node", (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    return pairs, near.select("node")


def _survivors(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int, shard_tokens: int) -> DataFrame:
    """(node, n, tokens, a, b): the classes that orders 1 and 2 leave, with whole sets, under a short number of their own."""
    wanted = common.materialise(classes.where("alive").select(F.col("doc_id").alias("wanted_id")).distinct(), "wanted")
    buckets = common.buckets_for(wanted.count())
    texts = common.may_contain(docs, "doc_id", common.bitmap_filter(wanted, "wanted_id", buckets), buckets)
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = common.materialise(_sets(texts, n).where("n > 0"), "sets")
    left = common.materialise(_classes(sets, num, den, shard_tokens).where("alive").select("node", "check"), "left")
    whole = sets.join(left, ["node", "check"], "left_semi").groupBy("node", "check").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    numbered = whole.select(F.monotonically_increasing_id().alias("node"), "n", "tokens", F.col("node").alias("a"), F.col("check").alias("b"))
    return common.materialise(numbered, "survivors")


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, block: int = 4096, block_tokens: int = 1_000_000, pool: float | None = None, shard_tokens: int = _SHARD_TOKENS, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, component, node and check (its class); with `texts` also text_hash.

    Two documents link when den * shared >= num * union of their n-word shingle sets.
    component_id is the smallest doc_id of a component; component tells components apart
    whatever their doc_ids are, and is null for documents without words.
    """
    spark = docs.sparkSession
    pool = min(1.0, 2 * (1 - num / den)) if pool is None else pool
    text_hash = [F.xxhash64(common.fold_null(F.col("text"))).alias("text_hash")] if texts else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hash, "text")
    feats = common.materialise(_scan(docs, n, pool), "shingles")
    classes = common.materialise(_classes(feats, num, den, shard_tokens), "classes")
    survivors = _survivors(docs.select("doc_id", "text"), classes, n, num, den, shard_tokens)
    common.tidy(spark)

    with common.scratch(spark):
        rows = common.materialise(_index(common.materialise(_ordered(survivors, num, den, pool), "ordered"), num, den), "prefixes")
        pairs, mine = _deal(rows, block, block_tokens)
        sets = survivors.select("node", "tokens").join(mine, "node", "left_semi")
        dealt = pairs.join(sets, "node").repartition("task", "i", "j").sortWithinPartitions("task", "i", "j")
        run, schema = _join_task(num, den)
        found = dealt.select("task", "i", "j", "node", "side", "tokens").mapInPandas(run, schema)
        links = common.store(found, "links")  # the components read their edges more than once
    roots = components(spark.read.schema(schema).parquet(common.remember(links))).join(survivors.select("node", "a", "b"), "node")

    linked = roots.select(F.col("a").alias("node"), F.col("b").alias("check"), "root")
    named = common.materialise(classes.select("node", "check", "doc_id").join(linked, ["node", "check"], "left"), "named")
    names = common.materialise(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest")), "names")
    lone = F.concat_ws(":", "node", "check")
    named = named.join(names, "root", "left").select(
        "node", "check", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
        F.when(F.col("root").isNull(), lone).otherwise(F.col("root").cast("string")).alias("component"),
    )
    common.tidy(spark)
    out = feats.drop("tokens").join(common.materialise(named, "components"), ["node", "check"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "component", "node", "check", *(["text_hash"] if texts else []))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its set's size and the smallest doc_id that links reach."""
    return ngram_join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
