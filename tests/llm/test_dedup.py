"""Exact, line and near dedup against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, duck_rows, rows_of
from pyspark.sql import functions as F

from millrace.llm import common, exact_dedup, line_dedup, ngram_join
from millrace.operators.components import connected_components as components

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        first = True
        for n, i in members:
            keep = (n, i) == best and first
            first = first and not keep
            out[(i, best[1], len(members), keep)] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha_digest, lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 1))])
def test_exact(odd_docs, digest):
    """Also with a digest of four bits, so that every group collides and must be told apart by its texts."""
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd_docs, digest=digest).collect())
    assert got == exact_expected(plain(odd_docs))


def test_exact_null_ids_and_empty_table(spark, no_docs):
    rows = spark.createDataFrame([(None, "a b"), (3, "ab"), (2, "ab"), (None, "c")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {(None, None, True), (3, None, False), (2, None, False)} and exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_sql(spark):
    assert rows_of(exact_dedup.op7_exact_dedup(spark, SF)) == duck_rows(exact_dedup.SQL)


def test_merge_index_levels_and_lookup(spark):
    index = exact_dedup.MergeIndex(spark, fan_in=2, memtable_rows=20)
    rows = [(b"%d" % (i % 37), i % 5, i) for i in range(150)]
    for lo in (0, 60, 90):
        part = rows[lo : {0: 60, 60: 90, 90: 150}[lo]]
        index.put(spark.createDataFrame([(bytearray(d), n, i) for d, n, i in part], "digest binary, n_cp int, doc_id long"))
    assert index.runs == 4 + 2 + 4
    found = {(r["best"]["id"], r["n_rows"]) for r in index.lookup([b"7"]).collect()}
    assert {i for i, _ in found} <= {i for d, _, i in rows if d == b"7"} and len(found) > 1
    got = {bytes(r["digest"]): (r["best"]["id"], r["n_rows"]) for r in index.compact().collect()}
    assert index.runs == 1 and index.levels == 4
    want = {}
    for d, n, i in rows:
        want.setdefault(d, []).append((-n, i))
    assert got == {d: (min(m)[1], len(m)) for d, m in want.items()}


def test_exact_small_memtables_and_a_large_group(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, "the same " * 3 if i % 2 else f"t{i // 8}") for i in range(120)], "doc_id long, text string"))
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, memtable_rows=7, fan_in=2).collect())
    assert got == exact_expected(plain(docs))


def lines_expected(rows):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"per_shard": 1, "per_salt": 2}])
def test_lines(odd_docs, sizes):
    """Also with tiny shards and several copies of each."""
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.line_dedup(odd_docs, **sizes).collect())
    assert got == lines_expected(plain(odd_docs))


def test_lines_empty_null_and_sql(spark, no_docs):
    assert line_dedup.line_dedup(no_docs).count() == 0
    rows = spark.createDataFrame([(None, "a long enough line"), (1, "a long enough line"), (2, "a long enough line")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.line_dedup(rows).collect()) == [(0, 0), (1, 0), (2, 1)]
    assert rows_of(line_dedup.op3_line_dedup(spark, SF)) == duck_rows(line_dedup.SQL)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    b[:100] = b[0]
    a[100:200] = a[100]
    ph = line_dedup.PerfectHash.build(a, b)
    assert sorted(ph.slots(a, b)) == list(range(5000))
    shard = line_dedup.Shard(line_dedup.pack_shard(a, b, np.arange(5000), np.arange(5000) * 7))
    found, count, keeper = shard.probe(np.r_[a, a], np.r_[b, b + np.uint64(1)])
    assert found[:5000].all() and not found[5100:].any() and (count[:5000] == np.arange(5000)).all() and (keeper[:5000] == np.arange(5000) * 7).all()
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(a[[0, 0]], b[[0, 0]])


def near_expected(rows, n=3, num=90, den=100):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate(LOWER)) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, s) in enumerate(sets):
        for y, (_, t) in enumerate(sets[:x]):
            if s and t and den * len(s & t) >= num * len(s | t):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    least = {}
    for x, (i, s) in enumerate(sets):
        r = root(x)
        least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least[root(x)] if s else i) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("setting", [{}, {"block": 2}, {"n": 5, "num": 80}, {"pool": 0.01}, {"pool": 1.0, "block": 3}, {"block_tokens": 40}])
def test_near(odd_docs, setting):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(odd_docs, **setting).collect())
    keys = {k: v for k, v in setting.items() if k in ("n", "num")}
    assert got == near_expected(plain(odd_docs), **keys)


@pytest.mark.parametrize("block", [512, 8])
def test_near_group_of_variants(spark, block):
    """A group in which some pairs are linked and some aren't, in blocks and at once."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            w[at] = f"v{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"only text number {i} of its own kind") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, block=block).collect())
    assert got == near_expected(rows)


def test_near_long_documents_and_hot_tokens(spark):
    """Long texts with small and large differences, a passage in every document, null and repeated ids, many small shards."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(8))
    rows = []
    for i in range(12):
        w = [f"g{i // 4}x{k}" for k in range(1500)]
        for at in rng.choice(1500, 10 * (i % 4), replace=False):
            w[at] = f"v{i}x{at}"
        rows.append((None if i in (1, 5) else i % 7, " ".join([*w, passage])))
    rows += [(20 + i, f"{passage} own words of the text {i}") for i in range(30)] + [(20, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = [(i, t) for i, (_, t) in enumerate(rows)]
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, block=3, shard_tokens=1000).collect())))
    # The brute force numbers rows; a component's name is its least doc_id that isn't null.
    component = {}
    for i, n, c in near_expected(given):
        component.setdefault(c, []).append((i, n))
    want = []
    for members in component.values():
        name = min((rows[i][0] for i, _ in members if rows[i][0] is not None), default=None)
        want += [str((rows[i][0], n, name)) for i, n in members]
    assert got == sorted(want)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_near_query_against_brute_force(spark, sf):
    rows = plain(spark.read.parquet(f"{sf}/documents.parquet"))
    got = Counter(tuple(r) for r in ngram_join.op5_ngram_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == near_expected(rows)


def test_near_empty(no_docs):
    assert ngram_join.ngram_join(no_docs).count() == 0


def test_links_within_matches_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)] + [np.arange(30, dtype=np.uint64)] * 2
    linked = ngram_join.links_within(list(range(42)), sets, [0] * 42, 70, 100)
    up = list(range(42))
    for x, y in linked:
        up = [up[x] if u == up[y] else u for u in up]
    want = list(range(42))
    for x in range(42):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if both * 100 >= 70 * (len(sets[x]) + len(sets[y]) - both):
                want = [want[x] if u == want[y] else u for u in want]
    part = lambda u: sorted(sorted(i for i in range(42) if u[i] == r) for r in set(u))
    assert part(up) == part(want)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (2, 2)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(5, 3), (4, 3), (3, 3), (9, 3), (7, 7), (8, 7), (2, 2)}
    assert components(edges.limit(0)).count() == 0


def test_filter_loses_nothing(spark):
    keys = spark.range(0, 5000, 7).toDF("k")
    found = common.may_contain(spark.range(5000).toDF("k"), "k", common.bitmap_filter(keys, "k", 2), 2)
    assert keys.join(found, "k", "left_anti").count() == 0 and found.count() < 1500
