"""Benchmark decontamination by winnowing (DataFrame functions only).

Method: a text's words are hashed into k-grams (k = 5); of every w = 6 k-grams in a row
the smallest hash is kept. Two texts that share any k + w - 1 = 10 words in a row keep a
common k-gram inside that span, so the equi-join of training and test fingerprints misses
no shared window. A hit is then extended word by word to both sides and counts only if at
least 10 words in a row are equal; the words are compared, not their hashes. Items of
fewer than 10 words have one fingerprint, their whole word sequence, and documents are
given grams of just those lengths (at most nine, read from the items).

Defined cases: null or empty texts have no words and hit nothing; benchmark items without
words never occur; items with equal words are one class and all their ids are reported;
an item with a null item_id hits words like any other, and only its id is left out; repeated rows give repeated results; an empty benchmark gives
documents without hits; other columns are ignored.

Scale: fingerprints are about 2/7 of the words and meet the items' fingerprints in an
equi-join: Spark broadcasts the items where their written size is below its threshold and
shuffles both sides otherwise. Only documents with a joined fingerprint are read again,
found by a filter of fixed size. No group is gathered beyond one document's own positions.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, WINDOW = 5, 10
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(common.ascii_lower(common.fold_null(text)), _NOT_WORD), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def grams(hashes: Column, length: int) -> Column:
    """Hash of the gram of `length` words that starts at each position; empty where there are too few."""
    return common.let(hashes, lambda h: F.when(
        F.size(h) >= length, F.transform(F.sequence(F.lit(0), F.size(h) - length), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(length)]))
    ).otherwise(F.array().cast("array<bigint>")))


def every(gram: Column) -> Column:
    return F.when(F.size(gram) > 0, F.sequence(F.lit(0), F.size(gram) - 1)).otherwise(F.array().cast("array<int>"))


def winnowed(gram: Column, w: int) -> Column:
    """Positions whose gram is the smallest of some w in a row (all where there are fewer than w).

    gram must be a lambda's variable or a stored column: it is mentioned for each position.
    """

    def chosen(low: Column) -> Column:
        # position i lies in the windows that start at i - w + 1 to i
        first = lambda i: F.greatest(i - (w - 1), F.lit(0))
        return F.filter(every(gram), lambda i: F.array_contains(F.slice(low, first(i) + 1, F.least(i, F.size(low) - 1) - first(i) + 1), F.get(gram, i)))

    least = F.transform(F.sequence(F.lit(0), F.size(gram) - w), lambda i: F.array_min(F.slice(gram, i + 1, w)))
    return F.when(F.size(gram) < w, every(gram)).otherwise(common.let(least, chosen))


def _fingerprints(gram: Column, at: Column, length: int) -> Column:
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.get(gram, i).alias("h")))


def _all_fingerprints(length: int, gram: Column) -> Column:
    return _fingerprints(gram, every(gram), length)


def _items(bench: DataFrame) -> DataFrame:
    """Classes of items with equal words: class, words, item_ids."""
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item_id", "w", F.sha2(F.concat_ws(" ", "w"), 256).alias("class"))
    return rows.groupBy("class", "w").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _item_prints(items: DataFrame, k: int, window: int) -> DataFrame:
    """(class, len, h, pos, before, gram, after): a test fingerprint with the words around it."""
    side = window - k
    long = items.where(F.size("w") >= window)
    long = long.select("class", "w", F.explode(common.let(
        grams(F.transform("w", lambda x: F.xxhash64(x)), k), lambda g: _fingerprints(g, winnowed(g, window - k + 1), k)
    )).alias("f"))
    short = items.where(F.size("w") < window).select("class", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    whole = None
    for n in range(1, window):
        whole = F.when(F.size("wh") == n, grams(F.col("wh"), n)) if whole is None else whole.when(F.size("wh") == n, grams(F.col("wh"), n))
    short = short.select("class", "w", F.struct(F.lit(0).alias("pos"), F.size("w").alias("len"), F.get(whole, F.lit(0)).alias("h")).alias("f"))
    prints = long.unionByName(short)
    pos, n = F.col("f.pos"), F.col("f.len")
    return prints.select(
        "class", "f.len", "f.h", (F.size("w") < window).alias("short"),
        F.transform(F.sequence(F.lit(1), F.lit(side)), lambda j: F.when(pos >= j, F.get("w", pos - j))).alias("before"),
        F.slice("w", pos + 1, n).alias("gram"),
        F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: F.get("w", pos + n + j)).alias("after"),
    )


def _run(mine: Column, theirs: Column, n: int) -> Column:
    """How many leading places of the two arrays hold equal words."""
    out = F.lit(n)
    for j in reversed(range(n)):
        same = F.coalesce(F.get(mine, F.lit(j)) == F.get(theirs, F.lit(j)), F.lit(False))
        out = F.when(~same, F.lit(j)).otherwise(out)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, n_hit, item_ids (sorted strings)."""
    side = window - k
    common.bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.fold_null(F.col("text")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = common.materialise(_items(bench), "items")
    prints = common.materialise(_item_prints(items, k, window), "item-prints")
    lengths = sorted(r[0] for r in prints.where("short").select("len").distinct().collect())  # at most window - 1 values

    # 1. Documents' fingerprints against the items'. One more row per document carries its number of words.
    def all_prints(h: Column) -> Column:
        count = F.array(F.struct(F.lit(-1).alias("pos"), F.size(h).alias("len"), F.xxhash64("doc_id", "text_hash").alias("h")))
        parts = [common.let(grams(h, k), lambda g: _fingerprints(g, winnowed(g, side + 1), k))]
        # partial(), as a lambda's second parameter would be taken for the element's index
        parts += [common.let(grams(h, n), partial(_all_fingerprints, n)) for n in lengths]
        return F.concat(count, *parts)

    prints_of = docs.select("doc_id", "text_hash", F.explode(common.let(word_hashes(F.col("text")), all_prints)).alias("f")).select("doc_id", "text_hash", "f.pos", "f.len", "f.h")
    known = prints.select("len", "h").distinct().withColumn("known", F.lit(True))
    met = prints_of.join(known, ["len", "h"], "left").where("pos < 0 or known").drop("known")
    met = common.materialise(met.select("doc_id", "text_hash", "pos", "len", "h"), "met")
    common.tidy(docs.sparkSession)
    counts = met.where("pos < 0").select("doc_id", "text_hash", F.col("len").cast("long").alias("n_words"))
    hits = met.where("pos >= 0").distinct()

    # 2. The words around each hit, from the documents that have one.
    where = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "len")).alias("at"))
    buckets = common.buckets_for(hits.count())
    again = common.may_contain(docs, "text_hash", common.bitmap_filter(hits.select("text_hash"), "text_hash", buckets), buckets)
    again = _same_doc(again.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")), where)
    around = again.select("doc_id", "text_hash", F.explode(common.let(words(F.col("text")), lambda w: F.transform("at", lambda a: F.struct(
        a["pos"].alias("pos"), a["len"].alias("len"),
        F.transform(F.sequence(F.lit(1), F.lit(side)), lambda j: F.when(a["pos"] >= j, F.get(w, a["pos"] - j))).alias("d_before"),
        F.slice(w, a["pos"] + 1, a["len"]).alias("d_gram"),
        F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: F.get(w, a["pos"] + a["len"] + j)).alias("d_after"),
    )))).alias("a")).select("doc_id", "text_hash", "a.*")
    met_words = _same_doc(hits, around, ["pos", "len"])

    # 3. Extend.
    spans = met_words.join(prints, ["len", "h"]).where("gram = d_gram")
    spans = spans.select("doc_id", "text_hash", "class", "short", "pos", "len", _run(F.col("d_before"), F.col("before"), side).alias("l"), _run(F.col("d_after"), F.col("after"), side).alias("r"))
    spans = spans.where(f"short or l + len + r >= {window}")
    spans = spans.select("doc_id", "text_hash", "class", F.when(F.col("short"), F.col("pos")).otherwise(F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("len") + F.when(F.col("short"), 0).otherwise(F.col("r"))).alias("hi"))
    spans = common.materialise(spans, "spans")
    hit = spans.select("doc_id", "text_hash", "lo", "hi").distinct().select("doc_id", "text_hash", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at")).distinct()
    hit = hit.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = spans.select("doc_id", "text_hash", "class").distinct().join(items.select("class", "item_ids"), "class")
    ids = ids.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    out = _same_doc(_same_doc(counts, hit, how="left"), ids, how="left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def _same_doc(left: DataFrame, right: DataFrame, more: list[str] = (), how: str = "inner") -> DataFrame:
    """Equi-join on the document (null doc_ids are equal) and further columns."""
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    for c in more:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    rest = [c for c in right.columns if c not in ("doc_id", "text_hash", *more)]
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *[f"r.{c}" for c in rest])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its words inside windows of benchmark items."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH tok AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
itok AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM itok WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tok, ns WHERE len(w) >= n)),
hits AS (SELECT d.rid, d.i, d.n, m.item_id FROM dwin d JOIN iwin m ON d.n = m.n AND d.win = m.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
ids AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hits GROUP BY rid)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tok t LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)
"""
