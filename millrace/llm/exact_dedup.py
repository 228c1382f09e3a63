"""Exact dedup by a log-structured merge index over digests (DataFrame functions only).

Method: every row becomes an entry (digest, code points, doc_id). Entries are dealt to
memtables of a bounded number of rows; each memtable is aggregated and flushed as a *run*
sorted by digest, in Parquet files with Bloom filters and min/max statistics on the
digest, so that a lookup of single digests skips almost every row group. Compaction merges
runs level by level, a few into one, and keeps for each digest the identifier that wins.
Entries then probe a filter of the digests that more than one row holds: what it rejects
is alone, what it lets through is looked up in the last run. Such hits get byte
verification: the smallest and the largest normalised text of the group must be the same
string. A group that fails is split by the texts themselves.

Defined cases: null text counts as empty, and all empty texts are equal; ties go to the
smallest doc_id, a null doc_id loses to any other; of rows repeated with one doc_id and
text exactly one is kept; an empty table gives an empty result; other columns of the
input are ignored whatever their names.

Scale: the text is read twice and never shuffled, except for the texts of hits that are
not combined on the map side. A task that flushes or merges reads a slice of a run, of at
most about memtable_rows entries, whatever the groups' sizes; runs and levels grow with the
rows. A group that holds a third of all rows is reduced to one row per task before the
other exchanges, and the look-up is an equi-join that AQE may split.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import remember

from . import common


def sha_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _winner() -> Column:
    """Smallest means: most code points, then smallest doc_id, null doc_ids last."""
    return F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


class MergeIndex:
    """Runs of (run, digest, best, n_rows) in the shared folder; `best` is the winning identifier.

    A memtable holds at most about `memtable_rows` entries and becomes one run of level 0;
    compaction merges `fan_in` runs of a level into one of the next, all of a level in one
    job. A run lies in several files by slices of the digest; each file is sorted by run and
    digest and has Bloom filters and min/max statistics on the digest.
    """

    schema = "run BIGINT, slice INT, digest BINARY, best STRUCT<neg_cp: INT, no_id: BOOLEAN, id: BIGINT>, n_rows BIGINT"

    def __init__(self, spark: SparkSession, fan_in: int = 4, memtable_rows: int = 50_000):
        self.spark, self.fan_in, self.memtable_rows = spark, fan_in, memtable_rows
        self.root = remember(f"{common.shared_dir(spark)}/millrace/merge-index-{uuid.uuid4().hex}")
        self.places: list[str] = []
        self.runs = self.levels = 0

    def _flush(self, entries: DataFrame, runs: int, best: Column, n_rows: Column) -> None:
        """Aggregates and sorts each run's slices, one slice a task."""
        slices = 8 * self.fan_in**self.levels
        entries = entries.withColumn("slice", F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int")).repartition("run", "slice")
        run = entries.groupBy("run", "slice", "digest").agg(best.alias("best"), n_rows.alias("n_rows"))
        place = f"{self.root}/level-{self.levels}-from-{self.runs}"
        (run.sortWithinPartitions("run", "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(place))
        self.places.append(place)
        self.runs += runs

    def put(self, entries: DataFrame) -> None:
        """Flush the memtables of (digest, n_cp, doc_id) as runs of level 0."""
        runs = entries.count() // self.memtable_rows + 1
        run = F.pmod(F.xxhash64("digest", "n_cp", "doc_id"), F.lit(runs)) + F.lit(self.runs)
        self._flush(entries.select(run.alias("run"), "digest", "n_cp", "doc_id"), runs, F.min(_winner()), F.count(F.lit(1)))

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.places) if self.places else self.spark.createDataFrame([], self.schema)

    def compact(self) -> DataFrame:
        """Merge fan_in runs at a time until one is left; returns that run."""
        while self.runs > 1:
            level = self._read().select((F.floor(F.col("run") / self.fan_in)).cast("long").alias("run"), "digest", "best", "n_rows")
            runs, self.runs, self.places, self.levels = -(-self.runs // self.fan_in), 0, [], self.levels + 1
            self._flush(level, runs, F.min("best"), F.sum("n_rows"))
        return self._read().drop("run", "slice")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests; the predicate reaches the runs' statistics and Bloom filters."""
        return self._read().where(F.col("digest").isin([bytearray(d) for d in digests]))


def exact_dedup(docs: DataFrame, memtable_rows: int = 50_000, fan_in: int = 4, digest: Callable[[Column], Column] = sha_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, digest, n_cp."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.fold_null(F.col("text")).alias("text"))
    norm = common.without_spaces(F.col("text"))
    seen = docs.select("doc_id", F.char_length("text").alias("n_cp"), norm.alias("norm"))
    seen = seen.select("doc_id", "n_cp", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("sha"))
    entries = common.materialise(seen, "entries")

    index = MergeIndex(spark, fan_in, memtable_rows)
    index.put(entries.select("digest", "n_cp", "doc_id"))
    merged = common.materialise(index.compact().where("n_rows > 1"), "hits")

    common.tidy(spark)
    # Entries probe the hits' filter; what it rejects is alone with its text and needs no join.
    buckets = common.buckets_for(merged.count())
    flagged = common.probed(entries, "digest", common.bitmap_filter(merged, "digest", buckets), buckets)
    own, single = F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")), F.lit(1).cast("long")
    columns = ["digest", "sha", "doc_id", "n_cp", "n_same", "best", "n_rows"]
    alone = flagged.where("not _may").select("digest", "sha", "doc_id", "n_cp", single.alias("n_same"), own.alias("best"), single.alias("n_rows"))
    # Rows that agree in all of these are repeats of one row.
    rows = flagged.where("_may").groupBy("digest", "sha", "doc_id", "n_cp").agg(F.count(F.lit(1)).alias("n_same")).join(merged, "digest", "left")
    rows = rows.withColumn("best", F.coalesce("best", own)).withColumn("n_rows", F.coalesce("n_rows", single)).select(columns)

    bad = _verify(docs, entries, merged, norm, digest)
    if bad is not None:
        rows = rows.join(bad, "digest", "left_anti").unionByName(_by_text(docs, bad, norm, digest).select(columns))
    told = alone.unionByName(rows)
    best = (F.col("doc_id").eqNullSafe(F.col("best.id"))) & (F.col("n_cp") == -F.col("best.neg_cp"))
    told = told.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_same"))))
    return told.select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("n_rows").alias("group_size"),
        (best & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), "digest", "n_cp",
    )


def _verify(docs: DataFrame, entries: DataFrame, merged: DataFrame, norm: Column, digest) -> DataFrame | None:
    """Digests whose rows aren't all the same normalised text; None if there are none."""
    hits = entries.join(merged.select("digest"), "digest", "left_semi").select("doc_id")
    buckets = common.buckets_for(merged.agg(F.sum("n_rows")).first()[0] or 0)
    texts = common.may_contain(docs, "doc_id", common.bitmap_filter(hits, "doc_id", buckets), buckets).select(norm.alias("norm"))
    spans = texts.groupBy(digest(F.col("norm")).alias("digest")).agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    bad = common.materialise(spans.where("lo <> hi").select("digest"), "collisions")
    return None if bad.isEmpty() else bad


def _by_text(docs: DataFrame, bad: DataFrame, norm: Column, digest) -> DataFrame:
    """The groups of the digests in `bad`, told apart by text."""
    rows = docs.select("doc_id", F.char_length("text").alias("n_cp"), norm.alias("norm"))
    rows = rows.select("*", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("sha")).join(bad, "digest", "left_semi")
    rows = rows.groupBy("digest", "sha", "norm", "doc_id", "n_cp").agg(F.count(F.lit(1)).alias("n_same"))
    groups = rows.groupBy("norm").agg(F.min(_winner()).alias("best"), F.sum("n_same").alias("n_rows"))
    return rows.join(groups, "norm")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays for its normalised text."""
    return exact_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id)
"""
