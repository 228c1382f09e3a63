"""The corpus pipeline: toxicity, exact dedup, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept,
and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it again for the next stage. All stages but the last return the columns of
documents, extra columns included.

A row is known by its doc_id and its text together, so rows with a null or repeated
doc_id are judged like others. Rows that share both are one document: exact dedup keeps
one of them, the other filters keep or drop them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, exact_dedup, ngram_join, pieces, toxicity

_KEY = "_millrace_key"


def _key(*parts: Column) -> Column:
    """128 bits for a row's doc_id and text; a null doc_id is told from all others."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.unhex(F.md5(text))


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose key is in gone(_millrace_key).

    Rows that a filter of the keys rejects pass without a join, so their texts aren't shuffled.
    """
    gone = common.materialise(gone.select(_KEY).distinct(), "dropped")
    buckets = common.buckets_for(gone.count())
    flagged = common.probed(docs.withColumn(_KEY, key), _KEY, common.bitmap_filter(gone, _KEY, buckets), buckets)
    stay = flagged.where("not _may").unionByName(flagged.where("_may").join(gone, _KEY, "left_anti"))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    rows, names = _renamed(docs)
    return _restored(toxicity.scored(rows, model, rows.columns).where(F.col("score") < toxicity.THRESHOLD), docs, names)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 and so on besides doc_id and text; extra columns may be called anything."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _restored(df: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows, names = _renamed(docs)
    found = exact_dedup.exact_dedup(docs).select(_key(F.col("doc_id"), F.col("n_cp"), F.hex("digest")).alias(_KEY), "kept")
    # Rows of one key are repeats, or differ in their blanks only.
    found = found.groupBy(_KEY).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = common.materialise(found.where("not kept or n > 1"), "copies")
    text = common.fold_null(F.col("text"))
    key = _key(F.col("doc_id").cast("long"), F.char_length(text), F.hex(exact_dedup.sha_digest(common.without_spaces(text))))
    clean = _without(rows, found.where("not kept"), key)
    twice = found.where("kept").select(_KEY)
    if twice.isEmpty():
        return _restored(clean, docs, names)
    several = clean.withColumn(_KEY, key).join(twice, _KEY, "left_semi")
    one = several.groupBy(_KEY).agg(F.first(F.struct(*rows.columns)).alias("row")).select("row.*")
    return _restored(_without(clean, twice, key).unionByName(one), docs, names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8."""
    rows, names = _renamed(docs)
    text_hash = F.xxhash64(common.fold_null(F.col("text")))
    found = common.materialise(ngram_join.ngram_join(docs, n=5, num=80, den=100, texts=True), "near")
    found = found.where("component is not null").select("component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("row"))
    first = common.materialise(found.groupBy("component").agg(F.min("row").alias("first")), "first")
    gone = found.join(first, "component").where("row <> first")
    return _restored(_without(rows, gone.select(_key(F.col("row.doc_id"), F.col("row.text_hash")).alias(_KEY)), _key(F.col("doc_id").cast("long"), text_hash)), docs, names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    rows, names = _renamed(docs)
    text_hash = F.xxhash64(common.fold_null(F.col("text")))
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    return _restored(_without(rows, found.select(_key(F.col("doc_id"), F.col("text_hash")).alias(_KEY)), _key(F.col("doc_id").cast("long"), text_hash)), docs, names)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and round_trip (whether the ids decode to the text) of each document."""
    return pieces.encode_documents(docs.select("doc_id", "lang", "source", "text"), pieces.default_model(), ["doc_id", "lang", "source"], give="round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: A trained score and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself goes when its result is written, and that when the next one's is."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with common.scratch(spark):
            made = stage(spark, docs, sf_dir)
            place = common.store(made, f"stage-{name}")
        docs = spark.read.schema(made.schema).parquet(place)
        common.delete(spark, *before)
        before = [place]
    common.remember(place)
    return docs
