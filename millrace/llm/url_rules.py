"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Method: a rule lists a canonical URL, host followed by a path prefix. A page's candidates
are its host and parent domains, each with the path prefixes of the lengths that occur in
the list. Every candidate probes a blocked Bloom filter (one block of 256 bits, eight bits
in it, so one lookup a probe). Candidates that pass go to an exact equi-join with the
list, which removes false positives; of the rules left the longest wins.

Defined cases: a null url or one without :// has an empty host and path and meets only a
rule with an empty host; repeated pages give repeated results; of rules listed twice for
one canonical URL a block beats an allow; an empty list gives the default verdict; other
columns (html among them) are never read.

Scale: the filter's size is 12 bits a rule up to `max_bytes`, a fixed bound that makes
it safe to broadcast; a longer list makes it fuller, which sends more candidates to the
join and changes no result. The list itself is joined by hash and never forced to be
broadcast. Pages are joined back by (page_id, url), so a frequent host makes no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The rules of op10 as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_PROBES = 8
_WORDS = 4


def host(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _bits(key: Column) -> list[Column]:
    """Eight places in the block, 0 to 255, from the bytes of a second hash."""
    h = F.xxhash64(F.lit(1), key)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(_PROBES)]


def _masks(key: Column) -> list[Column]:
    """The key's bits as the block's four words."""
    at = _bits(key)
    out = []
    for w in range(_WORDS):
        word = F.lit(0).cast("long")
        for b in at:
            mine = F.expr("1L").cast("long")
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", mine, b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows (block, w0..w3) of its non-empty blocks."""
    rows = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def passing(df: DataFrame, key: str, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key the filter may hold."""
    masks = _masks(F.col(key))
    inside = F.lit(True)
    for i, m in enumerate(masks):
        inside = inside & (F.col(f"w{i}").bitwiseAND(m) == m)
    keep = df.columns
    return df.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(filter_rows), "block").where(inside).select(*keep)


def url_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict.

    rules has the columns verdict, host, path; hosts are compared lower-cased.
    """
    rules = rules.select("verdict", F.concat(common.ascii_lower(F.col("host")), F.col("path")).alias("rule"), F.char_length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels"))
    rules = common.materialise(rules.groupBy("rule", "n", "labels").agg(F.max("verdict").alias("verdict")), "rules")
    # The distinct lengths of listed paths and hosts, at most as many as the longest of them has characters.
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    labels = sorted(r[0] for r in rules.select("labels").distinct().collect())
    blocks = max(1, min(rules.count() * 12 // 256 + 1, max_bytes // 40))
    bloom = bloom_blocks(rules, "rule", blocks)

    # Repeats and a frequent url: the verdict rests on the url alone, but rows stay apart by page.
    pages = pages.select("page_id", "url").select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    domains = common.let(F.split("host", r"\."), lambda x: F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: F.size(x) >= n),
        lambda n: F.array_join(F.slice(x, -n, n), "."),
    ))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(F.char_length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    each = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))
    tried = pages.select("page_id", "url", F.explode(F.array_distinct(each)).alias("rule"))
    hits = passing(tried, "rule", bloom, blocks).distinct().join(rules.select("rule", "verdict"), "rule")
    best = hits.groupBy("page_id", "url").agg(F.max(F.struct(F.char_length("rule").alias("size"), "rule", "verdict")).alias("best"))
    on = F.col("p.page_id").eqNullSafe(F.col("b.page_id")) & F.col("p.url").eqNullSafe(F.col("b.url"))
    out = pages.alias("p").join(best.alias("b"), on, "left")
    return out.select("p.page_id", "p.host", "p.path", F.col("b.best.rule").alias("rule"), F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with the rule that decides its url."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_rules(common.table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h0,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         row_number() OVER () AS rid
  FROM pages),
q AS (SELECT rid, page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT rid, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC) AS k
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM q LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""
