"""WARC: resolution of not-modified revisits.

Method: a revisit record (server not modified, status 304) has no payload. It is resolved
by an as-of join on the canonical URL: to the latest earlier full response (status 200),
which must agree with the revisit's validators. An ETag, where the revisit has one, must
equal the response's (weakly: without W/); otherwise Last-Modified must equal; a revisit
without a validator takes the response as it is. The resolved record has the response's
payload and its headers, updated by those headers of the revisit that a 304 may carry.

The as-of join is a union of both kinds and a running last_value in time order, in two
levels: the records are cut into ranges of (URL, time), so that a hot URL, even at one
moment, is spread over many; the running value inside a (URL, range) is a window over at
most a range's rows, and a second window over one row per URL and range carries the last
response into the ranges that follow. Payloads take no part in either; they are fetched by
record id, in equi-joins whose hot side Spark may split.

Defined cases: at equal times a response comes before a revisit, and the response with the
largest record_id is the later one; a revisit without an earlier response, or whose
validators differ, is 'unresolved' with nulls; rows with a null url or time are unresolved
too; null headers are an empty map; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Headers that a 304 response may carry to update a stored one (RFC 9111, RFC 9110).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters without influence on the resource.
IGNORED = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical(url: Column) -> Column:
    """Scheme dropped, host lower-cased, default port, fragment, tracking parameters and a last slash removed; parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(IGNORED)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _etag(headers: Column) -> Column:
    return F.regexp_replace(_header(headers, "etag"), r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of records(record_id, kind, url, time, status, headers, payload), resolved.

    kind is response or revisit, time is in seconds, headers a map with lower-case names.
    Returns record_id, url_key, state, source_id, headers, payload for every revisit.
    """
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    rows = records.select("record_id", "kind", canonical(F.col("url")).alias("key"), F.col("time").cast("long").alias("time"), "status", F.coalesce("headers", empty).alias("headers"))
    rows = rows.where(((F.col("kind") == "response") & (F.col("status") == 200)) | (F.col("kind") == "revisit"))
    is_full = F.col("kind") == "response"
    rows = rows.withColumn("order", F.struct("time", F.when(is_full, 0).otherwise(1).alias("late"), "record_id"))
    timed = rows.where("key is not null and time is not null").repartitionByRange("key", "order").withColumn("bucket", F.spark_partition_id())
    timed = common.materialise(timed, "captures")

    # Level 1, inside a (key, bucket); level 2 carries the last response of each bucket onwards.
    here = Window.partitionBy("key", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    full = F.when(is_full, F.struct("record_id", "headers"))
    near = timed.withColumn("near", F.last(F.when(is_full, F.struct("record_id")), ignorenulls=True).over(here)).where("kind = 'revisit'")
    ends = timed.groupBy("key", "bucket").agg(F.max(F.when(is_full, F.col("order"))).alias("end"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).select("key", "bucket", F.col("far.record_id").alias("far"))
    found = near.join(carried, ["key", "bucket"], "left").select("record_id", "key", "headers", F.coalesce("near.record_id", "far").alias("source_id"))
    found = found.unionByName(rows.where("kind = 'revisit' and (key is null or time is null)").select("record_id", "key", "headers", F.lit(None).cast(records.schema["record_id"].dataType).alias("source_id")))

    source = timed.where(is_full).select(F.col("record_id").alias("source_id"), F.col("headers").alias("old"))
    pair = found.join(source, "source_id", "left")
    mine, theirs = _etag(F.col("headers")), _etag(F.col("old"))
    date = _header(F.col("headers"), "last-modified")
    fits = F.when(mine.isNotNull(), F.coalesce(mine == theirs, F.lit(False))).when(date.isNotNull(), F.coalesce(date == _header(F.col("old"), "last-modified"), F.lit(False))).otherwise(True)
    ok = F.col("source_id").isNotNull() & fits
    new = F.map_filter("headers", lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    pair = pair.select("record_id", F.col("key").alias("url_key"), F.when(ok, "resolved").otherwise("unresolved").alias("state"), F.when(ok, F.col("source_id")).alias("source_id"), F.when(ok, merged).alias("headers"))
    payloads = records.select(F.col("record_id").alias("source_id"), "payload")
    return pair.join(payloads, "source_id", "left").select("record_id", "url_key", "state", "source_id", "headers", "payload")


#: Record ids of second captures begin here, those of second revisits lie as far below zero.
SECOND = 1_000_000_000_000


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl log made from pages, which hold full responses only.

    Every page is a response at time 600 page_id. Each is fetched again a day later
    under its canonical form with a fragment, conditionally, and is answered by a
    revisit with record_id -1 - page_id: a third carry the right ETag, a third the right
    Last-Modified, a sixth no validator and a sixth an ETag that has changed. Every seventh
    page has a second, conflicting capture at the time of the first, with other content; every
    fifth is revisited twice at one time, the second time without a validator.
    """
    when = (F.col("page_id") * 600).alias("time")
    stamp = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    html = F.coalesce("html", F.lit(""))
    nothing = F.create_map().cast("map<string,string>")

    def response(rows: DataFrame, record_id: Column, payload: Column, content: Column) -> DataFrame:
        headers = F.create_map(F.lit("etag"), _quoted(F.md5(content)), F.lit("last-modified"), stamp, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string"))
        return rows.select(record_id.alias("record_id"), F.lit("response").alias("kind"), "url", when, F.lit(200).alias("status"), headers.alias("headers"), payload.alias("payload"))

    def revisit(rows: DataFrame, record_id: Column, validator: Column) -> DataFrame:
        date = F.map_from_arrays(F.array(F.lit("date"), F.lit("server")), F.array((-F.col("page_id")).cast("string"), F.lit("x")))
        url = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
        return rows.select(record_id.alias("record_id"), F.lit("revisit").alias("kind"), url.alias("url"), (F.col("page_id") * 600 + 86_400).alias("time"), F.lit(304).alias("status"), F.map_concat(date, validator).alias("headers"), F.lit(None).cast("string").alias("payload"))

    turn = F.pmod("page_id", F.lit(6))
    validator = F.when(turn < 2, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), _quoted(F.md5(html))))).when(turn < 4, F.create_map(F.lit("last-modified"), stamp)).when(turn == 4, nothing).otherwise(F.create_map(F.lit("etag"), F.lit('"changed"')))
    other = F.concat(html, F.lit("<!-- second -->"))
    parts = [
        response(pages, F.col("page_id"), F.col("html"), html),
        response(pages.where("page_id % 7 = 0"), F.col("page_id") + SECOND, other, other),
        revisit(pages, -1 - F.col("page_id"), validator),
        revisit(pages.where("page_id % 5 = 0"), -1 - F.col("page_id") - SECOND, nothing),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl log over pages, with the digest of the payload that it stands for."""
    found = resolve(capture_log(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    names = F.array_sort(F.map_keys("headers"))
    text = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), ";")
    return found.select("record_id", "url_key", "state", "source_id", text.alias("headers"), F.md5("payload").alias("payload_md5"))


SQL = r"""
WITH pg AS (
  SELECT page_id, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
k AS (
  SELECT page_id, html, md5(html) AS m,
         regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS q
  FROM pg),
c AS (SELECT page_id, m, html, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM k),
r AS (
  SELECT page_id AS rid, page_id, key, m, html FROM c
  UNION ALL
  SELECT page_id + 1000000000000, page_id, key, md5(html || '<!-- second -->'), html || '<!-- second -->' FROM c WHERE page_id % 7 = 0),
v AS (
  SELECT -1 - page_id AS vid, page_id, key, m, page_id % 6 AS turn FROM c
  UNION ALL
  SELECT -1 - page_id - 1000000000000, page_id, key, m, 4 FROM c WHERE page_id % 5 = 0),
near AS (
  SELECT v.vid, max({'t': r.page_id, 'rid': r.rid}).rid AS src
  FROM v JOIN r ON r.key = v.key AND r.page_id * 600 <= v.page_id * 600 + 86400 GROUP BY v.vid),
j AS (
  SELECT v.*, r.page_id AS rpage, r.rid AS src, r.m AS rm, r.html AS rhtml,
         coalesce(CASE WHEN v.turn < 2 THEN v.m = r.m WHEN v.turn < 4 THEN v.page_id % 365 = r.page_id % 365 ELSE v.turn = 4 END AND r.rid IS NOT NULL, false) AS ok
  FROM v LEFT JOIN near USING (vid) LEFT JOIN r ON r.rid = near.src)
SELECT vid AS record_id, key AS url_key, CASE WHEN ok THEN 'resolved' ELSE 'unresolved' END AS state,
       CASE WHEN ok THEN src END AS source_id,
       CASE WHEN ok THEN 'content-type=text/html;date=' || CAST(-page_id AS VARCHAR) || ';etag=' || CASE WHEN turn < 2 THEN 'W/' ELSE '' END || '"' || rm || '";last-modified=day ' || CAST(rpage % 365 AS VARCHAR) END AS headers,
       CASE WHEN ok THEN md5(rhtml) END AS payload_md5
FROM j
"""
