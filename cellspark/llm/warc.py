"""Resolution of not-modified revisit records.

Each revisit is joined as of its date with the latest earlier full response of the same
canonical URL; its validators are checked against that response's (entity tags by weak
comparison, else last-modified dates, else payload digests), and the headers that a 304
response may update are merged into the stored ones.

A URL's records are ordered inside blocks of time, and each block is handed the last full
response of the blocks before it, so that one hot URL is spread over many tasks.

Defined results: a record without URL or date resolves to nothing; a response counts as earlier
only if its date is; of responses of one date the one with the highest ``record_id`` counts; a revisit whose
validators are all absent, or differ, is unverified and keeps its own headers only; repeated
rows each give a row.
Very long payloads never enter the window; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

#: The headers that a 304 response may update in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that only track visits.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)"
#: Units of ``date`` in a block.
BLOCK = 1 << 12
#: The same where dates are page numbers.
PAGE_BLOCK = 1 << 7


def canonical_url(url: Column) -> Column:
    """Without scheme, www./m. prefix, default port, fragment, tracking parameters and last slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each revisit.

    records: ``record_id long, uri, date long, type ('response' or 'revisit'), etag, last_modified, digest, headers map<string,string>``.
    """
    kept = records.where("type in ('response', 'revisit')").select("record_id", canonical_url(F.col("uri")).alias("url"), F.col("date").cast("long").alias("date"), (F.col("type") == "response").alias("full"), "etag", "last_modified", "digest", "headers")
    rows = kept.withColumn("block", F.expr(f"date div {block}")).withColumn("stored", F.when(F.col("full") & F.col("url").isNotNull() & F.col("date").isNotNull(), F.struct("date", "record_id", "etag", "last_modified", "digest", "headers")))
    # At one date revisits come first: a response of the same date isn't earlier.
    inside = Window.partitionBy("url", "block").orderBy("date", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("near", F.last("stored", ignorenulls=True).over(inside)).where(~F.col("full"))
    key = F.struct("stored.date", "stored.record_id")
    blocks = rows.where("url is not null and block is not null").groupBy("url", "block").agg(F.max_by("stored", key).alias("last"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(F.col("url").alias("u"), F.col("block").alias("b"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = within.join(carried, (F.col("url") == F.col("u")) & (F.col("block") == F.col("b")), "left").withColumn("to", F.when(F.col("url").isNotNull() & F.col("date").isNotNull(), F.coalesce("near", "carried")))
    same = F.coalesce(_weak(F.col("etag")) == _weak(F.col("to.etag")), F.col("last_modified") == F.col("to.last_modified"), F.col("digest") == F.col("to.digest"), F.lit(False))
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    update = F.map_filter(own, lambda k, v: F.lower(k).isin(*PERMITTED))
    stored = F.coalesce("to.headers", F.create_map().cast("map<string,string>"))
    names = F.transform(F.map_keys(update), F.lower)
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(names, F.lower(k))), update)
    checked = found.withColumn("verified", same)
    return checked.select("record_id", "url", "date", F.col("to.record_id").alias("refers_to"), "verified", F.when(F.col("verified"), merged).otherwise(own).alias("headers"), F.when(F.col("verified"), F.col("to.digest")).alias("digest"))


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), e["value"]))), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Each page as a full response at its id and as a revisit 50 later.

    Revisits bring, by turns, an entity tag, a last-modified date, a digest or no validator; a third of them are stale.
    """
    text = F.coalesce("html", F.lit(""))
    digest = F.md5(text.cast("binary"))
    base = pages.select("page_id", "url", digest.alias("digest"), F.octet_length(text).cast("string").alias("size"))
    heads = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    day, modified = F.col("page_id").cast("string"), F.concat(F.lit("modified "), F.col("digest"))
    full = base.select((2 * F.col("page_id")).alias("record_id"), F.col("url").alias("uri"), F.col("page_id").alias("date"), F.lit("response").alias("type"), F.col("digest").alias("etag"), modified.alias("last_modified"), "digest", heads("Content-Type", "text/html", "Content-Length", F.col("size"), "Date", day, "ETag", F.col("digest")).alias("headers"))
    turn = lambda k, c: F.when(F.pmod("page_id", F.lit(4)) == k, F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("stale")).otherwise(c))
    again = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.col("url").alias("uri"), (F.col("page_id") + 50).alias("date"), F.lit("revisit").alias("type"), turn(0, F.concat(F.lit("W/"), F.col("digest"))).alias("etag"), turn(1, modified).alias("last_modified"), turn(2, F.col("digest")).alias("digest"),
        heads("Date", (F.col("page_id") + 50).cast("string"), "Content-Length", "0", "Cache-Control", "no-cache").alias("headers"),
    )
    return full.unionByName(again)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(page_records(read_table(spark, sf_dir, "pages")), PAGE_BLOCK)
    return out.select("record_id", "url", "date", "refers_to", "verified", header_text(F.col("headers")).alias("headers"), "digest")


OP6_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
q AS (
  SELECT page_id, digest, size,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS args
  FROM p
),
c AS (SELECT page_id, digest, size, base || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url FROM q),
j AS (
  SELECT v.page_id, v.url, r.page_id AS rid, r.digest, r.size, v.page_id % 3 <> 0 AND v.page_id % 4 <> 3 AND v.digest = r.digest AS same, row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC) AS k
  FROM c v LEFT JOIN c r ON r.url = v.url AND r.page_id < v.page_id + 50
)
SELECT 2 * page_id + 1 AS record_id, url, page_id + 50 AS date, 2 * rid AS refers_to, coalesce(same, false) AS verified,
  CASE WHEN same THEN 'cache-control: no-cache' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 50) || chr(10) || 'etag: ' || digest
    ELSE 'cache-control: no-cache' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || (page_id + 50) END AS headers,
  CASE WHEN same THEN digest END AS digest
FROM j WHERE k = 1
"""
