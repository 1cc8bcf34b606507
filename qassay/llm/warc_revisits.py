"""Resolution of not-modified revisit records of a web archive.

A revisit belongs to the latest earlier full response of the same canonical URL. If their validators agree, the response's headers are brought up to
date with those headers that a not-modified answer may change, and the payload is the response's.

The as-of join needs no task that holds all captures of one URL: captures are dealt by range over (URL, time), so that slices follow the counts of rows
and not the clock. A window looks back within (URL, slice), and what a slice inherits is the latest response of the slices before it, from one aggregated
row per (URL, slice). Payloads do not travel; a result names the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.llm.shared import settle

# Headers that a 304 answer carries over.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case host without user, default port, www. or m.; no scheme and fragment; query without ref and utm_ parameters, sorted; null if no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^[^@]*@|:(80|443)?$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&", -1), lambda p: (p != "") & ~p.rlike(r"^(ref|utm_[a-z]+)(=|$)"))
    text = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))
    return F.when(host != "", text)


def _lower_keys(headers: Column) -> Column:
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(entries, lambda e: e["key"] == n), F.lit(0))["value"]))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (record_id, kind: response or revisit, url, ts long, etag, last_modified, headers map): record_id,
    canonical_url, matched_id, verdict and headers.

    verdict: resolved; mismatch (the latest earlier response has other validators); no_validator (the revisit has neither an entity tag nor a date);
    orphan (no earlier response, or no time or usable URL). Only resolved rows have headers. Entity tags compare weakly and go before dates.
    Earlier is strictly before; of responses of the same time the greatest record_id counts. Repeated revisits keep a row each, repeated
    responses change nothing, other kinds and columns are not looked at, null headers are empty, and no revisits give an empty result.
    """
    no_headers = F.expr("cast(map() as map<string,string>)")
    names = ["record_id", "kind", "url", "ts", "etag", "last_modified", "headers"]
    own = records.select(*names).filter(F.col("kind").isin("response", "revisit"))
    own = own.withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("headers", _lower_keys(F.coalesce("headers", no_headers)))
    placed = own.filter(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    lost = own.filter((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("ts").isNull()))

    placed = placed.withColumn("is_response", F.col("kind") == "response")
    in_time = ["canonical_url", "ts", "is_response", "record_id"]
    placed = settle(placed.repartitionByRange(*in_time).sortWithinPartitions(*in_time).withColumn("slice", F.spark_partition_id()), "captures")
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers")))
    placed = placed.withColumn("response", response)

    back = Window.partitionBy("canonical_url", "slice").orderBy("ts", "is_response", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("near", F.last("response", ignorenulls=True).over(back)).filter(F.col("kind") == "revisit")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("canonical_url", "slice").agg(F.max("response").alias("latest"))
    heads = heads.select("canonical_url", "slice", F.last("latest", ignorenulls=True).over(before).alias("inherited"))
    found = seen.join(heads, ["canonical_url", "slice"]).withColumn("match", F.coalesce("near", "inherited"))

    tag = lambda c: F.regexp_replace(c, "^W/", "")
    has_tag, has_date = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    agrees = F.when(has_tag, tag(F.col("etag")) == tag(F.col("match.etag"))).otherwise(F.col("last_modified") == F.col("match.last_modified"))
    verdict = F.when(F.col("match").isNull(), "orphan").when(~has_tag & ~has_date, "no_validator").when(agrees, "resolved").otherwise("mismatch")
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.map_from_entries("match.headers"), lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)
    found = found.withColumn("verdict", verdict)
    done = found.select("record_id", "canonical_url", F.col("match.record_id").alias("matched_id"), "verdict", F.when(F.col("verdict") == "resolved", merged).alias("headers"))
    kind = own.schema["record_id"].dataType
    rest = lost.select("record_id", "canonical_url", F.lit(None).cast(kind).alias("matched_id"), F.lit("orphan").alias("verdict"), F.lit(None).cast("map<string,string>").alias("headers"))
    return done.unionByName(rest)


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture records derived from pages: each page is a full response, and gives one later revisit of the same URL with a fragment.

    Every fourth revisit has a stale entity tag, every fifth has a date instead of a tag, and revisits come up to 6,005 seconds later, so that another
    response of the URL may lie between.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    response = pages.select(
        (p * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (p * 10).alias("ts"), tag.alias("etag"), F.concat(F.lit("d"), p.cast("string")).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), (p * 10).cast("string"), F.lit("Server"), F.lit("origin")).alias("headers"),
    )
    revisit_tag = F.when(p % 5 == 0, F.lit(None)).when(p % 4 == 3, '"stale"').otherwise(tag)
    ts = p * 10 + 5 + (p % 7) * 1000
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), ts.alias("ts"), revisit_tag.alias("etag"),
        F.when(p % 5 == 0, F.concat(F.lit("d"), p.cast("string"))).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), ts.cast("string")).alias("headers"),
    )
    return response.unionByName(revisit)
