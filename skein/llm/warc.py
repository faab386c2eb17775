"""Not-modified revisit records: an as-of join to the latest earlier full response.

Records of one canonical URL are ordered by capture time.  A URL that holds a large share
of all records is cut into time slices at quantiles of all capture times: inside a slice a
window finds the latest earlier response, and one row per (URL, slice) carries the latest
response over to later slices.  So no task needs all records of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm import scratch

#: Headers that a 304 answer may renew (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(?:utm_[^=]*|fbclid|gclid|ref)(?:=|$)"
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a final slash, query without tracking parameters and sorted; scheme and fragment go."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(0))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, with those of ``fresh`` that a 304 may renew put in their place; sorted by name."""
    renew = F.filter(fresh, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(renew, lambda h: F.lower(h["name"]))
    rest = F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return F.array_sort(F.concat(rest, renew))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit record.

    ``records``: record_id, uri, captured (timestamp), kind ('response' or 'revisit'),
    headers array<struct<name string, value string>>, digest (of the payload).
    Returned: record_id, url (canonical), captured, status, source_id, source_captured,
    digest, headers.

    The source is the response of the same canonical URL with the latest capture time before the
    revisit's; of several at one time the one with the largest record_id.  Validators are checked in
    this order, the first that both sides have deciding: ETag (weak comparison), Last-Modified, digest.
    status: 'resolved'; 'changed' if the validator differs; 'unverified' if there is none in common;
    'orphan' without an earlier response.  Only resolved rows carry the source's digest and merged headers.

    Null headers count as none.  Records with null uri or capture time match nothing; null
    kinds are ignored.  Repeated revisits give a row each.  Other columns are ignored.
    """
    empty = F.expr("cast(array() as array<struct<name:string,value:string>>)")
    r = records.select(
        F.col("record_id"),
        canonical_url(F.col("uri")).alias("url"),
        F.col("captured"),
        F.unix_micros("captured").alias("at"),
        F.col("kind"),
        F.coalesce("headers", empty).alias("headers"),
        F.col("digest"),
    ).filter("kind in ('response', 'revisit')")
    r = scratch.write(r, "warc-records")
    steps = ",".join(str(i / slices) for i in range(1, slices))
    bounds = r.agg(F.expr(f"array_distinct(percentile_approx(at, array({steps})))").alias("b")).first()["b"] or []
    slice_of = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("at"))) if bounds else F.lit(0)
    r = r.withColumn("slice", slice_of)
    known = F.col("url").isNotNull() & F.col("at").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", "captured", "digest", "headers"))
    live = r.filter(known)
    inside = Window.partitionBy("url", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = live.filter("kind = 'response'").groupBy("url", "slice").agg(F.max(full).alias("last"))
    steps_of = live.select("url", "slice").distinct().join(carried, ["url", "slice"], "left")
    carried = steps_of.select("url", "slice", F.max("last").over(before).alias("carried"))
    found = live.withColumn("near", F.max(full).over(inside)).filter("kind = 'revisit'").join(carried, ["url", "slice"], "left")
    found = found.withColumn("source", F.coalesce("near", "carried")).drop("near", "carried", "slice", "at", "kind")
    lost = r.filter(~known).filter("kind = 'revisit'").drop("slice", "at", "kind")
    source_type = found.schema["source"].dataType
    found = found.unionByName(lost.withColumn("source", F.lit(None).cast(source_type)))

    def weak(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    mine, theirs = F.col("headers"), F.col("source.headers")
    same = F.lit(None).cast("boolean")
    for a, b in (
        (weak(_header(mine, "etag")), weak(_header(theirs, "etag"))),
        (_header(mine, "last-modified"), _header(theirs, "last-modified")),
        (F.col("digest"), F.col("source.digest")),
    ):
        same = F.coalesce(same, a == b)
    status = F.when(F.col("source").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    out = found.withColumn("status", status)
    good = F.col("status") == "resolved"
    return out.select(
        "record_id",
        "url",
        "captured",
        "status",
        F.col("source.record_id").alias("source_id"),
        F.col("source.captured").alias("source_captured"),
        F.when(good, F.col("source.digest")).alias("digest"),
        F.when(good, merge_headers(theirs, mine)).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Captures made of a table of pages: each page is a full response at minute page_id, and is asked for again a day later with its own ETag.

    Where a page with the same canonical URL came between, that revisit's validator no longer fits.
    """
    start = 1704067200  # 2024-01-01
    etag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))

    def header(name: str, value) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    p = pages.select(
        F.col("page_id").alias("_page"),
        F.col("url").alias("uri"),
        etag.alias("etag"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"),
        (F.lit(start) + F.col("page_id") * 60).alias("sec"),
    )
    stamp = lambda s: F.timestamp_seconds(s)
    text = lambda s: s.cast("string")
    full = p.select(
        (F.col("_page") * 2).alias("record_id"),
        "uri",
        stamp(F.col("sec")).alias("captured"),
        F.lit("response").alias("kind"),
        F.array(header("Cache-Control", F.lit("max-age=60")), header("Content-Type", F.lit("text/html")), header("Date", text(F.col("sec"))), header("ETag", F.col("etag"))).alias("headers"),
        F.col("sha").alias("digest"),
    )
    again = p.select(
        (F.col("_page") * 2 + 1).alias("record_id"),
        "uri",
        stamp(F.col("sec") + 86400).alias("captured"),
        F.lit("revisit").alias("kind"),
        F.array(header("Cache-Control", F.lit("max-age=3600")), header("Content-Length", F.lit("0")), header("Date", text(F.col("sec") + 86400)), header("ETag", F.concat(F.lit("W/"), F.col("etag"))), header("Set-Cookie", F.lit("s=1"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)
