"""WARC revisits: not-modified answers resolved to the full response they stand for.

For each revisit an as-of join by canonical URL finds the latest response with
a body that is strictly earlier. The join is made of running maxima: within a
URL and a span of time, and over a URL's spans, so that a URL with a large part
of all captures is worked on in as many tasks as there are spans. A revisit
holds if its validators do (entity tags compared weakly, else the date of last
modification); it then has the response's body and its header fields, updated
by those of the revisit that a 304 may update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields of a 304 that say nothing about the stored response (content and connection fields).
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that name a visit, not a page.
_TRACKING = "^(utm_[^=]*|gclid|fbclid|sessionid)(=|$)"
#: Spans of time by which a URL's captures are split.
SPANS = 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a last slash, parameters sorted and without tracking; no scheme, no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.rlike(p, F.lit(_TRACKING))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(captures: DataFrame) -> DataFrame:
    """captures: capture_id, url, ts (a number), status, headers (a map of strings), digest, n_bytes; other columns stay out.

    One row per capture: capture_id, url_key, ts, outcome, source_id (the
    response), status, digest, n_bytes and header_lines ("name: value", names
    in lower case, sorted). Outcomes: response (status other than 304),
    resolved, no_earlier_response, validator_mismatch, no_validator; only
    resolved revisits take anything over. A response is full with status 200
    and a digest. Defined results: of responses at the same time the larger
    capture_id counts; a capture without URL or time resolves to nothing and
    serves for nothing; null headers are none, a null value is an empty one;
    rows that repeat stay; an empty table gives an empty result.
    """
    lines = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("v")))
    base = captures.select("capture_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "status", "digest", F.col("n_bytes").cast("long").alias("n_bytes"), F.array_sort(lines).alias("fields"))
    bounds = base.agg(F.percentile_approx("ts", [k / SPANS for k in range(1, SPANS)], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    span = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("ts"))) if bounds else F.lit(0)
    placed = base.withColumn("span", F.when(F.col("ts").isNotNull(), span)).withColumn("joins", F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    full = F.when((F.col("status") == 200) & F.col("digest").isNotNull(), F.struct("ts", F.col("capture_id").alias("id"), "digest", "n_bytes", "fields"))
    live = placed.where("joins")
    inside = F.max(full).over(Window.partitionBy("url_key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    of_span = live.groupBy("url_key", "span").agg(F.max(full).alias("last"))
    before = of_span.select("url_key", "span", F.max("last").over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = live.withColumn("inside", inside).join(before, ["url_key", "span"], "left").withColumn("src", F.coalesce("inside", "before")).drop("inside", "before")
    none = placed.where("not joins").withColumn("src", F.lit(None).cast(found.schema["src"].dataType))
    rows = found.unionByName(none)
    first = lambda fields, name: F.try_element_at(F.filter(F.transform(F.filter(fields, lambda f: f["k"] == name), lambda f: f["v"]), lambda v: v != ""), F.lit(1))
    tag, date = first(F.col("fields"), "etag"), first(F.col("fields"), "last-modified")
    fits = F.when(tag.isNotNull(), F.coalesce(_opaque(tag) == _opaque(first(F.col("src.fields"), "etag")), F.lit(False))).when(date.isNotNull(), F.coalesce(date == first(F.col("src.fields"), "last-modified"), F.lit(False)))
    outcome = F.when(F.coalesce(F.col("status") != 304, F.lit(True)), "response").when(F.col("src").isNull(), "no_earlier_response").when(fits.isNull(), "no_validator").when(fits, "resolved").otherwise("validator_mismatch")
    rows = rows.withColumn("outcome", outcome).withColumn("taken", F.col("outcome") == "resolved")
    may = F.filter("fields", lambda f: ~f["k"].isin(*NOT_UPDATED))
    merged = F.array_sort(F.concat(F.filter("src.fields", lambda f: ~F.exists(may, lambda m: m["k"] == f["k"])), may))
    chosen = F.when(F.col("taken"), merged).otherwise(F.col("fields"))
    own = lambda c: F.when(F.col("taken"), F.col(f"src.{c}")).otherwise(F.col(c))
    return rows.select("capture_id", "url_key", "ts", "outcome", F.when(F.col("taken"), F.col("src.id")).alias("source_id"), F.when(F.col("taken"), F.lit(200)).otherwise(F.col("status")).cast("int").alias("status"), own("digest").alias("digest"), own("n_bytes").alias("n_bytes"), F.transform(chosen, lambda f: F.concat(f["k"], F.lit(": "), f["v"])).alias("header_lines"))


_VISITS = """
SELECT page_id * 4 AS capture_id, url, page_id * 7919 % 100000 AS ts, 200 AS status, md5(html) AS digest, length(html) AS n_bytes,
  concat('"', substring(md5(html), 1, 12), '"') AS etag, concat('day ', CAST(page_id % 28 AS STRING)) AS modified, 'max-age=60' AS cache, 'text/html' AS kind FROM pages
UNION ALL
SELECT page_id * 4 + 1, concat(url, '#again'), page_id * 7919 % 100000 + 500, 304, NULL, 0,
  CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '"other"' WHEN page_id % 7 = 0 THEN concat('W/"', substring(md5(html), 1, 12), '"') ELSE concat('"', substring(md5(html), 1, 12), '"') END,
  CASE WHEN page_id % 26 = 0 THEN NULL ELSE concat('day ', CAST(page_id % 28 AS STRING)) END, 'max-age=3600', 'text/plain' FROM pages
UNION ALL
SELECT page_id * 4 + 2, url, page_id * 7919 % 100000 - page_id % 3, 304, NULL, 0, concat('"', substring(md5(html), 1, 12), '"'), NULL, 'no-cache', NULL FROM pages WHERE page_id % 5 = 0
UNION ALL
SELECT page_id * 4 + 3, url, page_id * 7919 % 100000 + 300, 500, NULL, 12, NULL, NULL, 'no-store', 'text/html' FROM pages WHERE page_id % 9 = 0
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the captures that a crawler would have of each row of `pages` (a response, conditional visits, errors), resolved."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    visits = spark.sql(_VISITS.replace("FROM pages", "FROM {pages}"), pages=pages)
    named = [("ETag", "etag"), ("Last-Modified", "modified"), ("Cache-Control", "cache"), ("Content-Type", "kind")]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in named]), lambda e: e["value"].isNotNull())
    out = resolve(visits.withColumn("headers", F.map_from_entries(entries)))
    return out.withColumn("headers", F.array_join("header_lines", "\n")).drop("header_lines")


SQL = (
    "WITH v AS ("
    + _VISITS.replace("AS STRING", "AS VARCHAR")
    + r"""),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM v),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*[.]', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
  array_to_string(list_sort([p for p in string_split(regexp_extract(bare, '[?](.*)$', 1), '&') if p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|sessionid)(=|$)')]), '&') AS args FROM b),
c AS (SELECT capture_id, CASE WHEN args = '' THEN page ELSE page || '?' || args END AS url_key, CAST(ts AS BIGINT) AS ts, status, digest, CAST(n_bytes AS BIGINT) AS n_bytes, etag, modified, cache, kind FROM k),
j AS (SELECT r.capture_id AS rid, s.*, row_number() OVER (PARTITION BY r.capture_id ORDER BY s.ts DESC, s.capture_id DESC) AS n
  FROM c r JOIN c s ON r.url_key = s.url_key AND s.ts < r.ts AND s.status = 200 AND s.digest IS NOT NULL WHERE r.status = 304),
o AS (SELECT c.*, s.capture_id AS sid, s.digest AS sdigest, s.n_bytes AS sbytes, s.etag AS setag, s.modified AS smod, s.cache AS scache, s.kind AS skind,
  CASE WHEN c.status <> 304 THEN 'response' WHEN s.capture_id IS NULL THEN 'no_earlier_response' WHEN c.etag IS NOT NULL THEN CASE WHEN regexp_replace(c.etag, '^W/', '') = regexp_replace(s.etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN c.modified IS NOT NULL THEN CASE WHEN c.modified = s.modified THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS outcome
  FROM c LEFT JOIN (SELECT * FROM j WHERE n = 1) s ON c.capture_id = s.rid),
m AS (SELECT *, outcome = 'resolved' AS taken FROM o)
SELECT capture_id, url_key, ts, outcome, CASE WHEN taken THEN sid END AS source_id, CAST(CASE WHEN taken THEN 200 ELSE status END AS INTEGER) AS status,
  CASE WHEN taken THEN sdigest ELSE digest END AS digest, CASE WHEN taken THEN sbytes ELSE n_bytes END AS n_bytes,
  array_to_string([x for x in ['cache-control: ' || (CASE WHEN taken THEN coalesce(cache, scache) ELSE cache END), 'content-type: ' || (CASE WHEN taken THEN skind ELSE kind END),
    'etag: ' || (CASE WHEN taken THEN coalesce(etag, setag) ELSE etag END), 'last-modified: ' || (CASE WHEN taken THEN coalesce(modified, smod) ELSE modified END)] if x IS NOT NULL], chr(10)) AS headers
FROM m
"""
)
