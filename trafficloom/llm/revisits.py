"""Resolution of not-modified revisit records: an as-of join by canonical URL.

A revisit belongs to the latest earlier full response of its canonical URL. It is
resolved if their validators agree: by ETag (weak comparison) where both have
one, else by Last-Modified; else it stays unresolved with the reason. The merged
headers are the response's, updated by those that a 304 may carry.

The as-of join is one sort: records are dealt by range of (URL, time, responses last, id), so a
URL that holds much of all records spreads over many ranges of about equal size. Within a
range the last response before a revisit is found by a window; across ranges one row
per range, its last response, is carried on. Payloads never move; a resolved
record names the response that holds its payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize

# Headers that a 304 may update; all others are the stored response's.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "set-cookie", "vary")
# Query parameters that don't name a resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url):
    """Lower-case scheme and host without default port, no fragment, no tracking parameters, no trailing slash; http as https.

    Only what follows the first ``?`` is a query; a path may hold ``&``. A query of which nothing is left goes with its ``?``.
    """
    whole = F.split_part(F.trim(url), F.lit("#"), F.lit(1))
    base = F.split_part(whole, F.lit("?"), F.lit(1))
    query = F.array_join(F.filter(F.split(F.substring(whole, F.length(base) + 2, F.length(whole)), "&"), lambda p: ~p.rlike(TRACKING)), "&")
    head = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_replace(F.substring(base, F.length(head) + 1, F.length(base)), r"/+$", "")
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$|^(https://.*):443$", "$1$2"), "^http://", "https://")
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers, name):
    return F.element_at(headers, F.lit(name))


def _latest_before(rows: DataFrame) -> DataFrame:
    """The revisits of rows with ``of``, the latest response of a smaller ts of their URL; canonical and ts are not null.

    Within equal ts responses sort after revisits and by record_id, so the last response above a revisit is the one.
    """
    order = [F.col("canonical"), F.col("ts"), F.col("is_response"), F.col("record_id")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.withColumn("is_response", F.col("kind") == "response").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "records")
    full = F.when(F.col("is_response"), F.struct("ts", "record_id", "headers"))
    above = Window.partitionBy("part", "canonical").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(full, ignorenulls=True).over(above)).filter("NOT is_response")
    # one row a range: its first and last URL, and the last URL's last response
    edges = dealt.groupBy("part").agg(F.min("canonical").alias("first"), F.max("canonical").alias("last"))
    ends = dealt.join(F.broadcast(edges), "part").filter("is_response AND canonical = last").groupBy("part").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct("ts", "record_id")).alias("end"))
    edges = edges.join(ends, "part", "left")
    asks = edges.select(F.col("first").alias("canonical"), "part", F.lit(False).alias("tells"), F.lit(None).cast(ends.schema["end"].dataType).alias("end"))
    tells = edges.select(F.col("last").alias("canonical"), "part", F.lit(True).alias("tells"), "end")
    before = Window.partitionBy("canonical").orderBy("part", "tells").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.union(tells).withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("NOT tells AND carried IS NOT NULL").select("part", "canonical", "carried")
    return near.join(F.broadcast(carried), ["part", "canonical"], "left").withColumn("of", F.coalesce("near", "carried")).drop("part", "near", "carried", "is_response")  # at most a row a range


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, canonical, ts, response_id, outcome, headers for each revisit.

    records: record_id, url, ts, kind (response or revisit), status, headers (map). Names of
    headers are matched in lower case; other columns are ignored. Full
    responses have status 200; of equal times the largest record_id counts as the latest. A null
    url or ts, or no earlier response, gives outcome 'no response'; null headers
    are empty; repeated rows each get their row; an empty table gives none.
    """
    low = F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "status", F.coalesce(low, F.expr("cast(map() AS map<string,string>)")).alias("headers"))
    rows = rows.filter("kind = 'revisit' OR (kind = 'response' AND status = 200)")
    whole = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    found = _latest_before(rows.filter(whole))
    lost = rows.filter(~whole & (F.col("kind") == "revisit"))
    found = found.unionByName(lost.withColumn("of", F.lit(None).cast(found.schema["of"].dataType)))
    stored = F.col("of.headers")

    def tag(headers):
        return F.regexp_replace(_header(headers, "etag"), "^W/", "")

    outcome = (
        F.when(F.col("of").isNull(), "no response")
        .when(tag("headers").isNotNull() & tag(stored).isNotNull(), F.when(tag("headers") == tag(stored), "resolved").otherwise("mismatch"))
        .when(_header("headers", "last-modified").isNotNull() & _header(stored, "last-modified").isNotNull(), F.when(_header("headers", "last-modified") == _header(stored, "last-modified"), "resolved").otherwise("mismatch"))
        .otherwise("no validator"))
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    found = found.withColumn("outcome", outcome)
    return found.select("record_id", "canonical", "ts", F.col("of.record_id").alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, update)).otherwise(F.col("headers")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl over pages: each page's full response, a second one of every fifth, and a revisit of each.

    The revisit's ETag is that of the page's last response, but every fourth revisit has a
    stale one and every seventh only a date; pages without html were never fetched.
    """
    etag, when = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"')), F.col("page_id") * 10
    changed = F.col("page_id") % 5 == 0

    def record(kind, step, status, tag, modified, *more):
        headers = F.create_map(*[F.lit(x) if isinstance(x, str) else x for pair in [("Last-Modified", modified), *([("ETag", tag)] if tag is not None else []), *more] for x in pair])
        return F.struct((when + step).alias("record_id"), "url", (when + step).alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), headers.alias("headers"))

    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    second = F.concat(F.lit("W/"), etag)
    records = F.array(
        F.when(F.col("html").isNotNull(), record("response", 0, 200, etag, day, ("Content-Type", "text/html"), ("Cache-Control", "max-age=60"))),
        F.when(F.col("html").isNotNull() & changed, record("response", 3, 200, second, day, ("Content-Type", "text/html"), ("Content-Length", F.length("html").cast("string")))),
        F.when(F.col("page_id") % 7 == 0, record("revisit", 5, 304, None, day, ("Cache-Control", "no-store"))).otherwise(
            record("revisit", 5, 304, F.when(F.col("page_id") % 4 == 0, F.lit('"stale"')).otherwise(F.coalesce(etag, F.lit('"none"'))), day, ("Cache-Control", "max-age=5"), ("Content-Type", "text/plain"))))
    return pages.select("page_id", "url", "html").select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")


def op6_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    """record_id, canonical, response_id, outcome and the merged headers (sorted, as text) of all revisits of pages."""
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "canonical", "response_id", "outcome", text.alias("merged"))


OP6_SQL = r"""
WITH u AS (SELECT page_id, html, string_split(trim(url), '#')[1] AS u FROM pages),
s AS (SELECT page_id, html, string_split(u, '?')[1] AS base, CASE WHEN contains(u, '?') THEN list_filter(string_split(substr(u, strpos(u, '?') + 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')) ELSE [] END AS params FROM u),
c AS (SELECT page_id, html, array_to_string(params, '&') AS query, string_split(base, '://') AS around, string_split(string_split(base, '://')[2], '/') AS parts FROM s),
h AS (SELECT page_id, html, query, lower(around[1]) AS scheme, string_split(lower(parts[1]), ':') AS host, rtrim(array_to_string(parts[2:], '/'), '/') AS path FROM c),
p AS (SELECT page_id, html, 'https://' || host[1] || CASE WHEN len(host) = 1 OR (scheme, host[2]) IN (('http', '80'), ('https', '443')) THEN '' ELSE ':' || host[2] END
    || CASE WHEN path = '' THEN '' ELSE '/' || path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical,
  '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page_id % 28) AS day FROM h),
responses AS (SELECT canonical, page_id * 10 AS id, tag, day, 'cache-control: max-age=60' AS own, FALSE AS second FROM p WHERE html IS NOT NULL
  UNION ALL SELECT canonical, page_id * 10 + 3, tag, day, 'content-length: ' || length(html), TRUE FROM p WHERE html IS NOT NULL AND page_id % 5 = 0),
revisits AS (SELECT canonical, page_id * 10 + 5 AS id, day, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 4 = 0 THEN '"stale"' ELSE coalesce(tag, '"none"') END AS tag FROM p),
j AS (SELECT v.*, r.id AS response_id, r.tag AS rtag, r.day AS rday, r.own, r.second FROM revisits v ASOF LEFT JOIN responses r ON v.canonical = r.canonical AND v.id > r.id),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no response' WHEN coalesce(tag, rtag) IS NOT NULL AND tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END WHEN day = rday THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT id AS record_id, canonical, response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || CASE WHEN tag IS NULL THEN 'no-store' ELSE 'max-age=5' END || CASE WHEN second THEN chr(10) || own ELSE '' END || chr(10) || 'content-type: text/html'
      || chr(10) || 'etag: ' || coalesce(tag, CASE WHEN second THEN 'W/' ELSE '' END || rtag) || chr(10) || 'last-modified: ' || day
    WHEN tag IS NULL THEN 'cache-control: no-store' || chr(10) || 'last-modified: ' || day
    ELSE 'cache-control: max-age=5' || chr(10) || 'content-type: text/plain' || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: ' || day END AS merged
FROM o
"""
