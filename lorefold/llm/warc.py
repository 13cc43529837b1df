"""WARC: not-modified revisits resolve to the latest earlier full response of their canonical URL, whose validators must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Header fields of a 304 response that must not replace those of the stored response. RFC 9111 section 3.2 and the fields it points to.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name a campaign, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Records of one span of time, on average; a URL with more records is spread over spans, of which there are MOST_SPANS at most.
SPAN_RECORDS, MOST_SPANS = 20_000, 1000
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default ports, path without a last slash, parameters sorted without those for tracking, no scheme, no fragment.

    What isn't an absolute URL stays as it is; null stays null."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r":(80|443)?$", ""), r"^www\.", "")
    params = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    return F.when(url.rlike(_URL), F.concat(host, F.regexp_replace(part(3), r"/+$", ""), query)).otherwise(url)


def header_map(headers: Column) -> Column:
    """A header map with names in lower case, the last of a repeated name; null becomes empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored response's fields, replaced by those of the 304 response that may replace them."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def _entries(h: Column) -> Column:
    """A header map as an ordered array, which can be compared."""
    return F.array_sort(F.map_entries(h))


def resolve_revisits(records: DataFrame, span_records: int = SPAN_RECORDS) -> DataFrame:
    """Records (record_id, warc_type response or revisit, url, ts long, status int, headers map) to one row for each revisit.

    Returns record_id, url_key (canonical URL), ts, outcome, response_id, response_ts, merged (headers). A full response is a response record of status 200.
    outcome is `resolved` if the latest full response before the revisit (of equal times, the largest record_id, then the largest validators and headers)
    carries the validator that the revisit shows: ETag by weak comparison, else Last-Modified; `mismatch` if it carries another; `no_validator` if the
    revisit shows none; `no_response` without an earlier response, or with a null url or ts. Only resolved revisits have response_id and merged.
    Each record is one of its own, with its own headers, whatever ids and times it repeats; a null headers map is empty; extra columns play no part; no records give no rows.
    URLs and headers may be long: they are compared whole.

    The as-of join deals records by (URL, span of time), so that one URL with a large part of all records is many tasks. Spans hold about equally many records,
    by quantiles of the times, so that a burst is cut too; one URL's records of one second stay together. In a span, a running maximum finds the latest
    response with its headers; that of earlier spans is carried over from one row for each URL and span. Bodies take no part.
    """
    h = header_map(F.col("headers"))
    base = records.where(F.col("warc_type").isin("response", "revisit")).select("record_id", "warc_type", "status", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), h.alias("h"))
    base = base.withColumns({"etag": F.regexp_replace(F.element_at("h", "etag"), "^W/", ""), "modified": F.element_at("h", "last-modified")})
    spans = min(MOST_SPANS, -(-records.count() // span_records))
    cuts = sorted({int(q) for q in records.select(F.col("ts").cast("long").alias("ts")).approxQuantile("ts", [k / spans for k in range(1, spans)], 0.25 / spans)}) if spans > 1 else []
    span = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    stored = F.when(F.col("warc_type") == "response", F.struct("ts", "record_id", "etag", "modified", _entries(F.col("h")).alias("entries")))
    placed = base.where("url_key is not null and ts is not null").where(full | (F.col("warc_type") == "revisit")).select("url_key", "ts", "record_id", "warc_type", "etag", "modified", stored.alias("stored"), F.when(F.col("warc_type") == "revisit", F.col("h")).alias("update"), span.alias("span"))
    placed = materialise(placed, "visits")
    inside = Window.partitionBy("url_key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    latest = placed.withColumn("here", F.max("stored").over(inside)).where("warc_type = 'revisit'").drop("stored")
    tops = placed.groupBy("url_key", "span").agg(F.max("stored").alias("top"))
    carried = tops.withColumn("before", F.max("top").over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).where("before is not null").drop("top")
    found = (latest.join(carried, ["url_key", "span"], "left") if cuts else latest.withColumn("before", F.lit(None).cast(latest.schema["here"].dataType))).withColumn("r", F.coalesce("here", "before"))
    same = F.when(F.col("etag").isNotNull(), F.col("r.etag").eqNullSafe(F.col("etag"))).otherwise(F.col("r.modified").eqNullSafe(F.col("modified")))
    outcome = F.when(F.col("r").isNull(), "no_response").when(F.col("etag").isNull() & F.col("modified").isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    hit = lambda c: F.when(F.col("outcome") == "resolved", c)
    merged = hit(merge_headers(F.map_from_entries("r.entries"), F.col("update")))
    found = found.select("record_id", "url_key", "ts", "outcome", hit(F.col("r.record_id")).alias("response_id"), hit(F.col("r.ts")).alias("response_ts"), merged.alias("merged"))
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("response_id", "response_ts", "merged")]
    lost = base.where("warc_type = 'revisit' and (url_key is null or ts is null)").select("record_id", "url_key", "ts", F.lit("no_response").alias("outcome"), *nothing)
    return found.unionByName(lost)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl of pages (page_id, url, html), four a page: its response at second 10 * page_id with both validators; an hour later a revisit, which shows by
    page_id mod 4 the ETag, the Last-Modified date, neither, or another ETag; a revisit five seconds before the response; and a visit of the host's front page, which changes
    with every 50th page_id: a response for every fourth page, a revisit for the others.
    """
    p, text = F.col("page_id"), lambda s: F.lit(s)
    tag = F.concat(text('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), text('"'))
    day = F.concat(text("day "), (p % 365).cast("string"))
    front = F.concat(text('"front-'), F.floor(p / 50).cast("string"), text('"'))
    heads = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)])
    again = F.when(p % 4 == 0, heads(ETag=F.concat(text("W/"), tag), Content_Length=text("0"), Cache_Control=text("max-age=60"))).when(p % 4 == 1, heads(Last_Modified=day, Age=(p % 60).cast("string"))).when(p % 4 == 2, heads(Age=text("1"))).otherwise(heads(ETag=text('"other"'), Last_Modified=day))
    record = lambda k, kind, url, ts, status, headers: F.struct((4 * p + k).alias("record_id"), F.lit(kind).alias("warc_type") if isinstance(kind, str) else kind.alias("warc_type"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status") if isinstance(status, int) else status.alias("status"), headers.alias("headers"))
    home = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    answers = p % 4 == 0
    rows = F.array(
        record(0, "response", F.col("url"), 10 * p, 200, heads(Content_Type=text("text/html"), Content_Length=size, ETag=tag, Last_Modified=day, Cache_Control=text("no-cache"))),
        record(1, "revisit", F.col("url"), 10 * p + 3600, 304, again),
        record(2, "revisit", F.col("url"), 10 * p - 5, 304, heads(ETag=tag)),
        record(3, F.when(answers, "response").otherwise("revisit"), home, 10 * p + 1, F.when(answers, 200).otherwise(304), F.when(answers, heads(ETag=front, Server=text("s"), Content_Length=text("9"))).otherwise(heads(ETag=front, Date=day, Content_Length=text("0")))),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "url_key", "outcome", "response_id", text.alias("headers"))


_KEY = r"""case when regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://') then
  regexp_replace(regexp_replace(lower(regexp_extract({0}, '://([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\.', '') || regexp_replace(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({0}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') else {0} end"""
SQL = {
    "op1_warc_revisits": rf"""
with p as (select page_id as p, {_KEY.format('url')} as url_key, {_KEY.format("regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)")} as home_key, '"' || md5(html) || '"' as tag, strlen(html) as size,
    'day ' || (page_id % 365) as day, '"front-' || (page_id // 50) || '"' as front from pages),
responses as (
  select 4 * p as id, url_key, 10 * p as ts, tag as etag, day as modified, ['cache-control: no-cache', 'content-length: ' || size, 'content-type: text/html', 'etag: ' || tag, 'last-modified: ' || day] as h from p
  union all select 4 * p + 3, home_key, 10 * p + 1, front, null, ['content-length: 9', 'etag: ' || front, 'server: s'] from p where p % 4 = 0),
revisits as (
  select 4 * p + 1 as id, url_key, 10 * p + 3600 as ts, case p % 4 when 0 then tag when 3 then '"other"' end as etag, case when p % 4 in (1, 3) then day end as modified,
    case p % 4 when 0 then ['cache-control: max-age=60', 'etag: W/' || tag] when 1 then ['age: ' || (p % 60), 'last-modified: ' || day] end as h from p
  union all select 4 * p + 2, url_key, 10 * p - 5, tag, null, ['etag: ' || tag] from p
  union all select 4 * p + 3, home_key, 10 * p + 1, front, null, ['date: ' || day, 'etag: ' || front] from p where p % 4 <> 0),
latest as (select v.id, any_value(v.url_key) as url_key, any_value(v.etag) as etag, any_value(v.modified) as modified, any_value(v.h) as h, max({{'ts': r.ts, 'id': r.id}}) as top
  from revisits v left join responses r on r.url_key = v.url_key and r.ts < v.ts group by v.id),
judged as (select l.*, r.id as response, r.h as stored, case when r.id is null then 'no_response' when l.etag is null and l.modified is null then 'no_validator'
  when case when l.etag is not null then r.etag is not distinct from l.etag else r.modified is not distinct from l.modified end then 'resolved' else 'mismatch' end as outcome
  from latest l left join responses r on r.id = l.top.id)
select id as record_id, url_key, outcome, case when outcome = 'resolved' then response end as response_id,
  case when outcome = 'resolved' then array_to_string(list_sort(list_concat(h, list_filter(stored, lambda x: len(list_filter(h, lambda y: string_split(y, ': ')[1] = string_split(x, ': ')[1])) = 0))), chr(10)) end as headers
from judged
"""
}
