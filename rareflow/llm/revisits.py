"""Not-modified revisits of a crawl resolved to the full response that they stand for.

A revisit record says that a page had not changed (status 304) and has no body. It belongs to the latest earlier full
response of the same canonical URL, if that has the same validators; its headers are then those of the response, renewed by
the few that a 304 may renew. The as-of join deals records into ranges of (URL, time), so a much visited URL is split by
time; the last response of each range is carried into the next ones of its URL, and within a range a running aggregate
finds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rareflow.llm.common import kept

# Header fields that a 304 response may renew, and query parameters that don't choose a page.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)(?:\?([^#]*))?"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` or ``m.``, path without a closing slash or ``.html``, sorted query without tracking
    parameters; no scheme, user, port or fragment. A null URL stays null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), r"(/index)?(\.html?)?/*$", "")
    query = F.array_join(F.sort_array(F.filter(F.split(F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Headers with their names in lower case. Of several spellings of a name the last in byte order counts, which is the
    lower-case one if it is there."""
    entries = F.map_entries(headers)
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (F.lower(o["key"]) == F.lower(e["key"])) & (o["key"] > e["key"])))
    renamed = F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.when(F.exists(F.map_keys(headers), lambda k: k != F.lower(k)), renamed).otherwise(headers)


def _field(headers: str, name: str) -> Column:
    return F.when(F.length(F.col(headers)[name]) > 0, F.col(headers)[name])


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", status_col: str = "status",
            headers_col: str = "headers") -> DataFrame:
    """A row for each record with status 304: record_id, url_key, ts, state, matched_id, matched_ts, headers.

    Full responses are records with status 200. ``state`` is ``resolved``, ``validator_mismatch`` (the latest earlier response has
    other validators), ``no_earlier_response``, or ``no_url`` (null URL or time). An entity tag decides, by weak
    comparison; without one, the modification date does; a revisit with neither matches a response with neither. Of responses
    at the same time the one with the largest id counts; a response at the revisit's own time is not earlier. Header names may
    be in any case and come out in lower case; null headers count as none; an unresolved revisit keeps its own. Repeated records are resolved each;
    other columns are not read, and an empty table gives no rows.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.where(records[status_col].isin(200, 304)).select(
        records[id_col].cast("long").alias("record_id"), canonical(records[url_col].cast("string")).alias("url_key"), records[time_col].cast("long").alias("ts"),
        (records[status_col] == 304).alias("revisit"), F.coalesce(lower_names(records[headers_col].cast("map<string,string>")), none).alias("headers"))
    located = rows.where("url_key is not null and ts is not null").repartitionByRange("url_key", "ts")
    located = kept(located.withColumn("part", F.spark_partition_id()), "crawl")
    full = F.when(~F.col("revisit"), F.struct("record_id", "ts", "headers"))
    newest = F.when(~F.col("revisit"), F.struct("ts", "record_id"))
    ends = located.groupBy("url_key", "part").agg(F.max_by(full, newest).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range that the URL is in
    ends = ends.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).drop("end")
    before = Window.partitionBy("url_key", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = located.withColumn("own", F.max_by(full, newest).over(before)).where("revisit").join(ends, ["url_key", "part"])
    found = found.withColumn("match", F.coalesce("own", "carried")).withColumns({"theirs": F.coalesce(F.col("match.headers"), none)})
    tag, their_tag = _weak(_field("headers", "etag")), _weak(_field("theirs", "etag"))
    date, their_date = _field("headers", "last-modified"), _field("theirs", "last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(tag == their_tag, F.lit(False))).when(date.isNotNull(), F.coalesce(date == their_date, F.lit(False))).otherwise(
        their_tag.isNull() & their_date.isNull())
    state = F.when(F.col("match").isNull(), "no_earlier_response").when(same, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("state", state).withColumn("renewed", F.map_filter("headers", lambda k, v: k.isin(PERMITTED)))
    merged = F.map_concat(F.map_filter("theirs", lambda k, v: ~F.array_contains(F.map_keys("renewed"), k)), F.col("renewed"))
    resolved = F.col("state") == "resolved"
    out = found.select("record_id", "url_key", "ts", "state", F.when(resolved, F.col("match.record_id")).alias("matched_id"),
                       F.when(resolved, F.col("match.ts")).alias("matched_ts"), F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"))
    lost = rows.where("revisit and (url_key is null or ts is null)").select(
        "record_id", "url_key", "ts", F.lit("no_url").alias("state"), F.lit(None).cast("long").alias("matched_id"), F.lit(None).cast("long").alias("matched_ts"), "headers")
    return out.unionByName(lost)
