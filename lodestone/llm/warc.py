"""WARC: not-modified revisits resolved against earlier full responses.

A revisit ("not modified") is joined as of its time with the latest earlier response
of the same canonical URL. Of records at the same time the one with the lower id is
earlier. The revisit is resolved if a validator that both carry agrees (the entity
tag first, weak or strong; else the date of modification; else the payload digest).
Its headers are the response's, with those that a 304 may update taken from the
revisit.

The join doesn't gather a URL's records: time is cut into slices at quantiles of all
records, each slice of a URL is a group of its own, and what a slice hands on to the
next ones is its last response alone, at most `slices` rows for a URL.

Defined results: a revisit with no earlier response, or with a null URL or time, has
status no_response. Without a validator in common, or with one that differs, the status is
mismatch. Repeated records are judged one by one. Null headers count as none. Tables
without rows give none. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import number_array
from .common import fresh

#: Header fields that a not-modified answer may replace.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merge_headers(stored: Column, newer: Column) -> Column:
    """The stored header fields, with permitted ones of the newer answer put in; names in lower case."""
    none = F.create_map().cast("map<string,string>")

    def lower(m: Column) -> Column:
        pairs = F.map_entries(F.coalesce(m, none))
        named = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        first = F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda o: o["key"] == e["key"]))
        return F.map_from_entries(first)

    old, new = lower(stored), F.map_filter(lower(newer), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """Every revisit of `records` with what it stands for.

    Unless told, `slices` are one for each million of records, 256 at least and 4096 at most.

    `records` has record_id, url (canonical), at (orderable number), kind ('response' or
    'revisit'), etag, last_modified, digest and headers (map of strings). Added: status
    ('resolved', 'mismatch', 'no_response'), response_id and merged_headers.
    """
    if slices is None:
        slices = max(256, min(4096, records.count() // 1_000_000))
    quantiles = F.percentile_approx("at", [i / slices for i in range(1, slices)], 10_000)
    cuts = number_array(sorted(set(records.select(quantiles.alias("c")).first()["c"] or [])))
    slice_, order = fresh(records, "_slice"), fresh(records, "_order")
    last, before = fresh(records, "_last"), fresh(records, "_before")
    judged = records.withColumn(slice_, F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("at"))), F.lit(0)))
    judged = judged.withColumn(order, F.struct("at", "record_id"))
    usable = F.col("url").isNotNull() & F.col("at").isNotNull()
    full = usable & (F.col("kind") == "response")
    one = F.struct(*(F.col(c) for c in ("at", "record_id", "etag", "last_modified", "digest", "headers")))
    per_slice = judged.where(full).groupBy("url", slice_).agg(F.max_by(one, order).alias("_own"))
    # each slice that has a revisit asks for what came before it
    asked = judged.where(usable & (F.col("kind") == "revisit")).select("url", slice_).distinct()
    both = per_slice.join(asked, ["url", slice_], "full")
    carried = both.select("url", slice_, F.last("_own", ignorenulls=True).over(Window.partitionBy("url").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    within = Window.partitionBy("url", slice_, F.when(~usable, F.col(order))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = judged.withColumn(last, F.last(F.when(full, one), ignorenulls=True).over(within))
    revisits = seen.where(F.col("kind") == "revisit").join(carried, ["url", slice_], "left")
    found = F.coalesce(F.when(usable, F.col(last)), F.col(before))
    revisits = revisits.withColumn(last, found).drop(before, slice_, order)
    response = F.col(last)
    tags = (F.col("etag").isNotNull() & response["etag"].isNotNull(), _strong(F.col("etag")) == _strong(response["etag"]))
    dates = (F.col("last_modified").isNotNull() & response["last_modified"].isNotNull(), F.col("last_modified") == response["last_modified"])
    digests = (F.col("digest").isNotNull() & response["digest"].isNotNull(), F.col("digest") == response["digest"])
    agrees = F.when(tags[0], tags[1]).when(dates[0], dates[1]).when(digests[0], digests[1]).otherwise(F.lit(False))
    status = F.when(response.isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch")
    resolved = status == "resolved"
    columns = [c for c in records.columns]
    return revisits.select(
        *columns, status.alias(fresh(records, "status")),
        F.when(resolved, response["record_id"]).alias(fresh(records, "response_id")),
        F.when(resolved, merge_headers(response["headers"], F.col("headers"))).alias(fresh(records, "merged_headers")),
    )
