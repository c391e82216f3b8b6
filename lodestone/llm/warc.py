"""WARC: revisit records that a server answered with "not modified", resolved to the full response before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import scan
from lodestone.session import durable

#: The header fields that a 304 answer may update (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query of a URL; null without a host.

    Left out: scheme, fragment, ``www.``, the ports 80 and 443, slashes at the path's end and
    ``utm_`` parameters. Hosts are lower case.
    """
    part = lambda i: F.regexp_extract(F.trim(url), PARTS, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)$", ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.array_join(kept, "&")
    whole = F.concat(host, F.regexp_replace(part(2), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", whole)


def plain_headers(headers: Column) -> Column:
    """Names in lower case; of names that differ in case alone the first stays; null: none."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]), e["value"])))


def latest_before(events: DataFrame) -> DataFrame:
    """As-of join inside one table: for each revisit the last full response before it.

    ``events``: at (long, unique), id, url, ts (long, microseconds), full (boolean). All rows are
    put in the order of URL and time by one range shuffle, and the latest response so far is a
    running maximum in blocks of positions; what a block leaves behind is one row. So a URL, or
    an hour of it, with a third of all rows is many tasks. A response at the same instant isn't
    earlier; of responses at one instant the largest id counts, then the last row. Rows without
    URL or time find nothing. Gives (at, response): the ``at`` of the response, or null.
    """
    order = ["url", "ts", "full", "id", "at"]  # at one instant revisits stand before responses
    placed = events.where("url is not null and ts is not null").select(*order)
    held = placed.withColumn("__last", F.when(F.col("full"), F.struct("url", "ts", "id", "at")))
    seen = scan(held, "__last", order, how="max", out="__seen").where("not full")
    return seen.select("at", F.when(F.col("__seen.url") == F.col("url"), F.col("__seen.at")).alias("response"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url, response_id, outcome, headers, payload.

    ``records``: record_id, warc_type, uri, ts (timestamp), status, headers (map), payload; of
    other columns only refers_to_uri is read, where there is one: the revisit's target. A full
    response is a ``response`` of status 200. The latest earlier one under the same canonical URL
    must agree with the revisit's first validator: ETag (W/ aside), else Last-Modified, else
    WARC-Payload-Digest. ``outcome``: ``resolved``, ``validator_mismatch``, ``no_validator`` or
    ``no_response``. Only a resolved revisit has payload and headers: the response's, updated by
    the permitted fields of the revisit. Null headers are none, null ids ids like any other;
    records that repeat, or share an id, are rows of their own, each with the answer for its URL
    and time. Bodies of any length are moved whole. Without revisits the result is empty.
    """
    target = F.coalesce(F.col("refers_to_uri"), F.col("uri")) if "refers_to_uri" in records.columns else F.col("uri")
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200), F.lit(False))
    revisit = F.coalesce(F.col("warc_type") == "revisit", F.lit(False))
    base = records.where(full | revisit).select("record_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "headers", "payload", canonical_url(target).alias("url"), full.alias("full"))
    # written once: rows are known by their places, and the joins below have shuffles of their own
    stored = durable(base.withColumn("at", F.monotonically_increasing_id()), "records")
    found = durable(latest_before(stored.select("at", F.col("record_id").alias("id"), "url", "ts", "full")), "found")
    asked = stored.where("not full").select("at", "record_id", "url", "headers").join(found, "at", "left")
    asked = durable(asked.select("record_id", "url", "response", plain_headers(F.col("headers")).alias("new")), "asked")
    answers = stored.where("full").select(F.col("at").alias("response"), F.col("record_id").alias("response_id"), plain_headers(F.col("headers")).alias("old"), "payload")
    both = asked.join(answers, "response", "left")
    tag = lambda m: F.regexp_replace(F.try_element_at(m, F.lit("etag")), "^W/", "")
    field = lambda m, k: F.try_element_at(m, F.lit(k))
    new, old = F.col("new"), F.col("old")
    agrees = F.coalesce(
        F.when(tag(new).isNotNull(), tag(new) == tag(old))
        .when(field(new, "last-modified").isNotNull(), field(new, "last-modified") == field(old, "last-modified"))
        .otherwise(field(new, "warc-payload-digest") == field(old, "warc-payload-digest")),
        F.lit(False),
    )
    has = F.coalesce(field(new, "etag"), field(new, "last-modified"), field(new, "warc-payload-digest")).isNotNull()
    outcome = F.when(F.col("response").isNull(), "no_response").when(~has, "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(update, k)), update)
    judged = both.withColumn("outcome", outcome)
    sure = F.col("outcome") == "resolved"
    return judged.select("record_id", "url", "response_id", "outcome", F.when(sure, merged).alias("headers"), F.when(sure, F.col("payload")).alias("payload"))
