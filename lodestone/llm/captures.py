"""Pages as WARC records: what the revisit query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.warc import resolve_revisits


def captures(pages: DataFrame) -> DataFrame:
    """Each page as a full response and as a revisit one day later, with validators that hold, fail or lack.

    Pages stand a minute apart by their ids, so pages of one canonical URL are candidates for
    each other's revisits. By the id's last digit the revisit has a stale ETag (0), only
    Last-Modified (1), only a digest (2), no validator (3), or the right ETag.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.md5(html)
    digit = F.col("page_id") % 10
    seconds = F.lit(1_700_000_000) + F.col("page_id") * 60
    text = lambda s: F.lit(s)
    common = [text("date"), F.concat(F.lit("t"), seconds.cast("string")), text("content-length")]
    response = F.create_map(text("Content-Type"), text("text/html"), text("ETag"), digest, text("Last-Modified"), F.concat(F.lit("m"), digest), text("WARC-Payload-Digest"), F.concat(F.lit("md5:"), digest), *common, F.octet_length(html).cast("string"))
    day = [text("date"), F.concat(F.lit("t"), (seconds + 86_400).cast("string")), text("content-length"), text("0"), text("cache-control"), text("max-age=60")]
    revisit = (
        F.when(digit == 0, F.create_map(text("etag"), text("stale"), *day))
        .when(digit == 1, F.create_map(text("last-modified"), F.concat(F.lit("m"), digest), *day))
        .when(digit == 2, F.create_map(text("warc-payload-digest"), F.concat(F.lit("md5:"), digest), *day))
        .when(digit == 3, F.create_map(*day))
        .otherwise(F.create_map(text("etag"), F.concat(F.lit("W/"), digest), *day))
    )
    one = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("uri"), F.timestamp_seconds(seconds).alias("ts"), F.lit(200).alias("status"), response.alias("headers"), html.alias("payload"))
    two = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.concat(F.col("url"), F.lit("#again")).alias("uri"), F.timestamp_seconds(seconds + 86_400).alias("ts"), F.lit(304).alias("status"), revisit.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return one.unionByName(two)


def revisit_digests(pages: DataFrame) -> DataFrame:
    """What each revisit resolves to, its headers as sorted lines and its payload as a digest."""
    out = resolve_revisits(captures(pages))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "url", "response_id", "outcome", lines.alias("headers"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"))
