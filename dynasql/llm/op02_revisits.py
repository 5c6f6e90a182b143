"""Not-modified revisits of a web archive, resolved to full responses (operator 2).

A revisit record says that a page had not changed. It is joined as of its time,
by canonical URL, to the latest earlier full response; it resolves only if their
validators agree (entity tag, else last-modified time, else payload digest), and
then yields the stored headers with those of the revisit that a not-modified
answer may change.

The as-of join sorts records by (URL, time) into ranges instead of grouping by
URL, so a URL with a third of all records is many ranges. Each range finds its
own latest response by a window, and what an earlier range of the same URL ends
with is carried over from a table with one row for each range and URL. Only
metadata is sorted; payloads are joined by record id where they are wanted.

Defined results: at equal times a full response comes before a revisit, then by
record id; a null or empty URL resolves to nothing (reason no_url), as does a
revisit without an earlier response (no_response), with none of the validators
on both sides (no_validator) or with different ones (changed); a null time is
before all others; repeated records each get a row. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut

#: Query parameters that do not name content; headers that a
#: not-modified answer may change (RFC 9110, 15.4.5, and RFC 9111, 3.2).
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
COLUMNS = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")


def canonical(url: Column) -> Column:
    """URL without scheme, www, default port, fragment, tracking parameters and last slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z]+://)?([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z]+://)?[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(asked), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def lowered(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only, the first in byte order."""
    held = F.array_sort(F.map_entries(headers))
    entries = F.transform(held, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(held, lambda e: F.lower(e["key"]))
    once = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each revisit of records (COLUMNS; kind is response or revisit) with what it resolves to.

    Columns: record_id, canonical_url, response_id (null if unresolved), reason
    and headers (merged, by name).
    """
    spark = records.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select(*COLUMNS).withColumn("canonical_url", canonical(F.col("url"))).withColumn("late", (F.col("kind") != "response").cast("int"))
    order = ["ts", "late", "record_id"]
    whole = rows.filter("canonical_url is not null").repartitionByRange(n, "canonical_url", *order).withColumn("part", F.spark_partition_id())
    whole = cut(whole)
    full = F.when(F.col("late") == 0, F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    here = Window.partitionBy("canonical_url", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = whole.withColumn("found", F.last(full, ignorenulls=True).over(here)).filter("late = 1")
    ends = whole.filter("late = 0").groupBy("canonical_url", "part").agg(F.max_by(full, F.struct(*order)).alias("end"))
    spans = whole.select("canonical_url", "part").distinct().join(ends, ["canonical_url", "part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("carried is not null").select("canonical_url", "part", "carried")
    met = seen.join(carried, ["canonical_url", "part"], "left").withColumn("r", F.coalesce("found", "carried"))
    same = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), F.col("etag") == F.col("r.etag"))
    same = same.when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), F.col("last_modified") == F.col("r.last_modified"))
    same = same.when(F.col("digest").isNotNull() & F.col("r.digest").isNotNull(), F.col("digest") == F.col("r.digest"))
    reason = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("changed")
    own = F.map_filter(lowered(F.col("headers")), lambda k, v: k.isin(*PERMITTED))
    stored = lowered(F.col("r.headers"))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    out = met.withColumn("reason", reason).select("record_id", "canonical_url", F.when(F.col("reason") == "resolved", F.col("r.record_id")).alias("response_id"), "reason", F.when(F.col("reason") == "resolved", merged).alias("headers"))
    nowhere = rows.filter("canonical_url is null and late = 1").select("record_id", "canonical_url", F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"), F.lit("no_url").alias("reason"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.unionByName(nowhere)


def captures(pages: DataFrame) -> DataFrame:
    """A full response and a later revisit of every page, by rule from its id and html.

    Response 2p comes at hour p mod 97, revisit 2p + 1 at hour 40 + p mod 61.
    Revisits of every fifth page hold another entity tag; of every seventh, none;
    of every eleventh, no validator at all.
    """
    p, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    tag = F.substring(digest, 1, 16)
    none = F.lit(None).cast("string")
    full = F.struct((2 * p).alias("record_id"), "url", (p % 97).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), none.alias("last_modified"), digest.alias("digest"),
                    F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Age"), F.lit("0")).alias("headers"))
    own = F.when((p % 7 == 0) | (p % 11 == 0), none).when(p % 5 == 0, F.lit("other")).otherwise(tag)
    again = F.struct((2 * p + 1).alias("record_id"), "url", (40 + p % 61).alias("ts"), F.lit("revisit").alias("kind"), own.alias("etag"), none.alias("last_modified"), F.when(p % 11 != 0, digest).alias("digest"),
                     F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("Age"), p.cast("string")).alias("headers"))
    return pages.select(F.explode(F.array(full, again)).alias("r")).select("r.*")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    flat = F.array_join(F.sort_array(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "response_id", "reason", flat.alias("headers"))
