"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit (status 304) says that a page is as it was; it is resolved by the latest full response of the same canonical
URL that is not later, if a validator agrees: the entity tag where the revisit has one, else its Last-Modified date. Of
the revisit's headers only those that such an answer may update replace the response's.

The join never gathers a URL: records are dealt to ranges of (URL, time), which Spark cuts by a sample into parts of about
equal size, so a URL of many records is cut by time. The latest response is carried along inside a URL's part, and one
row for each URL and part carries it over to later parts.

Edge cases: a record without a time is neither resolved (``no_time``) nor a response to others; a null URL is the
canonical URL ``''``, never resolved (``no_url``); entity tags are compared weakly, without a leading ``W/``, as for any such
request; of records at one time responses come first, then smaller ids; repeated rows are resolved each; null header maps are
empty; an empty table gives no rows; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Headers of a not-modified answer that replace the stored ones.
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, path without its last slash, query if not empty; scheme and fragment dropped."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*(\?.+)$", 1)
    return F.concat(host, path, query)


def _weak(tag: Column) -> Column:
    """What two entity tags must share to agree weakly."""
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """For each revisit of records (record_id, url, time, kind: response or revisit, etag, last_modified, digest, headers):
    record_id, canonical, time, status (resolved, mismatch, no_validator, no_response, no_url, no_time), response_id, digest, headers."""
    revisit = F.col("kind") == "revisit"
    stored = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    known = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "time", revisit.alias("revisit"), "etag", "last_modified", "digest",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )
    known = known.where(F.col("revisit") | F.col("time").isNotNull() & (F.col("canonical") != "")).withColumn("row", F.monotonically_increasing_id())
    known = materialize(
        known.repartitionByRange("canonical", "time", "revisit", "record_id", "row").withColumn("slice", F.spark_partition_id()), "records",
    )
    # A URL without a name and a record without a time have no partner: any slice will do, so they are dealt by their numbers.
    alone = (F.col("canonical") == "") | F.col("time").isNull()
    known = known.withColumn("slice", F.when(alone, -1 - F.pmod(F.xxhash64("row"), F.lit(1 << 20))).otherwise(F.col("slice")).cast("int"))
    order = ["time", "revisit", "record_id", "row"]
    answer = F.when(~F.col("revisit"), stored)
    inside = Window.partitionBy("canonical", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = known.withColumn("near", F.last(answer, ignorenulls=True).over(inside))
    ends = known.groupBy("canonical", "slice").agg(F.max_by(answer, F.when(~F.col("revisit"), F.struct("time", "record_id", "row"))).alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.where("slice >= 0").withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("canonical", "slice", "carried")
    joined = near.where("revisit").join(carried, ["canonical", "slice"], "left").withColumn("r", F.coalesce("near", "carried"))
    same = F.when(F.col("etag").isNotNull(), _weak(F.col("etag")).eqNullSafe(_weak(F.col("r.etag")))).when(
        F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("r.last_modified")),
    )
    status = (F.when(F.col("time").isNull(), "no_time").when(F.col("canonical") == "", "no_url").when(F.col("r").isNull(), "no_response")
              .when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch"))
    updates = F.map_filter("headers", lambda k, v: F.lower(k).isin(UPDATABLE))
    merged = F.map_concat(
        F.map_filter(F.col("r.headers"), lambda k, v: ~F.array_contains(F.transform(F.map_keys(updates), F.lower), F.lower(k))), updates,
    )
    found = joined.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return found.select(
        "record_id", "canonical", "time", "status", F.when(resolved, F.col("r.record_id")).alias("response_id"),
        F.when(resolved, F.col("r.digest")).alias("digest"), F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records derived from pages (page_id, url, html): of each page a full response and three revisits.

    A page's revisits come after its response (entity tag kept, but changed for each fourth page), later still (only a
    date, or for each third page no validator), and, for each fifth page, just before it.
    """
    page = F.col("page_id")
    tag, date = F.md5(F.coalesce(F.col("html"), F.lit(""))), F.concat(F.lit("day-"), (page % 365).cast("string"))
    none = F.lit(None).cast("string")

    def record(k: int, offset: int, kind: str, etag: Column, modified: Column, headers: list[Column]) -> Column:
        return F.struct(
            (page * 4 + k).alias("record_id"), (page * 10 + offset).alias("time"), F.lit(kind).alias("kind"), etag.alias("etag"),
            modified.alias("last_modified"), F.when(F.lit(kind == "response"), tag).alias("digest"), F.create_map(*headers).alias("headers"),
        )

    h = lambda *pairs: [x if isinstance(x, Column) else F.lit(x) for x in pairs]
    full = record(
        0, 0, "response", tag, date,
        h(
            "cache-control", "max-age=60", "content-length", F.length(F.coalesce("html", F.lit(""))).cast("string"), "content-type", "text/html",
            "etag", tag, "last-modified", date,
        ),
    )
    after = record(
        1, 3, "revisit", F.when(page % 4 == 0, F.lit("changed")).otherwise(tag), none, h("cache-control", "max-age=600", "content-length", "0"),
    )
    later = record(
        2, 5, "revisit", none, F.when(page % 3 != 0, date), h("date", F.concat(F.lit("day-"), ((page + 1) % 365).cast("string")), "server", "cache"),
    )
    early = record(3, -1, "revisit", tag, none, h("vary", "accept"))
    all_of = F.array(full, after, later, F.when(page % 5 == 0, early))
    return pages.select("url", F.explode(all_of).alias("r")).where("r is not null").select("url", "r.*")
