"""Fingerprints, freshness, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(files: DataFrame) -> DataFrame:
    """repo, sourceFingerprint: a digest of all files' paths and contents, whatever their order.

    Contents are hashed before the shuffle, which carries a path and 32 bytes a file.
    """
    each = files.select("repo", F.struct(F.col("rel").alias("rel"), F.unhex(F.sha2("content", 256)).alias("digest")).alias("f"))
    listed = each.groupBy("repo").agg(F.array_sort(F.collect_list("f")).alias("l"))
    parts = F.transform("l", lambda f: F.concat(F.encode(f["rel"], "UTF-8"), F.lit(b"\0"), f["digest"]))
    return listed.select("repo", F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(F.transform(parts, F.hex), "")), 256)).alias("sourceFingerprint"))


def statuses(stored: DataFrame, found: DataFrame) -> DataFrame:
    """repo, status from two tables of (repo, sourceFingerprint): new, removed, fresh, stale, or unknown where a fingerprint is missing."""
    a, b = stored.select("repo", F.col("sourceFingerprint").alias("was"), F.lit(1).alias("in_a")), found.select("repo", F.col("sourceFingerprint").alias("now"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "removed").when(F.col("was").isNull() | F.col("now").isNull(), "unknown").when(F.col("was") == F.col("now"), "fresh").otherwise("stale")
    return a.join(b, "repo", "full_outer").select("repo", status.alias("status"))


def all_fresh(told: DataFrame) -> DataFrame:
    return told.agg(((F.count("*") > 0) & F.coalesce(F.bool_and(F.col("status") == "fresh"), F.lit(False))).alias("fresh"))


def planned_eviction(entries: DataFrame, most: int | None = None, share: float | None = None) -> DataFrame:
    """Entries (path, mtimeMs, bytes) that go, oldest first, ties by path, until the rest fits `most` bytes or a share of the total.

    The running sum is over ranges of time: sums by range first, then within each, so that no task holds all entries.
    """
    total = entries.agg(F.sum("bytes").alias("total"), F.min("mtimeMs").alias("lo"), F.max("mtimeMs").alias("hi"), F.count("*").alias("n"))
    placed = entries.join(F.broadcast(total)).withColumn("bucket", F.floor((F.col("mtimeMs") - F.col("lo")) * F.sqrt("n") / (F.col("hi") - F.col("lo") + 1)).cast("long"))
    sums = placed.groupBy("bucket").agg(F.sum("bytes").alias("b"))
    starts = sums.select("bucket", F.coalesce(F.sum("b").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("bucket").orderBy("mtimeMs", "path").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("inside", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(starts, "bucket")
    limit = F.lit(most) if most is not None else F.col("total") * share
    return before.where(F.col("total") - F.col("start") - F.col("inside") > limit).select("path", "mtimeMs", "bytes")


def bytes_by_slug(entries: DataFrame) -> DataFrame:
    """slug, bytes, remeasure: recorded sizes summed; a missing or negative one asks for measuring again."""
    return entries.groupBy("slug").agg(F.sum("bytes").cast("long").alias("bytes"), F.bool_or(F.col("bytes").isNull() | (F.col("bytes") < 0)).alias("remeasure"))
