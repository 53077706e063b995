"""Results of versions kept by content: what was worked out for the same files before is read, the rest is worked out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import cut

VERSION = ("pub_id", "version")
#: What the cache adds to each row: the hash of its version's content, and the run that made it.
HASH, RUN = "cache_content", "cache_run"


def content_hashes(sources: DataFrame, settings: str = "") -> DataFrame:
    """(pub_id, version, cache_content): SHA-256 of a version's files, names and texts in the order of names, and of the settings."""
    one = sources.select(*VERSION, F.struct("file_name", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")).alias("f"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: F.concat(f["file_name"], F.lit("\n"), f["hash"])), "\n")
    return one.groupBy(*VERSION).agg(F.sha2(F.concat(F.lit(settings + "\n"), joined), 256).alias(HASH))


def exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))


def through_cache(sources: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
    """`work(sources)`, of which only versions that `path` has not yet, with the same files and settings, are worked out.

    `work` takes rows of sources and returns rows with pub_id and version. New results are appended with the hash of their
    content, in one commit; a version without any row is worked out each time. Of a version that changed the old rows stay
    but are not read. Two runs at once may append the same version twice, of which one is read.
    """
    spark = sources.sparkSession
    now = cut(content_hashes(sources, settings))
    if exists(spark, path):
        known = spark.read.parquet(path).select(*VERSION, HASH).distinct()
        fresh = now.join(known, [*VERSION, HASH], "left_anti")
    else:
        fresh = now
    fresh = cut(fresh)
    if not fresh.isEmpty():
        found = work(sources.join(fresh.select(*VERSION), list(VERSION), "left_semi")).join(fresh, list(VERSION))
        found.withColumn(RUN, F.lit(uuid.uuid4().hex)).write.mode("append").parquet(path)
    if not exists(spark, path):
        return work(sources.limit(0))
    kept = spark.read.parquet(path).join(now, [*VERSION, HASH], "left_semi")
    first = kept.groupBy(*VERSION, HASH).agg(F.min(RUN).alias(RUN))
    return kept.join(first, [*VERSION, HASH, RUN], "left_semi").drop(HASH, RUN)

