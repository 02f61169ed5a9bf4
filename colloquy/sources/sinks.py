"""Sinks, nested-column encoding, schema alignment and the media manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..schemas import ALIGN_DEFAULTS


def encode_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nested columns as JSON text; null becomes an empty list."""
    return df.withColumns({c: F.coalesce(F.to_json(c), F.lit("[]")) for c in columns})


def decode_json(df: DataFrame, schemas: Mapping[str, str]) -> DataFrame:
    """JSON text as typed arrays; null, blank or malformed text becomes an empty array."""
    return df.withColumns({
        c: F.coalesce(F.from_json(c, ddl), F.array().cast(ddl)) for c, ddl in schemas.items()})


def align_schema(df: DataFrame, schema: str, defaults: Mapping[str, object] = ALIGN_DEFAULTS) -> DataFrame:
    """Columns of ``schema`` in order; a column the data lacks gets its default or null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in T.StructType.fromDDL(schema).fields])


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def media_manifest(spark: SparkSession, path: str, allowed: Sequence[str] = tuple(V.MEDIA_EXTENSIONS)) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files below ``path``.  File contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", "modificationTime").withColumn("extension", extension_of(F.col("path"))))
    ok = F.col("extension").isin(*allowed)
    accepted = files.filter(ok).withColumn("is_video", F.col("extension").isin(*V.VIDEO_EXTENSIONS))
    rejected = files.filter(~ok).withColumn(
        "reason", F.concat(F.lit("unsupported extension: "), F.col("extension")))
    return accepted, rejected


def write_context(tables: Mapping[str, DataFrame], path: str, buckets: int = 64, recomputed: DataFrame | None = None) -> None:
    """Store context tables, replacing only the meetings that were recomputed.

    ``recomputed`` (meeting_id) names these meetings; without it they are the meetings
    with a row in any of the tables.  Their old rows go from every table, also where no
    new row takes their place.  Rows live in ``buckets`` directories by a hash of the
    meeting.  A run reads the buckets it touches, drops the recomputed meetings from them
    and overwrites just those buckets, so repeating a run gives the same files' contents.
    The rebalance hint lets one large bucket be written by many tasks.
    """
    if recomputed is None:
        recomputed = reduce(DataFrame.union, [t.select("meeting_id") for t in tables.values()])
    bucket = F.pmod(F.xxhash64("meeting_id"), F.lit(buckets)).cast("int")
    ids = recomputed.select("meeting_id").distinct()
    touched = {r[0] for r in ids.select(bucket).distinct().collect()}  # at most ``buckets``
    for name, fresh in tables.items():
        spark = fresh.sparkSession
        target = f"{path}/{name}"
        out = fresh.withColumn("bucket", bucket)
        stored = _exists(spark, target)
        if stored:
            kept = spark.read.schema(out.schema).parquet(target).where(F.col("bucket").isin(*touched)).join(ids, "meeting_id", "left_anti")
            out = out.unionByName(kept)
        (out.hint("rebalance", "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target))
        if stored:  # a bucket without any row left is not written, so its old files go by themselves
            left = {r[0] for r in spark.read.schema(fresh.withColumn("bucket", bucket).schema).parquet(target)
                    .join(ids, "meeting_id", "left_anti").unionByName(fresh.withColumn("bucket", bucket)).select("bucket").distinct().collect()}
            for number in touched - left:
                _delete(spark, f"{target}/bucket={number}")


def _delete(spark: SparkSession, target: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(target)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def _exists(spark: SparkSession, target: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(target)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def write_minutes_text(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """One directory of text per document.

    ``lines``: doc_stem, line, the columns that order the lines and, where several
    meetings may share a title, meeting_id, which then ends the name.  Range partitioning
    keeps file order equal to line order even when one document is split over several
    tasks.
    """
    if "meeting_id" in lines.columns:
        key = F.regexp_replace(F.col("meeting_id").cast("string"), "[^A-Za-z0-9._-]", "_")
        lines = lines.withColumn("doc_stem", F.concat_ws("-", "doc_stem", key))
    (lines.repartitionByRange("doc_stem", *order).sortWithinPartitions("doc_stem", *order)
     .select("doc_stem", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("doc_stem").text(path))
