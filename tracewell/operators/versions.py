"""Content versions of datasets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, a, id, writing, size, mtime, v0, s0, m0), sorted by p, a -> (id, version, fresh). The state is one version and its probe."""
    path, version, size, mtime = None, 0, None, None
    for batch in batches:
        versions, fresh = [], []
        for p, writing, s, m, v0, s0, m0 in zip(*(batch.column(c).to_pylist() for c in ("p", "writing", "size", "mtime", "v0", "s0", "m0"))):
            if p != path:
                path, version, size, mtime = p, v0, s0, m0
            both = None not in (s, m, size, mtime)
            bump = version == 0 or ((s, m) != (size, mtime) if both else writing)
            if bump:  # the probe on record is that of the latest version, not of the latest look
                version, size, mtime = version + 1, s, m
            versions.append(version)
            fresh.append(bool(bump))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(versions, pa.int32()), pa.array(fresh, pa.bool_())], names=["id", "version", "fresh"])


def latest_versions(entities: DataFrame) -> DataFrame:
    """(path, version, size_bytes, mtime_us): the latest version of each path on record, with the probe that came with it."""
    fact = lambda name: F.get_json_object("metadata", f"$.{name}").cast("bigint").alias(name)
    named = entities.where(F.coalesce("file_path", F.lit("")) != "")
    last = named.groupBy(F.col("file_path").alias("path")).agg(F.max_by(F.struct("content_version", fact("size_bytes"), fact("mtime_us")), "content_version").alias("x"))
    return last.select("path", F.col("x.content_version").cast("int").alias("version"), "x.size_bytes", "x.mtime_us")


def assign_versions(df: DataFrame, *, path: str, arrival: str, ident: str, writing: str, size: str, mtime: str, known: DataFrame | None = None) -> DataFrame:
    """(id, version int, fresh boolean) of each reference to a dataset, in arrival order within its path.

    Without a path every reference is a dataset of its own, version 1. A first reference is version 1. If the file was probed now and then,
    the version moves when the probes differ; otherwise writing moves it and reading doesn't. known: latest_versions() of what is on
    record, from which its paths go on. References are sorted by path and arrival and passed over once, so memory doesn't depend on how many a path has.
    """
    slim = df.select(F.col(path).alias("p"), F.col(arrival).alias("a"), F.col(ident).alias("id"), F.col(writing).alias("writing"), F.col(size).cast("bigint").alias("size"), F.col(mtime).cast("bigint").alias("mtime"))
    named = slim.where(F.col("p").isNotNull() & (F.col("p") != ""))
    if known is None:
        rows = named.withColumns({"v0": F.lit(0), "s0": F.lit(None).cast("bigint"), "m0": F.lit(None).cast("bigint")})
    else:
        last = known.select(F.col("path").alias("p"), F.col("version").alias("v0"), F.col("size_bytes").alias("s0"), F.col("mtime_us").alias("m0"))
        rows = named.join(last, "p", "left").withColumn("v0", F.coalesce("v0", F.lit(0)))
    ordered = rows.select("p", "a", "id", "writing", "size", "mtime", "v0", "s0", "m0").repartition("p").sortWithinPartitions("p", "a")
    out = ordered.mapInArrow(_versions, f"id {slim.schema['id'].dataType.simpleString()}, version int, fresh boolean")
    alone = slim.where(F.col("p").isNull() | (F.col("p") == "")).select("id", F.lit(1).alias("version"), F.lit(True).alias("fresh"))
    return out.unionAll(alone)


def next_version(paths: DataFrame, versions: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """(path, next_version): one more than the highest on record, 1 where there is none."""
    top = versions.groupBy(F.col(path).alias("__p")).agg(F.max(version).alias("__v"))
    out = paths.select(path).distinct().join(top, F.col(path) == F.col("__p"), "left")
    return out.select(path, (F.coalesce("__v", F.lit(0)) + 1).cast("bigint").alias("next_version"))
