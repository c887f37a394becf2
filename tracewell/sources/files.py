"""Files of datasets: sizes, times and digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stat_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size_bytes, mtime_us) without reading contents."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime_us"))


_CHUNK = 1 << 20
_PIECES = 64  # of a sample, each a sixteenth of a chunk
_HASHED = "path string, size_bytes bigint, hash_value string"


def _digest(uri: str, size: int, sample: bool) -> str:
    """SHA-256 of a file's bytes, a chunk at a time; or of its size and evenly spaced pieces, its first and last bytes among them."""
    if uri.startswith("file:"):
        system, name = fs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)
    else:
        system, name = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    piece = _CHUNK >> 4
    if sample and size > _PIECES * piece:
        out = hashlib.sha256(f"{size}|".encode())
        with system.open_input_file(name) as file:
            for i in range(_PIECES):
                out.update(file.read_at(piece, (size - piece) * i // (_PIECES - 1)))
        return out.hexdigest()
    out = hashlib.sha256(f"{size}|".encode() if sample else b"")
    with system.open_input_stream(name) as file:
        while part := file.read(_CHUNK):
            out.update(part)
    return out.hexdigest()


def _streamed(files: DataFrame, sample: bool) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_digest(uri, size, sample) for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string())], names=["path", "size_bytes", "hash_value"])

    return files.select("path", F.col("length").alias("size_bytes")).mapInArrow(task, _HASHED)


def hash_files(spark: SparkSession, path: str, glob: str = "*", limit_bytes: int | None = None, stream_bytes: int = 500_000_000) -> DataFrame:
    """(path, size_bytes, hash_value, hash_strategy, warning): SHA-256 of the whole file, whatever its size; over stream_bytes it is read in chunks.

    Only if limit_bytes is given, files over it are hashed by their size and evenly spaced pieces, all of the content up to 4 MB. They are
    marked schema_sample, with a warning: no schema or feature count is read, and edits between the pieces aren't seen. Times never count.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    whole = df if limit_bytes is None else df.where(F.col("length") <= limit_bytes)
    small = whole.where(F.col("length") <= stream_bytes).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("hash_value"))
    out = small.unionAll(_streamed(whole.where(F.col("length") > stream_bytes), False)).withColumns({"hash_strategy": F.lit("file"), "warning": F.lit(None).cast("string")})
    if limit_bytes is not None:
        sampled = _streamed(df.where(F.col("length") > limit_bytes), True)
        out = out.unionAll(sampled.withColumns({"hash_strategy": F.lit("schema_sample"), "warning": F.lit(f"over {limit_bytes} bytes: size and content samples only")}))
    return out.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
