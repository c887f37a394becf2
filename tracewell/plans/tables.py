"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where none is set and the driver does all the work, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[str] = []


def stored_so_far() -> int:
    """How many tables there are that drop_stored() would delete: a mark for its `since`."""
    return len(_written)


def drop_stored(spark: SparkSession, since: int = 0, last: bool = True) -> int:
    """Delete the tables that this process stored, once no result that reads them is needed any more; returns how many there were.

    since: a mark of stored_so_far(), for the tables stored after it. last=False: all but the newest table.
    """
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    gone = _written[since : len(_written) if last else -1]
    del _written[since : since + len(gone)]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


#: Bytes of what a step reads for each file that it writes. With fewer than twice as many files as the session has cores, cores would idle.
BYTES_A_FILE = 1 << 23
#: The same for steps that pass texts through row by row, whose tasks hold no more however much they read.
BYTES_A_LONG_FILE = 1 << 25
#: Under this a further file costs more than a further core saves: on a local path it starts three processes.
BYTES_A_SHORT_FILE = 1 << 16


def _files(df: DataFrame, a_file: int = BYTES_A_FILE) -> int:
    """Files that df is written to at most: small tables in hundreds of them cost more to write, commit and list than to compute."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    enough = min(2 * df.sparkSession.sparkContext.defaultParallelism, 1 + read // BYTES_A_SHORT_FILE)
    return max(enough, min(read // a_file, (1 << 31) - 1))


def in_few_files(df: DataFrame, a_file: int = BYTES_A_FILE) -> DataFrame:
    """df, in no more partitions than it needs files. Tasks take several of its partitions, one after the other, if those are many for the bytes that it comes from."""
    return df.coalesce(_files(df, a_file))


def stored(df: DataFrame, name: str, a_file: int = BYTES_A_FILE) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    It is written in few files: see in_few_files().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    in_few_files(df, a_file).write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
