"""What the text operators share: table access, row identity, intermediate tables and byte-level words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.tables import BYTES_A_LONG_FILE, shared_dir, stored  # noqa: F401

#: Words are maximal runs of characters other than space and U+0009..U+000D; Java and DuckDB read this class alike.
SPACE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Files up to which their numbers are broadcast: some 30 MB. Rows of more files are stored with their numbers.
MAX_FILES = 100_000
_PLACE_BITS = 40
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _is_scan(df: DataFrame) -> bool:
    """Does every row of df stand for one row of a file? Then the file and the place in it name the row."""
    plan = [df._jdf.queryExecution().analyzed()]
    for node in plan:
        kind = node.getClass().getSimpleName()
        if kind not in _PLAIN or kind == "LogicalRelation" and not node.toString().rstrip().endswith("parquet"):
            return False
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return "_metadata" not in (c.lower() for c in df.columns)


def numbered(df: DataFrame) -> DataFrame:
    """(rid bigint, doc struct of all columns of df): rows under numbers that stay the same however often and by however many tasks df is read.

    In a scan of files a row's number is that of its file, by path, and its place in it, whatever splits the files are read in. Rows that
    come from elsewhere, or from more than MAX_FILES files, are stored once together with their numbers.
    """
    doc = F.struct(*df.columns).alias("doc")
    if _is_scan(df):
        paths = df.select(F.col("_metadata.file_path").alias("path")).distinct().limit(MAX_FILES + 1).toArrow().column("path").to_pylist()
        if len(paths) <= MAX_FILES:
            place = F.col("_metadata.row_index")
            if len(paths) <= 1:
                return df.select(place.alias("rid"), doc)
            # from Arrow it has a size that plans can tell, unlike rows, which count as more than any table
            files = df.sparkSession.createDataFrame(pa.table({"path": pa.array(sorted(paths), pa.string()), "first": pa.array([i << _PLACE_BITS for i in range(len(paths))], pa.int64())}))
            rows = df.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), doc)
            return rows.join(F.broadcast(files), "path").select((F.col("first") + F.col("place")).alias("rid"), "doc")
    return stored(df.select(F.monotonically_increasing_id().alias("rid"), doc), "numbered")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_column(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words: runs are counted where each starts, so no array is built."""
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")


def lower_words(text: str) -> list[bytes]:
    """Words of a text with A-Z lowered. bytes.split() splits at exactly the six ASCII space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc_rest(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
