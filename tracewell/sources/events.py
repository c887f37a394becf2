"""Reading capture events and raw history entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import fixed
from tracewell.functions.scalars import as_int, instant, parameters_object


def read_events(spark: SparkSession, path: str, *, session_id: str | None = None, status: str | None = None, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """Recorded events of JSON files, by start. Unknown fields are ignored and types are never inferred."""
    df = spark.read.schema(schemas.EVENT).option("multiLine", multi_line).json(path)
    if session_id is not None:
        df = df.where(F.col("session_id") == session_id)
    if status is not None:
        df = df.where(F.col("status") == status)
    df = df.orderBy(instant("started_at"), "event_id")
    return df if limit is None else df.limit(limit)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, with the fields that have values; read_events(multi_line=False) reads events back."""
    df.write.mode("errorifexists").json(path)


def _first(payload: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(payload, f"$.{k}", "variant") for k in keys])


def parse_history(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df plus algorithm_id, parameters (JSON text), python_command; algorithm_id is null where the entry is no job.

    The id is looked for under its spellings, then in the recorded command.
    """
    v = F.try_parse_json(F.col(payload))
    text = lambda x: x.try_cast("string")
    command = text(_first(v, fixed.COMMAND_KEYS))
    named = F.nullif(text(_first(v, fixed.ALGORITHM_KEYS)), F.lit(""))
    found = F.nullif(F.regexp_extract(command, fixed.COMMAND_PATTERN, 1), F.lit(""))
    return df.withColumns({"algorithm_id": F.coalesce(named, found), "parameters": parameters_object(_first(v, fixed.PARAMETER_KEYS)), "python_command": command})


def new_entries(df: DataFrame, mark: int, *, entry_id: str = "entry_id", provider: str = "provider") -> DataFrame:
    """Entries of the processing provider above the cursor."""
    return df.where((as_int(entry_id) > mark) & (F.col(provider).isNull() | (F.col(provider) == "processing")))


def entry_counts(df: DataFrame, mark: int, entry_id: str = "entry_id") -> DataFrame:
    """(offered, skipped): entries seen, and those at or below the cursor, which came late or again."""
    late = F.coalesce(as_int(entry_id) <= mark, F.lit(True))
    return df.agg(F.count("*").alias("offered"), F.count_if(late).alias("skipped"))


def next_mark(df: DataFrame, mark: int, entry_id: str = "entry_id") -> int:
    """The cursor after df: entries that are no jobs move it too."""
    return max(mark, df.agg(F.max(as_int(entry_id))).first()[0] or mark)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, bad events with `reasons`): capture never fails on a row."""
    checks = {
        "event_id is missing": F.col("event_id").isNull(),
        "session_id is missing": F.col("session_id").isNull(),
        "algorithm_id is missing": F.coalesce(F.col("algorithm_id"), F.lit("")) == "",
        "source is unknown": ~F.coalesce(F.col("source").isin(*schemas.CHANNELS), F.lit(False)),
        "status is unknown": ~F.coalesce(F.col("status").isin(*schemas.STATUSES), F.lit(False)),
        "started_at is no time": instant("started_at").isNull(),
    }
    reasons = F.array_compact(F.array(*[F.when(bad, reason) for reason, bad in checks.items()]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
