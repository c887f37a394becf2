"""Capture as a stream: channels are merged, bad rows set aside, repeats recognised and the rest recorded, batch by batch."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell import schemas
from tracewell.functions import fixed
from tracewell.functions.scalars import instant

DECISION = "id bigint, anchor bigint, recorded boolean"
START = "id bigint, started_us bigint"


def read_channels(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One stream of the events of every channel (name -> folder of JSON files)."""
    out = None
    for channel, path in paths.items():
        one = spark.readStream.schema(schemas.EVENT).option("multiLine", True).json(path).withColumn("source", F.coalesce("source", F.lit(channel)))
        out = one if out is None else out.unionByName(one)
    return out


class FirstWins(StatefulProcessor):
    """Recorded runs of a dedup group: the first sighting is recorded, later ones in its widened interval repeat it.

    Runs that ended more than `keep_us` before the newest start are forgotten, so state doesn't grow with time; a sighting later than that
    is recorded as a run of its own. Without `keep_us` nothing is forgotten, and decisions are those of the batch however late a sighting is.
    """

    def __init__(self, margin_us: int, keep_us: int | None) -> None:
        self.margin, self.keep = margin_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "s bigint, id bigint, e bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if pd.isna(r.s):
                out.append((r.id, r.id, True))
                continue
            s, e = int(r.s), int(r.s) if pd.isna(r.e) else int(r.e)
            hits = [x for x in runs if x[0] - self.margin <= s <= x[2] + self.margin]
            if hits:
                out.append((r.id, min(hits)[1], False))
            else:
                runs.append((s, int(r.id), max(s, e)))
                out.append((r.id, r.id, True))
        newest = max((x[0] for x in runs), default=0)
        self.runs.put(runs if self.keep is None else [x for x in runs if x[2] + self.margin >= newest - self.keep])
        yield pd.DataFrame(out, columns=["id", "anchor", "recorded"])

    def close(self) -> None:
        pass


def dedup_stream(sightings: DataFrame, margin_s: float = fixed.DEDUP_MARGIN_S, keep_s: float | None = 86_400.0) -> DataFrame:
    """Decisions for a stream of (dedup_group, id, start_ts, end_ts); ids ascend in order of arrival."""
    slim = sightings.select("dedup_group", F.col("id").cast("bigint").alias("id"), F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e"))
    return slim.groupBy("dedup_group").transformWithStateInPandas(FirstWins(int(margin_s * 1e6), None if keep_s is None else int(keep_s * 1e6)), DECISION, "append", "none")


class StartHandover(StatefulProcessor):
    """One slot a session: a pre-run mark fills it, the next finished run takes it if it is neither from the future nor over an hour old."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        slot = self.slot.get()[0] if self.slot.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if r.kind == "pre":
                slot = int(r.us)
            elif not pd.isna(r.given_us):
                out.append((r.id, int(r.given_us)))  # a time of its own leaves the slot alone
            else:
                age = None if slot is None else int(r.us) - slot
                out.append((r.id, slot if age is not None and 0 <= age <= fixed.HANDOVER_MAX_S * 1_000_000 else None))
                slot = None
        if slot is None:
            self.slot.clear()
        else:
            self.slot.update((slot,))
        yield pd.DataFrame({"id": pd.Series([x for x, _ in out], dtype="int64"), "started_us": pd.Series([y for _, y in out], dtype="Int64")})

    def close(self) -> None:
        pass


def start_times(marks: DataFrame) -> DataFrame:
    """(id, started_us) of finished runs in a stream of (session_id, id, kind 'pre' or 'post', us, given_us)."""
    return marks.groupBy("session_id").transformWithStateInPandas(StartHandover(), START, "append", "none")


def start_times_batch(df: DataFrame, session: str, arrival: str, kind: str, us: str) -> DataFrame:
    """The same for a table, where every finished run consumes: a run's start is the row before it, if that is a mark of fitting age."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(session).orderBy(arrival)
    before = F.struct(F.lag(kind).over(order).alias("kind"), F.lag(us).over(order).alias("us"))
    age = F.col(us) - F.col("b.us")
    fits = (F.col("b.kind") == "pre") & (age >= 0) & (age <= fixed.HANDOVER_MAX_S * 1_000_000)
    return df.withColumn("b", before).where(F.col(kind) == "post").withColumn("started_us", F.when(fits, F.col("b.us"))).drop("b")


class HistoryCursor(StatefulProcessor):
    """The highest entry id seen of each provider. Ids at or below it came late or again and are skipped; entries that are no jobs move it too."""

    def __init__(self, start: int) -> None:
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        mark = self.mark.get()[0] if self.mark.exists() else self.start
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").itertuples():
            out.append((int(r.arrival), int(r.id), int(r.id) <= mark))
            mark = max(mark, int(r.id))
        self.mark.update((mark,))
        yield pd.DataFrame(out, columns=["arrival", "id", "skipped"])

    def close(self) -> None:
        pass


def follow_history(entries: DataFrame, start: int = 0) -> DataFrame:
    """(arrival, id, skipped) for a stream of (provider, entry_id, arrival). start: the highest id when the stream begins, so that history isn't imported again."""
    ids = F.trim(F.col("entry_id").cast("string")).try_cast("bigint")
    slim = entries.select(F.coalesce("provider", F.lit("processing")).alias("provider"), F.col("arrival").cast("bigint").alias("arrival"), ids.alias("id")).where(F.col("id").isNotNull())
    return slim.groupBy("provider").transformWithStateInPandas(HistoryCursor(start), "arrival bigint, id bigint, skipped boolean", "append", "none")


def record_batches(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):  # noqa: ANN201
    """Start the query that records a stream of events into the log at path.

    A batch is one commit, keyed by its number, so a retried batch adds nothing. Repeats are recognised against the runs of
    their groups that are on record, however old these are, and versions of a path go on from the latest on record. Constraints are checked. Then the
    workflows of the batch's sessions are regrouped, as a commit of its own; if that fails, what is recorded stays, and the next batch of a session
    regroups it. Rows that can't be recorded go to `quarantine` with their reasons.
    """
    from tracewell.operators.normalize import event_keys
    from tracewell.operators.relate import record
    from tracewell.operators.versions import latest_versions
    from tracewell.sources.events import quarantine
    from tracewell.sources.store import LogStore

    def write(batch: DataFrame, number: int) -> None:
        store = LogStore(batch.sparkSession, path)
        batch = batch.withColumn("__text", F.to_json("parameters")).withColumn("parameters", F.col("__text")).drop("__text").persist()
        try:
            good, bad = quarantine(batch)
            aside = bad.select("event_id", "source", F.array_join("reasons", "; ").alias("reasons")).withColumn("batch", F.lit(number))
            if not bad.isEmpty():  # a folder for each batch, so a retry writes the same one
                aside.drop("batch").write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
            keyed = event_keys(good.withColumn("parameters", F.parse_json("parameters"))).withColumn("parameters", F.to_json("parameters"))
            known = store.table("activities").where(F.col("dedup_key").isNotNull()).select(F.col("id").alias("activity_id"), F.regexp_replace("dedup_key", r"\|[^|]*$", "").alias("dedup_group"), "started_at", F.greatest("started_at", F.coalesce("ended_at", "started_at")).alias("ended_at"))
            margin = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(fixed.DEDUP_MARGIN_S))
            start = instant("e.started_at")
            hits = keyed.alias("e").join(known.alias("k"), (F.col("e.dedup_group") == F.col("k.dedup_group")) & (start >= F.col("k.started_at") - margin) & (start <= F.col("k.ended_at") + margin))
            again = hits.groupBy(F.col("e.event_id").alias("event_id")).agg(F.min_by(F.col("k.activity_id"), F.col("k.started_at")).alias("activity_id"), F.first("e.source").alias("source"), F.first(start).alias("seen_at"))
            fresh = keyed.join(again.select("event_id"), "event_id", "left_anti")
            made = record(fresh, known=latest_versions(store.table("entities")))
            made["agents"] = made["agents"].join(store.table("agents").select("env_fingerprint"), "env_fingerprint", "left_anti")
            made["entities"] = made["entities"].join(store.table("entities").select("id"), "id", "left_anti")
            made["sightings"] = made["sightings"].unionByName(again.select("activity_id", "event_id", "source", "seen_at"))
            store.append(f"stream-{number}", made)
            try:
                store.regroup(f"stream-{number}-groups", good.select("session_id"))
            except Exception:  # noqa: BLE001  grouping never costs a recorded run
                logging.getLogger(__name__).exception("batch %s was recorded, its sessions were not regrouped", number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{fixed.POLL_INTERVAL_MS} milliseconds"})).start()

