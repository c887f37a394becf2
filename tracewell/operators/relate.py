"""From recorded events to rows of the log: agents, activities, entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.operators.dedup import first_wins
from tracewell.operators.normalize import event_keys
from tracewell.operators.versions import assign_versions
from tracewell.plans.tables import stored


def decide(events: DataFrame, arrival: str | None = None) -> DataFrame:
    """events with seq (arrival), dedup keys, anchor seq and recorded. arrival: a column that orders sightings; by default start and id."""
    keyed = events if "dedup_group" in events.columns else event_keys(events)
    if dict(keyed.dtypes)["parameters"] == "variant":
        keyed = keyed.withColumn("parameters", F.to_json("parameters"))
    keyed = keyed.withColumns({"start_ts": S.instant("started_at"), "end_ts": S.instant("ended_at")})
    if arrival:
        keyed = keyed.withColumn("seq", F.col(arrival).cast("bigint"))
    else:  # sorted by range, so places ascend over partitions; stored, so they stay
        keyed = keyed.orderBy("start_ts", "event_id").withColumn("seq", F.monotonically_increasing_id())
    keyed = stored(keyed, "record-arrivals")
    found = first_wins(keyed, group="dedup_group", arrival="seq", ident="seq", start="start_ts", end="end_ts")
    return keyed.join(found.select(F.col("id").alias("seq"), "anchor"), "seq").withColumn("recorded", F.col("anchor") == F.col("seq"))


def distinct_agents(events: DataFrame) -> DataFrame:
    """One agent for each environment, by its first sighting."""
    env = events.select(F.col("agent.*"), "start_ts").withColumn("env_fingerprint", S.environment_fingerprint("qgis_version", "os_info", "python_version", "plugin_versions"))
    first = env.groupBy("env_fingerprint").agg(F.min_by(F.struct("qgis_version", "os_info", "python_version", F.to_json(S.sorted_map("plugin_versions")).alias("plugins")), "start_ts").alias("e"), F.min("start_ts").alias("created_at"))
    return first.select(S.derived_id(F.lit("agent"), "env_fingerprint").alias("id"), F.lit("software").alias("agent_type"), F.lit(None).cast("string").alias("label"), "e.qgis_version", "e.os_info", "e.python_version", F.from_json("e.plugins", "map<string,string>").alias("plugin_versions"), "created_at", "env_fingerprint")


def new_agents(agents: DataFrame, known: DataFrame) -> DataFrame:
    """Those whose environment isn't on record."""
    return agents.join(known.select("env_fingerprint"), "env_fingerprint", "left_anti")


def references(events: DataFrame) -> DataFrame:
    """One row for each dataset that a recorded event read or wrote, in order: seq, event_id, ref (orders by arrival, reads before writes), writing, place, layer.*"""
    reads = events.select("seq", "event_id", F.posexplode("inputs").alias("place", "layer")).withColumn("writing", F.lit(False))
    writes = events.select("seq", "event_id", F.posexplode("outputs").alias("place", "layer")).withColumn("writing", F.lit(True))
    both = reads.unionByName(writes)
    return both.select("seq", "event_id", F.struct("seq", "writing", "place").alias("ref"), "writing", "place", "layer.*")


def record(events: DataFrame, arrival: str | None = None, probes: DataFrame | None = None, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the log for events. probes: (path, size_bytes, mtime_us) of files that can be read now; known: latest_versions() of the log so far."""
    # what follows reads decisions and references several times, so both are stored
    decided = stored(decide(events, arrival), "record-decided")
    kept = decided.where("recorded").withColumn("activity_id", S.derived_id(F.lit("activity"), "event_id"))
    agents = distinct_agents(kept)
    fingerprint = S.environment_fingerprint("agent.qgis_version", "agent.os_info", "agent.python_version", "agent.plugin_versions")
    kept = kept.withColumn("agent_id", S.derived_id(F.lit("agent"), fingerprint))
    activities = kept.select(
        F.col("activity_id").alias("id"), "algorithm_id", "algorithm_name", "provider", "session_id", F.col("start_ts").alias("started_at"), F.col("end_ts").alias("ended_at"),
        F.col("parameters").cast("string").alias("parameters"), "status", "execution_log", F.col("source").alias("capture_channel"), F.lit(0).alias("corroborations"), "dedup_key",
    )
    refs = references(kept)
    if probes is None:
        refs = refs.withColumns({"size_bytes": F.lit(None).cast("bigint"), "mtime_us": F.lit(None).cast("bigint")})
    else:
        refs = refs.join(probes.select("path", "size_bytes", "mtime_us"), "path", "left")
    versions = assign_versions(refs, path="path", arrival="ref", ident="ref", writing="writing", size="size_bytes", mtime="mtime_us", known=known)
    refs = refs.join(versions.withColumnRenamed("id", "ref"), "ref")
    # without a path, the event and the place in it tell a dataset from those of all other batches
    alone = S.derived_id(F.lit("entity"), F.lit("place"), "event_id", F.when(F.col("writing"), "output").otherwise("input"), F.coalesce("param", F.lit("")), "place")
    refs = refs.withColumn("entity_id", F.when(F.coalesce("path", F.lit("")) == "", alone).otherwise(S.derived_id(F.lit("entity"), "path", "version")))
    refs = stored(refs.join(kept.select("seq", "activity_id", "start_ts"), "seq"), "record-references")
    facts = F.struct("feature_count", "band_count", "pixel_size", "width", "height", "size_bytes", "mtime_us")
    entities = refs.where("fresh").select(
        F.col("entity_id").alias("id"), F.lit("dataset").alias("entity_type"), S.path_label(F.lit(None).cast("string"), "path", "param").alias("label"), F.col("path").alias("file_path"), F.col("version").alias("content_version"), "format", "crs",
        F.coalesce("layer_type", F.lit("unknown")).alias("layer_type"), F.col("start_ts").alias("created_at"), F.nullif(F.to_json(facts), F.lit("{}")).alias("metadata"),
    )
    relation = lambda df, kind, source, target, role, key: df.select(
        S.derived_id(F.lit(kind), source, target, *([key, "place"] if key else [])).alias("id"), F.lit(kind).alias("relation_type"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), role.cast("string").alias("role"),
        (F.col(key) if key else F.lit(None).cast("string")).alias("qgis_param_key"), F.col("start_ts").alias("created_at"),
    )
    used = relation(refs.where(~F.col("writing")), "used", "activity_id", "entity_id", S.input_role("param"), "param")
    made = relation(refs.where("writing"), "wasGeneratedBy", "entity_id", "activity_id", F.lit("output"), "param")
    by = relation(kept, "wasAssociatedWith", "activity_id", "agent_id", F.lit(None), None)
    again = decided.where(~F.col("recorded")).select(F.col("anchor").alias("seq"), "event_id", "source", F.col("start_ts").alias("seen_at"))
    sightings = again.join(kept.select("seq", "activity_id"), "seq").select("activity_id", "event_id", "source", "seen_at")
    return {"agents": agents, "activities": activities, "entities": entities, "relations": used.unionAll(made).unionAll(by), "sightings": sightings}
