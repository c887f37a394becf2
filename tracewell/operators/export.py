"""Documents in the PROV data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import iso_micros


def prov_json(activities: DataFrame, entities: DataFrame, agents: DataFrame, relations: DataFrame, key: str | None = None) -> DataFrame:
    """One row (document): PROV-JSON of one workflow's graph, which fits a row by nature.

    With key, a column of all four tables, (key, document) of each workflow that has activities; a null key is one too.
    """

    def block(df: DataFrame, body: list, name: str) -> DataFrame:
        entry = F.struct(F.concat(F.lit("log:"), F.col("id")).alias("key"), F.struct(*body).alias("value"))
        entries = F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name)
        return df.agg(entries) if key is None else df.groupBy(F.col(key).alias(f"__{name}")).agg(entries)

    def beside(doc: DataFrame, more: DataFrame, name: str) -> DataFrame:
        if key is None:
            return doc.crossJoin(more)  # one row each
        none = F.create_map().cast(more.schema[name].dataType)
        return doc.join(more, F.col("__activity").eqNullSafe(F.col(f"__{name}")), "left").withColumn(name, F.coalesce(name, none)).drop(f"__{name}")

    doc = block(activities, [iso_micros("started_at").alias("prov:startTime"), iso_micros("ended_at").alias("prov:endTime"), F.col("algorithm_id").alias("log:algorithm"), F.col("status").alias("log:status")], "activity")
    doc = beside(doc, block(entities, [F.col("label").alias("prov:label"), F.col("file_path").alias("log:path"), F.col("content_version").alias("log:version")], "entity"), "entity")
    doc = beside(doc, block(agents, [F.lit("prov:SoftwareAgent").alias("prov:type"), F.col("qgis_version").alias("log:version")], "agent"), "agent")
    ends = {"used": ("prov:activity", "prov:entity"), "wasGeneratedBy": ("prov:entity", "prov:activity"), "wasDerivedFrom": ("prov:generatedEntity", "prov:usedEntity"), "wasAssociatedWith": ("prov:activity", "prov:agent"), "wasAttributedTo": ("prov:entity", "prov:agent")}
    for kind, (a, b) in ends.items():
        body = [F.concat(F.lit("log:"), "source_id").alias(a), F.concat(F.lit("log:"), "target_id").alias(b), F.col("role").alias("prov:role")]
        doc = beside(doc, block(relations.where(F.col("relation_type") == kind), body, kind), kind)
    prefix = F.create_map(F.lit("prov"), F.lit("http://www.w3.org/ns/prov#"), F.lit("log"), F.lit("urn:tracewell:")).alias("prefix")
    document = F.to_json(F.struct(prefix, *[c for c in doc.columns if c != "__activity"])).alias("document")
    return doc.select(document) if key is None else doc.select(F.col("__activity").alias(key), document)


def prov_jsonld(activities: DataFrame, entities: DataFrame, agents: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, document): JSON-LD of each workflow. Nodes and qualified edges are the members of one @graph, in order of their text. key: a column of all four tables."""
    name = lambda c: F.concat(F.lit("log:"), F.col(c))
    node = lambda kind, **facts: F.to_json(F.struct(name("id").alias("@id"), F.lit(f"prov:{kind}").alias("@type"), *[F.col(c).alias(k) for k, c in facts.items()]))
    ends = {"used": ("Usage", "activity", "entity"), "wasGeneratedBy": ("Generation", "entity", "activity"), "wasDerivedFrom": ("Derivation", "generatedEntity", "usedEntity"), "wasAssociatedWith": ("Association", "activity", "agent"), "wasAttributedTo": ("Attribution", "entity", "agent")}
    edge = lambda kind, a, b: F.to_json(F.struct(F.lit(f"prov:{kind}").alias("@type"), F.struct(name("source_id").alias("@id")).alias(f"prov:{a}"), F.struct(name("target_id").alias("@id")).alias(f"prov:{b}"), F.col("role").alias("prov:role")))
    parts = [
        activities.withColumn("__start", iso_micros("started_at")).withColumn("__end", iso_micros("ended_at")).select(key, node("Activity", **{"prov:startedAtTime": "__start", "prov:endedAtTime": "__end", "log:algorithm": "algorithm_id"}).alias("n")),
        entities.select(key, node("Entity", **{"prov:label": "label", "log:version": "content_version"}).alias("n")),
        agents.select(key, node("SoftwareAgent", **{"log:version": "qgis_version"}).alias("n")),
        *[relations.where(F.col("relation_type") == kind).select(key, edge(*names).alias("n")) for kind, names in ends.items()],
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    head = '{"@context":{"prov":"http://www.w3.org/ns/prov#","log":"urn:tracewell:"},"@graph":['
    return rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("n")), ","), F.lit("]}")).alias("document"))


def replay_plan(activities: DataFrame, members: DataFrame, workflow_id: str) -> DataFrame:
    """(sequence_order, algorithm_id, parameters) of a workflow, in order."""
    rows = members.where(F.col("workflow_id") == workflow_id).join(activities, F.col("activity_id") == F.col("id"))
    return rows.select("sequence_order", "algorithm_id", "parameters").orderBy(F.asc_nulls_first("sequence_order"))
