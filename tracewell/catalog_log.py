"""Queries that write the log's tables from the driver's, and read them as a graph, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.catalog import _COMPONENTS, _DERIVED, _OF_7, _derived, _named_relations, _query
from tracewell.functions import scalars as S
from tracewell.operators import audit, graph, grouping, normalize, relate, versions
from tracewell.plans import bindings as B

# ------------------------------------------------------------------------------------------ normalising

_SOURCE = """'{"source":"/d/' || p_partkey || '.shp|layername=a","driver":"ESRI Shapefile","feature_count":"' || p_size || '"}'"""
_RAW = f"CAST(json_object('DISTANCE', CAST(p_size AS VARCHAR), 'INPUT', {_SOURCE}, 'OUTPUT', '\"TEMPORARY_OUTPUT\"') AS VARCHAR)"


@_query(
    f"""SELECT p_partkey AS part, 'native' AS provider, 'completed' AS status, '{{"DISTANCE":"' || p_size || '"}}' AS parameters, '/d/' || p_partkey || '.shp' AS input_path, 'Shapefile' AS input_format, CAST(p_size AS BIGINT) AS features,
  CAST(2 AS BIGINT) AS n_outputs, '/out/' || p_partkey || '.gpkg' AS output_path, 'GeoPackage' AS output_format, '/out/' || p_partkey || '.html' AS extra_path, 'native:' || p_type || '|' || substr(sha256({_RAW}), 1, 16) AS dedup_group,
  'native:' || p_type || '|' || substr(sha256({_RAW}), 1, 16) || '|2026-08-08T10:00:00.000000+00:00' AS dedup_key FROM part"""
)
def build_events(spark: SparkSession, d: str) -> DataFrame:
    """Raw jobs, one a part: parameters split by their definitions, results merged into declared outputs, keys made."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    source = text('{"source":"/d/', k, '.shp|layername=a","driver":"ESRI Shapefile","feature_count":"', size, '"}')
    none = lambda t="string": F.lit(None).cast(t)
    # a job takes far longer than reading it: rows are dealt to all tasks, however few splits their file has
    parts = B.load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size").repartition("p_partkey")
    raw = parts.select(
        F.col("p_brand").alias("session_id"), F.lit("post_hook").alias("source"), text("native:", F.col("p_type")).alias("algorithm_id"), k.alias("algorithm_name"), none().alias("provider"), F.lit("2026-08-08T10:00:00+00:00").alias("started_at"),
        none().alias("ended_at"), none().alias("status"), none().alias("execution_log"), none(schemas.AGENT).alias("agent"),
        F.create_map(F.lit("OUTPUT"), F.lit('"TEMPORARY_OUTPUT"'), F.lit("INPUT"), source, F.lit("DISTANCE"), size).alias("parameters"),
        F.create_map(F.lit("OUTPUT"), text('{"source":"/out/', k, '.gpkg","driver":"GPKG"}'), F.lit("EXTRA"), text('"/out/', k, '.html"')).alias("results"),
        F.create_map(F.lit("INPUT"), F.lit("source"), F.lit("OUTPUT"), F.lit("sink")).alias("definitions"),
    )
    first, out = F.col("inputs")[0], F.col("outputs")
    return normalize.build_events(raw).select(
        F.col("algorithm_name").cast("bigint").alias("part"), "provider", "status", "parameters", first["path"].alias("input_path"), first["format"].alias("input_format"), first["feature_count"].alias("features"),
        F.size(out).cast("bigint").alias("n_outputs"), out[0]["path"].alias("output_path"), out[0]["format"].alias("output_format"), out[1]["path"].alias("extra_path"), "dedup_group", "dedup_key",
    )


@_query("""SELECT c_custkey, sha256('{"os_info":"nation ' || c_nationkey || '","plugin_versions":{"a":"1","b":"2"},"python_version":null,"qgis_version":"' || c_mktsegment || '"}') AS env_fingerprint FROM customer""")
def environment_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    plugins = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    found = S.environment_fingerprint("c_mktsegment", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.lit(None).cast("string"), plugins)
    return B.load(spark, d, "customer").select("c_custkey", found.alias("env_fingerprint"))


@_query(
    """SELECT p_partkey, 'L' AS param, '/d/' || p_partkey || '.tif' AS path, CASE p_partkey % 3 WHEN 0 THEN 'GeoTIFF' WHEN 1 THEN 'gdal' ELSE 'PNG' END AS format, CASE WHEN p_partkey % 2 = 0 THEN 'EPSG:' || p_size END AS crs,
  CASE WHEN p_partkey % 5 = 0 THEN 'vector' WHEN p_partkey % 7 <> 0 THEN 'raster' WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'unknown' END AS layer_type, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size END AS BIGINT) AS features, CAST(CASE WHEN p_partkey % 7 <> 0 THEN 3 END AS BIGINT) AS bands,
  CASE WHEN p_partkey % 4 <> 0 THEN p_size / 2.0::DOUBLE END AS pixel_x, CAST(p_partkey AS BIGINT) AS width, NULL::BIGINT AS height FROM part"""
)
def layer_facts(spark: SparkSession, d: str) -> DataFrame:
    """Layers described in JSON, some facts missing, empty, negative or no numbers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    fact = lambda name, value: F.concat(F.lit(f',"{name}":"'), value.cast("string"), F.lit('"'))
    opt = lambda test, text, other="": F.when(test, text).otherwise(F.lit(other))
    text = F.concat(
        F.lit('{"source":"/d/'), k.cast("string"), F.lit('.tif|layerid=0"'), F.when(k % 3 == 0, F.lit(',"driver":"GTiff"')).when(k % 3 == 1, F.lit(',"driver":"","provider":"gdal"')).otherwise(F.lit(',"format":"PNG"')),
        opt(k % 2 == 0, F.concat(F.lit(',"crs":"EPSG:'), size.cast("string"), F.lit('","layer_type":"table"')), ',"crs":""'), opt(k % 5 == 0, fact("feature_count", size), ',"feature_count":"-1"'), opt(k % 7 != 0, fact("band_count", F.lit(3)), ',"band_count":"many"'),
        opt(k % 4 != 0, F.concat(fact("pixel_x", size / 2), fact("pixel_y", size / 2)), ',"pixel_x":"NaN","pixel_y":"1"'), fact("width", k), F.lit(',"height":"-5"}'),
    )
    layer = normalize.describe_layer(F.lit("L"), text)
    rows = B.load(spark, d, "part").select("p_partkey", layer.alias("x"))
    return rows.select("p_partkey", "x.param", "x.path", "x.format", "x.crs", "x.layer_type", F.col("x.feature_count").alias("features"), F.col("x.band_count").alias("bands"), F.get("x.pixel_size", F.lit(0)).alias("pixel_x"), "x.width", "x.height")


_ID = "md5(concat_ws(chr(31), coalesce(c_mktsegment, chr(0)), CAST(c_custkey AS VARCHAR), chr(0)))"


@_query(f"SELECT c_custkey, substr({_ID}, 1, 8) || '-' || substr({_ID}, 9, 4) || '-' || substr({_ID}, 13, 4) || '-' || substr({_ID}, 17, 4) || '-' || substr({_ID}, 21, 12) AS id FROM customer")
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    return B.load(spark, d, "customer").select("c_custkey", S.derived_id("c_mktsegment", "c_custkey", F.lit(None)).alias("id"))


@_query("SELECT doc_id, CASE WHEN l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.n_chars IS NOT NULL THEN d.n_chars % 2 = l.quality AND d.n_chars % 3 = l.toxic END AS same FROM documents d LEFT JOIN labels l USING (doc_id)")
def same_probe(spark: SparkSession, d: str) -> DataFrame:
    both = B.load(spark, d, "documents").join(B.load(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", S.same_probe(F.col("n_chars") % 2, F.col("n_chars") % 3, "quality", "toxic").alias("same"))


@_query("SELECT p_partkey, p_size // 10 = p_partkey % 5 AS major, p_size // 10 = p_partkey % 5 AND p_size % 10 = p_partkey % 10 AS minor FROM part")
def environment_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Host versions that agree in their first number, or their first two."""
    text = lambda *n: F.concat_ws(".", *[x.cast("int").cast("string") for x in n], F.lit("7"))
    a, b = text(F.floor(F.col("p_size") / 10), F.col("p_size") % 10), text(F.col("p_partkey") % 5, F.col("p_partkey") % 10)
    return B.load(spark, d, "part").select("p_partkey", audit.environment_similar(a, b).alias("major"), audit.environment_similar(a, b, "minor").alias("minor"))


# -------------------------------------------------------------------------------------------- recording

_REFS = """refs AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_linestatus <> 'F' AS w, CASE WHEN l_linestatus <> 'F' THEN 'output' WHEN l_returnflag = 'R' THEN 'overlay' ELSE 'input' END AS role FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  ver AS (SELECT o, p, w, CAST(sum(CASE WHEN w THEN 1 ELSE 0 END) OVER t AS BIGINT) + CASE WHEN first_value(w) OVER t THEN 0 ELSE 1 END AS version, w OR row_number() OVER t = 1 AS fresh FROM (SELECT DISTINCT o, p, w FROM refs) WINDOW t AS (PARTITION BY p ORDER BY o, w))"""


@_query(f"WITH {_REFS} SELECT o AS job, p AS path, w AS writing, version, fresh FROM ver")
def content_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of parts as orders read and make them, in order of their keys."""
    orders = B.load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    refs = B.load(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linestatus") != "F").alias("writing")).distinct().join(orders, "l_orderkey")
    refs = refs.select(F.col("l_partkey").cast("string").alias("path"), F.struct("l_orderkey", "writing").alias("at"), F.struct("l_orderkey", "l_partkey", "writing").alias("id"), "writing", F.lit(None).cast("bigint").alias("none"))
    out = versions.assign_versions(refs, path="path", arrival="at", ident="id", writing="writing", size="none", mtime="none")
    return out.select(F.col("id.l_orderkey").alias("job"), F.col("id.l_partkey").alias("path"), "id.writing", F.col("version").cast("bigint").alias("version"), "fresh")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as capture events that read and make parts; every tenth is seen by a second channel as well."""
    layer = F.struct(F.when(F.col("role") == "overlay", "OVERLAY").when(F.col("writing"), "OUTPUT").otherwise("INPUT").alias("param"), F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("path"))
    whole = F.struct(layer["param"].alias("param"), layer["path"].alias("path"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split(":", 1) for x in schemas.LAYER[7:-1].split(",")[2:])])
    lines = B.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", (F.col("l_linestatus") != "F").alias("writing"), F.when(F.col("l_linestatus") != "F", "output").when(F.col("l_returnflag") == "R", "overlay").otherwise("input").alias("role")).distinct()
    lines = lines.withColumn("layer", whole.cast(schemas.LAYER))
    sides = lines.groupBy("k").agg(F.sort_array(F.collect_list(F.when(~F.col("writing"), F.col("layer")))).alias("inputs"), F.sort_array(F.collect_list(F.when(F.col("writing"), F.col("layer")))).alias("outputs"))
    acts = B.activities(spark, d).withColumnRenamed("id", "k").join(sides, "k", "left")
    none = F.array().cast(f"array<{schemas.LAYER}>")
    version = F.when(F.col("session_id") % 2 == 0, "3.34").otherwise("4.0")
    agent = F.struct(version.alias("qgis_version"), F.lit("Linux").alias("os_info"), F.lit("3.10").alias("python_version"), F.create_map(F.lit("a"), F.lit("1")).alias("plugin_versions"))
    start = S.iso_micros("started_at")
    rows = acts.select(
        F.concat(F.lit("o"), F.col("k").cast("string")).alias("event_id"), F.col("session_id").cast("string").alias("session_id"), F.lit("post_hook").alias("source"), F.concat(F.lit("native:"), "algorithm_id").alias("algorithm_id"), F.col("algorithm_id").alias("algorithm_name"),
        F.lit("native").alias("provider"), start.alias("started_at"), start.alias("ended_at"), "status", F.parse_json(F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}"))).alias("parameters"),
        F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"), agent.alias("agent"), F.lit(None).cast("string").alias("execution_log"), F.col("k").alias("arrival"),
    )
    again = rows.where(F.col("arrival") % 10 == 0).withColumns({"event_id": F.concat(F.lit("h"), "event_id"), "source": F.lit("history_signal"), "arrival": F.col("arrival") + 10_000_000_000})
    return rows.unionByName(again)


def _made(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    made = relate.record(_events(spark, d), arrival="arrival")
    acts = made["activities"].select(F.col("id").alias("activity_id"), F.get_json_object("parameters", "$.k").cast("bigint").alias("job"))
    return made, acts


@_query("SELECT o_orderkey AS job, CAST(o_custkey AS VARCHAR) AS session_id, 'native:' || o_orderpriority AS algorithm_id, epoch_us(o_orderdate) AS started_us, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' WHEN 'P' THEN 'cancelled' END AS status, 'post_hook' AS channel, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sightings FROM orders")
def recorded_activities(spark: SparkSession, d: str) -> DataFrame:
    made, acts = _made(spark, d)
    seen = made["sightings"].groupBy("activity_id").agg(F.count("*").alias("sightings"))
    rows = made["activities"].withColumnRenamed("id", "activity_id").join(acts, "activity_id").join(seen, "activity_id", "left")
    return rows.select("job", "session_id", "algorithm_id", B.micros("started_at").alias("started_us"), "status", F.col("capture_channel").alias("channel"), F.coalesce("sightings", F.lit(0)).alias("sightings"))


@_query(f"WITH {_REFS} SELECT '/p/' || p AS file_path, version, epoch_us(o_orderdate) AS created_us, CAST(p AS VARCHAR) AS label FROM ver JOIN orders ON o_orderkey = o WHERE fresh")
def recorded_entities(spark: SparkSession, d: str) -> DataFrame:
    made, _ = _made(spark, d)
    return made["entities"].select("file_path", F.col("content_version").cast("bigint").alias("version"), B.micros("created_at").alias("created_us"), "label")


@_query(f"WITH {_REFS} SELECT CASE WHEN r.w THEN 'wasGeneratedBy' ELSE 'used' END AS relation_type, r.o AS job, '/p/' || r.p AS other, version, role FROM refs r JOIN ver v ON v.o = r.o AND v.p = r.p AND v.w = r.w UNION ALL SELECT 'wasAssociatedWith', o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '3.34' ELSE '4.0' END, NULL, NULL FROM orders")
def recorded_relations(spark: SparkSession, d: str) -> DataFrame:
    made, acts = _made(spark, d)
    rel, kind = made["relations"], F.col("relation_type")
    job, other = F.when(kind == "wasGeneratedBy", F.col("target_id")).otherwise(F.col("source_id")), F.when(kind == "wasGeneratedBy", F.col("source_id")).otherwise(F.col("target_id"))
    ends = made["entities"].select(F.col("id").alias("__e"), F.col("file_path").alias("other"), F.col("content_version").cast("bigint").alias("version")).unionAll(made["agents"].select("id", "qgis_version", F.lit(None).cast("bigint")))
    rows = rel.select("relation_type", "role", job.alias("activity_id"), other.alias("__e")).join(acts, "activity_id").join(ends, "__e")
    return rows.select("relation_type", "job", "other", "version", "role")


@_query("""SELECT v AS qgis_version, sha256('{"os_info":"Linux","plugin_versions":{"a":"1"},"python_version":"3.10","qgis_version":"' || v || '"}') AS env_fingerprint, epoch_us(min(o_orderdate)) AS first_us FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN '3.34' ELSE '4.0' END AS v, o_orderdate FROM orders) GROUP BY v""")
def recorded_agents(spark: SparkSession, d: str) -> DataFrame:
    made, _ = _made(spark, d)
    return made["agents"].select("qgis_version", "env_fingerprint", B.micros("created_at").alias("first_us"))


# ------------------------------------------------------------------------------------ groups and graphs


@_query(f"""{_COMPONENTS}, step AS (SELECT component, activity, trim(o_orderpriority) AS step, o_custkey, row_number() OVER (PARTITION BY component ORDER BY o_orderdate, activity) AS i FROM comp JOIN orders ON o_orderkey = activity),
  named AS (SELECT component, any_value(o_custkey) AS c, count(*) AS n, string_agg(step, ', then ' ORDER BY i) AS listed, arg_min(step, i) AS a, arg_max(step, i) AS b FROM step GROUP BY component),
  low AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)
  SELECT component, CAST(c AS VARCHAR) AS session_id, CASE WHEN k IS NOT NULL THEN 'Set by hand ' || c WHEN n <= 3 THEN listed ELSE a || ' to ' || b || ' (' || n || ' steps)' END AS name, k IS NOT NULL AS kept, n AS members FROM named LEFT JOIN low ON low.k = component""")
def regrouped_workflows(spark: SparkSession, d: str) -> DataFrame:
    """Workflows of every customer; each third has one on record, named by a person, that holds its smallest order."""
    acts = B.activities(spark, d).select("id", F.col("session_id").cast("string").alias("session_id"), "started_at", F.col("algorithm_id").alias("algorithm_name"), "algorithm_id")
    mine = B.load(spark, d, "orders").where(F.col("o_custkey") % 3 == 0).groupBy("o_custkey").agg(F.min("o_orderkey").alias("activity_id"))
    flow = F.concat(F.lit("w"), F.col("o_custkey").cast("string"))
    flows = mine.select(flow.alias("id"), F.concat(F.lit("Set by hand "), F.col("o_custkey").cast("string")).alias("name"), F.col("o_custkey").cast("string").alias("session_id"), F.timestamp_micros(F.lit(0)).alias("created_at"))
    before = mine.select(flow.alias("workflow_id"), "activity_id", F.lit(0).alias("sequence_order"))
    made = grouping.regroup(acts, B.links(spark, d).select("activity_id", "file_path"), flows, before)
    sizes = made["members"].groupBy("workflow_id").agg(F.min("activity_id").alias("component"), F.count("*").alias("members"))
    return made["workflows"].join(sizes, F.col("id") == F.col("workflow_id")).select("component", "session_id", "name", F.col("id").startswith("w").alias("kept"), "members")


_TOUCHED = f"WITH {_DERIVED}, t AS (SELECT * FROM rel WHERE source_id IN {_OF_7} OR target_id IN {_OF_7}), own AS (SELECT DISTINCT l_partkey AS k FROM t)"


@_query(f"""{_TOUCHED} SELECT 'workflow' AS part, 'w7' AS id, NULL AS at UNION ALL SELECT 'activity', 'a' || o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 FROM orders WHERE o_custkey = 7
  UNION ALL SELECT 'entity', 'e' || k, NULL FROM own UNION ALL SELECT 'agent', 'host', NULL UNION ALL SELECT DISTINCT 'relation', relation_type || ' ' || source_id || ' ' || target_id || ' ' || role, NULL::BIGINT FROM t
  UNION ALL SELECT 'relation', 'wasDerivedFrom e' || derived || ' e' || origin || ' ', NULL FROM der WHERE derived IN (SELECT k FROM own) AND origin IN (SELECT k FROM own)
  UNION ALL SELECT 'relation', 'wasAssociatedWith a' || o_orderkey || ' host ', NULL FROM orders WHERE o_custkey = 7""")
def workflow_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph of one workflow, customer 7's orders: its jobs in order, what they touch, and every edge between these."""
    named = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    acts = B.activities(spark, d)
    flows = acts.select(named("session_id", "w").alias("id")).distinct()
    members = grouping.in_sequence(acts, ["session_id"], F.col("started_at"), F.col("id")).select(named("session_id", "w").alias("workflow_id"), named("id", "a").alias("activity_id"), "sequence_order")
    entities = B.load(spark, d, "part").select(named("p_partkey", "e").alias("id"))
    edges = _named_relations(spark, d).distinct()
    derived = _derived(spark, d).select(F.lit("wasDerivedFrom").alias("relation_type"), named("derived", "e").alias("source_id"), named("origin", "e").alias("target_id"), F.lit("").alias("role"))
    by = acts.select(F.lit("wasAssociatedWith").alias("relation_type"), named("id", "a").alias("source_id"), F.lit("host").alias("target_id"), F.lit("").alias("role"))
    edges = edges.unionByName(derived).unionByName(by).withColumn("id", F.concat_ws(" ", "relation_type", "source_id", "target_id", "role"))
    tables = {"workflows": flows, "workflow_activities": members, "activities": acts.select(named("id", "a").alias("id"), "started_at"), "entities": entities, "agents": spark.createDataFrame([("host",), ("other",)], "id string"), "relations": edges}
    found = graph.workflow_graph(tables, "w7")
    at = lambda df, part, n=F.lit(None): df.select(F.lit(part).alias("part"), "id", n.cast("bigint").alias("at"))
    out = at(found["workflow"], "workflow").unionAll(at(found["activities"], "activity", F.col("sequence_order")))
    return out.unionAll(at(found["entities"], "entity")).unionAll(at(found["agents"], "agent")).unionAll(at(found["relations"], "relation"))


@_query("SELECT sequence_order, 'native:' || p AS algorithm_id, CAST(k AS VARCHAR) AS parameters FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS sequence_order, o_orderpriority AS p, o_orderkey AS k FROM orders WHERE o_custkey = 7)")
def replay_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to run again, in order, for one workflow."""
    from tracewell.operators.export import replay_plan as plan

    acts = B.activities(spark, d)
    members = grouping.in_sequence(acts, ["session_id"], F.col("started_at"), F.col("id")).select(F.col("session_id").cast("string").alias("workflow_id"), F.col("id").alias("activity_id"), F.col("sequence_order").cast("bigint").alias("sequence_order"))
    jobs = acts.select("id", F.concat(F.lit("native:"), "algorithm_id").alias("algorithm_id"), F.col("id").cast("string").alias("parameters"))
    return plan(jobs, members, "7")


@_query("SELECT d.doc_id AS entity_id, source AS file_path, CAST(n_chars % 3 AS BIGINT) AS content_version, sha256(text) AS hash_value FROM documents d WHERE text IS NOT NULL AND source IS NOT NULL")
def fingerprinted_entities(spark: SparkSession, d: str) -> DataFrame:
    docs = B.load(spark, d, "documents")
    entities = docs.where(F.col("source").isNotNull()).select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), (F.col("n_chars") % 3).cast("bigint").alias("content_version"))
    return audit.fingerprinted(audit.fingerprints(docs, "doc_id", "text"), entities).select("entity_id", "file_path", "content_version", "hash_value")


@_query("""WITH n AS (SELECT o_custkey AS k, '{"@id":"log:a' || o_orderkey || '","@type":"prov:Activity","prov:startedAtTime":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '","log:algorithm":"' || o_orderpriority || '"}' AS n FROM orders
  UNION ALL SELECT DISTINCT o_custkey, '{"@id":"log:host","@type":"prov:SoftwareAgent","log:version":"3.34"}' FROM orders
  UNION ALL SELECT DISTINCT o_custkey, '{"@id":"log:e' || l_partkey || '","@type":"prov:Entity","prov:label":"part ' || l_partkey || '","log:version":1}' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT o_custkey, CASE WHEN l_linestatus = 'F' THEN '{"@type":"prov:Usage","prov:activity":{"@id":"log:a' || l_orderkey || '"},"prov:entity":{"@id":"log:e' || l_partkey || '"},"prov:role":"' || CASE WHEN l_returnflag = 'R' THEN 'overlay' ELSE 'input' END || '"}'
    ELSE '{"@type":"prov:Generation","prov:entity":{"@id":"log:e' || l_partkey || '"},"prov:activity":{"@id":"log:a' || l_orderkey || '"},"prov:role":"output"}' END FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT k AS session_id, '{"@context":{"prov":"http://www.w3.org/ns/prov#","log":"urn:tracewell:"},"@graph":[' || string_agg(n, ',' ORDER BY n) || ']}' AS document FROM n GROUP BY k""")
def prov_jsonld_all(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD of every customer's orders, one document each."""
    from tracewell.operators.export import prov_jsonld

    acts = B.activities(spark, d).select("session_id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"), "algorithm_id", "started_at", F.lit(None).cast("timestamp").alias("ended_at"))
    used = F.col("relation_type") == "used"
    rel = _named_relations(spark, d).distinct().withColumns({"job": F.when(used, F.col("source_id")).otherwise(F.col("target_id")), "part": F.when(used, F.col("target_id")).otherwise(F.col("source_id"))})
    rel = rel.join(acts.select("session_id", F.col("id").alias("job")), "job")
    parts = rel.select("session_id", F.col("part").alias("id")).distinct().select("session_id", "id", F.concat(F.lit("part "), F.substring("id", 2, 20)).alias("label"), F.lit(1).alias("content_version"))
    agents = acts.select("session_id").distinct().select("session_id", F.lit("host").alias("id"), F.lit("3.34").alias("qgis_version"))
    return prov_jsonld(acts, parts, agents, rel, "session_id")
