"""Every query over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import scalars as S
from tracewell.operators import audit, graph, grouping, lookup, relate, report, validate
from tracewell.operators.dedup import corroborations, first_wins
from tracewell.operators.versions import next_version
from tracewell.plans import bindings as B
from tracewell.plans.tables import stored
from tracewell.streaming.capture import start_times_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MARGIN_S = 7200.0


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ----------------------------------------------------------------------------------- scans and filters


@_query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_partkey = 42")
def entity_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_key(B.load(spark, d, "part"), "p_partkey", 42)


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ALL_TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.table_counts({t: B.load(spark, d, t) for t in ALL_TABLES})


@_query("SELECT o_orderkey, o_orderpriority, epoch_us(o_orderdate) AS started_us FROM orders WHERE o_custkey = 7")
def activities_for_session(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.by_key(B.load(spark, d, "orders"), "o_custkey", 7).orderBy("o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", "o_orderpriority", B.micros("o_orderdate").alias("started_us"))


@_query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '1-' AND o_orderpriority < '1.'")
def dedup_prefix_range(spark: SparkSession, d: str) -> DataFrame:
    return lookup.prefix_range(B.load(spark, d, "orders"), "o_orderpriority", "1", "-", ".").select("o_orderkey", "o_orderpriority")


@_query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000")
def high_water_filter(spark: SparkSession, d: str) -> DataFrame:
    return lookup.above_mark(B.load(spark, d, "events"), "event_id", 5000).select("event_id", "user_id", "event_type")


@_query("SELECT o_orderstatus AS raw, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' WHEN 'P' THEN 'cancelled' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def status_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.breakdown(B.load(spark, d, "orders").select(F.col("o_orderstatus").alias("raw"), B.order_status(F.col("o_orderstatus")).alias("status")), "raw", "status")


# -------------------------------------------------------------------------------------------- versions

_VERSIONS = "SELECT l_partkey AS path, l_shipdate AS shipped, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS version FROM (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem)"


@_query(f"SELECT path, max(version) AS version, epoch_us(max(shipped)) AS at_us FROM ({_VERSIONS}) GROUP BY path")
def latest_version_per_path(spark: SparkSession, d: str) -> DataFrame:
    return lookup.latest(B.versions(spark, d), ["path"], F.desc("version")).select("path", "version", B.micros("at").alias("at_us"))


@_query(f"SELECT p_partkey AS path, coalesce(max(version), 0) + 1 AS next_version FROM part LEFT JOIN ({_VERSIONS}) ON path = p_partkey GROUP BY 1")
def next_content_version(spark: SparkSession, d: str) -> DataFrame:
    return next_version(B.load(spark, d, "part").select(F.col("p_partkey").alias("path")), B.versions(spark, d))


@_query(f"SELECT path, version, epoch_us(shipped) AS at_us FROM ({_VERSIONS})")
def entity_version_history(spark: SparkSession, d: str) -> DataFrame:
    return B.versions(spark, d).orderBy("path", "version").select("path", "version", B.micros("at").alias("at_us"))


# ----------------------------------------------------------------------------------------------- dedup

_SIGHT = """s AS (SELECT event_id AS id, user_id AS session_id, event_type || '|' || coalesce(props, '') AS g, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 1000) * 1000 AS BIGINT) AS e,
  CASE event_id % 3 WHEN 0 THEN 'post_hook' WHEN 1 THEN 'run_wrapper' ELSE 'history_signal' END AS channel,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  row_number() OVER (PARTITION BY event_type || '|' || coalesce(props, '') ORDER BY event_id) AS rn FROM events)"""
_M = int(MARGIN_S * 1_000_000)
_FIRST_WINS = f"""WITH RECURSIVE {_SIGHT}, r(g, rn, anchors, id, anchor) AS (
  SELECT g, rn, [{{'s': s, 'id': id, 'e': greatest(s, e)}}], id, id FROM s WHERE rn = 1
  UNION ALL
  SELECT s.g, s.rn, CASE WHEN len(list_filter(r.anchors, lambda a: s.s >= a.s - {_M} AND s.s <= a.e + {_M})) = 0 THEN list_append(r.anchors, {{'s': s.s, 'id': s.id, 'e': greatest(s.s, s.e)}}) ELSE r.anchors END,
    s.id, coalesce(list_sort(list_filter(r.anchors, lambda a: s.s >= a.s - {_M} AND s.s <= a.e + {_M}))[1].id, s.id)
  FROM r JOIN s ON s.g = r.g AND s.rn = r.rn + 1), d AS (SELECT id, anchor FROM r)"""


@_query("SELECT event_id, event_type || '|' || substr(sha256(props), 1, 16) AS dedup_group FROM events")
def dedup_group_key(spark: SparkSession, d: str) -> DataFrame:
    return B.load(spark, d, "events").select("event_id", S.dedup_group("event_type", "props").alias("dedup_group"))


@_query("SELECT event_id, event_type || '|' || substr(sha256(props), 1, 16) || '|' || strftime(make_timestamp((epoch_us(ts) // 100000) * 100000), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS dedup_key FROM events")
def dedup_key_bucket(spark: SparkSession, d: str) -> DataFrame:
    return B.load(spark, d, "events").select("event_id", S.dedup_key("event_type", "props", S.iso_micros("ts")).alias("dedup_key"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(B.sightings(spark, d), group="dedup_group", arrival="id", ident="id", start="start_ts", end="end_ts", margin_s=MARGIN_S)


@_query(f"{_FIRST_WINS} SELECT id, anchor, id = anchor AS recorded FROM d")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).withColumn("recorded", F.col("id") == F.col("anchor"))


@_query(f"{_FIRST_WINS}, c AS (SELECT anchor, count(*) - 1 AS n FROM d GROUP BY anchor) SELECT channel, count(*) AS activities, CAST(sum(n) AS BIGINT) AS corroborations FROM c JOIN s ON s.id = c.anchor GROUP BY channel")
def channel_statistics(spark: SparkSession, d: str) -> DataFrame:
    counted = corroborations(_decided(spark, d)).join(B.sightings(spark, d).select("id", "channel"), "id")
    return report.channel_statistics(counted, F.col("channel"), F.col("corroborations"))


@_query(f"WITH {_SIGHT} SELECT coalesce(channel, 'unknown') AS channel, count(*) AS activities, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS corroborations FROM s GROUP BY 1")
def channel_statistics_raw(spark: SparkSession, d: str) -> DataFrame:
    rows = B.sightings(spark, d)
    return report.channel_statistics(rows, F.col("channel"), F.unix_micros("end_ts") - F.unix_micros("start_ts"))


@_query("SELECT id, event_id - id AS gap FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS id FROM events) WHERE id IS NOT NULL")
def previous_sighting(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return B.load(spark, d, "events").withColumn("id", before).where(F.col("id").isNotNull()).select("id", (F.col("event_id") - F.col("id")).alias("gap"))


# ---------------------------------------------------------------------------------------------- agents


@_query("SELECT c_mktsegment, c_nationkey, min(c_custkey) AS agent_id FROM customer GROUP BY 1, 2")
def distinct_agents(spark: SparkSession, d: str) -> DataFrame:
    agent = F.struct(F.col("c_mktsegment").alias("qgis_version"), F.col("c_nationkey").cast("string").alias("os_info"), F.lit("3").alias("python_version"), F.create_map().cast("map<string,string>").alias("plugin_versions"))
    found = relate.distinct_agents(B.load(spark, d, "customer").select(agent.alias("agent"), F.timestamp_micros("c_custkey").alias("start_ts")))
    return found.select(F.col("qgis_version").alias("c_mktsegment"), F.col("os_info").cast("int").alias("c_nationkey"), F.unix_micros("created_at").alias("agent_id"))


@_query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def new_agents_anti(spark: SparkSession, d: str) -> DataFrame:
    known = B.load(spark, d, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_nationkey").alias("env_fingerprint"))
    agents = B.load(spark, d, "customer").select(F.col("c_nationkey").alias("env_fingerprint")).distinct()
    return relate.new_agents(agents, known).select(F.col("env_fingerprint").alias("c_nationkey"))


# -------------------------------------------------------------------------------------------- grouping

_LINKS = "SELECT DISTINCT o_custkey AS session_id, l_orderkey AS activity_id, l_partkey AS file_path FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_COMPONENTS = f"""WITH RECURSIVE links AS ({_LINKS}), e AS (SELECT DISTINCT a.activity_id AS a, b.activity_id AS b FROM links a JOIN links b ON a.session_id = b.session_id AND a.file_path = b.file_path),
  reach(a, b) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), comp AS (SELECT a AS activity, min(b) AS component FROM reach GROUP BY a)"""


@_query(_LINKS)
def session_datasets(spark: SparkSession, d: str) -> DataFrame:
    acts = B.activities(spark, d)
    # parts get ids apart from orders', as the log's ids are
    edges = B.relations(spark, d)
    entity, act = F.concat(F.lit("e"), F.col("entity_id").cast("string")), F.concat(F.lit("a"), F.col("activity_id").cast("string"))
    used = F.col("relation_type") == "used"
    edges = edges.select("relation_type", F.when(used, act).otherwise(entity).alias("source_id"), F.when(used, entity).otherwise(act).alias("target_id"))
    parts = B.load(spark, d, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").cast("string").alias("file_path"))
    found = grouping.session_datasets(acts.select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"), "session_id"), edges, parts)
    return found.select("session_id", F.substring("activity_id", 2, 20).cast("bigint").alias("activity_id"), F.col("file_path").cast("bigint").alias("file_path"))


def _components(spark: SparkSession, d: str) -> DataFrame:
    return grouping.session_components(B.activities(spark, d), B.links(spark, d).select("activity_id", "file_path"))


@_query(f"{_COMPONENTS} SELECT activity, component FROM comp")
def session_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)


@_query(f"{_COMPONENTS}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1) SELECT size, count(*) AS components FROM z GROUP BY size")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


@_query(f"{_COMPONENTS} SELECT component, activity, row_number() OVER (PARTITION BY component ORDER BY o_orderdate, activity) - 1 AS sequence_order FROM comp JOIN orders ON o_orderkey = activity")
def workflow_sequence(spark: SparkSession, d: str) -> DataFrame:
    placed = _components(spark, d).join(B.activities(spark, d).select(F.col("id").alias("activity"), "started_at"), "activity")
    out = grouping.in_sequence(placed, ["component"], F.col("started_at"), F.col("activity"))
    return out.select("component", "activity", F.col("sequence_order").cast("bigint").alias("sequence_order"))


@_query("""SELECT conv_id, CASE WHEN n = 0 THEN 'Untitled work' WHEN n <= 3 THEN listed ELSE first || ' to ' || last || ' (' || n || ' steps)' END AS suggested_name FROM (
  SELECT conv_id, count(*) FILTER (trim(role) <> '') AS n, string_agg(trim(role), ', then ' ORDER BY turn) FILTER (trim(role) <> '') AS listed, arg_min(trim(role), turn) FILTER (trim(role) <> '') AS first, arg_max(trim(role), turn) FILTER (trim(role) <> '') AS last
  FROM conversations GROUP BY conv_id)""")
def workflow_suggested_name(spark: SparkSession, d: str) -> DataFrame:
    return grouping.titles(B.load(spark, d, "conversations"), ["conv_id"], "turn", "role")


@_query("SELECT c_custkey AS id, c_name AS name, c_custkey AS created_at, count(o_orderkey) AS activity_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def list_workflows(spark: SparkSession, d: str) -> DataFrame:
    flows = B.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("created_at"))
    return grouping.list_workflows(flows, B.load(spark, d, "orders").select(F.col("o_custkey").alias("workflow_id"), F.col("o_orderkey").alias("activity_id")))


@_query("SELECT s_suppkey, CASE WHEN n = 1 THEN label ELSE label || ' #' || n END AS shown FROM (SELECT s_suppkey, 'nation ' || s_nationkey AS label, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)")
def workflow_choices(spark: SparkSession, d: str) -> DataFrame:
    rows = B.load(spark, d, "supplier").withColumn("label", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))
    return lookup.numbered_labels(rows, "label", F.col("s_suppkey")).select("s_suppkey", "shown")


# ----------------------------------------------------------------------------------------------- graph

_REL = """rel AS (SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN 'used' ELSE 'wasGeneratedBy' END AS relation_type, CASE WHEN l_linestatus = 'F' THEN 'a' || l_orderkey ELSE 'e' || l_partkey END AS source_id,
  CASE WHEN l_linestatus = 'F' THEN 'e' || l_partkey ELSE 'a' || l_orderkey END AS target_id, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'overlay' WHEN l_linestatus = 'F' THEN 'input' ELSE 'output' END AS role, l_orderkey, l_partkey FROM lineitem)"""
_DERIVED = f"{_REL}, der AS (SELECT DISTINCT m.l_partkey AS derived, u.l_partkey AS origin FROM rel m JOIN rel u ON m.l_orderkey = u.l_orderkey WHERE m.relation_type = 'wasGeneratedBy' AND u.relation_type = 'used')"


def _named_relations(spark: SparkSession, d: str) -> DataFrame:
    rel = B.relations(spark, d)
    act, ent = F.concat(F.lit("a"), F.col("activity_id").cast("string")), F.concat(F.lit("e"), F.col("entity_id").cast("string"))
    used = F.col("relation_type") == "used"
    return rel.select("relation_type", F.when(used, act).otherwise(ent).alias("source_id"), F.when(used, ent).otherwise(act).alias("target_id"), "role")


def _session_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.activities(spark, d).where(F.col("session_id") == 7).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("node"))


_OF_7 = "(SELECT 'a' || o_orderkey FROM orders WHERE o_custkey = 7)"


@_query("SELECT conv_id, turn, role, md5(text) AS body FROM conversations")
def graph_activities(spark: SparkSession, d: str) -> DataFrame:
    rows = B.load(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("body"))
    return rows.orderBy("conv_id", F.asc_nulls_first("turn"))


@_query(f"WITH {_REL} SELECT relation_type, source_id, target_id, role FROM rel WHERE source_id IN {_OF_7} OR target_id IN {_OF_7}")
def graph_relations_touching(spark: SparkSession, d: str) -> DataFrame:
    return graph.touching(_named_relations(spark, d), _session_nodes(spark, d))


@_query(f"WITH {_REL}, t AS (SELECT * FROM rel WHERE source_id IN {_OF_7} OR target_id IN {_OF_7}) SELECT p_partkey, p_type FROM part WHERE 'e' || p_partkey IN (SELECT source_id FROM t UNION SELECT target_id FROM t)")
def graph_other_endpoints(spark: SparkSession, d: str) -> DataFrame:
    nodes = _session_nodes(spark, d)
    ends = graph.endpoints(graph.touching(_named_relations(spark, d), nodes)).join(nodes, "node", "left_anti")
    parts = B.load(spark, d, "part").withColumn("node", F.concat(F.lit("e"), F.col("p_partkey").cast("string")))
    return parts.join(ends, "node", "left_semi").select("p_partkey", "p_type")


@_query(f"WITH {_DERIVED}, t AS (SELECT l_partkey AS k FROM rel WHERE source_id IN {_OF_7} OR target_id IN {_OF_7}) SELECT derived, origin FROM der WHERE derived IN (SELECT k FROM t) AND origin IN (SELECT k FROM t)")
def graph_entity_entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the datasets of one session's graph."""
    nodes = _session_nodes(spark, d)
    ends = graph.endpoints(graph.touching(_named_relations(spark, d), nodes)).join(nodes, "node", "left_anti")
    own = ends.select(F.substring("node", 2, 20).cast("bigint").alias("k"))
    return _derived(spark, d).join(own.withColumnRenamed("k", "derived"), "derived", "left_semi").join(own.withColumnRenamed("k", "origin"), "origin", "left_semi")


@_query(" UNION ALL ".join(("WITH " + _REL if way == "out" else "") + f" SELECT '{way}' AS direction, relation_type, source_id, target_id, role FROM rel WHERE {cond}" for way, cond in (("out", "source_id = 'e42'"), ("in", "target_id = 'e42'"), ("both", "source_id = 'e42' OR target_id = 'e42'"))))
def relations_by_direction(spark: SparkSession, d: str) -> DataFrame:
    rel, node = _named_relations(spark, d), spark.createDataFrame([("e42",)], "node string")
    parts = [graph.touching(rel, node, way).select(F.lit(way).alias("direction"), "relation_type", "source_id", "target_id", "role") for way in ("out", "in", "both")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _derived(spark: SparkSession, d: str) -> DataFrame:
    rel = B.relations(spark, d)
    return graph.derived_from(rel)


@_query(f"WITH {_DERIVED} SELECT derived, origin FROM der")
def derived_from(spark: SparkSession, d: str) -> DataFrame:
    return _derived(spark, d)


@_query(f"WITH {_DERIVED} SELECT a.derived, count(DISTINCT b.origin) AS origins FROM der a JOIN der b ON a.origin = b.derived GROUP BY a.derived")
def derived_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """How many datasets each dataset comes from in two steps."""
    edges = _derived(spark, d)
    first = edges.select("derived", F.col("origin").alias("via"))
    # distinct pairs are made in each task before they are shuffled
    pairs = first.join(edges.select(F.col("derived").alias("via"), "origin"), "via").select("derived", "origin").distinct()
    return pairs.groupBy("derived").agg(F.count("*").alias("origins"))


@_query("""WITH RECURSIVE up(conv_id, start, node, depth) AS (SELECT conv_id, turn, turn, 0 FROM conversations UNION ALL SELECT up.conv_id, up.start, c.turn, up.depth + 1 FROM up JOIN conversations c ON c.conv_id = up.conv_id AND c.turn = up.node - 1)
  SELECT conv_id * 1000 + start AS start, conv_id * 1000 + node AS node, CAST(depth AS BIGINT) AS depth FROM up""")
def lineage_backward(spark: SparkSession, d: str) -> DataFrame:
    turns = B.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("derived"), "turn")
    nodes = turns.select("derived")
    edges = turns.where(F.col("turn") > 0).select("derived", (F.col("derived") - 1).alias("origin")).join(nodes.withColumnRenamed("derived", "origin"), "origin", "left_semi")
    return graph.lineage(edges.select("derived", "origin"), nodes)


@_query("SELECT conv_id * 1000 + turn AS node, turn AS layer FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING min(turn) = 0 AND max(turn) = count(*) - 1 AND count(*) > 1)")
def graph_layers(spark: SparkSession, d: str) -> DataFrame:
    conv = B.load(spark, d, "conversations")
    whole = conv.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n")).where((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n") > 1))
    turns = conv.join(whole, "conv_id", "left_semi").where(F.col("turn") > 0).select((F.col("conv_id") * 1000 + F.col("turn")).alias("derived"))
    return graph.layers(turns.withColumn("origin", F.col("derived") - 1)).select("node", F.col("layer").cast("bigint").alias("layer"))


@_query(f"WITH {_REL} SELECT DISTINCT l_orderkey AS activity_id, l_partkey AS file_path, CASE relation_type WHEN 'used' THEN 'read' ELSE 'made' END AS way FROM rel")
def files_of_jobs(spark: SparkSession, d: str) -> DataFrame:
    rel = B.relations(spark, d)
    return graph.files_of_jobs(rel, B.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_path")))


# ----------------------------------------------------------------------------------------------- audit


@_query("SELECT doc_id AS entity_id, sha256(text) AS hash_value, octet_length(encode(text)) AS file_size_bytes FROM documents WHERE text IS NOT NULL")
def fingerprint_sha256(spark: SparkSession, d: str) -> DataFrame:
    return audit.fingerprints(B.load(spark, d, "documents"), "doc_id", "text")


@_query("SELECT sha256(text) AS hash_value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def fingerprint_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(audit.fingerprints(B.load(spark, d, "documents"), "doc_id", "text"), ["hash_value"])


@_query("SELECT entity_id, id, computed_us FROM (SELECT user_id AS entity_id, event_id AS id, epoch_us(ts) AS computed_us, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = B.load(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("id"), F.col("ts").alias("computed_at"))
    return audit.latest_fingerprint(rows).select("entity_id", "id", B.micros("computed_at").alias("computed_us"))


@_query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'new' WHEN d.v IS NOT DISTINCT FROM l.v THEN 'verified' ELSE 'changed' END AS status
  FROM (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS v FROM documents) d FULL JOIN (SELECT doc_id, quality AS v FROM labels) l ON d.doc_id = l.doc_id""")
def dataset_status(spark: SparkSession, d: str) -> DataFrame:
    was = B.load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("v"))
    now = B.load(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    return audit.dataset_status(was, now, "doc_id", "v")


@_query("""SELECT source, round(avg(e) * 100, 4) AS input_exists_score, round(avg(u) * 100, 4) AS input_unchanged_score, round(avg(a) * 100, 4) AS algorithm_available_score, round(avg(v) * 100, 4) AS environment_similar_score, round(avg(p) * 100, 4) AS parameters_valid_score,
  round(0.0 + avg(e) * 30 + avg(u) * 25 + avg(a) * 20 + avg(v) * 15 + avg(p) * 10, 4) AS overall_score FROM (SELECT source, CASE WHEN l.doc_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS e, coalesce(quality, 0)::DOUBLE AS u, CASE WHEN n_chars > 100 THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END AS v, CASE WHEN coalesce(toxic, 0) = 0 THEN 1.0::DOUBLE ELSE 0 END AS p
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source""")
def audit_score(spark: SparkSession, d: str) -> DataFrame:
    rows = B.load(spark, d, "documents").join(B.load(spark, d, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    checks = rows.select("source", F.col("there").alias("input_exists"), (F.col("quality") == 1).alias("input_unchanged"), (F.col("n_chars") > 100).alias("algorithm_available"), (F.col("lang") == "en").alias("environment_similar"), (F.coalesce("toxic", F.lit(0)) == 0).alias("parameters_valid"))
    return audit.audit_scores(checks, "source")


@_query("SELECT doc_id, quality, toxic FROM labels ORDER BY doc_id DESC")
def audit_history(spark: SparkSession, d: str) -> DataFrame:
    return B.load(spark, d, "labels").orderBy(F.desc("doc_id"))


_AUDITED = (
    ("control", "'unchanged'", "max(100.0)"), ("deleted", "CASE WHEN p_partkey % 10 = 0 THEN 'input deleted' ELSE 'unchanged' END", "100 - 55 * avg(CASE WHEN p_partkey % 10 = 0 THEN 1.0 ELSE 0 END)"),
    ("modified", "CASE WHEN p_partkey % 5 = 0 THEN 'input modified' ELSE 'unchanged' END", "100 - 25 * avg(CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0 END)"),
    ("replaced", "CASE WHEN p_partkey % 7 = 0 THEN 'input replaced' ELSE 'unchanged' END", "100 - 25 * avg(CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE 0 END)"),
    ("other host", "'version changed'", "max(85.0)"), ("no plugin", "CASE WHEN p_partkey % 2 = 0 THEN 'plugin uninstalled' ELSE 'unchanged' END", "100 - 20 * avg(CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0 END)"),
)


@_query(" UNION ALL ".join(f"SELECT '{name}' AS scenario, {kind} AS found, count(*) AS n, (SELECT round(CAST({score} AS DOUBLE), 4) FROM part) AS overall_score FROM part GROUP BY 2" for name, kind, score in _AUDITED))
def change_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Six worlds after a run was recorded: as it was, inputs deleted, edited, replaced by others of the same name, another host version, a plugin gone."""
    k = F.col("p_partkey")
    plugin = F.when(k % 2 == 0, "extra").otherwise("core")
    base = B.load(spark, d, "part").select(k, F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("hash"), F.col("p_size").alias("size"), F.lit("3.34").alias("version"), F.array(F.lit("core"), F.lit("extra")).alias("plugins"), plugin.alias("plugin"))
    changed = lambda every, **to: base.withColumns({c: F.when(k % every == 0, v).otherwise(F.col(c)) for c, v in to.items()})
    worlds = {
        "control": base, "deleted": base.where(k % 10 != 0), "modified": changed(5, hash=F.concat("hash", F.lit("x"))), "replaced": changed(7, hash=F.lit("other"), size=F.col("size") + 1000),
        "other host": base.withColumn("version", F.lit("4.0")), "no plugin": base.withColumn("plugins", F.array(F.lit("core"))),
    }
    return audit.change_experiment(base, worlds, "p_partkey")


# ----------------------------------------------------------------------------------- scalar functions

_CUT = "split_part(split_part(split_part(split_part(trim(u), '|layername=', 1), '|layerid=', 1), '|subset=', 1), '|selectedFeaturesOnly=', 1)"
_PATHS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '|layername=roads' WHEN 1 THEN 'memory:' || url WHEN 2 THEN '  ' || url || '|subset=a|layerid=0' WHEN 3 THEN CASE WHEN page_id % 2 = 0 THEN 'TEMPORARY_OUTPUT' ELSE '/vsimem/' || page_id END ELSE url END AS u FROM pages"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    i, url = F.col("page_id") % 5, F.col("url")
    text = (
        F.when(i == 0, F.concat(url, F.lit("|layername=roads"))).when(i == 1, F.concat(F.lit("memory:"), url)).when(i == 2, F.concat(F.lit("  "), url, F.lit("|subset=a|layerid=0")))
        .when((i == 3) & (F.col("page_id") % 2 == 0), F.lit("TEMPORARY_OUTPUT")).when(i == 3, F.concat(F.lit("/vsimem/"), F.col("page_id").cast("string"))).otherwise(url)
    )
    return B.load(spark, d, "pages").select("page_id", text.alias("u"))


_FILE = f"CASE WHEN trim(u) IN ('TEMPORARY_OUTPUT', 'memory', '') OR starts_with(trim(u), 'memory:') OR starts_with(trim(u), '/vsimem/') OR starts_with(trim(u), '/vsizip/') OR starts_with(trim(u), '/vsicurl/') OR starts_with(trim(u), 'vsimem/') OR trim(u) LIKE '<%>' THEN NULL ELSE nullif({_CUT}, '') END"


@_query(f"SELECT page_id, {_FILE} AS file_path FROM ({_PATHS})")
def classify_path(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", S.file_path("u").alias("file_path"))


@_query(f"SELECT page_id, coalesce(string_split(f, '/')[-1], 'OUTPUT (temporary)') AS label FROM (SELECT page_id, {_FILE} AS f FROM ({_PATHS}))")
def path_label(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", S.path_label(F.lit(None).cast("string"), S.file_path("u"), F.lit("OUTPUT")).alias("label"))


@_query("SELECT event_id, CASE WHEN contains(a, ':') THEN split_part(a, ':', 1) END AS provider FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ':' || user_id ELSE event_type END AS a FROM events)")
def provider_inference(spark: SparkSession, d: str) -> DataFrame:
    rows = B.load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))).otherwise(F.col("event_type")).alias("a"))
    return rows.select("event_id", S.provider_of(F.lit(""), "a").alias("provider"))


@_query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'GeoTIFF' WHEN 1 THEN 'Shapefile' WHEN 2 THEN 'GeoPackage' ELSE p_type END AS format FROM part")
def canonical_format(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_size") % 4
    name = F.when(i == 0, " GTiff ").when(i == 1, "ESRI Shapefile").when(i == 2, "gpkg").otherwise(F.col("p_type"))
    return B.load(spark, d, "part").select("p_partkey", S.canonical_format(name).alias("format"))


@_query("SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'overlay' ELSE 'input' END AS role, count(*) AS n FROM lineitem GROUP BY 1, 2")
def role_mapping(spark: SparkSession, d: str) -> DataFrame:
    param = F.when(F.col("l_returnflag") == "R", "OVERLAY").otherwise("INPUT")
    return B.load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("role", S.input_role(param))


@_query("SELECT event_id, CAST(floor(value * 1000) * 1000 AS BIGINT) AS duration_us FROM events")
def job_duration(spark: SparkSession, d: str) -> DataFrame:
    return B.sightings(spark, d).select(F.col("id").alias("event_id"), F.round(S.seconds_between("start_ts", "end_ts") * 1_000_000).cast("bigint").alias("duration_us"))


@_query("""SELECT p_partkey, CASE WHEN s < 1024 THEN printf('%d bytes', s) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%.1f GB', s / 1073741824.0) END AS shown FROM (SELECT p_partkey, p_partkey * p_partkey * 131 AS s FROM part)""")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    return B.load(spark, d, "part").select("p_partkey", S.human_size(F.col("p_partkey") * F.col("p_partkey") * 131).alias("shown"))


# ------------------------------------------------------------------------------------------ validation


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false)")
def constraint_check_violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.failing(B.load(spark, d, "orders"), "o_orderstatus IN ('O', 'F')").select("o_orderkey", "o_orderstatus")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(B.load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    return validate.orphans(B.load(spark, d, "documents"), "doc_id", B.load(spark, d, "labels"), "doc_id").select("doc_id", "lang")


# ------------------------------------------------------------------------------------ pairing, reports


@_query("""SELECT event_id, CASE WHEN pk = 'view' AND us - pu BETWEEN 0 AND 3600000000 THEN pu END AS started_us FROM (SELECT event_id, event_type, epoch_us(ts) AS us, lag(event_type) OVER w AS pk, lag(epoch_us(ts)) OVER w AS pu FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click'""")
def prepost_pairing(spark: SparkSession, d: str) -> DataFrame:
    marks = B.load(spark, d, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_id", F.when(F.col("event_type") == "view", "pre").otherwise("post").alias("kind"), B.micros("ts").alias("us"))
    return start_times_batch(marks, "user_id", "event_id", "kind", "us").select("event_id", "started_us")


@_query(f"WITH {_SIGHT} SELECT channel, count(*) AS total, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS captured, round(100.0::DOUBLE * sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) / count(*), 4) AS percent FROM s GROUP BY channel")
def capture_completeness(spark: SparkSession, d: str) -> DataFrame:
    return report.completeness(B.sightings(spark, d), "channel", F.col("status") == "completed")


@_query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, round(1.96::DOUBLE * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS ci95 FROM lineitem GROUP BY 1")
def overhead_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.spread(B.load(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@_query("SELECT l_linestatus, round(100 * (avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) - 1), 4) AS percent FROM lineitem GROUP BY 1")
def overhead_percent(spark: SparkSession, d: str) -> DataFrame:
    return report.overhead(B.load(spark, d, "lineitem").withColumn("tracked", F.col("l_returnflag") == "R"), "l_linestatus", "tracked", "l_quantity")


@_query("SELECT event_type, count(*) AS operations, round(CAST(sum(length(props)) AS DOUBLE) / count(*), 4) AS bytes_per_operation FROM events GROUP BY 1")
def bytes_per_operation(spark: SparkSession, d: str) -> DataFrame:
    return report.bytes_per_operation(B.load(spark, d, "events"), "event_type", F.length("props"))


@_query()
def prov_export_all(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, document): PROV-JSON of every customer's orders, one document each."""
    from tracewell.operators.export import prov_json

    none = lambda t: F.lit(None).cast(t)
    acts = B.activities(spark, d).select("session_id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"), "algorithm_id", "status", "started_at", none("timestamp").alias("ended_at"))
    # every relation has one order at one end
    order = F.when(F.col("relation_type") == "used", F.col("source_id")).otherwise(F.col("target_id"))
    part = F.when(F.col("relation_type") == "used", F.col("target_id")).otherwise(F.col("source_id"))
    rel = _named_relations(spark, d).distinct().withColumns({"order": order, "part": part}).join(acts.select("session_id", F.col("id").alias("order")), "order")
    rel = stored(rel.withColumn("id", S.derived_id("relation_type", "source_id", "target_id", "role")), "prov-relations")
    ends = rel.select("session_id", F.col("part").alias("id")).distinct().select("session_id", "id", F.col("id").alias("label"), none("string").alias("file_path"), F.lit(1).alias("content_version"))
    agents = acts.select("session_id").distinct().select("session_id", F.lit("agent").alias("id"), F.lit("3.34").alias("qgis_version"))
    return prov_json(acts, ends, agents, rel, "session_id")


def queries() -> dict[str, Query]:
    from tracewell import catalog_log  # noqa: F401  adds its queries to these

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tracewell import catalog_log  # noqa: F401

    return dict(SQL)
