from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracewell import catalog_log
from tracewell.operators import audit, graph, grouping, validate
from tracewell.operators.export import prov_json
from tracewell.operators.normalize import build_events
from tracewell.operators.relate import record
from tracewell.operators.versions import assign_versions
from tracewell.sources.events import entry_counts, new_entries, next_mark, parse_history, quarantine, read_events
from tracewell.sources.store import LogStore, StoreError, resolve_path

T0 = datetime(2026, 8, 8, 10, 0, 0, tzinfo=timezone.utc)


def layer(param, path, **facts):
    return {"param": param, "path": path, "format": None, "crs": None, "layer_type": "vector", "feature_count": None, "band_count": None, "pixel_size": None, "width": None, "height": None} | facts


def event(n, name, inputs, outputs, *, second, session="s1", source="post_hook", status="completed", parameters=None, version="3.34.8"):
    start = T0 + timedelta(seconds=second)
    return {
        "event_id": f"e{n}", "session_id": session, "source": source, "algorithm_id": f"native:{name.lower()}", "algorithm_name": name, "provider": "qgis", "started_at": start.isoformat(timespec="microseconds"), "ended_at": (start + timedelta(seconds=1)).isoformat(timespec="microseconds"),
        "status": status, "parameters": parameters or {"DISTANCE": 500}, "inputs": inputs, "outputs": outputs, "agent": {"qgis_version": version, "os_info": "Linux", "python_version": "3.10", "plugin_versions": {"a": "1"}}, "execution_log": None,
    }


@pytest.fixture()
def events(spark, tmp_path):
    rows = [
        event(1, "Buffer", [layer("INPUT", "/data/roads.shp", feature_count=5)], [layer("OUTPUT", "/out/buffered.shp")], second=10),
        event(2, "Clip", [layer("INPUT", "/out/buffered.shp"), layer("OVERLAY", "/data/city.shp")], [layer("OUTPUT", "/out/clipped.shp")], second=20),
        event(3, "Clip", [layer("INPUT", "/out/buffered.shp"), layer("OVERLAY", "/data/city.shp")], [layer("OUTPUT", "/out/clipped.shp")], second=21, source="history_signal"),
        event(4, "Merge", [layer("INPUT", "/x/a.tif", layer_type="raster"), layer("INPUT", "/x/b.tif", layer_type="raster")], [layer("OUTPUT", None)], second=40, session="s2", version="3.40.0"),
        event(5, "Buffer", [layer("INPUT", "/data/roads.shp")], [layer("OUTPUT", "/out/buffered.shp")], second=90),
    ]
    path = tmp_path / "events.json"
    path.write_text(json.dumps(rows, indent=1))
    return read_events(spark, str(path))


def test_read(spark, events):
    assert [r["event_id"] for r in events.collect()] == ["e1", "e2", "e3", "e4", "e5"]
    assert events.select(F.to_json("parameters")).first()[0] == '{"DISTANCE":500}'


def test_record(spark, events):
    made = record(events)
    counts = {k: v.count() for k, v in made.items()}
    # e3 repeats e2; versions: buffered is written twice (2), the others once; one output has no path
    assert counts == {"agents": 2, "activities": 4, "entities": 8, "relations": 6 + 4 + 4, "sightings": 1}
    versions = {(r["file_path"], r["content_version"]) for r in made["entities"].collect()}
    assert versions == {("/data/roads.shp", 1), ("/out/buffered.shp", 1), ("/out/buffered.shp", 2), ("/data/city.shp", 1), ("/out/clipped.shp", 1), ("/x/a.tif", 1), ("/x/b.tif", 1), (None, 1)}
    roles = sorted(r["role"] for r in made["relations"].where("relation_type = 'used'").collect())
    assert roles == ["input"] * 5 + ["overlay"]
    assert made["entities"].where("file_path IS NULL").first()["label"] == "OUTPUT (temporary)"
    assert made["relations"].select("id").distinct().count() == 14


def test_record_jobs_with_many_datasets(spark, tmp_path):
    tiles = [layer("INPUT", f"/t/{i}.tif") for i in range(1002)]
    parts = [layer("OUTPUT", f"/p/{i}.tif") for i in range(1002)]
    rows = [event(1, "Merge", tiles, [layer("OUTPUT", "/m.tif"), layer("OUTPUT", None)], second=10), event(2, "Split", [layer("INPUT", "/m.tif"), layer("INPUT", None)], parts, second=50), event(3, "Clip", [layer("INPUT", "/p/1.tif"), layer("INPUT", None)], [layer("OUTPUT", "/m.tif")], second=90)]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    made = record(read_events(spark, str(tmp_path / "e.json")).withColumn("n", F.substring("event_id", 2, 9).cast("bigint")), arrival="n")
    paths = sorted((r["file_path"] or "", r["content_version"]) for r in made["entities"].collect())
    assert paths == sorted([(x["path"], 1) for x in tiles + parts] + [("/m.tif", 1), ("/m.tif", 2), ("", 1), ("", 1), ("", 1)])
    assert len(made["relations"].collect()) == 1002 + 2 + 2 + 1002 + 2 + 1 + 3


def test_graph_and_groups(spark, events):
    made = record(events)
    links = grouping.session_datasets(made["activities"], made["relations"], made["entities"])
    none = {"workflows": spark.createDataFrame([], "id string, name string, session_id string, created_at timestamp"), "members": spark.createDataFrame([], "workflow_id string, activity_id string, sequence_order int")}
    first = grouping.regroup(made["activities"], links, none["workflows"], none["members"])
    names = {r["session_id"]: r["name"] for r in first["workflows"].collect()}
    assert names == {"s1": "Buffer, then Clip, then Buffer", "s2": "Merge"}
    again = grouping.regroup(made["activities"], links, first["workflows"], first["members"])
    assert sorted(map(tuple, again["workflows"].collect())) == sorted(map(tuple, first["workflows"].collect()))
    assert sorted(map(tuple, again["members"].collect())) == sorted(map(tuple, first["members"].collect()))
    assert again["deleted"].count() == 0
    flow = first["workflows"].where("session_id = 's2'").first()["id"]
    tables = made | {"workflows": first["workflows"], "workflow_activities": first["members"]}
    g = graph.workflow_graph(tables, flow)
    assert (g["activities"].count(), g["entities"].count(), g["agents"].count(), g["relations"].count()) == (1, 3, 1, 4)
    with pytest.raises(ValueError, match="no workflow"):
        graph.workflow_graph(tables, "nothing")
    doc = json.loads(prov_json(g["activities"], g["entities"], g["agents"], g["relations"]).first()["document"])
    assert len(doc["activity"]) == 1 and len(doc["used"]) == 2 and len(doc["wasGeneratedBy"]) == 1


def test_regroup_keeps_names_that_people_gave(spark):
    acts = spark.createDataFrame([("a", "s", T0, "A", "x"), ("b", "s", T0 + timedelta(seconds=5), "B", "x"), ("c", "s", T0 + timedelta(seconds=9), "C", "x")], "id string, session_id string, started_at timestamp, algorithm_name string, algorithm_id string")
    flows = spark.createDataFrame([("w1", "Flood risk", "s", T0), ("w2", "B", "s", T0 + timedelta(seconds=1)), ("w3", "gone", "s", T0)], "id string, name string, session_id string, created_at timestamp")
    members = spark.createDataFrame([("w1", "a", 0), ("w2", "b", 0)], "workflow_id string, activity_id string, sequence_order int")
    joined = spark.createDataFrame([("a", "/p"), ("b", "/p")], "activity_id string, file_path string")
    out = grouping.regroup(acts, joined, flows, members)
    assert {(r["id"], r["name"]) for r in out["workflows"].collect() if r["id"] == "w1"} == {("w1", "Flood risk")}
    assert {r["workflow_id"] for r in out["deleted"].collect()} == {"w2", "w3"}
    apart = grouping.regroup(acts, spark.createDataFrame([("b", "/q"), ("c", "/q")], "activity_id string, file_path string"), flows, members)
    assert {(r["id"], r["name"]) for r in apart["workflows"].collect()} == {("w1", "Flood risk"), ("w2", "B, then C")}


@pytest.mark.parametrize(
    ("looks", "want"),
    [
        ([(False, 1, 1), (False, 1, 1), (True, 1, 1)], [1, 1, 1]),
        ([(True, 1, 1), (True, 2, 1), (False, 1, 1)], [1, 2, 3]),
        ([(True, None, None), (True, None, None), (False, None, None)], [1, 2, 2]),
        ([(False, 1, 1), (False, None, None), (False, 2, 2)], [1, 1, 2]),
        ([(False, 1, 1), (True, None, None), (False, 1, 1)], [1, 2, 2]),
    ],
)
def test_versions(spark, looks, want):
    rows = [(i, "/p", w, s, m) for i, (w, s, m) in enumerate(looks)] + [(100, None, True, 1, 1), (101, None, True, 1, 1)]
    df = spark.createDataFrame(rows, "id bigint, path string, writing boolean, size bigint, mtime bigint")
    out = {r["id"]: r["version"] for r in assign_versions(df, path="path", arrival="id", ident="id", writing="writing", size="size", mtime="mtime").collect()}
    assert [out[i] for i in range(len(looks))] == want
    assert out[100] == out[101] == 1


def test_store(spark, events, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    made = record(events)
    store.append("one", made)
    store.append("one", made)  # a retry
    assert {r["table_name"]: r["n"] for r in store.counts().collect()} | {} == {"entities": 8, "activities": 4, "agents": 2, "fingerprints": 0, "relations": 14, "workflows": 0, "workflow_activities": 0, "audit_results": 0}
    assert sorted(r["corroborations"] for r in store.activities().collect()) == [0, 0, 0, 1]
    with pytest.raises(StoreError, match="not unique"):
        store.append("two", {"agents": made["agents"]})
    bad = spark.createDataFrame([("r1", "eats", "a", "b", "Input", None, T0)], "id string, relation_type string, source_id string, target_id string, role string, qgis_param_key string, created_at timestamp")
    with pytest.raises(StoreError, match="outside its domain"):
        store.append("three", {"relations": bad})
    lost = spark.createDataFrame([("w", "a", 0)], "workflow_id string, activity_id string, sequence_order int")
    with pytest.raises(StoreError, match="no row in"):
        store.append("four", {"workflow_activities": lost})
    flow = spark.createDataFrame([("w", "Old", None, "s1", T0, T0)], "id string, name string, description string, session_id string, created_at timestamp, updated_at timestamp")
    change = spark.createDataFrame([("w", "New", None, T0 + timedelta(seconds=1)), ("w", None, "text", T0 + timedelta(seconds=2))], "workflow_id string, name string, description string, changed_at timestamp")
    store.append("five", {"workflows": flow, "workflow_changes": change})
    assert tuple(store.workflows().select("name", "description").first()) == ("New", "text")
    store.append("six", {"workflow_tombstones": spark.createDataFrame([("w", T0)], "workflow_id string, deleted_at timestamp")})
    assert store.workflows().count() == 0 and store.activities().count() == 4
    assert resolve_path(spark, " ", "d") == "d"


def test_a_batch_that_broke_off_counts_once(spark, events, tmp_path, monkeypatch):
    """A crash at any point between the first write and the commit leaves nothing that a reader sees, and the retry counts once."""
    made = record(events)
    for broken in ("activities", "relations", "commits"):
        store = LogStore(spark, str(tmp_path / broken))
        store.append("zero", {"agents": made["agents"]})
        write = LogStore._write

        def fails(self, name, rows, broken=broken, write=write):
            if name == broken:
                raise OSError("executor lost")
            write(self, name, rows)

        rest = {k: v for k, v in made.items() if k != "agents"}
        monkeypatch.setattr(LogStore, "_write", fails)
        with pytest.raises(OSError):
            store.append("one", rest)
        monkeypatch.setattr(LogStore, "_write", write)
        seen = store.summary()
        assert seen["agents"] == 2 and not any(n for t, n in seen.items() if t != "agents")
        store.append("one", rest)
        store.append("one", rest)
        assert store.summary() == {"entities": 8, "activities": 4, "agents": 2, "fingerprints": 0, "relations": 14, "workflows": 0, "workflow_activities": 0, "audit_results": 0}
    assert LogStore(spark, str(tmp_path / "nowhere")).summary()["agents"] == 0
    spark.range(1).selectExpr("id AS attempt", "id AS oops").write.parquet(str(tmp_path / "relations/agents2"))
    monkeypatch.setattr(LogStore, "_raw", lambda self, name: 1 / 0)
    assert store.summary() == {}


def test_validation(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x")], "a int, b string")
    assert [tuple(r) for r in validate.duplicates(df, ["a", "b"]).collect()] == [(2, "x", 2)]


def test_history_and_quarantine(spark):
    rows = [("1", None, '{"algorithm_id":"native:buffer","parameters":{"B":1,"A":2}}'), ("2", "processing", '{"python_command":"processing.run(\\"gdal:warp\\", {})"}'), ("3", "other", "{}"), ("4", None, "no json"), ("x", None, "{}")]
    df = spark.createDataFrame(rows, "entry_id string, provider string, payload string")
    out = {r["entry_id"]: (r["algorithm_id"], r["parameters"]) for r in parse_history(new_entries(df, 0)).collect()}
    assert out == {"1": ("native:buffer", '{"A":2,"B":1}'), "2": ("gdal:warp", "{}"), "4": (None, "{}")}
    assert new_entries(df, 1).count() == 2
    assert tuple(entry_counts(df, 1).first()) == (5, 2) and next_mark(df, 1) == 4 and next_mark(df.limit(0), 7) == 7
    ev = spark.createDataFrame([("e", "s", "post_hook", "a", "completed", "2026-08-08T10:00:00Z"), (None, "s", "other", "", "completed", "x")], "event_id string, session_id string, source string, algorithm_id string, status string, started_at string")
    good, bad = quarantine(ev)
    assert good.count() == 1 and len(bad.first()["reasons"]) == 4


def test_build_events(spark):
    schema = "session_id string, source string, algorithm_id string, algorithm_name string, provider string, started_at string, ended_at string, status string, execution_log string, agent struct<qgis_version:string>, parameters map<string,string>, results map<string,string>, definitions map<string,string>"
    params = {"INPUT": '{"source":"/d/roads.shp|layername=a","driver":"ESRI Shapefile","feature_count":"12"}', "DISTANCE": "5", "OUTPUT": '"TEMPORARY_OUTPUT"'}
    results = {"OUTPUT": '{"source":"/out/b.gpkg","driver":"GPKG","feature_count":"12"}', "COUNT": "7", "EXTRA": '"/out/x.html"', "INPUT": '"/other"'}
    kinds = {"INPUT": "source", "OUTPUT": "sink", "COUNT": "outputNumber"}
    df = spark.createDataFrame([("s", "post_hook", "native:buffer", None, None, "2026-08-08T10:00:00+00:00", None, None, None, ("3",), params, results, kinds)], schema)
    r = build_events(df).first()
    assert r["provider"] == "native" and r["status"] == "completed" and json.loads(r["parameters"]) == {"DISTANCE": "5"}
    assert [(x["param"], x["path"], x["format"], x["layer_type"], x["feature_count"]) for x in r["inputs"]] == [("INPUT", "/d/roads.shp", "Shapefile", "vector", 12)]
    assert [(x["param"], x["path"], x["format"]) for x in r["outputs"]] == [("OUTPUT", "/out/b.gpkg", "GeoPackage"), ("EXTRA", "/out/x.html", None)]
    assert r["dedup_key"].startswith("native:buffer|") and r["dedup_key"].endswith("|2026-08-08T10:00:00.000000+00:00")


def test_build_events_reads_each_value_once(spark, tmp_path):
    schema = "session_id string, source string, algorithm_id string, algorithm_name string, provider string, started_at string, ended_at string, status string, execution_log string, agent struct<qgis_version:string>, parameters map<string,string>, results map<string,string>, definitions map<string,string>"
    odd = {"A": None, "B": "{bad", "C": '{"path":" p |subset=q","driver":"","provider":"gtiff","feature_count":"-3","band_count":2,"pixel_x":"inf","pixel_y":"1"}', "D": "[1]", "E": '{"source":"u","selectedFeaturesOnly":true}'}
    kinds = {"A": "source", "B": "sink", "C": "sink", "D": "sink", "X": "outputFile", "Y": "number"}
    rows = [("s", "t", "n:a", None, None, "x", None, None, None, None, *more) for more in ((odd, {"B": "b.tif", "C": '{"crs":"EPSG:1"}', "X": "memory", "Y": "y", "Z": '"z"'}, kinds), (None, None, None))]
    out = build_events(spark.createDataFrame(rows, schema))
    full, empty = sorted(out.collect(), key=lambda r: r["parameters"] == "{}")
    assert empty["inputs"] == empty["outputs"] == [] and json.loads(full["parameters"]) == {"E": "u|selectedFeaturesOnly=yes"}
    facts = lambda xs: [(x["param"], x["path"], x["format"], x["crs"], x["layer_type"], x["feature_count"], x["band_count"], x["pixel_size"]) for x in xs]
    assert facts(full["inputs"]) == [("A", None, None, None, "unknown", None, None, None)]
    assert facts(full["outputs"]) == [
        ("B", "b.tif", None, None, "unknown", None, None, None), ("C", "p ", "GeoTIFF", "EPSG:1", "raster", None, 2, None), ("D", "[1]", None, None, "unknown", None, None, None),
        ("X", None, None, None, "unknown", None, None, None), ("Z", "z", None, None, "unknown", None, None, None),
    ]
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    # scalars, inputs, outputs, results of declared outputs, other results: each place parses its JSON once
    assert plan.count("parseJson") == 5
    # a file of one split is dealt to all tasks
    spark.sql("SELECT 1L AS p_partkey, 'b' AS p_brand, 'T' AS p_type, 3 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    query = catalog_log.build_events(spark, str(tmp_path))
    assert "REPARTITION_BY_COL" in query._jdf.queryExecution().toString() and query.first()["output_path"] == "/out/1.gpkg"


def test_graph_reading(spark):
    rel = spark.createDataFrame([("1", "used", "a", "b"), ("2", "used", "b", "a"), ("3", "used", "a", "a"), ("4", "used", "c", "d")], "id string, relation_type string, source_id string, target_id string")
    node = spark.createDataFrame([("a",)], "node string")
    got = {w: sorted(r["id"] for r in graph.touching(rel, node, w).collect()) for w in ("in", "out", "both")}
    assert got == {"in": ["2", "3"], "out": ["1", "3"], "both": ["1", "2", "3"]}
    with pytest.raises(ValueError, match="direction"):
        graph.touching(rel, node, "up")
    edges = spark.createDataFrame([(3, 2), (2, 1), (1, 3), (5, 4)], "derived bigint, origin bigint")  # with a cycle
    out = graph.lineage(edges, spark.createDataFrame([(3,)], "x bigint"))
    assert sorted((r["node"], r["depth"]) for r in out.collect()) == [(1, 2), (2, 1), (3, 0)]
    flat = graph.layers(spark.createDataFrame([(3, 2), (2, 1), (3, 1)], "derived bigint, origin bigint"))
    assert sorted((r["node"], r["layer"]) for r in flat.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_audit(spark):
    df = spark.createDataFrame([("w", True, True, True, False, True), ("w", True, None, True, True, True)], "w string, input_exists boolean, input_unchanged boolean, algorithm_available boolean, environment_similar boolean, parameters_valid boolean")
    assert audit.audit_scores(df, "w").first()["overall_score"] == 80.0
    versions = spark.createDataFrame([("3.34.8", "3.40.0")], "a string, b string")
    got = versions.select(audit.environment_similar(F.col("a"), F.col("b")), audit.environment_similar(F.col("a"), F.col("b"), "minor")).first()
    assert tuple(got) == (True, False)


def test_change_experiment_sends_no_table_to_the_driver(spark):
    schema = "k int, hash string, size int, version string, plugins array<string>"
    base = spark.createDataFrame([(1, "a", 5, "3.34", ["core"], "core"), (2, "b", 5, "3.34", ["core"], "core"), (None, "c", 5, "3.34", ["core"], "core")], schema + ", plugin string")
    now = lambda *rows: spark.createDataFrame(rows, schema)
    worlds = {"same": base, "edited": now((1, "x", 5, "3.34", ["core"]), (2, "x", 6, "3.34", ["core"])), "host": now((1, "a", 5, "4.0", ["core"]), (2, "b", 5, "3.40", [])), "empty": now()}
    out = audit.change_experiment(base, worlds, "k")
    assert {(r["scenario"], r["found"]): (r["n"], r["overall_score"]) for r in out.collect()} == {
        ("same", "unchanged"): (2, 81.6667), ("same", "input deleted"): (1, 81.6667), ("edited", "input modified"): (1, 65.0), ("edited", "input replaced"): (1, 65.0), ("edited", "input deleted"): (1, 65.0),
        ("host", "version changed"): (1, 70.0), ("host", "plugin uninstalled"): (1, 70.0), ("host", "input deleted"): (1, 70.0), ("empty", "input deleted"): (3, 45.0),
    }
    plan = out._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and plan.partition("== Physical Plan ==")[2].count("SortMergeJoin") >= len(worlds)


def test_versions_of_the_log(spark, tmp_path, monkeypatch):
    from tracewell import schemas
    from tracewell.sources import store as st

    LogStore(spark, str(tmp_path / "log")).append("one", {})
    monkeypatch.setattr(schemas, "VERSION", 2)
    ran = []
    monkeypatch.setitem(st.MIGRATIONS, 1, ran.append)
    assert LogStore(spark, str(tmp_path / "log")).schema_version() == 2 and len(ran) == 1
    monkeypatch.setattr(schemas, "VERSION", 1)
    with pytest.raises(StoreError, match="schema version 2"):
        LogStore(spark, str(tmp_path / "log"))
    spark.range(1).write.parquet(str(tmp_path / "odd/agents"))
    with pytest.raises(StoreError, match="without a version"):
        LogStore(spark, str(tmp_path / "odd"))


def test_environment(spark):
    from tracewell.sources.environment import agent_column, probe

    facts = probe("3.34", {"b": "2", "a": "1"})
    row = spark.range(1).select(agent_column(facts).alias("a")).first()["a"]
    assert row["qgis_version"] == "3.34" and row["plugin_versions"] == {"a": "1", "b": "2"}


def test_files(spark, tmp_path):
    import hashlib

    from tracewell.sources.files import hash_files, stat_files

    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    sizes = {r["path"].rpartition("/")[2]: r["size_bytes"] for r in stat_files(spark, str(tmp_path)).collect()}
    assert sizes == {"a.txt": 5, "b.txt": 100}
    out = {r["path"].rpartition("/")[2]: (r["hash_value"], r["hash_strategy"]) for r in hash_files(spark, str(tmp_path), limit_bytes=50).collect()}
    assert out["a.txt"] == (hashlib.sha256(b"hello").hexdigest(), "file") and out["b.txt"][1] == "schema_sample"


def test_large_files_are_hashed_by_content(spark, tmp_path):
    import hashlib
    import os

    from tracewell.sources.files import hash_files

    body = bytes(range(256)) * 20_000
    (tmp_path / "large file.bin").write_bytes(body)
    os.utime(tmp_path / "large file.bin", (1000, 1000))
    hashes = lambda **kw: [tuple(r)[2:] for r in hash_files(spark, str(tmp_path), **kw).collect()]
    assert hashes() == hashes(stream_bytes=50) == [(hashlib.sha256(body).hexdigest(), "file", None)]
    sampled = hashes(limit_bytes=50)
    os.utime(tmp_path / "large file.bin", (2000, 2000))
    assert hashes(limit_bytes=50) == sampled and sampled[0][1] == "schema_sample" and sampled[0][2]
    (tmp_path / "large file.bin").write_bytes(body[:-1] + b"x")  # same size and time
    os.utime(tmp_path / "large file.bin", (2000, 2000))
    assert hashes(limit_bytes=50) != sampled
    assert hashes(stream_bytes=50)[0][0] == hashlib.sha256(body[:-1] + b"x").hexdigest()
