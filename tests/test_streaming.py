from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import functions as F
from test_log import T0, event, layer

from tracewell.operators.dedup import first_wins
from tracewell.sources.store import LogStore
from tracewell.streaming.capture import dedup_stream, read_channels, record_batches, start_times


def drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_stream_decides_like_the_batch(spark, tmp_path):
    rows = [(i, f"g{i % 3}", T0 + timedelta(seconds=(i * 7) % 40), T0 + timedelta(seconds=(i * 7) % 40 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, dedup_group string, start_ts timestamp, end_ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = drain(dedup_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path, "decided")
    want = first_wins(df, group="dedup_group", arrival="id", ident="id", start="start_ts", end="end_ts")
    assert {(r["id"], r["anchor"]) for r in found} == {(r["id"], r["anchor"]) for r in want.collect()}


def test_start_times(spark, tmp_path):
    us = 1_000_000
    rows = [("s", 1, "pre", 10 * us, None), ("s", 2, "post", 12 * us, None), ("s", 3, "post", 13 * us, None), ("s", 4, "pre", 20 * us, None), ("s", 5, "pre", 21 * us, None), ("s", 6, "post", 22 * us, 5), ("s", 7, "post", 23 * us, None), ("s", 8, "pre", 30 * us, None), ("s", 9, "post", 4000 * us, None), ("t", 10, "pre", 50 * us, None), ("t", 11, "post", 49 * us, None)]
    df = spark.createDataFrame(rows, "session_id string, id bigint, kind string, us bigint, given_us bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = drain(start_times(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path, "starts")
    assert {r["id"]: r["started_us"] for r in found} == {2: 10 * us, 3: None, 6: 5, 7: 21 * us, 9: None, 11: None}


def test_record_batches(spark, tmp_path):
    post, history = tmp_path / "post", tmp_path / "history"
    post.mkdir()
    history.mkdir()
    one = event(1, "Buffer", [layer("INPUT", "/a.shp")], [layer("OUTPUT", "/b.shp")], second=10)
    (post / "1.json").write_text(json.dumps([one, one | {"event_id": "bad", "status": "unheard of"}]))
    stream = lambda: record_batches(read_channels(spark, {"post_hook": str(post), "history_signal": str(history)}), str(tmp_path / "log"), str(tmp_path / "ck"), {"availableNow": True})
    stream().awaitTermination(120)
    (history / "2.json").write_text(json.dumps([one | {"event_id": "e2", "source": "history_signal"}]))
    stream().awaitTermination(120)
    store = LogStore(spark, str(tmp_path / "log"))
    assert [(r["capture_channel"], r["corroborations"]) for r in store.activities().collect()] == [("post_hook", 1)]
    assert store.table("entities").count() == 2 and store.table("relations").count() == 3
    assert spark.read.parquet(str(tmp_path / "log/quarantine")).select(F.col("event_id")).collect()[0][0] == "bad"


def test_sessions_are_regrouped(spark, tmp_path):
    """Workflows follow the stream: made, extended, joined; names that people gave stay; members and deletions can be set by hand."""
    import pytest

    from tracewell.sources.store import StoreError

    folder = tmp_path / "in"
    folder.mkdir()
    jobs = [
        event(1, "Buffer", [layer("INPUT", "/a.shp")], [layer("OUTPUT", "/b.shp")], second=10) | {"algorithm_id": "own|buffer"},
        event(2, "Merge", [layer("INPUT", "/x.shp")], [layer("OUTPUT", "/y.shp")], second=20),
        event(3, "Clip", [layer("INPUT", "/b.shp"), layer("OVERLAY", "/y.shp")], [layer("OUTPUT", "/c.shp")], second=30),
        event(4, "Buffer", [layer("INPUT", "/a.shp")], [layer("OUTPUT", "/b.shp")], second=10, source="history_signal") | {"algorithm_id": "own|buffer"},
    ]
    seen = []
    for i, job in enumerate(jobs):
        (folder / f"{i}.json").write_text(json.dumps([job]))
        record_batches(read_channels(spark, {"post_hook": str(folder)}), str(tmp_path / "log"), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(240)
        store = LogStore(spark, str(tmp_path / "log"))
        names = {r["id"]: r["name"] for r in store.workflows().collect()}
        steps = {r["id"]: r["algorithm_name"] for r in store.activities().collect()}
        members = {}
        for r in store.members().orderBy("sequence_order").collect():
            members.setdefault(r["workflow_id"], []).append(steps[r["activity_id"]])
        assert set(members) == set(names)
        seen.append(sorted((names[w], members[w]) for w in names))
    joined = [("Buffer, then Merge, then Clip", ["Buffer", "Merge", "Clip"])]
    assert seen == [[("Buffer", ["Buffer"])], [("Buffer", ["Buffer"]), ("Merge", ["Merge"])], joined, joined]
    assert sorted(r["corroborations"] for r in store.activities().collect()) == [0, 0, 1]
    (flow,) = names
    first = store.members().orderBy("sequence_order").first()["activity_id"]
    store.update_workflow("r", flow, name="Flood risk")
    store.update_workflow("r2", flow)  # nothing to change
    store.replace_members("m", flow, [first])
    assert [r["activity_id"] for r in store.members().collect()] == [first] and store.workflows().first()["name"] == "Flood risk"
    store.regroup("again", store.activities().select("session_id"))
    assert store.members().count() == 3 and store.workflows().first()["name"] == "Flood risk"
    assert store.corroborate("c", first, "e9", "run_wrapper", T0) == 2
    store.delete_workflow("d", flow)
    assert store.workflows().count() == store.members().count() == 0 and store.activities().count() == 3
    assert store.summary()["workflow_activities"] == 0 and store.summary()["activities"] == 3
    for act in (lambda: store.update_workflow("u", "nothing", name="x"), lambda: store.delete_workflow("u", "nothing"), lambda: store.replace_members("u", "nothing", []), lambda: store.corroborate("u", "nothing", "e", "run_wrapper", T0)):
        with pytest.raises(StoreError, match="no (workflow|activity)"):
            act()
    store.regroup("back", store.activities().select("session_id"))  # a group that comes back
    assert store.workflows().count() == 1 and store.members().count() == 3


def test_versions_go_on_in_later_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    jobs = [
        event(1, "Buffer", [layer("INPUT", "/a.shp")], [layer("OUTPUT", "/b.shp"), layer("EXTRA", None)], second=10),
        event(2, "Clip", [layer("INPUT", "/b.shp")], [layer("OUTPUT", "/b.shp"), layer("EXTRA", None)], second=100),
        event(3, "Merge", [layer("INPUT", "/b.shp"), layer("INPUT", "/a.shp")], [layer("OUTPUT", "/b.shp"), layer("EXTRA", "")], second=200),
    ]
    for i, job in enumerate(jobs):
        (folder / f"{i}.json").write_text(json.dumps([job]))
        record_batches(read_channels(spark, {"post_hook": str(folder)}), str(tmp_path / "log"), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(120)
    store = LogStore(spark, str(tmp_path / "log"))
    entities = {r["id"]: (r["file_path"] or None, r["content_version"]) for r in store.table("entities").collect()}
    assert sorted(entities.values(), key=str) == sorted([("/a.shp", 1), ("/b.shp", 1), ("/b.shp", 2), ("/b.shp", 3), (None, 1), (None, 1), (None, 1)], key=str)
    names = {r["id"]: r["algorithm_name"] for r in store.table("activities").collect()}
    relations = store.table("relations").collect()
    made = sorted((names[r["target_id"]], entities[r["source_id"]]) for r in relations if r["relation_type"] == "wasGeneratedBy" and entities[r["source_id"]][0])
    used = sorted((names[r["source_id"]], entities[r["target_id"]]) for r in relations if r["relation_type"] == "used")
    assert made == [("Buffer", ("/b.shp", 1)), ("Clip", ("/b.shp", 2)), ("Merge", ("/b.shp", 3))]
    assert used == [("Buffer", ("/a.shp", 1)), ("Clip", ("/b.shp", 1)), ("Merge", ("/a.shp", 1)), ("Merge", ("/b.shp", 2))]
