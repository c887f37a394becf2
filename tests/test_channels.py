from __future__ import annotations

import datetime
import decimal
import enum
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.functions.plain import plain, plain_parameters
from tracewell.sources.channels import drop_folder, observed, signal_entry


class Thing:
    def __init__(self, **answers):
        for k, v in answers.items():
            setattr(self, k, (lambda v=v: v) if k not in ("source", "entry", "id", "timestamp") else v)


class Broken:
    def __repr__(self):
        raise ValueError


def test_plain_values():
    deep = {"a": [1, {"b": {"c": {"d": {"e": {"f": 1}}}}}]}
    kind = enum.Enum("kind", {"ONE": 1})
    values = [None, True, 3, 2.5, float("nan"), decimal.Decimal("1.5"), "x", b"\xff", [1, (2,)], {3}, kind.ONE, Path("/a"), datetime.date(2026, 8, 8), deep, Broken(), object()]
    texts = [plain(v) for v in values]
    json.dumps(texts)
    assert texts[:13] == [None, True, 3, 2.5, "nan", 1.5, "x", "�", [1, [2]], [3], 1, "/a", "2026-08-08"]
    assert "{'f': 1}" in json.dumps(texts[13]) and "Broken" in texts[14] and "0x…" in texts[15]
    assert plain(Thing(authid="EPSG:4326")) == "EPSG:4326" and plain(Thing(authid="", toWkt="WKT")) == "WKT" and plain(Thing(authid="", toWkt="")) is None
    assert plain(Thing(isNull=True)) is None and plain(Thing(expressionString="a + b")) == "a + b" and plain(Thing(expressionString="", staticValue=[1])) == [1]
    assert plain(Thing(source="/d.shp", selectedFeaturesOnly=True)) == "/d.shp|selectedFeaturesOnly=yes" and plain(Thing(source="/d.shp", selectedFeaturesOnly=False)) == "/d.shp"
    assert plain(Thing(toString="0,0 : 1,1")) == "0,0 : 1,1"
    assert plain_parameters({1: (2, 3)}) == {"1": [2, 3]} and plain_parameters([1]) == {"_parameters": [1]}


def test_wrapper_writes_failures_and_passes_them_on(tmp_path):
    def run(algorithm, parameters):
        if parameters["n"] < 0:
            raise KeyError("no")
        return {"OUTPUT": "/o.gpkg"}

    wrapped = observed(run, drop_folder(str(tmp_path)), "s")
    assert observed(wrapped, print, "s") is wrapped and wrapped("native:buffer", {"n": 1}) == {"OUTPUT": "/o.gpkg"}
    with pytest.raises(KeyError, match="no"):
        wrapped("native:buffer", {"n": -1})
    rows = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    assert sorted((r["status"], r["parameters"]["n"], r["results"].get("OUTPUT")) for r in rows) == [("completed", "1", "/o.gpkg"), ("failed", "-1", None)]
    fails = lambda row: 1 / 0
    assert observed(run, fails, "s")("x", {"n": 2}) == {"OUTPUT": "/o.gpkg"}


def test_signal_arguments_by_shape():
    payload = {"algorithm_id": "a"}
    entry = Thing(id=7, entry=payload, timestamp="t")
    for args, want in (((5, payload), ("5", True, None)), ((entry,), ("7", True, "t")), ((entry, 3), ("7", True, "t")), (((9, payload, "t"),), ("9", True, "t")), ((payload, 4), (None, True, None)), (("12", payload), ("12", True, None)), ((True,), (None, False, None)), ((), (None, False, None))):
        got = signal_entry(*args)
        assert (got["entry_id"], got["payload"] is not None, got["timestamp"]) == want, args


def test_parameters_that_are_no_object(spark):
    rows = [('{"a":1}',), ("[1,2]",), ('"x"',), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.parameters_object(F.try_parse_json("t"))).collect()]
    assert out == ['{"a":1}', '{"_parameters":[1,2]}', '{"_parameters":"x"}', "{}"]
    values = [('{"source":"/d","selectedFeaturesOnly":true}',), ('{"source":"/d","selectedFeaturesOnly":false}',), ("[1]",), ("plain",), (None,)]
    out = [r[0] for r in spark.createDataFrame(values, "t string").select(S.selection("t")).collect()]
    assert out == ["/d|selectedFeaturesOnly=yes", values[1][0], "[1]", "plain", None]


def test_history_stream_drops_late_entries(spark, tmp_path):
    from test_streaming import drain

    from tracewell.streaming.capture import follow_history

    rows = [(1, "5", None), (2, "7", None), (3, "6", None), (4, "7", "processing"), (5, "9", "other"), (6, "8", None), (7, "x", None)]
    df = spark.createDataFrame(rows, "arrival bigint, entry_id string, provider string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = drain(follow_history(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), start=5), tmp_path, "followed")
    assert sorted(tuple(r) for r in found) == [(1, 5, True), (2, 7, False), (3, 6, True), (4, 7, True), (5, 9, False), (6, 8, False)]


def test_events_written_as_json_are_read_back(spark, tmp_path):
    from test_log import event, layer

    from tracewell.sources.events import read_events, write_json

    (tmp_path / "e.json").write_text(json.dumps([event(1, "Buffer", [layer("INPUT", "/a")], [], second=1), event(2, "Clip", [], [layer("OUTPUT", None)], second=2)]))
    events = read_events(spark, str(tmp_path / "e.json"))
    write_json(events, str(tmp_path / "out"))
    text = lambda df: [str(r) for r in df.withColumn("parameters", F.to_json("parameters")).collect()]
    assert text(read_events(spark, str(tmp_path / "out"), multi_line=False)) == text(events)
