from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("memory:x", None), ("memory", None), ("TEMPORARY_OUTPUT", None), ("/vsimem/t.tif", None), ("/vsizip/a.zip", None), ("vsimem/t", None), ("", None), ("   ", None), (None, None), ("<object>", None),
        ("/d/city.gpkg|layername=roads", "/d/city.gpkg"), ("/d/city.gpkg|layerid=0", "/d/city.gpkg"), (" /d/a.shp|subset=x|selectedFeaturesOnly=yes ", "/d/a.shp"), ("/d/a.shp", "/d/a.shp"), ("|layername=a", None),
    ],
)
def test_file_path(spark, raw, want):
    assert one(spark, S.file_path(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("names", "want"), [([], "Untitled work"), ([" ", ""], "Untitled work"), (["Buffer"], "Buffer"), (["Buffer", "Clip "], "Buffer, then Clip"), (["A", "B", "C"], "A, then B, then C"), (["Buffer", "b", "c", "Centroids"], "Buffer to Centroids (4 steps)")])
def test_suggested_name(spark, names, want):
    assert one(spark, S.suggested_name(F.lit(names) if names else F.array().cast("array<string>"))) == want


def test_times(spark):
    assert one(spark, S.iso_micros(F.lit("2026-08-08T10:00:10+00:00").cast("timestamp"))) == "2026-08-08T10:00:10.000000+00:00"
    assert one(spark, S.bucket_time(F.lit("2026-08-08T10:00:10.199999+00:00"))) == "2026-08-08T10:00:10.100000+00:00"
    assert one(spark, S.bucket_time(F.lit("later"))) == "later"
    assert one(spark, S.entry_time(F.lit("soon"))) is None
    assert one(spark, S.human_time(F.lit("2026-08-18T14:31:00Z").cast("timestamp"))) == "18 Aug 2026, 2:31 pm"
    assert one(spark, S.seconds_between(F.lit("2026-08-18T14:31:00Z"), F.lit("2026-08-18T14:31:31.5Z"))) == 31.5


def test_values(spark):
    assert one(spark, S.canonical_format(F.lit(" GTiff "))) == "GeoTIFF"
    assert one(spark, S.canonical_format(F.lit("ogr"))) == "ogr"
    assert one(spark, S.provider_of(F.lit(None).cast("string"), F.lit("native:buffer"))) == "native"
    assert one(spark, S.provider_of(F.lit("qgis"), F.lit("native:buffer"))) == "qgis"
    assert one(spark, S.provider_of(F.lit(""), F.lit("buffer"))) is None
    assert one(spark, S.whole_number(F.lit("-1"))) is None
    assert one(spark, S.finite_number(F.lit("nan"))) is None
    assert one(spark, S.as_int(F.lit(" 12 "))) == 12
    assert one(spark, S.masked(F.lit("<Thing object at 0x7f3cAB>"))) == "<Thing object at 0x…>"
    assert [one(spark, S.human_size(F.lit(n))) for n in (12, 42 * 1024, 5 * 1024**4)] == ["12 bytes", "42.0 KB", "5120.0 GB"]
    assert [one(spark, S.and_list(F.lit(x))) for x in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b and c"]


def test_keys_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([('{"A":1,"B":2}',), ('{"B": 2, "A": 1}',), ('{"A":1,"B":3}',)], "p string")
    keys = [r[0] for r in rows.select(S.dedup_group(F.lit("native:buffer"), S.canonical_json("p"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_last_parameter_of_a_name_counts(spark):
    layer = "array<struct<param:string,path:string>>"
    df = spark.createDataFrame([({"D": "5"}, [("INPUT", "/a"), ("INPUT", "/b")], [("OUTPUT", "/c")])], f"s map<string,string>, i {layer}, o {layer}")
    assert df.select(S.dedup_parameters("s", "i", "o")).first()[0] == {"D": "5", "INPUT": "/b", "OUTPUT": "/c"}


def test_environment_fingerprint_ignores_map_order(spark):
    env = "q string, o string, p string, m map<string,string>"
    rows = spark.createDataFrame([("3", "l", "3.10", {"a": "1", "b": "2"}), ("3", "l", "3.10", {"b": "2", "a": "1"}), ("4", "l", "3.10", {"a": "1", "b": "2"})], env)
    prints = [r[0] for r in rows.select(S.environment_fingerprint("q", "o", "p", "m")).collect()]
    assert prints[0] == prints[1] != prints[2]
