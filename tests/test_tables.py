from __future__ import annotations

from tracewell.plans import tables
from tracewell.plans.components import connected_components


def test_stored_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(tables, "_written", [])
    df = tables.stored(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()[0].startswith(tables.shared_dir(spark).split(":")[0])
    assert tables.drop_stored(spark) == 1 and tables.drop_stored(spark) == 0
    kept, mark = tables.stored(spark.range(2), "kept"), tables.stored_so_far()
    frames = [tables.stored(spark.range(i), "more") for i in (3, 4)]
    assert tables.drop_stored(spark, since=mark, last=False) == 1 and kept.count() == 2 and frames[1].count() == 4
    assert tables.drop_stored(spark) == 2


def test_small_tables_get_few_files(spark, monkeypatch):
    monkeypatch.setattr(tables, "_written", [])
    wide = tables.stored(spark.range(1000).repartition(50, "id"), "wide")
    assert len(wide.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism and wide.count() == 1000


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7), (5, None), (30, 20), (20, 40), (40, 25), (25, 50)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 25: 20, 30: 20, 40: 20, 50: 20} | {100 + i: 100 for i in range(41)}
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_tables_of_numbered_rows_get_few_files(spark, tmp_path, monkeypatch):
    """The numbers of several files count as what they are, not as more than any table; next to nothing becomes one file."""
    from tracewell.llm.common import numbered

    monkeypatch.setattr(tables, "_written", [])
    spark.range(3000).repartition(3).write.parquet(str(tmp_path / "many"))
    rows = numbered(spark.read.parquet(str(tmp_path / "many")))
    assert rows.select("rid").distinct().count() == 3000
    wide = tables.stored(rows.repartition(50, "rid"), "wide")
    assert len(wide.inputFiles()) <= 2 and wide.count() == 3000
