"""Every catalogue query against its SQL."""

from __future__ import annotations

import json
import math
from pathlib import Path

import duckdb
import pytest

from tracewell import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalog.ALL_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == columns
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def test_export_of_every_workflow(spark, con):
    documents = catalog.prov_export_all(spark, DATA).collect()
    got = {r["session_id"]: json.loads(r["document"]) for r in documents}
    orders, lines = con.sql("SELECT o_orderkey, o_custkey FROM orders").fetchall(), con.sql("SELECT DISTINCT l_orderkey, l_partkey, l_linestatus, l_returnflag FROM lineitem").fetchall()
    customer = dict(orders)
    assert len(customer) == len(orders) and len(documents) == len(got) and set(got) == set(customer.values()) and len(got) > 1
    want = {c: {"activity": set(), "entity": set(), "used": set(), "wasGeneratedBy": set()} for c in got}
    for o, c in orders:
        want[c]["activity"].add(f"log:a{o}")
    for o, p, status, flag in lines:
        if o in customer:
            one = want[customer[o]]
            one["entity"].add(f"log:e{p}")
            if status == "F":
                one["used"].add((f"log:a{o}", f"log:e{p}", "overlay" if flag == "R" else "input"))
            else:
                one["wasGeneratedBy"].add((f"log:e{p}", f"log:a{o}", "output"))
    ends = {"used": ("prov:activity", "prov:entity"), "wasGeneratedBy": ("prov:entity", "prov:activity")}
    for c, doc in got.items():
        assert set(doc["activity"]) == want[c]["activity"] and set(doc["entity"]) == want[c]["entity"] and set(doc["agent"]) == {"log:agent"}
        for kind, (a, b) in ends.items():
            rows = [(x[a], x[b], x["prov:role"]) for x in doc[kind].values()]
            assert len(rows) == len(set(rows)) and set(rows) == want[c][kind]


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.SQL) <= set(__spark_entry__.oracle_sql())
