from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from tracewell.operators.dedup import corroborations, first_wins

T0 = datetime(2026, 8, 8, 10, 0, 0, tzinfo=timezone.utc)
SCHEMA = "id bigint, g string, s timestamp, e timestamp"


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def decide(spark, rows, margin=2.0):
    df = spark.createDataFrame([(i, g, at(s), at(e)) for i, g, s, e in rows], SCHEMA)
    return {r["id"]: r["anchor"] for r in first_wins(df, group="g", arrival="id", ident="id", start="s", end="e", margin_s=margin).collect()}


def brute(rows, margin=2.0):
    runs, out = {}, {}
    for i, g, s, e in sorted(rows):
        hits = [] if s is None else [r for r in runs.get(g, []) if r[0] - margin <= s <= r[2] + margin]
        if hits:
            out[i] = min(hits)[1]
        else:
            out[i] = i
            if s is not None:
                runs.setdefault(g, []).append((s, i, max(s, s if e is None else e)))
    return out


def test_cases(spark):
    # two channels; a late sighting; a straddled grid line; re-runs; another group; no time
    rows = [(1, "a", 22.4, 23.0), (2, "a", 22.9, None), (3, "a", 23.5, 23.5), (4, "a", 30.0, 31.0), (5, "a", 3600.0, 3601.0), (6, "b", 22.4, 23.0), (7, "a", None, None), (8, "a", None, None), (9, "c", 5.0, 1.0), (10, "c", 6.9, None)]
    assert decide(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9}


def test_same_as_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, f"g{rng.randrange(6)}", *(None if rng.random() < 0.05 else round(rng.random() * 400_000, 3) for _ in range(1)), None) for i in range(600)]
    rows = [(i, g, s, None if s is None or rng.random() < 0.2 else s + rng.random() * rng.choice((5, 3000, 100_000)) - 1) for i, g, s, _ in rows]
    for margin in (2.0, 900.0):
        assert decide(spark, rows, margin) == brute(rows, margin)


def test_runs_in_blocks():
    from tracewell.operators.dedup import Runs

    rng = random.Random(3)
    for block in (2, 5, 1024):
        Runs._BLOCK = block
        runs, plain = Runs(3), []
        for i in range(600):
            s = rng.randrange(4000)
            hits = [r for r in plain if r[0] - 3 <= s <= r[2] + 3]
            assert runs.find(s) == (min(hits)[1] if hits else None)
            if not hits:
                e = s + rng.choice((0, 1, 40))
                runs.add(s, i, e)
                plain.append((s, i, e))
    Runs._BLOCK = 1024


def test_one_island_that_is_never_idle(spark):
    """Half a million sightings of one group, each within reach of the one before."""
    from pyspark.sql import functions as F

    df = spark.range(500_000).select("id", F.lit("g").alias("g"), F.timestamp_micros(F.col("id") * 1_500_000).alias("s"), F.timestamp_micros(F.col("id") * 1_500_000 + 100_000).alias("e"))
    out = first_wins(df, group="g", arrival="id", ident="id", start="s", end="e", margin_s=2.0)
    # a run takes the sighting after it; the one after that starts anew
    assert out.where("anchor <> id - id % 2").isEmpty() and out.count() == 500_000


def test_counts(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id bigint, anchor bigint")
    assert {r["id"]: r["corroborations"] for r in corroborations(df).collect()} == {1: 1, 3: 0}


def test_empty(spark):
    assert decide(spark, []) == {}
