from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import suffix_dedup as D


def brute(texts, length=D.LENGTH):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cut) if not c)
        runs = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, flood", [(D.HOT, D.FLOOD), (1, D.FLOOD), (1, 2)])
def test_same_as_all_windows(docs, rows, hot, flood):
    """Keys sorted whole, dealt out by distance, and by window give the same."""
    got = Counter(tuple(r) for r in D.dedup(docs, hot=hot, flood=flood).collect())
    assert got == Counter((doc, *x) for (doc, _), x in zip(rows, brute([t for _, t in rows])))


def test_strip(docs, rows):
    out = D.strip(docs)
    assert out.schema == docs.schema
    sizes = {d: n - m for (d, _), (n, m, *_) in zip(rows, brute([t for _, t in rows])) if d is not None and d != 140}
    assert {r["doc_id"]: len((r["text"] or "").encode()) for r in out.collect() if r["doc_id"] in sizes} == sizes


def test_empty(empty):
    assert D.dedup(empty).count() == 0 and D.strip(empty).count() == 0


def test_sort_is_a_suffix_sort():
    rng = random.Random(1)
    data = np.array([rng.choice(b"ab") for _ in range(900)], np.uint8)
    s = D.Suffixes(data, 40)
    starts = np.array(rng.sample(range(850), 400))
    group = np.sort(np.array([rng.randrange(5) for _ in starts]))
    got = s.sort(starts, group)
    for g in range(5):
        text = [bytes(data[i : i + 40]) for i in got[group == g]]
        assert text == sorted(text) and sorted(got[group == g]) == sorted(starts[group == g])
    x, y = np.array([0, 5, 9]), np.array([100, 5, 333])
    want = [next((k for k in range(40) if data[a + k] != data[b + k]), 40) for a, b in zip(x, y)]
    assert s.common(x, y).tolist() == want


def test_segments_cover_all_windows():
    rng = random.Random(2)
    body = bytes(rng.choice(b"abcd ") for _ in range(3000))
    key, start, n, twice = D.segments_of(body)
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and n.sum() == 3000 - D.LENGTH + 1
    old, D._CHUNK = D._CHUNK, 257
    try:
        again = D.segments_of(body)
    finally:
        D._CHUNK = old
    assert all((a == b).all() for a, b in zip(again, (key, start, n, twice)))
    assert D.segments_of(b"xy" * 300)[3].any()


def test_common_passage_and_long_texts(spark, tmp_path):
    """A passage in a third of the rows between different words, a text that repeats it, and a very long text, over all three ways to deal a key."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join([word() for _ in range(40)] + ([passage] if i % 3 == 0 else []) + [word() for _ in range(40)])) for i in range(240)]
    rows += [(900, (passage + " ") * 3), (901, " ".join(word() for _ in range(60_000)) + passage), (902, "z" * 300_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    want = Counter((doc, *x) for (doc, _), x in zip(rows, brute([t for _, t in rows])))
    for hot, flood in ((D.HOT, D.FLOOD), (20, D.FLOOD), (5, 30)):
        assert Counter(tuple(r) for r in D.dedup(df, hot=hot, flood=flood).collect()) == want
