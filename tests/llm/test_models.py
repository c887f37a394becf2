"""Language-model scores and graph search."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import ann_graph, lm_scoring


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def ppm_loop(training, texts, order):
    """log10 probability, a byte at a time, from dictionaries."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in training:
        line = bytes([lm_scoring.PAD] * order) + t + bytes([lm_scoring.END])
        for i in range(order, len(line)):
            for k in range(order + 1):
                counts[k][line[i - k : i]][line[i]] += 1

    def prob(k, context, s):
        if k < 0:
            return 1.0 / lm_scoring.SYMBOLS
        seen = counts[k].get(context[len(context) - k :])
        if not seen:
            return prob(k - 1, context, s)
        n, t = sum(seen.values()), len(seen)
        if s in seen:
            return seen[s] / (n + t)
        rest = 1.0 - sum(prob(k - 1, context, x) for x in seen)
        return t / (n + t) * prob(k - 1, context, s) / rest

    out = []
    for t in texts:
        line = bytes([lm_scoring.PAD] * order) + t + bytes([lm_scoring.END])
        out.append(sum(math.log10(prob(order, line[i - order : i], line[i])) for i in range(order, len(line))))
    return out


def test_scores(docs, rows):
    rows = [(d, t) for d, t in rows]
    got = defaultdict(list)
    for r in lm_scoring.score(docs, max_head=5).collect():
        got[r["doc_id"]].append(r)
    training = [(t or "").encode() for d, t in rows if not held(d)]
    counts = Counter(w for t in training for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    few = [(d, t) for d, t in rows if t is None or len(t) < 700]
    wanted = dict(zip([d for d, _ in few], ppm_loop(training, [(t or "").encode() for _, t in few], lm_scoring.ORDER)))
    for d, t in rows:
        if d is None:
            continue
        r = got[d][0]
        tokens = [*(t or "").encode().lower().split(), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
        if d in wanted:
            assert math.isclose(r["score"], wanted[d], rel_tol=1e-4, abs_tol=1e-3)


def test_model_is_a_distribution():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(300)).encode() for _ in range(20)]
    keys = np.concatenate([k for k, _ in lm_scoring._keys(texts)])
    levels = [np.unique(keys & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True) for k in range(lm_scoring.ORDER + 1)]
    # a pruned trie is one too
    for least in (1, 3):
        model = lm_scoring.Model([(u[c >= least], c[c >= least]) for u, c in levels])
        contexts = np.unique(keys >> np.uint64(8))[:60]
        symbols = np.array([b for b in range(256) if b != lm_scoring.PAD], np.uint64)
        p = 10 ** model.log10(((contexts[:, None] << np.uint64(8)) | symbols).ravel()).reshape(len(contexts), -1)
        assert np.allclose(p.sum(1), 1, atol=1e-5)


def test_scores_beyond_what_is_sent(docs):
    """Orders too large to send give the scores of the whole model, whichever of them are."""
    scores = lambda **kw: sorted((str(r["doc_id"]), r["score"]) for r in lm_scoring.score(docs, **kw).collect())
    want = scores()
    grams = lm_scoring.count(docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1).select("text")).where("gram IS NOT NULL")
    kinds = [grams.select(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))).distinct().count() for k in range(lm_scoring.ORDER + 1)]
    assert 100 < kinds[2] < kinds[3] < kinds[4]
    for most in (100, kinds[2], kinds[3], kinds[4] - 1):
        got = scores(max_grams=most)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-3) for (_, a), (_, b) in zip(got, want))


def test_keys_of_long_texts(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice((0, 1, 3, 400)))) for _ in range(40)]
    whole = [np.concatenate(x) for x in zip(*lm_scoring._keys(texts))]
    want = [int.from_bytes(line[i - lm_scoring.ORDER : i + 1]) for t in texts for line in [bytes([lm_scoring.PAD] * lm_scoring.ORDER) + t + bytes([lm_scoring.END])] for i in range(lm_scoring.ORDER, len(line))]
    assert whole[0].tolist() == want and whole[1].tolist() == [i for i, t in enumerate(texts) for _ in range(len(t) + 1)]
    for step in (1, 7, 100):
        monkeypatch.setattr(lm_scoring, "_STEP", step)
        assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*lm_scoring._keys(texts))))


def test_scores_of_a_very_long_text(spark, tmp_path):
    rows = [(1, "the same words again " * 60_000), (2, "the same words again"), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Tail", F.lit(1)).withColumn("rest", F.lit(2)).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in lm_scoring.score(spark.read.parquet(str(tmp_path / "d"))).collect()}
    training = [(t or "").encode() for d, t in rows if not held(d)]
    want = dict(zip((2, 3), ppm_loop(training, [b"the same words again", b""], lm_scoring.ORDER)))
    assert all(math.isclose(got[d]["score"], want[d], rel_tol=1e-4, abs_tol=1e-3) for d in want) and got[1]["n_tokens"] == 240_001


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    t = lm_scoring.Table(keys, np.arange(len(keys), dtype=np.float64))
    hit, value = t.find(np.concatenate([keys, keys + np.uint64(1 << 41)]))
    assert hit[: len(keys)].all() and not hit[len(keys) :].any() and (value[: len(keys)] == np.arange(len(keys))).all()


def test_counts_fit_a_bound(spark):
    df = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [3] * 9 + [100] * 5 + [5000, 5001, 70_000]], "n bigint")
    for most in (0, 1, 2, 3, 7, 8, 16, 17, 37, 60, 87, 1000):
        least = lm_scoring._least_count(df, most)
        assert df.where(F.col("n") >= least).count() <= most or most == 0
        assert most not in (3, 8, 17, 37, 87, 1000) or df.where(F.col("n") >= least).count() == min(most, 87)


def test_scores_of_nothing(empty, docs):
    assert lm_scoring.score(empty).count() == 0


# ------------------------------------------------------------------------------------------------- search


def brute(rows, k=20):
    ids, vectors = [], []
    for i, v in sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}):
        ids.append(i)
        vectors.append(v)
    out = {}
    for i, v in zip(ids, vectors):
        if i % 20 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in zip(ids, vectors) if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in hits[:k]]
    return out


def test_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(float).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 16) for i in range(60)] + [(2000, [1.0] * 16)]  # equal vectors and a repeated row
    rows += [(3000, None), (3020, []), (3040, [0.0] * 16), (3060, [1.0] * 15 + [None]), (3080, [float("nan")] * 16), (3100, [float("inf")] * 16), (None, [1.0] * 16), (3120, [1.0, 2.0, 3.0]), (3121, [1.0, 2.0, 4.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    got = defaultdict(list)
    for r in ann_graph.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows)
    assert set(got) == set(want)
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    vectors = {i: v for i, v in rows}
    for q, hits in got.items():
        assert len(hits) == min(20, len(want[q]))
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert all(math.isclose(s, float(np.dot(vectors[q], vectors[v])), rel_tol=1e-12) for v, s in hits)
    assert got[2000] == want[2000]


def recall(got, want):
    return sum(len(set(got[q]) & set(want[q])) for q in want) / max(1, sum(map(len, want.values())))


def exact(ids, vectors, k=20):
    """The k nearest of every 20th id by all products, ties to the smaller id."""
    products = vectors @ vectors.T
    out = {}
    for place, i in enumerate(ids):
        if i % 20 == 0:
            order = np.lexsort((ids, -products[place]))
            out[int(i)] = [int(ids[j]) for j in order if j != place][:k]
    return out


def searched(spark, path, vectors, **options):
    rows = [(i, v.tolist(), "x", i) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, Shard string, dim int").write.parquet(path)
    slim = spark.read.parquet(path).select("vec_id", "embedding")
    out = defaultdict(list)
    for r in ann_graph.search(ann_graph.index(slim, 20, **options), slim.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["vec_id"])
    return out


def test_recall_over_several_shards(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(3000, 48))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    assert recall(searched(spark, str(tmp_path / "v"), vectors, shard_rows=700), exact(np.arange(3000), vectors)) >= 0.95


def test_recall_with_very_large_vectors(spark, tmp_path):
    """One vector of norm 10^4, one of 10^20, some tiny ones: the others are found as without them."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2000, 48))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[7] *= 1e4
    vectors[11] *= 1e20
    vectors[40] *= 1e-30
    vectors[60:80] *= rng.uniform(0.1, 30, 20)[:, None]
    assert recall(searched(spark, str(tmp_path / "v"), vectors), exact(np.arange(2000), vectors)) >= 0.95


def test_recall_with_a_hot_cluster(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(2400, 32))
    vectors[::2] = vectors[0] + 0.05 * rng.normal(size=(1200, 32))
    vectors[::30] = vectors[0]  # and copies
    got, want = searched(spark, str(tmp_path / "v"), vectors), exact(np.arange(2400), vectors)
    assert recall(got, want) >= 0.9


def test_search_with_ids_of_many_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    near = np.ones(8) + 0.01 * rng.normal(size=(400, 8))
    rows = [(0, [1.0] * 8)] + [(1 + i % 2, v.tolist()) for i, v in enumerate(near)] + [(10 + i, (0.5 * rng.normal(size=8)).tolist()) for i in range(200) if (10 + i) % 20]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "v"))
    got = [(r["vec_id"], r["score"]) for r in ann_graph.nearest(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") == 0).orderBy("rank").collect()]
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -math.inf), sum(v))
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    assert len(got) == 20 and [i for i, _ in got][:2] == want[:2] and len({i for i, _ in got} & set(want)) >= 19
    assert all(math.isclose(s, best[i], rel_tol=1e-12) for i, s in got)


def test_back_edges_are_all_considered(monkeypatch):
    """Nothing that overflows a node is dropped unseen."""
    seen = set()
    prune = ann_graph.robust_prune

    def watched(data, nodes, candidates, degree, alpha):
        seen.update((int(x), int(c)) for x, row in zip(nodes, candidates) for c in row if c >= 0)
        return prune(data, nodes, candidates, degree, alpha)

    monkeypatch.setattr(ann_graph, "robust_prune", watched)
    rng = np.random.default_rng(2)
    # spokes about a hub: all of a batch point back to it
    data = np.concatenate([np.zeros((1, 32)), 10 * np.eye(32)[rng.integers(0, 32, 1500)] + rng.normal(size=(1500, 32))]).astype(np.float32)
    edges, entry = ann_graph.build(data, 4, 16, 1.15)
    got = {c for x, c in seen if x == entry}
    assert len(got) > 4 * 4
    reach, todo = {entry}, [entry]
    while todo:
        new = {int(c) for x in todo for c in edges[x] if c >= 0} - reach
        reach |= new
        todo = list(new)
    assert len(reach) == len(data)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ann_graph.nearest(df, F.col("vec_id") % 20 == 0).count() == 0


def test_prune_keeps_diverse_edges():
    data = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3], [-2, 0]], np.float32)
    out = ann_graph.robust_prune(data, np.array([0]), np.array([[0, 1, 2, 3, 4, 1, -1]]), 3, 1.2)
    assert out.tolist() == [[1, 4, 3]]
