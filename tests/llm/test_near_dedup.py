from __future__ import annotations

import random
from collections import Counter

import pytest

from tracewell.llm import near_dedup as N


def brute(rows, width, percent=80):
    sets = [N.shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return Counter((doc, len(s), names.get(find(i)) if s else doc, doc == (names.get(find(i)) if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("width", [2, 5])
def test_same_as_all_pairs(docs, rows, width):
    got = N.link(docs, shingle=width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == brute(rows, width)


def test_large_groups_and_borderline_pairs(spark, tmp_path, monkeypatch):
    """Groups larger than a leaf, with members that miss the smallest one: every path of the join is taken."""
    monkeypatch.setattr(N, "_OTHERS", 8)
    monkeypatch.setattr(N, "_MEMBERS", 16)
    monkeypatch.setattr(N, "_BLOCK", 700)
    monkeypatch.setattr(N, "_STAR", 8)
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(60)]
    for i in range(220):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 8))):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert Counter(map(tuple, N.link(df).select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(rows, 2)


def test_keep_one(docs, rows):
    kept = N.keep_one(docs, shingle=2)
    assert kept.columns == docs.columns
    groups = N.link(docs).collect()
    roots = {r["root"] for r in groups if r["root"] is not None}
    assert kept.count() == len(roots) + sum(r["root"] is None for r in groups)


def test_empty(empty):
    assert N.link(empty).count() == 0 and N.keep_one(empty).count() == 0


def test_rows_keep_their_numbers(spark, tmp_path):
    """Numbers, links and kept rows don't depend on how many splits the files are read in, even if that changes midway."""
    from tracewell.llm.common import numbered

    rng, words = random.Random(5), [f"w{i}" for i in range(300)]
    rows = [(i % 700, " ".join(rng.choices(words, k=12)) if i % 3 else "the very same words in every third of these rows") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(keys[1], "1k")
        spark.conf.set(keys[0], "4")
        of = numbered(df)
        parts, few = of.rdd.getNumPartitions(), {r["rid"]: tuple(r["doc"]) for r in of.collect()}
        kept = N.keep_one(df)
        spark.conf.set(keys[0], "16")
        again = df.sparkSession.read.parquet(str(tmp_path / "d"))
        assert numbered(again).rdd.getNumPartitions() > parts
        assert {r["rid"]: tuple(r["doc"]) for r in numbered(again).collect()} == few == {r["rid"]: tuple(r["doc"]) for r in of.collect()} and len(few) == 3000
        assert kept.count() == N.link(again).where("root = s").select("s").distinct().count()
        assert sum(r["text"].startswith("the very") for r in kept.collect()) == 1
    finally:
        for k in keys:
            spark.conf.unset(k)
    twice = numbered(df.unionAll(df))  # no scan of files: stored with their numbers
    assert twice.select("rid").distinct().count() == 6000


def test_long_texts_in_portions(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcd", k=rng.choice((1, 3, 9)))) for _ in range(4000)).encode()
    whole = {w: N.shingle_hashes([text], w)[0] for w in (1, 2, 5)}
    monkeypatch.setattr(N, "_PORTION", 500)
    assert all((N.set_of(text, w) == whole[w]).all() for w in whole)
    long_word = b"x" * 5000 + b" y " + b"z" * 2000 + b" y z"
    assert (N.set_of(long_word, 2) == N.shingle_hashes([long_word], 2)[0]).all()


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(4)
    words = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(600_000)]
    one, other = " ".join(words), " ".join(words[:1000] + ["odd"] + words[1000:])
    spark.createDataFrame([(1, one), (2, other), (3, one.upper()), (4, "  ".join(words)), (5, "x" * 3_000_000)], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["component_id"] for r in N.link(spark.read.parquet(str(tmp_path / "d")), shingle=5).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_hashes_follow_sets():
    texts = [b"a b c a b", b"b c a b", b"a  b\tc\na b", b"", b"one", b"a b c"]
    h = [set(x.tolist()) for x in N.shingle_hashes(texts, 2)]
    assert h[0] == h[2] and h[0] == h[1] and len(h[0]) == 3 and not h[3] and len(h[4]) == 1 and h[5] < h[0]
    assert [len(x) for x in N.shingle_hashes(texts, 5)] == [1, 1, 1, 0, 1, 1]
