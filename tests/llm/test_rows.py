"""Splits that change while an operator runs, columns whose names clash with an operator's own, and very long texts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import prose
from pyspark.sql import functions as F
from test_texts import statistics

from tracewell.llm import common, license_scan, mixing, near_dedup, quality_rules, suffix_dedup

KEY, COST = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"


@pytest.fixture(scope="module")
def split_docs(spark, tmp_path_factory):
    """A table whose scan has other splits at other parallelism: many row groups in a few files."""
    rng = random.Random(11)
    passage = prose(rng, 80)
    rows = [(i, prose(rng, 40) + (passage if i % 5 == 0 else "") + prose(rng, 40), "abc"[i % 3], i) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " and more", "a", i) for i in range(0, 60, 2)] + [(2000 + i % 7, "the same row", "b", 1) for i in range(200)]
    path = str(tmp_path_factory.mktemp("split") / "d")
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, rid bigint").repartition(4).write.option("parquet.block.size", 1 << 14).parquet(path)
    return path


OPERATORS = {
    "near_dedup": lambda df: near_dedup.keep_one(df, shingle=5),
    "near_dedup links": lambda df: near_dedup.link(df).select("doc_id", "n_shingles", "component_id", "kept"),
    "suffix_dedup": suffix_dedup.dedup,
    "suffix_dedup texts": suffix_dedup.strip,
    "mixing": mixing.taken_rows,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_splits_may_change_midway(spark, split_docs, name, monkeypatch):
    """As when executors are lost or added: each pass over the table is dealt to another number of tasks."""
    plain = Counter(map(str, OPERATORS[name](spark.read.parquet(split_docs)).collect()))
    turns = []

    def stored(df, label, keep=common.stored):
        out = keep(df, label)
        turns.append(label)
        spark.conf.set(KEY, ("4", "16", "7")[len(turns) % 3])
        return out

    for module in (near_dedup, suffix_dedup, mixing, common):
        monkeypatch.setattr(module, "stored", stored)
    try:
        spark.conf.set(COST, "1k")
        spark.conf.set(KEY, "4")
        few = spark.read.parquet(split_docs).rdd.getNumPartitions()
        spark.conf.set(KEY, "16")
        assert spark.read.parquet(split_docs).rdd.getNumPartitions() > few
        out = OPERATORS[name](spark.read.parquet(split_docs))
        got = out.collect()
        assert Counter(map(str, got)) == plain and turns
    finally:
        spark.conf.unset(KEY)
        spark.conf.unset(COST)


def test_clashing_names(spark, split_docs):
    """Operators don't care what other columns are called."""
    df = spark.read.parquet(split_docs)
    names = ["n_words", "KEPT", "hash", "doc", "s", "times", "labels", "lang", "path", "place", "cut", "__p", "shares", "Key", "component", "score"]
    odd = df.withColumns({n: F.lit("x") for n in names})
    for f in OPERATORS.values():
        same = f(df).columns
        assert Counter(map(str, f(odd).select(*same).collect())) == Counter(map(str, f(df).collect()))
    assert Counter(map(str, license_scan.scan(odd).collect())) == Counter(map(str, license_scan.scan(df).collect()))
    fixed = ["doc_id", "n_words", "word_chars", "n_repeat_words", "base_failed", "kept"]
    assert Counter(map(str, quality_rules.judge(odd, []).select(*fixed).collect())) == Counter(map(str, quality_rules.judge(df, []).select(*fixed).collect()))
    assert quality_rules.keep(odd, []).columns == odd.columns and quality_rules.keep(odd, []).count() == quality_rules.keep(df, []).count()


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(2)
    long = prose(rng, 150_000)
    rows = [(1, long, "a"), (2, "under the MIT license " * 30_000, "a"), (3, "x" * 1_000_000, "b"), (4, " \n" * 400_000, "b"), (5, "short", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in quality_rules.judge(df, []).collect()}
    for d, t, _ in rows:
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_symbols"], got[d]["n_dup_lines"], got[d]["n_repeat_words"], got[d]["base_failed"]) == statistics(t)
    scanned = {r["doc_id"]: (r["n_words"], r["n_base"], r["last_word"]) for r in license_scan.scan(df).collect()}
    assert scanned[2] == (120_000, 30_000, 119_996) and scanned[3] == (1, 0, None) and scanned[4] == (0, 0, None)
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert sizes == {1: len(long.split()), 2: 120_000, 3: 1, 4: 0, 5: 1}
