from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, Rule string"
WORDS = "the of and there was harbour lantern quiet river stone garden window morning letter copper winter signal paper orchard meadow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def corpus(seed=3):
    """Rows with nulls in any column, blank and long texts, exact and near copies, shared passages, periodic text, repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, rng.choice((3, 25, 80, 200))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", None)), 5, "x", None) for i in range(60)]
    base = prose(rng, 150)
    for i in range(60, 72):
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"odd{i}"
        rows.append((i, " ".join(words), "en", "a", 1, None, "y"))
    rows += [(100 + i, base, "en", "a", 1, None, None) for i in range(4)]
    rows += [(110 + i, prose(rng, 30) + passage + prose(rng, 30), "de", "b", 1, None, None) for i in range(4)]
    rows += [(120, "echo " * 300, "en", "c", 1, None, None), (121, "aaaa" * 200, None, None, None, None, None), (122, prose(rng, 6000), "en", "a", 1, None, None)]
    rows += [(130, None, "en", "a", None, None, None), (131, "", None, None, None, None, None), (132, " \n\t ", "en", "a", 3, None, None), (133, "word", "en", "b", 4, None, None), (134, "Word", "en", "b", 4, None, None), (135, "ÄÖ ñ — 123", "de", "b", 4, None, None), (136, "12 34 !!", "de", "b", 4, None, None)]
    rows += [(None, base, "en", "a", 1, None, None), (None, None, None, None, None, None, None), (140, "same row twice here", "en", "a", 1, None, None), (140, "same row twice here", "en", "a", 1, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
