"""The pipeline's stages against plain Python, each on its own input."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from test_near_dedup import brute as near_brute
from test_texts import WORD, statistics
from tokenizers import Tokenizer

import corpus_pipeline as P
from tracewell.llm import quality_rules
from tracewell.llm.common import table
from tracewell.plans.tables import stored


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(name, input, output) of every stage."""
    out, now = [], table(spark, folder, "documents")
    for name, stage in P.STAGES:
        after = stored(stage(spark, now, folder), f"test-{name}")
        out.append((name, now, after))
        now = after
    return {name: (a, b) for name, a, b in out}


def test_stages_keep_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def features(text):
    """What the learned rules look at, in plain Python."""
    words, dups, repeat = WORD.findall(text or ""), statistics(text)[3], statistics(text)[4]
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    return {
        "mean_word": share(chars, len(words)), "symbol_share": share(statistics(text)[2], chars), "dup_line_share": share(dups, len(lines)), "repeat_share": share(repeat, len(words)), "upper_share": share(len(re.findall("[A-Z]", text or "")), chars),
        "bang_share": share((text or "").count("!"), len(words)), "distinct_share": share(len(set(words)), len(words)), "same_as_last_share": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
    }


def plain_quality(rows, rules):
    return [r for r in rows if not statistics(r["text"])[-1] and not any(quality_rules._covers(rule, features(r["text"])) for rule in rules)]


def plain_near(rows):
    """One row of each group of near copies, by all pairs: the one with the smallest id."""
    groups = [x[2] for x in Counter.elements(near_brute([(i, r["text"]) for i, r in enumerate(rows)], 5))]
    assert len(groups) == len(rows)
    first = {x[0]: x[2] for x in near_brute([(i, r["text"]) for i, r in enumerate(rows)], 5)}
    best = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] if r["doc_id"] is not None else 0)
        if first[i] not in best or key < best[first[i]][0]:
            best[first[i]] = (key, r)
    return [r for _, r in best.values()]


def plain_suffix(rows):
    """Every byte of a 200-byte string that occurs twice goes; so do documents that were nothing else."""
    bodies = [(r["text"] or "").encode() for r in rows]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for r, b in zip(rows, bodies):
        cut = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cut[i : i + 200] = b"\1" * 200
        text = bytes(x for x, c in zip(b, cut) if not c).decode("utf-8", "ignore")
        if text or not b:
            out.append(r | {"text": text if any(cut) else r["text"]})
    return out


def plain_mix(rows):
    """Rows in order of their hash until a source's target is full; whole sources first if the target exceeds them."""
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sums = Counter()
    for r in rows:
        sums[r["source"]] += size(r)
    order = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left, unit = 1.5 * sum(sums.values()) - sum(2 * sums[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sums[s] if s in full else left * weight[s] / unit for s in order}
        over = {s for s in order if target[s] > 2 * sums[s]}
        if not over:
            break
        full |= over
    out = []
    for s in order:
        copies = int(target[s] // max(sums[s], 1))
        left = target[s] - copies * sums[s]
        key = lambda r: hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:15]
        taken = 0
        for r in sorted((r for r in rows if r["source"] == s and size(r)), key=key):
            taken += size(r)
            out += [r] * (copies + (copies < 2 and taken <= left))
    return out


def plain_pieces(rows):
    """(doc_id, piece, length, crc) of the pieces of every row, by tokenizers."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[(r["doc_id"], k, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))] += 1
    return out


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def same(rows, others):
    return Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in others)


def test_quality(spark, folder, stages):
    before, after = stages["quality"]
    rules = quality_rules.fit(before, table(spark, folder, "labels"))
    assert same(as_rows(after), plain_quality(as_rows(before), rules)) and 0 < after.count() < before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    assert same(as_rows(after), plain_near(as_rows(before))) and after.count() < before.count()


def test_suffix_dedup(stages):
    before, after = stages["suffix_dedup"]
    rows = as_rows(after)
    assert same(rows, plain_suffix(as_rows(before))) and sum(len(r["text"] or "") for r in rows) < sum(len(r["text"] or "") for r in as_rows(before))
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_mixing(stages):
    before, after = stages["mixing"]
    assert same(as_rows(after), plain_mix(as_rows(before)))


def pieces(df):
    return Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())


def test_packing(stages):
    before, after = stages["packing"]
    assert pieces(after) == plain_pieces(as_rows(before))
    bins = {}
    for r in after.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, folder):
    """run() against all five steps in plain Python; only the rules are the learner's own."""
    docs = table(spark, folder, "documents")
    rows = plain_quality(as_rows(docs), quality_rules.fit(docs, table(spark, folder, "labels")))
    assert pieces(P.run(spark, folder)) == plain_pieces(plain_mix(plain_suffix(plain_near(rows))))


def test_results_in_few_files(spark, folder, tmp_path):
    """Whoever writes a stage's result starts processes for each of its files: there are few, however many partitions a shuffle has."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        dict(P.STAGES)["suffix_dedup"](spark, table(spark, folder, "documents"), folder).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(spark.read.parquet(str(tmp_path / "out")).inputFiles()) <= 2 * spark.sparkContext.defaultParallelism


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["quality_statistics", "license_phrases"])
def test_fixed_columns_against_sql(spark, folder, name):
    import duckdb

    from tracewell.llm import queries as Q

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = Q.queries()[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
