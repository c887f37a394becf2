"""MinHash near-dedup: a chosen-path set similarity join.

Documents are sets of word shingles. Documents with the same words in the same order, told by a 128-bit digest, are one node. `TREES` independent trees branch recursively: each tree node picks
one or two of the minwise coordinates by its own hash, and a set goes to the child named by its token there. A node of at most
`LEAF` sets is compared exhaustively; larger ones branch on, down to `DEPTH`. Two sets of similarity 0.8 stay together on one branch
of a level with probability 0.84 or more (one coordinate for three of four nodes, two for the fourth), so that with typical leaf depths of two
or three a tree finds a pair with 0.6 to 0.7. All trees share the coordinates, and a pair that agrees in too few is not compared, so by calculation
a pair at exactly 0.8 is missed with probability 5.9e-5 where leaves lie at depth 2, 1.6e-4 at depth 3 and 9.5e-4 at depth 4 (4.1e-4 at 0.82 and
1.0e-4 at 0.85, depth 4); similar pairs also connect through others.

Comparison is by estimate first, by full sets then. Within every node each set is compared to the node's smallest member;
these star edges, once confirmed, give labels. Other pairs are confirmed only if their labels differ, so a large group of
near copies costs one confirmation a member rather than all pairs. The stars of a set with very many edges are confirmed in many tasks.
In nodes that are still large at the last depth, sets that don't carry the label of the node's smallest member are compared to all
members, in blocks of bounded size, by their shingles' hashes; what links there is then confirmed on full sets like the others.

Nulls and edge cases: null, empty or blank texts have no set, link with nothing and stay; fewer words than a shingle are a set of one; rows
with equal sets are linked whatever their ids; null ids never name a component that has another id; repeated rows are in
one component; an empty table gives an empty result; texts are taken whole, very long ones in overlapping portions; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BYTES_A_LONG_FILE, lower_words, mix64, numbered, stored
from tracewell.plans.components import connected_components

COORDINATES = 96
TREES = 12
LEAF = 64
DEPTH = 4
_PORTION = 1 << 20  # bytes hashed at a time
_OTHERS, _MEMBERS = 512, 512  # sets of a block on either side
_BLOCK = 1 << 20  # shingles of a block on either side: 8 MB
_STAR = 256  # edges of a set that are confirmed in one task
_FILTER = 4_194_301  # places of the membership filter: a prime, half a megabyte of bits at any input size

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
_MULTIPLIERS = (mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (mix64(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_powers: dict[str, np.ndarray] = {}


def _geometric(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        factors = np.full(max(n, _PORTION), base, np.uint64)
        factors[0] = 1
        _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers[name][:n]


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the shingles of `width` words of each lowered text; fewer words are one shingle."""
    flat = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(flat, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _geometric("up", _BASE, len(data)), out=prefix[1:])
    word = (prefix[end] - prefix[start]) * _geometric("down", _INVERSE, len(data))[start]
    word = mix64(word + (end - start).astype(np.uint64))
    limits = np.searchsorted(start, np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]))
    runs = word
    for i in range(1, width):
        runs = mix64(runs[:-1] * _BASE + word[i:]) if len(runs) > 1 else runs[:0]
    out = []
    for a, b in zip(limits[:-1], limits[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            few = word[a:b]
            for i in range(1, b - a):
                few = mix64(few[:-1] * _BASE + word[a + i : b])
            out.append(few[:1])
    return out


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The COORDINATES minwise tokens of a set."""
    best = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 2048):
        np.minimum(best, (high[i : i + 2048, None] * _MULTIPLIERS + _ADDENDS).min(0), out=best)
    return best


def set_of(words: bytes, width: int) -> np.ndarray:
    """shingle_hashes() of one text whose words are parted by single spaces, a portion at a time: portions overlap by width - 1 words."""
    parts, at = [], 0
    while len(words) - at > 2 * _PORTION:
        end = words.find(b" ", at + _PORTION)
        if end < 0:
            break
        parts.append(shingle_hashes([words[at:end]], width)[0])
        back = end
        for _ in range(width - 1):
            back = words.rfind(b" ", at, back)
        if back <= at:  # words longer than a portion
            return shingle_hashes([words], width)[0]
        at = back + 1
    last = shingle_hashes([words[at:]], width)[0]
    return np.unique(np.concatenate([*parts, last])) if parts else last


def _set_portions(texts: pa.Array, width: int) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """(words parted by spaces, shingle hashes) of texts, some at a time."""
    held: list[bytes] = []
    size = 0
    for value in texts:
        words = b" ".join(lower_words(value.as_py() or ""))
        if len(words) > 2 * _PORTION:
            if held:
                yield held, shingle_hashes(held, width)
            yield [words], [set_of(words, width)]
            held, size = [], 0
            continue
        held.append(words)
        size += len(words)
        if size >= _PORTION:
            yield held, shingle_hashes(held, width)
            held, size = [], 0
    if held:
        yield held, shingle_hashes(held, width)


_ROWS = "rid bigint, doc_id bigint, n bigint, key binary, tokens binary, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, text -> rid, doc_id, n, key, tokens, sketch (a byte a token). The key is a digest of the words in their order."""
    kinds = [*[pa.int64()] * 3, *[pa.binary()] * 3]
    for batch in batches:
        at = 0
        for words, sets in _set_portions(batch.column(2), width):
            rows: list[tuple] = []
            for w, h in zip(words, sets):
                if len(h):
                    tokens = minwise(h)
                    rows.append((len(h), hashlib.blake2b(w, digest_size=16).digest(), tokens.tobytes(), (tokens & np.uint32(255)).astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            part = batch.slice(at, len(rows))
            at += len(rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds[2:])]], names=[x.split()[0] for x in _ROWS.split(", ")])


# ---------------------------------------------------------------------------------------------- the trees


def _children(nodes: np.ndarray, sets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child node, set) rows. nodes[i] holds sets[i], whose minwise tokens are tokens[i]."""
    turn = mix64(nodes.view(np.uint64))
    first = (turn % np.uint64(COORDINATES)).astype(np.int64)
    step = (turn >> np.uint64(20)) % np.uint64(COORDINATES - 1)
    second = (first + 1 + step.astype(np.int64)) % COORDINATES
    two = (turn >> np.uint64(40)) % np.uint64(4) == 0
    which = np.concatenate([np.arange(len(nodes)), np.flatnonzero(two)])
    place = np.concatenate([first, second[two]])
    child = mix64(turn[which] + mix64((place.astype(np.uint64) << np.uint64(32)) + tokens[which, place]))
    return child.view(np.int64), sets[which]


def _token_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _branch(roots: bool):  # noqa: ANN202
    """(s, tokens[, nodes]) -> (node, s): children of all roots, or of the nodes listed for each set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sets, tokens = part.column(0).to_numpy(), _token_matrix(part.column(1))
                if roots:
                    which = np.repeat(np.arange(len(sets)), TREES)
                    nodes = np.tile(np.arange(TREES, dtype=np.int64), len(sets))
                else:
                    lists = part.column(2).to_pylist()
                    which = np.repeat(np.arange(len(sets)), [len(x) for x in lists])
                    nodes = np.array([n for x in lists for n in x], np.int64)
                child, owner = _children(nodes, sets[which], tokens[which])
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(owner)], names=["node", "s"])

    return task


def _trees(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, s) of leaves with two sets or more, (node, s) of large nodes at the last depth)."""
    rows = stored(sets.select("s", "tokens").mapInArrow(_branch(True), "node bigint, s bigint"), "near-level1")
    leaves = None
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") > 1)
        tagged = stored(rows.join(sizes, "node").select("node", "s", (F.col("c") > LEAF).alias("large")), f"near-nodes{depth}")
        leaf, large = (tagged.where(F.col("large") == x).select("node", "s") for x in (False, True))
        leaves = leaf if leaves is None else leaves.unionAll(leaf)
        if depth == DEPTH:
            return leaves, large
        lists = large.groupBy("s").agg(F.collect_list("node").alias("nodes"))  # at most a few a tree
        rows = stored(sets.select("s", "tokens").join(lists, "s").select("s", "tokens", "nodes").mapInArrow(_branch(False), "node bigint, s bigint"), f"near-level{depth + 1}")
    raise AssertionError


# ------------------------------------------------------------------------------------------- comparisons


def _agree(similarity: float) -> int:
    """Agreeing coordinates asked of a pair: four standard deviations under what pairs at the similarity have."""
    return int(COORDINATES * similarity - 4 * (COORDINATES * similarity * (1 - similarity)) ** 0.5)


_PAIR = "a bigint, b bigint, star boolean"


def _leaf_pairs(similarity: float):  # noqa: ANN202
    """(node, s, n, sketch), sorted by node -> pairs of a leaf that may be similar; star marks those with its smallest member."""
    least = _agree(similarity)

    def compare(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """All groups have the same size; a row a pair."""
        s, n, k = (np.stack(x) for x in zip(*groups))
        i, j = np.triu_indices(s.shape[1], 1)
        out = []
        block = max(1, 400_000 // (len(i) * COORDINATES) or 1)
        for at in range(0, len(s), block):
            a, b, c = s[at : at + block], n[at : at + block], k[at : at + block]
            near = (c[:, i] == c[:, j]).sum(2) >= least
            near &= np.minimum(b[:, i], b[:, j]) >= similarity * np.maximum(b[:, i], b[:, j])
            g, p = np.nonzero(near)
            low = a.min(1)[g]
            x, y = np.minimum(a[g, i[p]], a[g, j[p]]), np.maximum(a[g, i[p]], a[g, j[p]])
            out.append(np.stack([x, y, (x == low).astype(np.int64)], 1))
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch | None:
            node, s, n = (t.column(c).to_numpy() for c in ("node", "s", "n"))
            k = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            end = np.append(begin[1:], len(node))
            by_size: dict[int, list] = {}
            for a, b in zip(begin.tolist(), end.tolist()):
                by_size.setdefault(b - a, []).append((s[a:b], n[a:b], k[a:b]))
            found = [x for size, groups in by_size.items() if size > 1 for x in compare(groups)]
            if not found:
                return None
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(bool))], names=["a", "b", "star"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            node = t.column("node").to_numpy()
            whole = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last group may go on
            carry = t.slice(whole)
            if whole and (out := work(t.slice(0, whole))) is not None:
                yield out
        if carry is not None and carry.num_rows and (out := work(carry)) is not None:
            yield out

    return task


def _candidates(similarity: float):  # noqa: ANN202
    """(a, na, ka, b, nb, kb) -> pairs that may be similar."""
    least = _agree(similarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, na, b, nb = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
            ka, kb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 5))
            near = (ka == kb).sum(1) >= least
            near &= np.minimum(na, nb) >= similarity * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near]), pa.array(np.ones(int(near.sum()), bool))], names=["a", "b", "star"])

    return task


def shingles(text: str | None, width: int) -> set:
    words = lower_words(text or "")
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def _membership(ids: DataFrame) -> np.ndarray:
    """A bit filter over ids: at most 2**17 words reach the driver, whatever the input. It only saves work; false hits are harmless."""
    place = F.pmod(F.col("s"), F.lit(_FILTER))
    words = ids.select(F.floor(place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 32).cast("int")).alias("bit"))
    rows = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(_FILTER // 32 + 1, np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return bits


def _members(ids: DataFrame):  # noqa: ANN202
    """A function that keeps the rows of a batch whose first column may be among ids."""
    bits = ids.sparkSession.sparkContext.broadcast(_membership(ids))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = np.mod(batch.column(0).to_numpy(), _FILTER)
        return batch.filter(pa.array((bits.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))

    return keep


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (s, text) whose s may be among ids."""
    keep = _members(ids)
    return texts.mapInArrow(lambda batches: map(keep, batches), "s bigint, text string")


def _hashes_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(s, hashes) of the rows of texts (s, text) whose s may be among ids."""
    keep = _members(ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, batches):
            at = 0
            for _, sets in _set_portions(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([h.tobytes() for h in sets], pa.binary())], names=["s", "hashes"])
                at += len(sets)

    return texts.mapInArrow(task, "s bigint, hashes binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets share `percent` of their union. texts: (s, text).

    The smaller end of a star has many edges. It comes last, so that its text meets rows that carry the other end's, and with over
    _STAR edges its text is sent once for each _STAR of them, to as many tasks.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, held = b, shingles(y.as_py(), width)
                own = shingles(x.as_py(), width)
                both = len(own & held)
                keep.append(100 * both >= percent * (len(own) + len(held) - both) and bool(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    some = stored(_texts_of(pairs.select(F.col("a").alias("s")).unionAll(pairs.select(F.col("b").alias("s"))), texts), f"{name}-texts", BYTES_A_LONG_FILE)
    shares = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / _STAR).cast("int").alias("shares")), f"{name}-shares")
    many = shares.where("shares > 1")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    ends = shares.join(some, shares["a"] == some["s"]).select("a", F.col("text").alias("y"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    both = dealt.join(some.select(F.col("s").alias("b"), F.col("text").alias("x")), "b")
    both = both.join(ends, ["a", "share"]).select(F.col("b").alias("p"), F.col("a").alias("q"), "x", "y")
    return stored(both.mapInArrow(check, "a bigint, b bigint"), name)


def _labelled(rows: DataFrame, labels: DataFrame, column: str, label: str) -> DataFrame:
    other = labels.select(F.col("node").alias("__n"), F.col("component").alias(label))
    return rows.join(other, F.col(column) == F.col("__n"), "left").withColumn(label, F.coalesce(label, column)).drop("__n")


def _large_links(large: DataFrame, sketches: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float, percent: int, width: int) -> DataFrame:
    """Links across labels in large nodes of the last depth.

    A set that lacks the label of a node's smallest member is compared to all that have it, and to the others that lack it, once
    for each label whatever the number of nodes. Both sides are dealt into blocks by hash; a task holds one block of each and tells at
    most one link of a set with each label, which is all that components need. Sets travel as sorted hashes of their shingles, and a block
    holds at most about _OTHERS or _MEMBERS sets and _BLOCK hashes, so a task's memory depends on neither the node nor its texts.
    """
    least = _agree(similarity)
    rows = _labelled(large, labels, "s", "l")
    head = rows.groupBy("node").agg(F.min(F.struct("s", "l")).alias("head"), F.min("l").alias("lo"), F.max("l").alias("hi")).where(F.col("lo") != F.col("hi"))
    others = stored(rows.join(head.select("node", F.col("head.l").alias("own")), "node").where(F.col("l") != F.col("own")).select("own", "s").distinct(), "near-others")
    owns = others.select("own").distinct()
    members = labels.join(owns, F.col("component") == F.col("own")).select("own", F.col("node").alias("s")).unionAll(owns.select("own", F.col("own").alias("s")))
    every = members.withColumn("other", F.lit(0)).unionAll(others.withColumn("other", F.lit(1))).groupBy("own", "s").agg(F.max("other").alias("other"))
    every = stored(_labelled(every, labels, "s", "l").join(sketches, "s"), "near-large-members")
    blocks = lambda count, n, sets: F.ceil(F.greatest(F.sum(count) / F.lit(sets), F.sum(F.col(count) * F.col(n)) / F.lit(_BLOCK))).cast("int")
    sizes = every.withColumn("one", F.lit(1)).groupBy("own").agg(blocks("other", "n", _OTHERS).alias("blocks"), blocks("one", "n", _MEMBERS).alias("chunks"))
    full = every.join(sizes, "own").join(_hashes_of(every.select("s"), texts, width), "s")
    right = full.withColumn("chunk", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = full.where(F.col("other") == 1).withColumn("block", F.pmod(F.xxhash64("s", F.lit(1)), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    columns = ["own", "block", "chunk", "s", "n", "l", "sketch", "other", "hashes"]

    def task(some: pa.Table, all_: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        some = some.rename_columns(columns)
        if some.num_rows and all_.num_rows:
            (x, nx, lx), (y, ny, ly) = ([t.column(c).to_numpy() for c in ("s", "n", "l")] for t in (some, all_))
            kx, ky = (np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES) for t in (some, all_))
            twice = all_.column("other").to_numpy() == 1  # such pairs come up on both sides
            set_at = lambda t, i: np.frombuffer(t.column("hashes")[i].as_buffer(), np.uint64)
            for i in range(len(x)):
                near = ((kx[i] == ky).sum(1) >= least) & (ly != lx[i]) & (np.minimum(nx[i], ny) >= similarity * np.maximum(nx[i], ny)) & ~(twice & (y <= x[i]))
                places, told = np.flatnonzero(near), set()
                for j in places[np.argsort(-(kx[i] == ky[places]).sum(1), kind="stable")].tolist():
                    if ly[j] in told:
                        continue
                    both = len(np.intersect1d(set_at(some, i), set_at(all_, j), assume_unique=True))
                    if 100 * both >= percent * (nx[i] + ny[j] - both):
                        told.add(ly[j])
                        found.append((min(x[i], y[j]), max(x[i], y[j])))
        return pa.table({"a": pa.array([int(f[0]) for f in found], pa.int64()), "b": pa.array([int(f[1]) for f in found], pa.int64())})

    a, b = left.select(*columns).toDF(*[f"x_{c}" for c in columns]), right.select(*columns)
    met = a.groupBy("x_own", "x_block", "x_chunk").cogroup(b.groupBy("own", "block", "chunk"))
    wide = stored(met.applyInArrow(task, "a bigint, b bigint").distinct(), "near-large-pairs")
    return _confirmed(wide, texts, percent, width, "near-large-links")


def _link(rows_: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rows_: (rid, doc_id, text), the same whenever it is read."""
    similarity = percent / 100
    rows = stored(rows_.select("rid", "doc_id", "text").mapInArrow(lambda batches: _sets(batches, shingle), _ROWS), "near-rows", BYTES_A_LONG_FILE)
    full = rows.where(F.col("n") > 0)
    first = full.groupBy("key").agg(F.min("rid").alias("s"), F.min("doc_id").alias("id"), F.min_by(F.struct("n", "tokens", "sketch"), "rid").alias("t"))
    sets = stored(first.select("key", "s", "id", "t.n", "t.tokens", "t.sketch"), "near-sets")
    nodes, sketch = sets.select("key", "s", "id"), sets.select("s", "n", "sketch")
    leaves, large = _trees(sets)
    leaf_rows = leaves.join(sketch, "s").select("node", "s", "n", "sketch").repartition("node").sortWithinPartitions("node")
    pairs = leaf_rows.mapInArrow(_leaf_pairs(similarity), _PAIR)
    # large nodes: stars around the smallest member
    heads = large.groupBy("node").agg(F.min("s").alias("b"))
    star = large.join(heads, "node").where(F.col("s") != F.col("b")).select(F.col("s").alias("a"), "b").distinct()
    end = lambda c, x: sketch.select(F.col("s").alias(c), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    star = star.join(end("a", "a"), "a").join(end("b", "b"), "b").select("a", "na", "ka", "b", "nb", "kb").mapInArrow(_candidates(similarity), _PAIR)
    pairs = stored(pairs.unionAll(star).groupBy("a", "b").agg(F.max("star").alias("star")), "near-pairs")
    texts = rows_.select(F.col("rid").alias("s"), "text")
    stars = _confirmed(pairs.where("star").select("a", "b"), texts, percent, shingle, "near-stars")
    labels = stored(connected_components(stars), "near-labels")
    rest = pairs.where(~F.col("star")).select("a", "b")
    rest = _labelled(_labelled(rest, labels, "a", "la"), labels, "b", "lb").where(F.col("la") != F.col("lb")).select("a", "b")
    links = _confirmed(stored(rest, "near-rest"), texts, percent, shingle, "near-links")
    wide = _large_links(large, sketch, labels, texts, similarity, percent, shingle)
    roots = connected_components(stars.unionAll(links).unionAll(wide))
    rooted = _labelled(nodes, roots, "s", "root")
    names = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "near-components")
    named = rooted.join(names, "root").select(F.col("key").alias("__key"), "s", "root", "component_id")
    out = rows.select("rid", "doc_id", "n", "key").join(named, F.col("key") == F.col("__key"), "left")
    component: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), "s", "root", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def link(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = 2, percent: int = 80) -> DataFrame:
    """Per row: rid (its number), doc_id, n_shingles, s (its set, null if empty), root (the component's smallest set), component_id, kept."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _link(numbered(slim).select("rid", "doc.doc_id", "doc.text"), shingle, percent)


def keep_one(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = 2, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest id, the first of those. Rows without a set stay."""
    rows = numbered(docs)
    column = lambda name: F.col("doc").getField(docs.columns[[c.lower() for c in docs.columns].index(name.lower())])
    found = stored(_link(rows.select("rid", column(id_col).cast("bigint").alias("doc_id"), column(text).cast("string").alias("text")), shingle, percent), "near-found")
    grouped = found.where(F.col("root").isNotNull())
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("f")).select(F.col("f.rid").alias("rid"))
    stay = first.unionAll(found.where(F.col("root").isNull()).select("rid"))
    return rows.join(stay, "rid", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
