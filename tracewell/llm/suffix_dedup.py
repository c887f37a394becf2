"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts somewhere else.

Equal windows of LENGTH bytes hold the same smallest k-mer hash, so texts are cut where that hash changes: a segment is a
maximal run of window starts that share it, and all windows equal to one of its own lie in segments of the same key. Then

1. `_segments` finds segments, and sends key and content digest of each, once a portion of text if it repeats within the portion;
2. `_meet` reads them in order of key and digest. Copies of a whole segment are settled there: a digest of 128 bits (BLAKE2) stands in for
   their bytes. Where a key has segments that differ, one of each kind is asked for;
3. `_contents` cuts those out of the texts. A key with over HOT different segments (a passage that many documents hold, with different
   surroundings) is dealt out by the distance from a window's start to the k-mer, _NEAR distances at a time: equal windows have equal
   distances. A key with over FLOOD of them is dealt out window by window, so no task has to hold what a common passage gathers;
4. `_sorted_windows` sorts the window suffixes of each key: a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes. Neighbours that share LENGTH bytes by hash are verified byte by byte;
5. spans are merged per document and cut out.

Nulls and edge cases: a null text is empty; texts under LENGTH bytes lose nothing; repeated rows are documents of their own, so
both lose what they share; null and repeated ids are fine, since rows are told apart by file and place; overlapping matches count; very
long texts are hashed a chunk at a time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import mix64, numbered, stored

LENGTH = 200
KMER = 64
_CHUNK = 1 << 17  # bytes hashed at a time: arrays of 1 MB, which stay in cache
_PORTION = 1 << 22  # bytes after which segments leave a task
_GROUPS = 1 << 20  # bytes of segments sorted at a time
HOT = 128  # different segments of one key from which it is dealt out by distance
FLOOD = 1 << 16  # from which it is dealt out by window
_NEAR = 8  # distances dealt together
_PIECES = 40_000  # pieces of dealt keys that a task holds to find copies

_SEED = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ODD = np.uint64(0x9FB21C651E98DF25)
_FOUND = "kind tinyint, key bigint, h bigint, h2 bigint, rid bigint, start int, n int, many boolean, twice boolean"
SEGMENT, SPAN, ASK = 0, 1, 2  # ASK + 0, 1 or 2: whole, dealt out by distance, by window


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """A hash of data[i : i + k] for each i; k a power of two, reached by doubling."""
    h, width = _SEED[data], 1
    while width < k:
        h = h[:-width] * _ODD + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i + w]) for each i, by doubling."""
    width = 1
    while 2 * width <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = w - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments_of(body: bytes, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, number of window starts, whether the key's k-mer occurs twice) of the segments of a text."""
    data = np.frombuffer(body, np.uint8)
    keys, starts, counts, anchors = [], [], [], []
    for at in range(0, len(data) - length + 1, _CHUNK):
        h = kmer_hashes(data[at : at + _CHUNK + length - 1], k)
        m = window_minima(h, length - k + 1)
        anchors.append(np.flatnonzero(h[: len(m)] == m) + at)
        edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        keys.append(m[edge])
        starts.append(edge + at)
        counts.append(np.diff(np.append(edge, len(m))))
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    key, start, n = np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)
    if len(keys) > 1:  # a run that crosses a chunk's end is one segment, wherever chunks end
        joins = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(joins)
        key, start, n = key[first], start[first], np.add.reduceat(n, first)
    # if windows with the same key start after its k-mer, the k-mer comes again
    places = np.concatenate(anchors)
    twice = np.searchsorted(places, start + n - 1) > np.searchsorted(places, start)
    return key, start, n, twice


def _rows(kind, key, h, h2, rid, start, n, many, twice=False) -> pa.RecordBatch:  # noqa: ANN001
    size = len(rid)
    fill = lambda x, t: np.full(size, x, t) if np.isscalar(x) else np.asarray(x).astype(t, copy=False)
    columns = [fill(kind, np.int8), *[fill(x, np.int64) for x in (key, h, h2, rid)], fill(start, np.int32), fill(n, np.int32), fill(many, bool), fill(twice, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")])


def _spans(rid, start, n) -> pa.RecordBatch:  # noqa: ANN001
    return _rows(SPAN, 0, 0, 0, rid, start, n, True)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Is a row different from the one before it?"""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, h, h2, rid, start, n, twice = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((h2, h, key))
        key, h, h2, rid, start, n, twice = (x[order] for x in (key, h, h2, rid, start, n, twice))
        new = _changes(key, h, h2)
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        many = np.bincount(run, minlength=len(first)) > 1
        yield _rows(SEGMENT, *(x[first].view(np.int64) for x in (key, h, h2)), rid[first], start[first], n[first], many, twice[first])
        again = many[run]
        if again.any():
            yield _spans(rid[again], start[again], n[again])

    for batch in batches:
        for rid, text in zip(batch.column(0).to_numpy(), batch.column(1)):
            body = _encoded(text)
            if len(body) < LENGTH:
                continue
            key, start, n, twice = segments_of(body)
            view = memoryview(body)
            digests = b"".join([hashlib.blake2b(view[a : a + b], digest_size=16).digest() for a, b in zip(start.tolist(), (n + (LENGTH - 1)).tolist())])
            h = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            parts.append((key, h[:, 0], h[:, 1], np.full(len(key), rid), start, n, twice))
            size += len(body)
            if size >= _PORTION:
                yield from flush()
                size = 0
    if parts:
        yield from flush()


class _Kinds:
    """Different segments in order of key, waiting for the rest of their key. What is held is bounded: a flooded key is passed on at once."""

    def __init__(self, hot: int, flood: int) -> None:
        self.hot, self.flood = hot, flood
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.flooded = 0, None

    def add(self, kinds: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        """kinds: key, h, h2, rid, start, n, known, twice."""
        if self.flooded is not None:
            same = kinds[0] == self.flooded
            if same.any():
                yield self._ask(2, tuple(x[same] for x in kinds))
                kinds = tuple(x[~same] for x in kinds)
        if len(kinds[0]):
            self.held.append(kinds)
            self.size += len(kinds[0])
            if self.size >= 20_000:
                yield from self.settle(last=False)

    def settle(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Decide keys that are complete: all, or all but the one that was last seen."""
        if not self.held:
            return
        kinds = tuple(np.concatenate(x) for x in zip(*self.held))
        key = kinds[0]
        end = len(key) if last else int(np.flatnonzero(_changes(key))[-1])
        rest = tuple(x[end:] for x in kinds)
        self.held, self.size = [rest] if len(rest[0]) else [], len(rest[0])
        if self.size > self.flood:
            self.flooded = rest[0][0]
            yield self._ask(2, rest)
            self.held, self.size = [], 0
        if not end:
            return
        kinds = tuple(x[:end] for x in kinds)
        key, known, twice = kinds[0], kinds[6], kinds[7]
        group = np.cumsum(_changes(key)) - 1
        count = np.bincount(group)
        unknown = np.bincount(group, ~known, len(count)) > 0
        # a lone segment can repeat its own windows, as periodic text does
        ask = ((count > 1) & unknown)[group] | (twice & ~known)
        tier = (count > self.hot).astype(np.int8) + (count > self.flood)
        if ask.any():
            yield self._ask(tier[group[ask]], tuple(x[ask] for x in kinds))

    @staticmethod
    def _ask(tier, kinds: tuple[np.ndarray, ...]) -> pa.RecordBatch:  # noqa: ANN001
        return _rows(ASK + tier, *kinds)


def _meet(batches: Iterator[pa.RecordBatch], hot: int, flood: int) -> Iterator[pa.RecordBatch]:
    """Segments in order of key, h, h2; all of a key are in the partition. Rows are passed over once, and only the last one is carried on."""
    kinds, open_ = _Kinds(hot, flood), None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "h", "h2", "rid", "start", "n", "many", "twice")]
        if open_ is not None:
            columns = [np.concatenate(x) for x in zip(open_, columns)]
        key, h, h2, rid, start, n, many, twice = columns
        new = _changes(key, h, h2)
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        known = (np.bincount(run) > 1) | (np.bincount(run, many) > 0)
        span = known[run] & ~many  # the portion that saw several has told already
        if span.any():
            yield _spans(rid[span], start[span], n[span])
        found = [x[first] for x in (key, h, h2, rid, start, n)] + [known, twice[first]]
        open_ = tuple(x[-1:] for x in found)  # known: told already
        yield from kinds.add(tuple(x[:-1] for x in found))
    if open_ is not None:
        yield from kinds.add(open_)
        yield from kinds.settle(last=True)


_CONTENT = "key bigint, anchor bigint, rid bigint, start int, n int, known boolean, body binary"
_CONTENT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())


def _encoded(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def distances(data: np.ndarray, at: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """From each window start to the first of the anchors (places of the key's k-mer) that is not before it."""
    if not len(anchors):
        return np.zeros(len(at), np.int64)
    return anchors[np.minimum(np.searchsorted(anchors, at), len(anchors) - 1)] - at


def _dealt(body: bytes, anchor: int, n: int, tier: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows) of the pieces of a segment that is dealt out."""
    if tier == 2:
        for i in range(n):
            yield xxhash.xxh3_64_intdigest(body[i : i + LENGTH]) - (1 << 63), i, 1
        return
    data = np.frombuffer(body, np.uint8)
    block = distances(data, np.arange(n), np.flatnonzero(kmer_hashes(data).view(np.int64) == anchor)) // _NEAR
    edge = np.flatnonzero(_changes(block))
    keys = mix64(np.array([anchor], np.int64).view(np.uint64) + (block[edge] + 1).astype(np.uint64) * _ODD).view(np.int64)
    yield from zip(keys.tolist(), edge.tolist(), np.diff(np.append(edge, n)).tolist())


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments asked for. Input: rid, text, asked array<struct<key, start, n, known, tier>>.

    Pieces of dealt keys that repeat among those held are settled here: they leave as rows without bytes, under their rid, neighbours
    as one, and one copy goes on, so a piece reaches its key once in _PIECES at most.
    """
    out: list[tuple] = []
    pieces: dict[tuple[int, int, bytes], list[tuple[int, int, int, bool]]] = {}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CONTENT_KINDS)], names=[x.split()[0] for x in _CONTENT.split(", ")])

    def settle() -> None:
        told = []
        for (key, anchor, piece), seen in pieces.items():
            rid, start, n, known = seen[0]
            out.append((key, anchor, rid, start, n, known or len(seen) > 1, piece))
            if len(seen) > 1:
                told += [(rid, start, n) for rid, start, n, known in seen if not known]
        told.sort()
        merged: list[list[int]] = []
        for rid, start, n in told:
            if merged and merged[-1][0] == rid and start <= merged[-1][1] + merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], start + n - merged[-1][1])
            else:
                merged.append([rid, start, n])
        out.extend((rid, 0, rid, start, n, True, None) for rid, start, n in merged)
        pieces.clear()

    size = held = 0
    for batch in batches:
        for rid, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            body = _encoded(text)
            for a in asked:
                key, start, n, known = a["key"], a["start"], a["n"], a["known"]
                segment = body[start : start + n + LENGTH - 1]
                if not a["tier"]:
                    out.append((key, key, rid, start, n, known, segment))
                    size += len(segment)
                    continue
                for deal, at, count in _dealt(segment, key, n, a["tier"]):
                    pieces.setdefault((deal, key, segment[at : at + count + LENGTH - 1]), []).append((rid, start + at, count, known))
                    held += 1
            if held >= _PIECES:
                settle()
                held = 0
            if size >= _PORTION or len(out) >= 20_000:
                yield batch_of(out)
                out.clear()
                size = 0
    settle()
    for i in range(0, len(out), 20_000):
        yield batch_of(out[i : i + 20_000])


class Suffixes:
    """Suffixes of a buffer, compared over at most `limit` bytes by prefix polynomial hashes."""

    _POWERS = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.data, self.limit = data, limit
        self.steps = [1 << b for b in range(limit.bit_length() - 1, -1, -1)]
        if len(Suffixes._POWERS) < len(data) + 1:
            factors = np.full(len(data) + 1, _ODD, np.uint64)
            factors[0] = 1
            Suffixes._POWERS = np.cumprod(factors, dtype=np.uint64)
        powers = Suffixes._POWERS[: len(data) + 1]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SEED[data] * powers[:-1])])
        self.powers = powers

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, up to limit. Both suffixes have limit bytes."""
        low, high = np.minimum(x, y), np.maximum(x, y)
        shift = self.powers[high - low]
        out = np.zeros(len(x), np.int64)
        for step in self.steps:
            to = out + step
            fits = to <= self.limit
            t = np.where(fits, to, out)
            a = self.prefix[low + t] - self.prefix[low + out]
            b = self.prefix[high + t] - self.prefix[high + out]
            out = np.where(fits & (a * shift == b), to, out)
        return out

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where or_equal."""
        ext = self.common(x, y)
        same = ext >= self.limit
        at = np.where(same, 0, ext)
        return np.where(same, or_equal, self.data[x + at] < self.data[y + at])

    def sort(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """suffixes, sorted within their groups (equal numbers, adjacent). Bottom-up mergesort, all groups and blocks at once.

        An element's place in a merged block is its place in its own half plus its rank in the other, found by binary search.
        """
        new = np.concatenate([[True], group[1:] != group[:-1]])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        own = np.arange(len(group)) - begin
        out, width, widest = suffixes.copy(), 1, int(size.max(initial=1))
        while width < widest:
            live = np.flatnonzero(size > width)
            block = own[live] // width
            right = (block & 1).astype(bool)
            base = (block & ~1) * width
            lo = np.minimum(np.where(right, base, base + width), size[live])
            hi = np.minimum(lo + width, size[live])
            other = lo.copy()
            x = out[live]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                y = out[begin[live[open_]] + mid]
                # of equal suffixes those of the left half come first
                before = self.less(y, x[open_], right[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            place = base + (own[live] - block * width) + (lo - other)
            out[begin[live] + place] = x
            width *= 2
        return out

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        span = np.arange(self.limit)
        for i in range(0, len(x), 20_000):
            out[i : i + 20_000] = (self.data[x[i : i + 20_000, None] + span] == self.data[y[i : i + 20_000, None] + span]).all(1)
        return out


def repeated_windows(bodies: list[bytes], keys: np.ndarray, counts: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """For each window start of segments (bodies, grouped by key, counts windows each): does the window occur at another one of its key?

    anchor: the hash of the k-mer that all windows of the key hold.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    lengths = counts + (LENGTH - 1)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    at = begin[owner] + inner
    # equal windows have their smallest k-mer at the same distance, so only such windows are compared
    h = np.concatenate([kmer_hashes(data), np.zeros(KMER - 1, np.uint64)])
    anchors = np.flatnonzero(h == np.repeat(anchor.view(np.uint64), lengths))
    distance = distances(data, at, anchors)
    kind = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)]))
    group = kind[owner] * (LENGTH + 1) + distance
    order = np.argsort(group, kind="stable")
    g = group[order]
    alone = np.concatenate([[True], g[1:] != g[:-1]]) & np.concatenate([g[1:] != g[:-1], [True]])
    order = order[~alone]
    g = group[order]
    out = np.zeros(len(at), bool)
    if not len(order):
        return out
    suffixes = Suffixes(data, LENGTH)
    s = suffixes.sort(at[order], g)
    near = np.flatnonzero(g[1:] == g[:-1])
    near = near[suffixes.common(s[near], s[near + 1]) >= LENGTH]
    near = near[suffixes.equal_bytes(s[near], s[near + 1])]
    hit = np.zeros(len(data), bool)
    hit[s[near]] = True
    hit[s[near + 1]] = True
    return hit[at]


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (key, anchor, rid, start, n, known, body), sorted by key: spans of the windows that repeat."""
    held: list[tuple] = []
    told: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        keys, anchors, rids, starts, counts, known, bodies = zip(*rows)
        keys, anchors, counts, known = np.array(keys, np.int64), np.array(anchors, np.int64), np.array(counts, np.int64), np.array(known, bool)
        hit = repeated_windows(list(bodies), keys, counts, anchors)
        owner = np.repeat(np.arange(len(counts)), counts)
        hit &= ~known[owner]
        edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (owner[1:] != owner[:-1])]))
        if not len(edge):
            return None
        last = np.flatnonzero(hit & np.concatenate([~hit[1:] | (owner[1:] != owner[:-1]), [True]]))
        offset = np.concatenate([[0], np.cumsum(counts)[:-1]])
        seg = owner[edge]
        return _spans(np.array(rids, np.int64)[seg], np.array(starts, np.int64)[seg] + edge - offset[seg], last - edge + 1)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[6] is None:
                told.append(row)
                continue
            if size >= _GROUPS and held[-1][0] != row[0]:
                if (found := flush(held)) is not None:
                    yield found
                held, size = [], 0
            held.append(row)
            size += len(row[6])
        if told:
            _, _, rids, starts, counts, _, _ = zip(*told)
            yield _spans(np.array(rids), np.array(starts), np.array(counts))
            told.clear()
    if held and (found := flush(held)) is not None:
        yield found


def _cut(body: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal runs removed)."""
    kept, at, runs, removed = [], 0, 0, 0
    end = -1
    for start, stop in sorted((s["start"], s["start"] + s["n"] + LENGTH - 1) for s in spans):
        if start > end:
            runs += 1
            kept.append(body[at:start])
            removed += stop - start
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    kept.append(body[at:])
    return b"".join(kept), removed, runs


def with_spans(docs: DataFrame, text: str, hot: int = HOT, flood: int = FLOOD) -> DataFrame:
    """(doc struct of all columns of docs, cut array of the spans to remove or null). hot, flood: see HOT and FLOOD; the result is the same."""
    rows = numbered(docs)
    body = F.col("doc").getField(docs.columns[[c.lower() for c in docs.columns].index(text.lower())])
    found = stored(rows.select("rid", body.alias("text")).mapInArrow(_segments, _FOUND), "suffix-segments")
    segments = found.where(F.col("kind") == SEGMENT).repartition("key").sortWithinPartitions("key", "h", "h2")
    met = stored(segments.mapInArrow(lambda batches: _meet(batches, hot, flood), _FOUND), "suffix-met")
    asked = met.where(F.col("kind") >= ASK)
    one = F.struct("key", "start", "n", F.col("many").alias("known"), (F.col("kind") - ASK).alias("tier"))
    asked = asked.groupBy("rid").agg(F.collect_list(one).alias("asked"))  # at most one a segment of the document
    # both joins read the same exchange of whole documents, which is made once
    dealt = rows.repartition("rid")
    content = dealt.join(asked.hint("shuffle_hash"), "rid").select("rid", body.alias("text"), "asked").mapInArrow(_contents, _CONTENT)
    more = content.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_windows, _FOUND)
    slim = lambda x: x.where(F.col("kind") == SPAN).select("rid", "start", "n")
    cut = slim(found).unionAll(slim(met)).unionAll(slim(more))
    cut = cut.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("cut"))  # bounded by the document's own length
    return dealt.join(cut.hint("shuffle_hash"), "rid", "left").select("doc", "cut")


def dedup(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", keep_text: bool = False, hot: int = HOT, flood: int = FLOOD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept_bytes."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * keep_text

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, cut in zip(batch.column(0).field(0).to_pylist(), batch.column(0).field(1), batch.column(1).to_pylist()):
                body = _encoded(value)
                kept, removed, runs = _cut(body, cut or [])
                rows.append((doc, len(body), removed, runs, hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            if rows:
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return with_spans(slim, "text", hot, flood).mapInArrow(task, schema)


def strip(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with repeated passages removed from text; other columns as they are. Bytes left over by a cut inside a character are dropped."""
    place = [c.lower() for c in docs.columns].index(text.lower())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [batch.column(0).field(i) for i in range(batch.column(0).type.num_fields)]
            made = []
            for value, cut in zip(fields[place], batch.column(1).to_pylist()):
                body = value.as_py()
                if body is not None and cut:
                    body = _cut(_encoded(value), cut)[0].decode("utf-8", "ignore")
                made.append(body)
            fields[place] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(fields, names=docs_names)

    docs_names = list(docs.columns)
    return with_spans(docs, text).mapInArrow(task, docs.schema)
