"""Approximate nearest neighbours by inner product: a robust-pruned directed graph a shard.

Equal vectors are one node that keeps its smallest ids, as many as an answer can hold. Nodes are dealt to shards by the power of two
near their norm, then by hash. In each shard
nodes are inserted in batches: a greedy beam search over the graph so far proposes neighbours, and relaxed distance pruning keeps
an edge only if no kept neighbour is nearer to its end by the factor `alpha`, so that edges point in diverse directions.
Targets get edges back and are pruned again when they have too many; nodes that end up beyond reach get an edge from a neighbour. Queries search every shard by beam search, in blocks; what the
beams hold is scored in double precision on the original vectors and merged a query.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2), M the largest norm of the shard; queries have 0 there. Norms of a
shard differ by less than a factor of two, and graphs are built and searched over vectors scaled by a power of two, in single precision, so a few
very large vectors neither swamp the others' distances nor overflow. Answers are scored on the original vectors in double precision.
All searches of a batch advance together, as array operations.

Recall is measured against brute force in the tests (0.9 is asked for; see the README for figures).

Nulls and edge cases: rows whose id or vector is null, whose vector is empty, all zero or holds a null or non-finite number,
neither ask nor answer; vectors of different lengths never meet; repeated rows count once; ties go to the smaller id; a query with
fewer candidates than asked for gets them all; products beyond double precision are infinite, as arithmetic has it; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import stored

GRAPH = "dim int, band int, shard int, n int, ids array<array<bigint>>, vectors binary, edges binary, entry int"
HITS = "query_id bigint, vec_id bigint, score double"


def beam_search(data: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int, *, by_distance: bool, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, costs) of the beam of each query, best first, -1 where it is not full. edges: (n, degree), -1 where there is none."""
    m, n = len(queries), len(data)
    norms = np.einsum("ij,ij->i", data, data) if by_distance else None

    def cost(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", queries[rows], data[nodes])
        return norms[nodes] - 2 * dots if by_distance else -dots

    seen = np.zeros((m, n), bool)
    beam = np.full((m, width), -1, np.int64)
    costs = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    k = min(len(entry), width)
    beam[:, :k] = entry[:k]
    costs[:, :k] = cost(np.repeat(np.arange(m), k), np.tile(entry[:k], m)).reshape(m, k)
    done[:, :k] = False
    seen[:, entry[:k]] = True
    order = np.argsort(costs, 1, kind="stable")
    beam, costs, done = (np.take_along_axis(x, order, 1) for x in (beam, costs, done))
    live = np.arange(m)
    while len(live):
        # the first `expand` beam places that haven't been followed
        waiting = ~done[live]
        turn = np.cumsum(waiting, 1)
        pick = waiting & (turn <= expand)
        rows, places = np.nonzero(pick)
        if not len(rows):
            break
        done[live[rows], places] = True
        to = edges[beam[live[rows], places]]
        r = np.repeat(live[rows], edges.shape[1])
        to = to.ravel()
        ok = to >= 0
        r, to = r[ok], to[ok]
        fresh = ~seen[r, to]
        r, to = r[fresh], to[fresh]
        flat = np.unique(r * n + to)
        r, to = flat // n, flat % n
        seen[r, to] = True
        if len(r):
            c = cost(r, to)
            # only what beats the beam's end is worth a place
            good = c < costs[r, -1]
            r, to, c = r[good], to[good], c[good]
        if len(r):
            who, begin, count = np.unique(r, return_index=True, return_counts=True)
            most = int(count.max())
            slot = np.arange(len(r)) - np.repeat(begin, count)
            row = np.repeat(np.arange(len(who)), count)
            nb, nc, nd = np.full((len(who), most), -1, np.int64), np.full((len(who), most), np.inf, np.float32), np.ones((len(who), most), bool)
            nb[row, slot], nc[row, slot], nd[row, slot] = to, c, False
            ab, ac, ad = np.concatenate([beam[who], nb], 1), np.concatenate([costs[who], nc], 1), np.concatenate([done[who], nd], 1)
            order = np.argsort(ac, 1, kind="stable")[:, :width]
            beam[who], costs[who], done[who] = (np.take_along_axis(x, order, 1) for x in (ab, ac, ad))
        live = live[(~done[live]).any(1)]
    return beam, costs


def robust_prune(data: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(len(nodes), degree) kept neighbours. candidates: (len(nodes), c), -1 where there is none."""
    x = data[nodes]
    v = data[np.maximum(candidates, 0)]
    d = ((v - x[:, None]) ** 2).sum(2)
    # not itself, not twice
    d[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    by_id = np.argsort(candidates, 1, kind="stable")
    c = np.take_along_axis(candidates, by_id, 1)
    twice = np.zeros_like(c, bool)
    twice[:, 1:] = c[:, 1:] == c[:, :-1]
    np.put_along_axis(d, by_id, np.where(twice, np.inf, np.take_along_axis(d, by_id, 1)), 1)
    order = np.argsort(d, 1, kind="stable")
    d, candidates, v = np.take_along_axis(d, order, 1), np.take_along_axis(candidates, order, 1), np.take_along_axis(v, order[..., None], 1)
    sq = (v * v).sum(2)
    out = np.full((len(nodes), degree), -1, np.int64)
    alive, rows = np.isfinite(d), np.arange(len(nodes))
    for slot in range(degree):
        any_ = alive.any(1)
        if not any_.any():
            break
        first = alive.argmax(1)
        out[any_, slot] = candidates[rows, first][any_]
        p = v[rows, first]
        between = sq + (p * p).sum(1)[:, None] - 2 * np.einsum("ij,ikj->ik", p, v)
        alive &= (alpha * alpha) * between > d
        alive[rows, first] = False
    return out


def build(data: np.ndarray, degree: int, width: int, alpha: float, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry) of the graph over data (float32, distance is Euclidean)."""
    n = len(data)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(((data - data.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        size = min(max(1, min(at, 1000)), n - at)
        new = order[at : at + size]
        at += size
        found, _ = beam_search(data, edges, np.array([entry]), data[new], width, by_distance=True)
        edges[new] = robust_prune(data, new, found, degree, alpha)
        # edges back
        src, dst = np.repeat(new, degree), edges[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        who, begin, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        back = np.full((len(who), most), -1, np.int64)
        back[np.repeat(np.arange(len(who)), count), np.arange(len(dst)) - np.repeat(begin, count)] = src
        both = np.concatenate([edges[who], back], 1)
        have = (both >= 0).sum(1)
        few = have <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
        edges[who[few], : min(degree, packed.shape[1])] = packed[few, :degree]
        for i in range(0, int((~few).sum()), 1000):
            w, rows = who[~few][i : i + 1000], packed[~few][i : i + 1000]
            kept = robust_prune(data, w, rows[:, : 4 * degree], degree, alpha)
            for j in range(4 * degree, most + degree, 3 * degree):  # the rest in blocks, against what is kept so far
                more = np.flatnonzero(rows[:, j] >= 0)
                if not len(more):
                    break
                kept[more] = robust_prune(data, w[more], np.concatenate([kept[more], rows[more, j : j + 3 * degree]], 1), degree, alpha)
            edges[w] = kept
    return connected(edges, entry), entry


def connected(edges: np.ndarray, entry: int) -> np.ndarray:
    """edges, and for each node that none of them leads to, one from a reached neighbour of it; columns are added where a row is full."""
    used = (edges >= 0).sum(1)
    seen = np.zeros(len(edges), bool)
    seen[entry] = True
    new = np.array([entry])
    while True:
        while len(new):
            new = np.unique(edges[new])
            new = new[new >= 0]
            new = new[~seen[new]]
            seen[new] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return edges
        ties = [(u, near[used[near].argmin()]) for u in lost if len(near := edges[u][(edges[u] >= 0) & seen[edges[u]]])] or [(lost[0], entry)]
        for u, v in ties:
            if used[v] == edges.shape[1]:
                edges = np.concatenate([edges, np.full((len(edges), 1), -1, np.int64)], 1)
            edges[v, used[v]] = u
            used[v] += 1
        new = np.array([u for u, _ in ties])
        seen[new] = True


def usable(vector: Column) -> Column:
    """Finite throughout, and not all zero."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def band(vector: Column) -> Column:
    """The power of two near the norm; the largest component is scaled out first, so nothing overflows.

    Bands begin a quarter under the powers of two, so that norms that are all about 1, or about the root of a dimension that is a power of two, aren't split.
    """
    largest = F.array_max(F.transform(vector, F.abs))
    rest = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / largest) * (x / largest)))
    return F.floor(F.log2(largest) + F.log2(rest) + 0.25).cast("int")


def scaled(rows: np.ndarray, power: np.ndarray | int) -> np.ndarray:
    """rows times 2^-power, in single precision; in two steps, since the factor alone may be beyond double precision."""
    power = np.asarray(power)
    half = power // 2
    column = (lambda e: e) if not power.ndim else (lambda e: e[:, None])
    return np.ldexp(np.ldexp(rows, -column(half)), -column(power - half)).astype(np.float32)


def index(rows: DataFrame, k: int, *, shard_rows: int = 16_384, degree: int = 32, width: int = 64, alpha: float = 1.15) -> DataFrame:
    """Graphs of (vec_id, embedding array<double>), one row a shard. A shard holds about shard_rows vectors and is built in one task's memory."""
    rows = rows.dropDuplicates(["vec_id", "embedding"])
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))  # limited before the shuffle
    nodes = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes.withColumns({"dim": F.size("embedding"), "band": band(F.col("embedding"))}), "ann-nodes")
    sizes = nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    nodes = nodes.join(F.broadcast(sizes), ["dim", "band"])  # a row a vector length and power of two, of which there are 2,100
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int")).drop("shards")

    def task(shard: pa.Table) -> pa.Table:
        dim = shard.column("dim")[0].as_py()
        flat = np.asarray(shard.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        ids = shard.column("ids").combine_chunks()
        order = np.argsort([x[0].as_py() for x in ids], kind="stable")
        flat, ids = flat[order], ids.take(pa.array(order))
        power = shard.column("band")[0].as_py()
        near = np.ldexp(np.ldexp(flat, -(power // 2)), -(power - power // 2))
        norms = (near**2).sum(1)
        edges, entry = build(np.concatenate([near, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1).astype(np.float32), degree, width, alpha)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "band": pa.array([power], pa.int32()), "shard": pa.array([shard.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(flat)], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "vectors": pa.array([flat.tobytes()], pa.binary()), "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()), "entry": pa.array([entry], pa.int32()),
            }
        )

    return stored(nodes.groupBy("dim", "band", "shard").applyInArrow(task, GRAPH), "ann-graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int, *, width: int = 160, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, embedding array<double>) queries against all graphs."""
    queries = queries.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # a row a vector length
    shards = graphs.groupBy("dim", F.col("band").alias("power")).agg(F.max("shard").alias("last"))
    dealt = queries.join(F.broadcast(blocks), "dim").join(F.broadcast(shards), "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("dim", F.col("power").alias("band"), "shard", "block", F.col("vec_id").alias("query_id"), "embedding")
    spread = graphs.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def task(graph: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not graph.num_rows or not asked.num_rows:
            return none
        g = {c: graph.column(c)[0].as_py() for c in graph.column_names}
        vectors = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["dim"])
        edges = np.frombuffer(g["edges"], np.int32).reshape(g["n"], -1).astype(np.int64)
        data = scaled(vectors, g["band"])
        query_ids = np.asarray(asked.column("query_id"))
        wanted = np.asarray(asked.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, g["dim"])
        parts = []
        for i in range(0, len(wanted), 256):
            q, own = wanted[i : i + 256], query_ids[i : i + 256]
            small = scaled(q, np.frexp(np.abs(q).max(1))[1])  # a positive factor leaves a query's order as it is
            open_, beam = np.arange(len(q)), max(width, k + 1)
            while len(open_):
                found, _ = beam_search(data, edges, np.array([g["entry"]]), small[open_], beam, by_distance=False)
                short = []
                for j, nodes in zip(open_.tolist(), found):
                    full = nodes[-1] >= 0
                    nodes = nodes[nodes >= 0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = vectors[nodes] @ q[j]
                    hits = [(s, v) for s, node in zip(scores.tolist(), nodes.tolist()) for v in g["ids"][node] if v != own[j]]
                    hits.sort(key=lambda h: (-h[0], h[1]))
                    best: dict[int, float] = {}
                    for s, v in hits:
                        best.setdefault(v, s)
                    if len(best) < k and full and beam < g["n"]:  # a few ids with many vectors fill the beam
                        short.append(j)
                        continue
                    parts += [(int(own[j]), v, s) for v, s in list(best.items())[:k]]
                open_, beam = np.array(short, np.int64), min(4 * beam, g["n"])
        if not parts:
            return none
        a, b, c = zip(*parts)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    hits = spread.groupBy("dim", "band", "shard", "block").cogroup(dealt.groupBy("dim", "band", "shard", "block")).applyInArrow(task, HITS)
    # an id that occurs with several vectors answers once, by its best
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", order.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, asks: Column, *, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of every row for which `asks` (a condition on id_col, named vec_id) holds."""
    slim = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    slim = slim.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return search(index(slim, k), slim.where(asks), k)
