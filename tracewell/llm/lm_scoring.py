"""Language-model scores: prediction by partial matching over bytes, and a word-unigram base beside it.

The model is a trie of byte contexts up to ORDER bytes long, with counts from every training document. A symbol is coded in the
longest context that the trie has: seen symbols get cnt/(n + t), where t is the number of different symbols seen there, and t/(n + t) is
left for escaping to the next shorter context. There the symbols of the longer one are excluded, which makes the rest sum to one; last
comes a uniform order. Since the model is fixed before scoring, exclusion depends on the context alone, so it is computed once
as the context's escape weight, and a text is scored by a few table lookups a byte, whole batches at a time.

Counting gathers n-grams and words of all training texts in Spark, and all of them are used; what is sent to executors does not grow
with them. Orders of at most max_grams grams travel whole. Once the longest order has more, its max_grams most frequent grams travel with
their final probabilities instead, and a text's other grams are scored in Spark, each once, by joins down the orders that don't travel.
Words are treated alike: those above a count threshold, at most max_head of them, travel as a table; the other words are
joined in Spark. None of what is joined is frequent enough in training texts to make a hot key.

Nulls and edge cases: a null or empty text is its end symbol; without training documents the model is uniform and the base
counts are 0 (a score of 0 per token when N + 0.5 (V + 1) is all the mass there is); repeated rows are counted and scored each; a very
long text is counted and scored a portion of symbols at a time; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import crc_rest, mix64, stored

ORDER = 4
PAD, END = 0xFE, 0xFF  # no byte of UTF-8 text
SYMBOLS = 255  # what can follow: all bytes but PAD, with END
_STEP = 1 << 19  # symbols counted or scored at a time: arrays of 4 MB


# ------------------------------------------------------------------------------------------------ tables


class Table:
    """uint64 keys to numbers, by open addressing; lookups are vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << bits, np.float64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] == np.iinfo(np.uint64).max
            first = np.unique(at[todo[free]], return_index=True)[1]
            placed = todo[free][first]
            self.slots[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            taken = self.slots[at[todo]] != keys[todo]
            at[todo[taken]] = (at[todo[taken]] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) for each key; 0 where there is none."""
        at = self._slot(keys)
        held = self.slots[at]
        hit = held == keys
        values = self.values[at]
        open_ = np.flatnonzero(~hit & (held != np.iinfo(np.uint64).max))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[at[open_]]
            now = held == keys[open_]
            hit[open_[now]] = True
            values[open_[now]] = self.values[at[open_[now]]]
            open_ = open_[~now & (held != np.iinfo(np.uint64).max)]
        values[~hit] = 0
        return hit, values


class Model:
    """grams[k]: log10 P of (k context bytes, symbol); escapes[k]: log10 weight of a context of k bytes on what it hasn't seen."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """counts[k]: keys of k + 1 bytes and their counts."""
        self.grams: list[Table] = []
        self.escapes: list[Table] = []
        for k, (keys, n) in enumerate(counts):
            keys, n = keys.astype(np.uint64), n.astype(np.float64)
            context, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context)).astype(np.float64)
            lower = 10.0 ** self.log10(keys, k - 1)
            unseen = np.maximum(1.0 - np.bincount(at, lower, len(context)), 1e-12)
            # a context that has seen every symbol needs no escape
            full = kinds >= SYMBOLS
            mass = np.where(full, total, total + kinds)
            self.grams.append(Table(keys, np.log10(n / mass[at])))
            self.escapes.append(Table(context, np.where(full, -12.0, np.log10(kinds / mass) - np.log10(unseen))))
        # the small differences that escapes hang on are taken; single precision does for what is looked up
        for table in self.grams:
            table.values = table.values.astype(np.float32)

    def log10(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """log10 P of the last byte of each key in the context of the bytes before it."""
        k = len(self.grams) - 1 if order is None else order
        out = np.zeros(len(keys), np.float64)
        rest: np.ndarray | slice = slice(None)
        while k >= 0:
            now = keys[rest] & np.uint64((1 << (8 * (k + 1))) - 1)
            hit, value = self.grams[k].find(now)
            miss = np.flatnonzero(~hit)
            value = value.astype(np.float64, copy=False)
            value[miss] = self.escapes[k].find(now[miss] >> np.uint64(8))[1]  # 0 for a context never seen
            out[rest] += value
            rest = miss if isinstance(rest, slice) else rest[miss]
            if not len(rest):
                return out
            k -= 1
        out[rest] -= math.log10(SYMBOLS)
        return out


# ------------------------------------------------------------------------------------------------ counting


def _keys(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of ORDER + 1 bytes of every symbol, END included, of texts, and whose each key is; at most _STEP at a time, however long a text is."""
    pad = bytes([PAD]) * ORDER
    flat = np.frombuffer(pad + b"".join([t + bytes([END]) + pad for t in texts]), np.uint8)
    last = np.cumsum([len(t) + 1 + ORDER for t in texts])  # where the next text's symbols begin, counted from the first text's
    for at in range(0, len(flat) - ORDER, _STEP):
        part = flat[at : at + _STEP + ORDER]
        keys = np.zeros(len(part) - ORDER, np.uint64)
        for i in range(ORDER + 1):
            keys <<= np.uint64(8)
            keys |= part[i : len(part) - ORDER + i]
        symbols = np.flatnonzero(part[ORDER:] != PAD)
        if len(symbols):
            yield keys[symbols], np.searchsorted(last, symbols + at, side="right")


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Texts in portions of about _STEP bytes, with the batch and the first row of each."""
    for batch in batches:
        texts, size, first = [], 0, 0
        for i, value in enumerate(batch.column(column)):
            body = (value.as_py() or "").encode("utf-8", "surrogatepass")
            texts.append(body)
            size += len(body)
            if size >= _STEP:
                yield batch, first, texts
                texts, size, first = [], 0, i + 1
        if texts:
            yield batch, first, texts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def count(training: DataFrame) -> DataFrame:
    """(gram bigint, word binary, n bigint): counts of byte grams and of words, over all rows of (text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()
        ends = 0

        def word_rows() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["gram", "word", "n"])
            words.clear()
            return rows

        def gram_rows() -> pa.RecordBatch:
            keys, n = _merged(grams)
            grams.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n)], names=["gram", "word", "n"])

        for _, _, texts in _portions(batches, 0):
            for keys, _ in _keys(texts):
                grams.append(np.unique(keys, return_counts=True))
                if len(grams) >= 32:
                    grams[:] = [_merged(grams)]
                    if len(grams[0][0]) > 2_000_000:
                        yield gram_rows()
            for t in texts:
                words.update(t.lower().split())
            ends += len(texts)
            if len(words) > 400_000:
                yield word_rows()
        if grams:
            yield gram_rows()
        if words:
            yield word_rows()
        if ends:  # the empty word stands for ends
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["gram", "word", "n"])

    return training.mapInArrow(task, "gram bigint, word binary, n bigint").groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count c such that at most `most` rows have n >= c. One row a power of two, then one a count within it, reach the driver."""
    bins = {r["b"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("k")).collect()}
    above = 0
    for b in sorted(bins, reverse=True):
        if above + bins[b] > most:
            inner = counts.where((F.col("n") >= 1 << b) & (F.col("n") < 1 << (b + 1)))
            # a bin of rare counts holds few different ones; of frequent ones, few rows
            step = max(1, (1 << b) >> 12)
            parts = {r["c"]: r["k"] for r in inner.groupBy((F.floor(F.col("n") / step) * step).cast("bigint").alias("c")).agg(F.count("*").alias("k")).collect()}
            least = 1 << (b + 1)
            for c in sorted(parts, reverse=True):
                if above + parts[c] > most:
                    return least
                above, least = above + parts[c], c
            return least
        above += bins[b]
    return 1


@dataclass
class Fit:
    """A model in the parts that scoring needs: whole orders as a Model; grams of the longest order and their log10 P, if that isn't whole."""

    whole: Model
    head: Table | None
    orders: dict[int, tuple[DataFrame, DataFrame]]  # those beyond whole: (gram, p), (context, escape)


def _order(level: DataFrame, k: int, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What Model computes, in Spark: (gram, context, p) and (context, escape) of order k. lower: (gram, p) of the order below, whose grams are the ends of these."""
    by = Window.partitionBy("context")
    rows = level.withColumn("context", F.shiftright("gram", 8)).withColumns({"total": F.sum("n").over(by), "kinds": F.count("*").over(by)})
    full = F.col("kinds") >= SYMBOLS
    rows = rows.withColumn("mass", F.when(full, F.col("total")).otherwise(F.col("total") + F.col("kinds"))).withColumn("p", F.log10(F.col("n") / F.col("mass")))
    rows = stored(rows, f"lm-order-{k}")
    ends = rows.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(lower.select(F.col("gram").alias("end"), F.col("p").alias("under")), "end")
    unseen = F.greatest(1.0 - F.sum(F.pow(F.lit(10.0), "under")), F.lit(1e-12))
    escapes = ends.groupBy("context", "kinds", "mass").agg(unseen.alias("unseen"))
    escape = F.when(full, F.lit(-12.0)).otherwise(F.log10(F.col("kinds") / F.col("mass")) - F.log10("unseen"))
    return rows.select("gram", "p"), stored(escapes.select("context", escape.alias("escape")), f"lm-escapes-{k}")


def _arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select("gram", value).toArrow()  # at most max_grams rows of two numbers
    keys, values = found.column(0).to_numpy().astype(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def fit_ppm(counts: DataFrame, max_grams: int = 1 << 20) -> Fit:
    """counts: (gram, n) of ORDER + 1 bytes. Shorter orders are sums of longer ones, and have no more grams than these."""
    shorter = lambda df, k: df.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
    least = _least_count(counts, max_grams)
    if least == 1:
        return Fit(Model([_arrays(shorter(counts, k) if k < ORDER else counts, "n") for k in range(ORDER + 1)]), None, {})
    levels, top = {ORDER: counts}, ORDER - 1  # top: the longest order that is whole
    for k in range(ORDER - 1, -1, -1):
        levels[k] = stored(shorter(levels[k + 1], k), f"lm-level-{k}")
    while top > 1 and levels[top].count() > max_grams:  # 2**16 grams at most below
        top -= 1
    whole = Model([_arrays(levels[k], "n") for k in range(top + 1)])
    total = levels[top].withColumn("context", F.shiftright("gram", 8)).withColumns({"total": F.sum("n").over(Window.partitionBy("context")), "kinds": F.count("*").over(Window.partitionBy("context"))})
    lower = total.select("gram", F.log10(F.col("n") / (F.col("total") + F.when(F.col("kinds") >= SYMBOLS, 0).otherwise(F.col("kinds")))).alias("p"))
    orders = {}
    for k in range(top + 1, ORDER + 1):
        orders[k] = _order(levels[k], k, lower)
        lower = orders[k][0]
    head = counts.where(F.col("n") >= least).select("gram").join(lower, "gram")
    return Fit(whole, Table(*_arrays(head, "p")), orders)


def _probabilities(grams: DataFrame, fit: Fit) -> DataFrame:
    """(gram, p): log10 P of each of grams, down the orders that don't travel by joins, then by the model that does."""
    top = min(fit.orders) - 1
    model = grams.sparkSession.sparkContext.broadcast(fit.whole)
    rows = grams.select("gram", F.col("gram").alias("at"), F.lit(0.0).alias("p"), F.lit(False).alias("done"))
    for k in range(ORDER, top, -1):
        seen, escapes = fit.orders[k]
        # rows that are done go along with their whole gram, so they don't meet at one key, and take nothing
        rows = rows.join(seen.select(F.col("gram").alias("at"), F.col("p").alias("seen")), "at", "left").withColumn("context", F.shiftright("at", 8)).join(escapes, "context", "left")
        hit = F.col("done") | F.col("seen").isNotNull()
        more = F.when(F.col("done"), 0.0).otherwise(F.coalesce("seen", "escape", F.lit(0.0)))
        at = F.when(hit, F.col("gram")).otherwise(F.col("at").bitwiseAND(F.lit((1 << (8 * k)) - 1)))
        rows = rows.select("gram", at.alias("at"), (F.col("p") + more).alias("p"), hit.alias("done"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, p, done = batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy().copy(), batch.column(3).to_numpy(zero_copy_only=False)
            p[~done] += model.value.log10(keys[~done], top)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["gram", "p"])

    return rows.mapInArrow(task, "gram bigint, p double")


def _unscored(keys: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """For each of n texts, its different keys and how often it has them; rows says whose each key is."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(keys[new].astype(np.int64)), pa.array(np.diff(np.append(new, len(keys))).astype(np.int64))], names=["gram", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[new], np.arange(n + 1)).astype(np.int32)), pairs)


# ------------------------------------------------------------------------------------------------ scoring


def score(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", max_grams: int = 1 << 20, max_head: int = 150_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), (crc_rest(id_col, 5) == 1).alias("held_out"))
    counts = stored(count(slim.where(~F.col("held_out")).select("text")), "lm-counts")
    grams = counts.where(F.col("gram").isNotNull()).select("gram", "n")
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, mass = total["n"] or 0, (total["n"] or 0) + 0.5 * (total["v"] + 1)
    fit = fit_ppm(grams, max_grams)
    model = spark.sparkContext.broadcast(fit.head or fit.whole)
    least = _least_count(words, max_head)
    head_rows = words.where((F.col("n") >= least) | (F.col("word") == F.lit(b""))).collect()  # at most max_head + 1
    head = spark.sparkContext.broadcast({bytes(r["word"]): math.log10((r["n"] + 0.5) / mass) for r in head_rows})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_score double, score double, tail array<struct<word:binary,tf:bigint>>, rest array<struct<gram:bigint,tf:bigint>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm, logs = model.value, head.value
        end = logs.get(b"", math.log10(0.5 / mass))
        pair = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
        for batch, first, texts in _portions(batches, 1):
            scores, left = np.zeros(len(texts)), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for keys, rows in _keys(texts):
                if isinstance(ppm, Table):
                    hit, logs_of = ppm.find(keys)
                    left.append((keys[~hit], rows[~hit]))
                else:
                    logs_of = ppm.log10(keys)
                scores += np.bincount(rows, logs_of, len(texts))
            if isinstance(ppm, Table):
                rest = _unscored(*(np.concatenate(x) for x in zip(*left)), len(texts))
            else:
                rest = pa.nulls(len(texts), pa.list_(pa.struct([("gram", pa.int64()), ("tf", pa.int64())])))
            n_tokens, n_known, base, tails = [], [], [], []
            for t in texts:
                found = Counter(t.lower().split())
                sum_, hits, tail, n = [end], int(b"" in logs), [], 1
                for w, tf in found.items():
                    n += tf
                    x = logs.get(w)
                    if x is None:
                        tail.append({"word": w, "tf": tf})
                    else:
                        hits += tf
                        sum_.append(tf * x)
                n_tokens.append(n)
                n_known.append(hits)
                base.append(math.fsum(sum_))
                tails.append(tail)
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array(x, pa.int64()) for x in (n_tokens, n_known)], pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(tails, pair), rest], names=["doc_id", "held_out", "n_tokens", "head_known", "head_score", "score", "tail", "rest"])

    rows = stored(slim.select("doc_id", "text", "held_out").mapInArrow(task, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = words.where(F.col("n") < least)
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.tf").alias("tf"))
    tail = tail.join(rare, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = tail.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(F.lit(0))).alias("tail_known"), F.sum(F.col("tf") * F.log10((c + 0.5) / F.lit(mass))).alias("tail_score"))
    out = rows.drop("tail", "rest").join(sums, "row", "left")
    score_ = F.col("score")
    if fit.head:
        rest = rows.select("row", F.explode("rest").alias("t")).select("row", "t.gram", "t.tf")
        rest = rest.join(_probabilities(rest.select("gram").distinct(), fit), "gram")
        out = out.join(rest.groupBy("row").agg(F.sum(F.col("tf") * F.col("p")).alias("rest_score")), "row", "left")
        score_ += F.coalesce("rest_score", F.lit(0.0))
    zero = lambda name, value: F.coalesce(F.col(name), F.lit(value))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known", 0)).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("head_score") + zero("tail_score", 0.0)).alias("base_score"), score_.alias("score")
    )
