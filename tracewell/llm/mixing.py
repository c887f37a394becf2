"""Mixing sources to target weights by nested hash-threshold histograms.

Every document gets a hash. Per source, its sizes are summed by hash bucket; the bucket in which the running sum crosses the
budget is the only one refined, by the next hash digits, until it holds a single hash. Documents below the threshold are then
taken by a filter: no row is ever sorted, and each level shuffles at most `2**BITS` sums a source from each task.

A source whose target exceeds its size is taken whole once and by threshold a second time. Targets follow the weights, stop at
`limit` times the source's size, and the excess is shared again by weight; the driver handles only the sums of each round.

Rows with the same id and text share a hash. If such copies are the boundary, as many of them are taken as fit, told apart by a
second hash, of the row's number, through the same histograms.

Nulls and edge cases: a null text has size 0 and is never taken, and a null source is a source of its own, last in order; repeated rows
are counted each; words of very long texts are counted where they start, without an array of them; an empty table gives an empty
result; extra columns are ignored by mix() and passed on by taken_rows(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import numbered, stored, text_or_empty, word_count

HEX = 15  # hash digits in use: 60 bits
DIGITS = 3  # hex digits a level: 4096 buckets


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `place`, the 0-based position by code point, null last. Range partitions are numbered on their own and then offset, so no task sorts all."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id()), "mix-sources")
    sizes = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    within = F.row_number().over(Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last())) - 1
    table = sources.sparkSession.createDataFrame(offsets, "__q int, __before bigint")  # one row a partition
    parts = parts.withColumn("__within", within).join(F.broadcast(table), F.col("__p") == F.col("__q"))
    return parts.withColumn("place", (F.col("__within") + F.col("__before")).cast("long")).drop("__p", "__q", "__within", "__before")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) with `target`: budget by weight, capped at limit x size, excess reshared among the uncapped."""
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, rate = share * total, 0.0
    while total:
        over = F.col("weight") * rate >= F.col("source_size") * limit
        full, open_weight = ranked.agg(F.sum(F.when(over, F.col("source_size") * limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        again = (budget - full) / open_weight
        if again <= rate:
            break
        rate = again
    return ranked.withColumn("target", F.least(F.col("weight") * rate, F.col("source_size") * limit))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For rows (source, size, hash) and budgets (source, budget): `below`, a hash such that sizes of hashes under it sum to at most budget.

    It is the largest such hash; sums of equal hashes stay together. left: what the budget has left for rows of that hash. Sources that fit whole have no row.
    """
    same = lambda a, b: a.eqNullSafe(b)
    state = budgets.select("source", F.col("budget").alias("left"), F.lit("").alias("prefix"))
    done = None
    for level in range(HEX // DIGITS):
        if level == 0:
            inside = rows.select("source", "size", "hash")
        else:
            s = state.select(F.col("source").alias("__s"), "prefix")
            inside = rows.join(s, same(F.col("source"), F.col("__s")) & F.col("hash").startswith(F.col("prefix"))).select("source", "size", "hash")
        sums = inside.groupBy("source", F.substring("hash", 1, DIGITS * (level + 1)).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        s = state.select(F.col("source").alias("__s"), "left")
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", running).join(s, same(F.col("source"), F.col("__s"))).where(F.col("upto") > F.col("left"))
        first = sums.groupBy("source").agg(F.min(F.struct("bucket", "size", "upto", "left", "lo", "hi")).alias("b"))
        cut = stored(first.select("source", F.col("b.bucket").alias("prefix"), (F.col("b.left") - (F.col("b.upto") - F.col("b.size"))).alias("left"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")), f"mix-level{level}")
        # a source without a crossing bucket fits whole; one whose boundary bucket has a single hash is settled
        last = level == HEX // DIGITS - 1
        settled = cut if last else cut.where(F.col("lo") == F.col("hi"))
        settled = settled.select("source", F.col("lo").alias("below"), "left")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        state = cut.where(F.col("lo") != F.col("hi")).select("source", "left", "prefix")
        if state.isEmpty():
            break
    return done


def plan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Per row: rid (its place), doc_id, source, size, source_size, target, times (how often the mix takes it)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    rows = numbered(slim).select("rid", "doc.doc_id", "doc.source", F.col("doc.text").alias("text"))
    return _plan(rows, weights, share, limit)


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """rows: (rid, doc_id, source, text), the same whenever it is read."""
    body = text_or_empty("text")
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), body).cast("binary")), 1, HEX)
    rows = stored(rows.select("rid", "doc_id", "source", word_count(body).alias("size"), key.alias("hash")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sources, weights, share, limit).select("source", "source_size", "target")
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    goal = stored(goal.withColumn("copies", whole.cast("long")), "mix-goal")
    sized = rows.where(F.col("size") > 0)
    below = stored(thresholds(sized, goal.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))), "mix-below")
    # copies of one row at the boundary: part of them fits
    edge = below.select(F.col("source").alias("__s"), "below")
    tie = F.substring(F.md5(F.col("rid").cast("string").cast("binary")), 1, HEX)
    tied = sized.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("hash") == F.col("below"))).select("source", "size", tie.alias("hash"))
    several = stored(tied.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source"), "mix-ties")
    ties = None
    if not several.isEmpty():
        ties = thresholds(tied, below.join(several.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left_semi").select("source", F.col("left").alias("budget")))
        below = below.join(ties.select(F.col("source").alias("__s"), F.col("below").alias("below_tie")), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    else:
        below = below.withColumn("below_tie", F.lit(None).cast("string"))
    goal = goal.join(below.select(F.col("source").alias("__s"), "below", "below_tie"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    # one row a source on the right; a hot source is split by the adaptive join or, under the size limit, broadcast
    out = rows.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    under = F.col("below").isNull() | (F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & (tie < F.col("below_tie")))
    extra = F.when(F.col("copies") >= limit, 0).when(under, 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("copies") + extra).otherwise(F.lit(0)).cast("int")
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Per row: doc_id, source, size, source_size, target, taken (0, 1 or 2 times the size). Options are those of plan()."""
    return plan(docs, **options).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def taken_rows(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Each row of docs as often as the mix takes it."""
    rows = numbered(docs)
    column = lambda name: F.col("doc").getField(docs.columns[[c.lower() for c in docs.columns].index(name.lower())])
    slim = rows.select("rid", column(id_col).alias("doc_id"), column(source).alias("source"), column(text).cast("string").alias("text"))
    often = _plan(slim, weights, share, limit).where(F.col("times") > 0).select("rid", "times")
    again = rows.join(often, "rid").select("doc", F.explode(F.sequence(F.lit(1), "times")))
    return again.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
