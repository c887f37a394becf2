"""Cross-channel dedup: the first sighting of a run is kept, later ones corroborate it.

In a group, in arrival order, a sighting is a repeat of the recorded run with the least start whose interval, widened by the margin,
holds the sighting's start; the run's interval doesn't grow. A sighting without a readable time is always a run of its own.

The decision depends on order, but only among sightings that can reach each other, so groups are first cut into islands: a new one begins
where no earlier interval reaches. Islands are found by days: each (group, day) is summed to its farthest reach first, so
no window spans more than one day of a group. Then islands are passed over once, in order of arrival. What a task holds is the recorded runs of
one island, not its sightings: an island that is never idle may be a whole group.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.fixed import DEDUP_MARGIN_S

_DAY = 86_400_000_000


def _islands(df: DataFrame, margin_us: int) -> DataFrame:
    """df(g, s, e in microseconds) with `island`."""
    reach = F.greatest("s", F.coalesce("e", "s")) + F.lit(2 * margin_us)
    df = df.withColumns({"__day": F.floor(F.col("s") / F.lit(_DAY)), "__reach": reach})
    days = df.groupBy("g", "__day").agg(F.max("__reach").alias("__far"))
    carried = F.max("__far").over(Window.partitionBy("g").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    df = df.join(days.withColumn("__carry", carried).drop("__far"), ["g", "__day"])
    order = Window.partitionBy("g", "__day").orderBy("s", "id")
    before = F.greatest(F.max("__reach").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carry"))
    df = df.withColumn("__new", F.when(before.isNull() | (F.col("s") > before), F.col("s")))
    inside = F.last("__new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # an island that began on an earlier day goes by that day's last beginning
    starts = df.groupBy("g", "__day").agg(F.max("__new").alias("__last"))
    earlier = F.last("__last", ignorenulls=True).over(Window.partitionBy("g").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__in", inside).join(starts.withColumn("__from", earlier).drop("__last"), ["g", "__day"])
    return df.withColumn("island", F.coalesce("__in", "__from")).drop("__day", "__reach", "__carry", "__new", "__in", "__from")


class Runs:
    """Recorded runs of one island: intervals by start, in blocks that know their farthest end."""

    _BLOCK = 1024

    def __init__(self, margin: int) -> None:
        self.margin = margin
        self.blocks: list[list[tuple[int, int, int]]] = []  # (start, id, end), ascending over blocks and in each
        self.far = np.zeros(0, np.int64)
        self.low = np.zeros(0, np.int64)

    def find(self, s: int) -> int | None:
        """The id of the run with the least start whose widened interval holds s."""
        near = np.flatnonzero((self.far >= s - self.margin) & (self.low <= s + self.margin))
        for at in near.tolist():
            for start, ident, end in self.blocks[at]:
                if start > s + self.margin:
                    return None
                if end >= s - self.margin and start - self.margin <= s:
                    return ident
        return None

    def add(self, s: int, ident: int, e: int) -> None:
        at = max(int(np.searchsorted(self.low, s, side="right")) - 1, 0)
        if not self.blocks:
            self.blocks, self.far, self.low = [[]], np.array([e]), np.array([s])
        block = self.blocks[at]
        bisect.insort(block, (s, ident, e))
        self.low[at], self.far[at] = block[0][0], max(self.far[at], e)
        if len(block) > self._BLOCK:
            half = [block[: len(block) // 2], block[len(block) // 2 :]]
            self.blocks[at : at + 1] = half
            self.low = np.concatenate([self.low[:at], [h[0][0] for h in half], self.low[at + 1 :]])
            self.far = np.concatenate([self.far[:at], [max(x[2] for x in h) for h in half], self.far[at + 1 :]])


def _decide(margin: int):  # noqa: ANN202
    """(g, island, a, id, s, e) sorted by g, island, a, id -> (id, anchor)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, Runs(margin)
        for batch in batches:
            ids, starts, ends = (batch.column(c).to_pylist() for c in ("id", "s", "e"))
            anchors = []
            for key, ident, s, e in zip(zip(batch.column("g").to_pylist(), batch.column("island").to_pylist()), ids, starts, ends):
                if key != now:
                    now, runs = key, Runs(margin)
                hit = runs.find(s)
                if hit is None:
                    runs.add(s, ident, s if e is None else max(s, e))
                anchors.append(ident if hit is None else hit)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(anchors, pa.int64())], names=["id", "anchor"])

    return task


def first_wins(df: DataFrame, *, group: str, arrival: str, ident: str, start: str, end: str, margin_s: float = DEDUP_MARGIN_S) -> DataFrame:
    """(id bigint, anchor bigint): each sighting with the run it belongs to; anchor = id for those that are recorded.

    start and end are timestamps. Arrival must be given; the order of files means nothing.
    """
    margin = int(margin_s * 1_000_000)
    slim = df.select(F.col(group).alias("g"), F.col(arrival).alias("a"), F.col(ident).cast("bigint").alias("id"), F.unix_micros(F.col(start).cast("timestamp")).alias("s"), F.unix_micros(F.col(end).cast("timestamp")).alias("e"))
    timed = _islands(slim.where(F.col("s").isNotNull()), margin)
    ordered = timed.select("g", "island", "a", "id", "s", "e").repartition("g", "island").sortWithinPartitions("g", "island", "a", "id")
    out = ordered.mapInArrow(_decide(margin), "id bigint, anchor bigint")
    return out.unionAll(slim.where(F.col("s").isNull()).select("id", F.col("id").alias("anchor")))


def corroborations(decided: DataFrame) -> DataFrame:
    """(id, corroborations) of the recorded runs of first_wins()."""
    return decided.groupBy(F.col("anchor").alias("id")).agg((F.count("*") - 1).alias("corroborations"))
