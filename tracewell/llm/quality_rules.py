"""Quality rules: ordered lists of learned threshold conjunctions over text statistics.

Statistics are built-in Spark expressions computed row by row, so scoring is one narrow stage without shuffles or Python workers.
The learner is sequential covering: a rule grows by the condition of the largest information gain on two thirds of the labelled
rows, loses conditions from its end while that helps on the other third, and is kept if it is precise there. The rows it
covers leave, and the next rule is grown. The result is a list of conjunctions, which `verdict` turns into one CASE expression.

Nulls and edge cases: a null or blank text has zero words and fails the base rule; null labels are not learned from; with no
labelled row of either class no rule is learned and the base rule alone decides; repeated rows are judged one by one; rows with equal
statistics always get equal verdicts; a very long text is judged whole, in arrays of its words and of a hash for each of its windows; an empty table
gives an empty result. Extra columns are passed on by keep(), whatever their names; judge() replaces those that have a statistic's name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import free_name, text_or_empty, words_column

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Shares the learner sees, all scale-free, so that a rule does not depend on how long texts happen to be.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share", "same_as_last_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice. Only texts in which a window repeats pay for the second, sorted pass."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(n >= WINDOW, keys).otherwise(F.array().cast("array<bigint>"))


def _covered(keys: Column) -> Column:
    """Length of the union of [p, p + 8) over the places p whose key is not unique; O(n log n)."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def repeated(arr: Column) -> Column:
        near = lambda e, j: F.coalesce(F.get(arr, j)["k"] == e["k"], F.lit(False))
        return F.sort_array(F.transform(F.filter(arr, lambda e, j: near(e, j - 1) | near(e, j + 1)), lambda e: e["i"]))

    def union(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    # a one-element transform binds an intermediate array once instead of repeating its expression
    bound = F.transform(F.array(placed), lambda arr: F.transform(F.array(repeated(arr)), union)[0])[0]
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), bound).otherwise(F.lit(0).cast("bigint"))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus the base counts and the learner's shares, all native expressions of its text column."""
    words, lines, keys, t = (free_name(df, f"__{x}") for x in ("words", "lines", "keys", "t"))
    df = df.withColumn(t, text_or_empty(text))
    df = df.withColumns({words: words_column(F.col(t)), lines: F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))})
    df = df.withColumn(keys, _repeat_words(F.col(words)))
    count = lambda pattern: F.regexp_count(F.col(t), F.lit(pattern)).cast("long")
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(F.col(words), "")).cast("long"),
            "n_symbols": count(SYMBOLS),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
            "n_repeat_words": _covered(F.col(keys)),
            "n_upper": count("[A-Z]"),
            "n_bang": count("!"),
            "n_distinct": F.size(F.array_distinct(F.col(words))).cast("long"),
            "n_same": F.size(F.filter(F.col(words), lambda w, i: (i > 0) & (w == F.coalesce(F.get(F.col(words), i - 1), F.lit(""))))).cast("long"),
        }
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
            "bang_share": share("n_bang", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
            "same_as_last_share": share("n_same", "n_words"),
        }
    ).drop(words, lines, keys, t)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# ---------------------------------------------------------------------------------------------- learning


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _best_condition(rows: list[dict], thresholds: dict[str, list[float]]) -> tuple[float, Condition | None]:
    p0 = sum(r["bad"] for r in rows)
    n0 = len(rows) - p0
    best, chosen = 0.0, None
    for feature, cuts in thresholds.items():
        pos, neg = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
        for r in rows:
            lo, hi = 0, len(cuts)
            while lo < hi:  # cuts at or below the value
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if cuts[mid] <= r[feature] else (lo, mid)
            (pos if r["bad"] else neg)[lo] += 1
        p = n = 0
        for i in range(len(cuts) - 1, -1, -1):
            p, n = p + pos[i + 1], n + neg[i + 1]
            for above, (a, b) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                g = _gain(p0, n0, a, b)
                if g > best:
                    # "at most" takes the midpoint below the cut, so that both directions split between the same two values
                    best, chosen = g, Condition(feature, above, cuts[i] if above else math.nextafter(cuts[i], -math.inf))
    return best, chosen


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.97, min_cover: int = 5, cuts: int = 48) -> list[Rule]:
    """Decision list for rows of {feature: value, "bad": 0 or 1, "part": 0..2}; part 2 is the pruning third.

    A kept rule covers at least min_cover pruning rows at min_precision or better, so clean texts are not paid for small gains.
    """
    grow, prune = [r for r in rows if r["part"] != 2], [r for r in rows if r["part"] == 2]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        thresholds = {}
        for f in FEATURES:
            ordered = sorted({r[f] for r in grow if r["bad"]} | {r[f] for r in grow[:: max(1, len(grow) // 2000)]})
            step = max(1, len(ordered) // cuts)
            thresholds[f] = ordered[1::step]
        rule, inside = (), grow
        while len(rule) < max_conditions and any(not r["bad"] for r in inside):
            _, condition = _best_condition(inside, thresholds)
            if condition is None:
                break
            rule, inside = (*rule, condition), [r for r in inside if condition.holds(r)]

        def worth(candidate: Rule) -> tuple[float, int]:
            hit = [r["bad"] for r in prune if _covers(candidate, r)]
            return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -len(candidate))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [r["bad"] for r in prune if rule and _covers(rule, r)]
        if len(hit) < min_cover or sum(hit) < min_precision * len(hit):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _covers(rule, r)] for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 6000) -> list[Rule]:
    """Learn from at most max_rows labelled rows, the ones with the smallest hash of their id; only their statistics reach the driver."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).alias("__label"))
    chosen = chosen.groupBy("__id").agg(F.min("__label").alias("__label"), F.xxhash64(F.first("__id")).alias("__h")).orderBy("__h", "__id").limit(max_rows)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    # the broadcast side has at most max_rows rows of two numbers
    rows = with_statistics(slim.join(F.broadcast(chosen), "__id"), "__text")
    picked = rows.select(base_failed().alias("failed"), (F.col("__label") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)).alias("part"), "__id", *FEATURES)
    return learn([r.asDict() for r in picked.orderBy("__id", *FEATURES).limit(max_rows).collect() if not r["failed"]])


def verdict(rules: list[Rule]) -> Column:
    """Position of the first rule that covers a row, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule (the first that covers the row) and kept."""
    out = with_statistics(docs, text)
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs alone.

    A predicate on computed columns is pushed below their projection with every expression written out at each use, which
    makes word arrays again for each element. A non-deterministic column in between stops that.
    """
    body, barrier, names = free_name(docs, "__body"), free_name(docs, "__barrier"), [free_name(docs, f"__c{i}") for i in range(len(docs.columns))]
    # docs' own columns travel under free names, so that none of them clashes with a statistic
    moved = docs.toDF(*names).withColumn(body, F.col(names[[c.lower() for c in docs.columns].index(text.lower())]))
    judged = judge(moved, rules, body).select(*names, "kept").withColumn(barrier, F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col(barrier) >= 0)).select(*names).toDF(*docs.columns)
