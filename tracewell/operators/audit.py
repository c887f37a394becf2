"""Fingerprints, dataset status and audit scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.fixed import AUDIT_WEIGHTS
from tracewell.operators.lookup import latest


def fingerprints(df: DataFrame, ident: str, content: str) -> DataFrame:
    """(entity_id, hash_value, file_size_bytes) of contents that are there."""
    body = F.col(content).cast("binary")
    return df.where(F.col(content).isNotNull()).select(F.col(ident).alias("entity_id"), F.sha2(body, 256).alias("hash_value"), F.octet_length(body).cast("bigint").alias("file_size_bytes"))


def dataset_status(recorded: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): verified, changed, missing, or new where only the scan has it."""
    a, b = recorded.select(key, F.col(value).alias("__was"), F.lit(True).alias("__r")), current.select(key, F.col(value).alias("__is"), F.lit(True).alias("__c"))
    status = F.when(F.col("__c").isNull(), "missing").when(F.col("__r").isNull(), "new").when(F.col("__was").eqNullSafe(F.col("__is")), "verified").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def latest_fingerprint(df: DataFrame) -> DataFrame:
    return latest(df, ["entity_id"], F.desc("computed_at"), F.desc("id"))


def fingerprinted(fingerprints_: DataFrame, entities: DataFrame) -> DataFrame:
    """fingerprints with the path and version of the entity that each is of."""
    named = entities.select(F.col("id").alias("entity_id"), "file_path", "content_version")
    return fingerprints_.join(named, "entity_id")


def environment_similar(a: Column, b: Column, level: str = "major") -> Column:
    """Do two versions agree in their first number, or their first two?"""
    n = {"major": 1, "minor": 2}[level]
    head = lambda x: F.array_join(F.slice(F.split(x, "\\."), 1, n), ".")
    return head(a) == head(b)


def audit_scores(checks: DataFrame, key: str) -> DataFrame:
    """Per key: share (0 to 100) of rows that pass each check, and their weighted sum. Checks are boolean columns named as the weights."""
    share = lambda c: F.avg(_passed(c))
    shares = [F.round(share(c) * 100, 4).alias(f"{c}_score") for c in AUDIT_WEIGHTS]
    return checks.groupBy(key).agg(*shares, _overall(share).alias("overall_score"))


def _passed(check: str) -> Column:
    return F.coalesce(F.col(check).cast("double"), F.lit(0.0))


def _overall(share: Callable[[str], Column]) -> Column:
    """Weighted sum of the shares of rows that pass each check."""
    return F.round(sum((share(c) * w for c, w in AUDIT_WEIGHTS.items()), F.lit(0.0)), 4)


#: What a scenario of the change experiment is expected to be judged as.
CHANGES = ("unchanged", "input deleted", "input modified", "input replaced", "version changed", "plugin uninstalled")


def change_kind(checks: DataFrame) -> Column:
    """What an audited row shows, from its checks and whether a file of another size is there: one of CHANGES."""
    return (
        F.when(~F.col("input_exists"), "input deleted").when(~F.col("input_unchanged") & ~F.col("same_size"), "input replaced").when(~F.col("input_unchanged"), "input modified")
        .when(~F.col("algorithm_available"), "plugin uninstalled").when(~F.col("environment_similar"), "version changed").otherwise("unchanged")
    )


def change_experiment(baseline: DataFrame, scenarios: dict[str, DataFrame], key: str) -> DataFrame:
    """(scenario, found, n, overall_score): what the audit of each changed world finds, and how it scores.

    baseline and every scan have key, hash, size, version (of the host) and plugins (array<string>); the baseline also names the plugin it needs.
    Scans are as large as the baseline, so they are merged with it and never sent to the driver to be broadcast; rows are counted in one pass, and the scores
    come from the counts.
    """
    was = baseline.select(key, *[F.col(c).alias(f"__{c}") for c in ("hash", "size", "version", "plugin")])
    out = None
    for name, scan in scenarios.items():
        now = was.join(scan.select(key, "hash", "size", "version", "plugins", F.lit(True).alias("__there")).hint("merge"), key, "left")
        checks = now.select(
            F.coalesce("__there", F.lit(False)).alias("input_exists"), F.coalesce(F.col("hash") == F.col("__hash"), F.lit(False)).alias("input_unchanged"), F.coalesce(F.col("size") == F.col("__size"), F.lit(False)).alias("same_size"),
            # without the file the rest of the world is not judged by its row
            F.coalesce(F.array_contains("plugins", F.col("__plugin")), F.lit(True)).alias("algorithm_available"), F.coalesce(environment_similar(F.col("__version"), F.col("version")), F.lit(True)).alias("environment_similar"),
            F.lit(True).alias("parameters_valid"), F.lit(name).alias("scenario"),
        )
        found = checks.withColumn("found", change_kind(checks)).groupBy("scenario", "found").agg(F.count("*").alias("n"), *[F.sum(_passed(c)).alias(f"__{c}") for c in AUDIT_WEIGHTS])
        out = found if out is None else out.unionAll(found)
    world = Window.partitionBy("scenario")
    share = lambda c: F.sum(f"__{c}").over(world) / F.sum("n").over(world)
    return out.select("scenario", "found", "n", _overall(share).alias("overall_score"))
