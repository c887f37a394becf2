"""The log as a directory of Parquet tables: append-only, checked before each append, committed by batch.

Rows are never changed. Corrections are rows of their own: workflow names come from a change table, deletions from tombstones, new
members from a reset, and a sighting that corroborates an activity is a sighting row that is counted when read.

A batch is written under an attempt of its own: the attempt is announced in `intents`, then its rows are written, then it is entered in
`commits`. Readers leave out the rows of attempts that were announced but not committed, so a batch that broke off and was written again counts
once. Of these there are few however long the log is: it is they that are joined with the rows, not the commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import grouping, validate
from tracewell.plans.tables import stored

SETTING = "spark.tracewell.path"
_EXTRA = {
    "sightings": "activity_id string, event_id string, source string, seen_at timestamp",
    "workflow_changes": "workflow_id string, name string, description string, changed_at timestamp",
    "workflow_tombstones": "workflow_id string, deleted_at timestamp",
    "workflow_revivals": "workflow_id string, revived_at timestamp",
    "member_resets": "workflow_id string, reset_at timestamp",
    "intents": "batch string, attempt string",
    "commits": "batch string, attempt string, version int",
}


class StoreError(ValueError):
    pass


def resolve_path(spark: SparkSession, override: str | None = None, default: str = "tracewell-log") -> str:
    """Where the log is: the argument, else the setting, else the default."""
    return (override or "").strip() or (spark.conf.get(SETTING, "") or "").strip() or default


#: What takes a log from version n to n + 1, by n. Forward only.
MIGRATIONS: dict[int, Callable[["LogStore"], None]] = {}


class LogStore:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, resolve_path(spark, path)
        version = self.schema_version()
        if version > schemas.VERSION:
            raise StoreError(f"the log has schema version {version}; this code knows {schemas.VERSION}")
        if not version and any(self._exists(name) for name in schemas.TABLES):
            raise StoreError("there are tables without a version")
        while 0 < version < schemas.VERSION:
            MIGRATIONS[version](self)
            version += 1
            self._commit(f"migrated to {version}", version)

    # -------------------------------------------------------------------------------------------- tables

    def _schema(self, name: str) -> str:
        if name in _EXTRA:
            return _EXTRA[name]
        if name not in schemas.TABLES:
            raise StoreError(f"no table {name!r}")
        return schemas.TABLES[name]

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _raw(self, name: str) -> DataFrame:
        schema = self._schema(name) + ("" if name in ("commits", "intents") else ", attempt string")
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _committed(self, name: str) -> DataFrame:
        """Committed rows, with their attempt."""
        broken = self._raw("intents").join(self._raw("commits").select("attempt"), "attempt", "left_anti").select("attempt")
        return self._raw(name).join(broken, "attempt", "left_anti")

    def table(self, name: str) -> DataFrame:
        """Committed rows."""
        return self._committed(name).drop("attempt")

    def schema_version(self) -> int:
        return (self._raw("commits").agg(F.max("version")).first()[0] if self._exists("commits") else None) or 0

    def counts(self) -> DataFrame:
        """(table_name, n) of the eight tables, as they are now."""
        now = {"workflows": self.workflows, "workflow_activities": self.members}
        out = None
        for name in schemas.TABLES:
            one = now.get(name, lambda name=name: self.table(name))().agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            out = one if out is None else out.unionAll(one)
        return out

    def summary(self) -> dict[str, int]:
        """counts() as a dictionary; empty if the log can't be read."""
        try:
            return {r["table_name"]: r["n"] for r in self.counts().collect()}
        except Exception:  # noqa: BLE001  a summary is for display and never fails
            return {}

    # -------------------------------------------------------------------------------------------- writes

    def committed(self, batch: str) -> bool:
        return not self._raw("commits").where(F.col("batch") == batch).isEmpty()

    def append(self, batch: str, tables: dict[str, DataFrame], check: bool = True) -> None:
        """Add one unit of rows, all or nothing. A batch that was committed before is left out, so retries do no harm."""
        if self.committed(batch):
            return
        if check:
            for name, rows in tables.items():
                if name in schemas.TABLES:
                    there = {n: self.table(n).unionByName(tables[n]) if n in tables else self.table(n) for n in {f[1] for f in schemas.FOREIGN.get(name, ())}}
                    existing = self.table(name)
                    if name == "workflow_activities":
                        existing = self.members()
                        if "member_resets" in tables:
                            existing = existing.join(tables["member_resets"].select("workflow_id"), "workflow_id", "left_anti")
                    found = validate.violations(name, rows, existing, there).limit(5).collect()
                    if found:
                        raise StoreError("; ".join(f"{name}: {r['problem']} ({r['example']})" for r in found))
        attempt = uuid.uuid4().hex
        self._write("intents", self.spark.createDataFrame([(batch, attempt)], _EXTRA["intents"]).coalesce(1))
        for name, rows in tables.items():
            columns = [c.split()[0] for c in _split_ddl(self._schema(name))]
            self._write(name, rows.select(*columns).withColumn("attempt", F.lit(attempt)))
        self._commit(batch, schemas.VERSION, attempt)

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _commit(self, batch: str, version: int, attempt: str | None = None) -> None:
        self._write("commits", self.spark.createDataFrame([(batch, attempt, version)], _EXTRA["commits"]).coalesce(1))

    def _now(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, F.current_timestamp())

    def _workflow(self, ident: str) -> None:
        if self.workflows().where(F.col("id") == ident).isEmpty():
            raise StoreError(f"no workflow {ident!r}")

    def update_workflow(self, batch: str, ident: str, *, name: str | None = None, description: str | None = None) -> None:
        """Change what is given; nothing happens if nothing is. An unknown id is an error."""
        if name is None and description is None or self.committed(batch):
            return
        self._workflow(ident)
        row = self.spark.createDataFrame([(ident, name, description)], "workflow_id string, name string, description string")
        self.append(batch, {"workflow_changes": self._now(row, "changed_at")})

    def delete_workflow(self, batch: str, ident: str) -> None:
        """The workflow and its membership go; its activities stay."""
        if not self.committed(batch):
            self._workflow(ident)
            self.append(batch, {"workflow_tombstones": self._now(self.spark.createDataFrame([(ident,)], "workflow_id string"), "deleted_at")})

    def replace_members(self, batch: str, ident: str, activity_ids: list[str]) -> None:
        """These activities, in this order, are the workflow's members, and no others."""
        if not self.committed(batch):
            self._workflow(ident)
            rows = self.spark.createDataFrame([(ident, a, i) for i, a in enumerate(activity_ids)], schemas.TABLES["workflow_activities"])
            now = self._now(self.spark.createDataFrame([(ident, None, None)], "workflow_id string, name string, description string"), "changed_at")
            self.append(batch, {"workflow_activities": rows, "member_resets": now.select("workflow_id", F.col("changed_at").alias("reset_at")), "workflow_changes": now})

    def corroborate(self, batch: str, activity_id: str, event_id: str, source: str, seen_at: datetime) -> int:
        """Count one more sighting of an activity; returns how many there are. An unknown id is an error."""
        own = lambda: self.activities().where(F.col("id") == activity_id).select("corroborations").head(1)
        if not own():
            raise StoreError(f"no activity {activity_id!r}")
        self.append(batch, {"sightings": self.spark.createDataFrame([(activity_id, event_id, source, seen_at)], _EXTRA["sightings"])})
        return own()[0]["corroborations"]

    def regroup(self, batch: str, sessions: DataFrame) -> None:
        """Workflows of the sessions (session_id) follow what their activities share now, as one unit. Workflows that stay as they are get no rows."""
        if self.committed(batch):
            return
        activities = stored(self.activities().join(sessions.select("session_id").distinct(), "session_id", "left_semi"), "regroup-activities")
        links = grouping.session_datasets(activities, self.table("relations"), self.table("entities"))
        before, flows = self.members(), self.workflows()
        made = grouping.regroup(activities, links, flows, before)
        groups, members = made["workflows"], stored(made["members"], "regroup-members")
        fresh = groups.join(self.table("workflows").select("id"), "id", "left_anti")
        fresh = fresh.select("id", "name", F.lit(None).cast("string").alias("description"), "session_id", "created_at", F.col("created_at").alias("updated_at"))
        # those on record whose name changes, and those that come back after they were deleted
        same = flows.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
        renamed = groups.join(fresh.select("id"), "id", "left_anti").join(same, F.col("id") == F.col("__id"), "left").where(~F.col("name").eqNullSafe(F.col("__name")))
        back = renamed.where(F.col("__id").isNull()).select(F.col("id").alias("workflow_id"))
        changes = self._now(renamed.select(F.col("id").alias("workflow_id"), "name", F.lit(None).cast("string").alias("description")), "changed_at")
        key = ["workflow_id", "activity_id", "sequence_order"]
        mine = before.join(groups.select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi").select(*key)
        differ = members.select(*key).join(mine, key, "left_anti").unionAll(mine.join(members.select(*key), key, "left_anti")).select("workflow_id").distinct()
        differ = stored(differ, "regroup-differ")
        self.append(batch, {
            "workflows": fresh, "workflow_changes": changes, "workflow_activities": members.join(differ, "workflow_id", "left_semi"),
            "member_resets": self._now(differ, "reset_at"), "workflow_tombstones": self._now(made["deleted"], "deleted_at"), "workflow_revivals": self._now(back, "revived_at"),
        })

    # --------------------------------------------------------------------------------------- latest states

    def activities(self) -> DataFrame:
        """Activities with the number of further sightings."""
        seen = self.table("sightings").groupBy(F.col("activity_id").alias("id")).agg(F.count("*").cast("int").alias("seen"))
        rows = self.table("activities").join(seen, "id", "left")
        return rows.withColumn("corroborations", F.coalesce("corroborations", F.lit(0)) + F.coalesce("seen", F.lit(0))).drop("seen")

    def workflows(self) -> DataFrame:
        """Workflows with their newest non-null name and description, without the deleted ones, unless they came back since."""
        newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("changed_at")))
        last = self.table("workflow_changes").groupBy(F.col("workflow_id").alias("id")).agg(newest("name").alias("n"), newest("description").alias("d"), F.max("changed_at").alias("t"))
        gone = self.table("workflow_tombstones").groupBy(F.col("workflow_id").alias("id")).agg(F.max("deleted_at").alias("gone"))
        back = self.table("workflow_revivals").groupBy(F.col("workflow_id").alias("id")).agg(F.max("revived_at").alias("back"))
        gone = gone.join(back, "id", "left").where(F.col("back").isNull() | (F.col("back") <= F.col("gone")))
        rows = self.table("workflows").join(gone, "id", "left_anti").join(last, "id", "left")
        return rows.withColumns({"name": F.coalesce("n", "name"), "description": F.coalesce("d", "description"), "updated_at": F.coalesce("t", "updated_at")}).drop("n", "d", "t")

    def members(self) -> DataFrame:
        """Membership as it is now: of each workflow that there is, the rows written with its last reset, or all if there was none."""
        last = self._committed("member_resets").groupBy("workflow_id").agg(F.max_by("attempt", "reset_at").alias("__last"))
        rows = self._committed("workflow_activities").join(last, "workflow_id", "left").where(F.col("__last").isNull() | (F.col("attempt") == F.col("__last")))
        return rows.drop("attempt", "__last").join(self.workflows().select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi")


def _split_ddl(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]
