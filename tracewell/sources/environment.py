"""The software environment that a job ran in."""

from __future__ import annotations

import json
import platform

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def probe(host_version: str | None = None, plugins: dict[str, str] | None = None) -> dict:
    """Facts of this process; what can't be found out is 'unknown'."""
    return {"qgis_version": host_version or "unknown", "os_info": platform.platform() or "unknown", "python_version": platform.python_version(), "plugin_versions": dict(plugins or {})}


def agent_column(facts: dict) -> Column:
    """The facts as an event's agent."""
    from tracewell.schemas import AGENT

    return F.from_json(F.lit(json.dumps(facts)), AGENT)


def cluster_agent(spark: SparkSession) -> Column:
    return agent_column(probe(f"spark {spark.version}"))
