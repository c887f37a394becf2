"""The data model: capture events and the eight tables of the log. Schemas are fixed, never inferred."""

from __future__ import annotations

LAYER = "struct<param:string,path:string,format:string,crs:string,layer_type:string,feature_count:bigint,band_count:bigint,pixel_size:array<double>,width:bigint,height:bigint>"
AGENT = "struct<qgis_version:string,os_info:string,python_version:string,plugin_versions:map<string,string>>"

EVENT = (
    "event_id string, session_id string, source string, algorithm_id string, algorithm_name string, provider string, started_at string, ended_at string, status string, "
    f"parameters variant, inputs array<{LAYER}>, outputs array<{LAYER}>, agent {AGENT}, execution_log string"
)

TABLES = {
    "entities": "id string, entity_type string, label string, file_path string, content_version int, format string, crs string, layer_type string, created_at timestamp, metadata string",
    "activities": "id string, algorithm_id string, algorithm_name string, provider string, session_id string, started_at timestamp, ended_at timestamp, parameters string, status string, execution_log string, capture_channel string, corroborations int, dedup_key string",
    "agents": "id string, agent_type string, label string, qgis_version string, os_info string, python_version string, plugin_versions map<string,string>, created_at timestamp, env_fingerprint string",
    "fingerprints": "id string, entity_id string, hash_algorithm string, hash_value string, hash_strategy string, file_size_bytes bigint, feature_count bigint, computed_at timestamp",
    "relations": "id string, relation_type string, source_id string, target_id string, role string, qgis_param_key string, created_at timestamp",
    "workflows": "id string, name string, description string, session_id string, created_at timestamp, updated_at timestamp",
    "workflow_activities": "workflow_id string, activity_id string, sequence_order int",
    "audit_results": "id string, workflow_id string, audited_at timestamp, overall_score double, input_exists_score double, input_unchanged_score double, algorithm_available_score double, environment_similar_score double, parameters_valid_score double, details string",
}

#: Schema version of a stored log; newer than this is refused.
VERSION = 1

# The domains of enumerated columns.
ROLES = ("input", "output", "overlay", "parameter")
RELATION_TYPES = ("wasGeneratedBy", "used", "wasDerivedFrom", "wasAssociatedWith", "wasAttributedTo")
STATUSES = ("completed", "failed", "cancelled")
CHANNELS = ("post_hook", "run_wrapper", "history_signal")
LAYER_TYPES = ("vector", "raster", "table", "unknown")

#: Columns whose values identify a row; rows with a null in one never collide.
UNIQUE = {
    "entities": [("id",), ("file_path", "content_version")],
    "activities": [("id",), ("dedup_key",)],
    "agents": [("id",), ("env_fingerprint",)],
    "fingerprints": [("id",), ("entity_id", "computed_at")],
    "relations": [("id",)],
    "workflows": [("id",)],
    "workflow_activities": [("workflow_id", "activity_id")],
    "audit_results": [("id",)],
}

FOREIGN = {
    "fingerprints": [("entity_id", "entities", "id")],
    "workflow_activities": [("workflow_id", "workflows", "id"), ("activity_id", "activities", "id")],
    "audit_results": [("workflow_id", "workflows", "id")],
}

CHECKS = {
    "activities": "status IN ('completed', 'failed', 'cancelled')",
    "relations": "relation_type IN ('wasGeneratedBy', 'used', 'wasDerivedFrom', 'wasAssociatedWith', 'wasAttributedTo') AND (role IS NULL OR role IN ('input', 'output', 'overlay', 'parameter'))",
}

NOT_NULL = {"workflows": ("name",)}
