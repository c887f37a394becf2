"""From raw job facts to capture events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import fixed
from tracewell.functions import scalars as S


def describe_layer(param: Column, value: Column) -> Column:
    """Layer struct of a parameter value in JSON: an object of layer facts, or a text that names it."""
    texts = ("crs", "layer_type", "feature_count", "band_count", "pixel_x", "pixel_y", "width", "height")

    def facts(v: Column, is_object: Column) -> Column:
        """The facts as texts, each read once."""
        get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
        pick = lambda k: F.when(is_object, get(k))
        plain = F.coalesce(F.try_variant_get(v, "$", "string"), value)
        driver = F.coalesce(F.nullif(pick("driver"), F.lit("")), pick("provider"), pick("format"))
        place = F.when(is_object, F.coalesce(get("source"), get("path"))).otherwise(plain)
        return F.struct(place.alias("place"), driver.alias("driver"), *[pick(k).alias(k) for k in texts])

    def layer(x: Column) -> Column:
        features, bands = S.whole_number(x["feature_count"]), S.whole_number(x["band_count"])
        return F.struct(
            param.alias("param"),
            S.file_path(x["place"]).alias("path"),
            S.canonical_format(x["driver"]).alias("format"),
            F.nullif(x["crs"], F.lit("")).alias("crs"),
            S.layer_kind(features, bands, x["layer_type"]).alias("layer_type"),
            features.alias("feature_count"),
            bands.alias("band_count"),
            S.pixel_size(x["pixel_x"], x["pixel_y"]).alias("pixel_size"),
            S.whole_number(x["width"]).alias("width"),
            S.whole_number(x["height"]).alias("height"),
        ).cast(schemas.LAYER)

    return S.bound(F.try_parse_json(value), lambda v: S.bound(S.bound(F.schema_of_variant(v).startswith("OBJECT"), lambda is_object: facts(v, is_object)), layer))


def _kind(name: Column, definitions: Column) -> Column:
    return F.try_element_at(definitions, name)


def split_parameters(parameters: Column, definitions: Column) -> Column:
    """struct<scalars map, inputs array<layer>, outputs array<layer>> of parameters map<string, JSON>; what has no definition is a scalar."""
    entries = F.map_entries(F.coalesce(parameters, F.create_map().cast("map<string,string>")))
    of = lambda kinds: F.filter(entries, lambda e: F.coalesce(_kind(e["key"], definitions).isin(*kinds), F.lit(False)))
    layers = lambda xs: F.transform(xs, lambda e: describe_layer(e["key"], e["value"]))
    rest = F.filter(entries, lambda e: ~F.coalesce(_kind(e["key"], definitions).isin(*fixed.INPUT_KINDS, *fixed.OUTPUT_KINDS), F.lit(False)))
    return F.struct(F.map_from_entries(F.transform(rest, lambda e: F.struct(e["key"].alias("key"), S.masked(S.selection(e["value"])).alias("value")))).alias("scalars"), layers(of(fixed.INPUT_KINDS)).alias("inputs"), layers(of(fixed.OUTPUT_KINDS)).alias("outputs"))


def merge_results(outputs: Column, results: Column, definitions: Column) -> Column:
    """Declared outputs with what the job reported: reported paths win, other facts fill gaps.

    Reported datasets that weren't declared are added if their kind is an output's, or if they have no kind but a path.
    """
    results = F.coalesce(results, F.create_map().cast("map<string,string>"))

    def filled(layer: Column, seen: Column) -> Column:
        pick = {f: F.coalesce(layer[f], seen[f]) for f in fixed.FILLED} | {"param": layer["param"], "path": F.coalesce(seen["path"], layer["path"]), "layer_type": F.when(layer["layer_type"] == "unknown", seen["layer_type"]).otherwise(layer["layer_type"])}
        order = ("param", "path", "format", "crs", "layer_type", "feature_count", "band_count", "pixel_size", "width", "height")
        return F.struct(*[pick[f].alias(f) for f in order]).cast(schemas.LAYER)

    def merged(layer: Column) -> Column:
        value = F.try_element_at(results, layer["param"])
        return F.when(value.isNull(), layer).otherwise(S.bound(describe_layer(layer["param"], value), lambda seen: filled(layer, seen)))

    def added(declared: Column) -> Column:
        extra = F.filter(F.map_entries(results), lambda e: ~F.array_contains(declared, e["key"]))
        extra = F.transform(extra, lambda e: F.struct(_kind(e["key"], definitions).alias("kind"), describe_layer(e["key"], e["value"]).alias("layer")))
        extra = F.filter(extra, lambda e: F.coalesce(e["kind"].isin(*fixed.OUTPUT_KINDS), F.lit(False)) | (e["kind"].isNull() & e["layer"]["path"].isNotNull()))
        return F.transform(extra, lambda e: e["layer"])

    return S.bound(outputs, lambda layers: F.concat(F.transform(layers, merged), S.bound(F.transform(layers, lambda x: x["param"]), added)))


def build_events(raw: DataFrame) -> DataFrame:
    """Events of raw rows: session_id, source, algorithm_id, algorithm_name, provider, started_at, ended_at, status, execution_log, agent,
    parameters and results map<string, JSON>, definitions map<string, kind>. Also dedup_group and dedup_key.
    """
    parts = raw.withColumn("__d", F.coalesce("definitions", F.create_map().cast("map<string,string>"))).withColumn("__s", split_parameters(F.col("parameters"), F.col("__d")))
    parts = parts.withColumns({"inputs": F.col("__s.inputs"), "outputs": merge_results(F.col("__s.outputs"), F.col("results"), F.col("__d")), "__scalars": F.col("__s.scalars")})
    raw_json = F.to_json(S.sorted_map("parameters"))
    return parts.select(
        S.derived_id("session_id", "source", "algorithm_id", "started_at", raw_json).alias("event_id"), "session_id", "source", "algorithm_id", "algorithm_name", S.provider_of("provider", "algorithm_id").alias("provider"), "started_at", "ended_at",
        F.coalesce("status", F.lit("completed")).alias("status"), F.to_json(S.sorted_map("__scalars")).alias("parameters"), "inputs", "outputs", "agent", "execution_log",
        S.dedup_group("algorithm_id", raw_json).alias("dedup_group"), S.dedup_key("algorithm_id", raw_json, "started_at").alias("dedup_key"),
    )


def event_keys(events: DataFrame) -> DataFrame:
    """Events with dedup_group and dedup_key from their recorded parts, for replays without raw parameters."""
    scalars = F.coalesce(F.try_variant_get(F.col("parameters"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    text = F.map_from_entries(F.transform(F.map_entries(scalars), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
    body = F.to_json(S.dedup_parameters(text, "inputs", "outputs"), {"ignoreNullFields": "false"})
    return events.withColumns({"dedup_group": S.dedup_group("algorithm_id", body), "dedup_key": S.dedup_key("algorithm_id", body, "started_at")})
