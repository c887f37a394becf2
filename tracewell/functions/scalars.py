"""Scalar functions of the engine as Column expressions; none of them runs Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import fixed

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row: without this, inside a lambda, it is computed wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------------------------------------ time


def iso_micros(ts: Cols) -> Column:
    """UTC text with microseconds and offset, also for whole seconds."""
    return F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def instant(text: Cols) -> Column:
    """Timestamp of an ISO text, null if it isn't one; without an offset it is UTC."""
    return _c(text).try_cast("timestamp")


def entry_time(text: Cols) -> Column:
    """A history entry's time: kept as it is if it can be read, else null."""
    return F.when(instant(text).isNotNull(), _c(text))


def bucket_time(text: Cols, millis: int = fixed.DEDUP_BUCKET_MS) -> Column:
    """Time floored to a grid within the second; text that is no time stays as it is."""
    micros = F.unix_micros(instant(text))
    return F.coalesce(iso_micros(F.timestamp_micros(micros - F.pmod(micros, F.lit(millis * 1000)))), _c(text))


def human_time(ts: Cols) -> Column:
    return F.concat(F.date_format(ts, "d MMM yyyy, h:mm "), F.lower(F.date_format(ts, "a")))


def human_size(n: Cols) -> Column:
    n = _c(n).cast("double")
    sized = lambda power, unit: F.format_string(f"%.1f {unit}", n / F.lit(1024.0**power))
    return F.when(n < 1024, F.format_string("%.0f bytes", n)).when(n < 1024**2, sized(1, "KB")).when(n < 1024**3, sized(2, "MB")).otherwise(sized(3, "GB"))


def seconds_between(start: Cols, end: Cols) -> Column:
    return (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / F.lit(1e6)


def and_list(names: Cols) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    names = _c(names)
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


# ----------------------------------------------------------------------------------------------- paths


def file_path(raw: Cols) -> Column:
    """The file a parameter value names, or null: memory layers, temporary outputs and virtual files name none."""
    text = F.trim(_c(raw))
    none = text.isin(*fixed.NO_FILE)
    for prefix in fixed.NO_FILE_PREFIXES:
        none = none | text.startswith(prefix)
    none = none | (text.startswith("<") & text.endswith(">"))
    path = text
    for selector in fixed.SELECTORS:
        path = F.substring_index(path, selector, 1)
    return F.when(~none & (path != ""), path)


def path_label(label: Cols, path: Cols, param: Cols) -> Column:
    return F.coalesce(F.nullif(_c(label), F.lit("")), F.element_at(F.split(_c(path), "/"), -1), F.concat(_c(param), F.lit(" (temporary)")))


def canonical_format(name: Cols) -> Column:
    """Known driver names get one spelling; others pass."""
    table = F.create_map(*[F.lit(x) for pair in fixed.FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(_c(name)))), _c(name))


def provider_of(provider: Cols, algorithm: Cols) -> Column:
    return F.coalesce(F.nullif(_c(provider), F.lit("")), F.when(F.instr(_c(algorithm), ":") > 0, F.substring_index(_c(algorithm), ":", 1)))


def input_role(param: Cols) -> Column:
    return F.when(_c(param) == "OVERLAY", "overlay").otherwise("input")


# ------------------------------------------------------------------------------------------------ values


def masked(text: Cols) -> Column:
    """Object addresses are no part of a value."""
    return F.regexp_replace(_c(text), "0x[0-9a-fA-F]+", "0x…")


def selection(value: Cols) -> Column:
    """A JSON object that names a source and says that only its selected features were used becomes a text that says so; other values stay."""

    def chosen(v: Column) -> Column:
        source = F.try_variant_get(v, "$.source", "string")
        only = F.try_variant_get(v, "$.selectedFeaturesOnly", "boolean")
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return F.when(is_object & F.coalesce(only, F.lit(False)) & source.isNotNull(), F.concat(source, F.lit(fixed.SELECTED))).otherwise(_c(value))

    return bound(F.try_parse_json(_c(value)), chosen)


def parameters_object(v: Column) -> Column:
    """JSON text of a variant that holds parameters: an object as it is, anything else under one key, nothing as an empty object."""
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(v.isNull(), F.lit("{}")).when(is_object, F.to_json(v)).otherwise(F.concat(F.lit('{"' + fixed.WRAPPED + '":'), F.to_json(v), F.lit("}")))


def whole_number(x: Cols) -> Column:
    n = _c(x).try_cast("bigint")
    return F.when(n >= 0, n)


def finite_number(x: Cols) -> Column:
    n = _c(x).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def as_int(text: Cols) -> Column:
    return F.trim(_c(text).cast("string")).try_cast("bigint")


def layer_kind(feature_count: Cols, band_count: Cols, given: Cols) -> Column:
    return F.when(_c(feature_count).isNotNull(), "vector").when(_c(band_count).isNotNull(), "raster").otherwise(F.coalesce(_c(given), F.lit("unknown")))


def pixel_size(x: Cols, y: Cols) -> Column:
    x, y = finite_number(x), finite_number(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.array(x, y))


def canonical_json(text: Cols) -> Column:
    """JSON with sorted keys; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(_c(text))), _c(text))


def sorted_map(m: Cols) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(_c(m))))


# ------------------------------------------------------------------------------------------------- keys


def dedup_group(algorithm: Cols, parameters: Cols) -> Column:
    """Algorithm and the first 16 hex digits of the digest of its parameters (canonical JSON)."""
    return F.concat(_c(algorithm), F.lit("|"), F.substring(F.sha2(_c(parameters).cast("binary"), 256), 1, 16))


def dedup_key(algorithm: Cols, parameters: Cols, started: Cols) -> Column:
    return F.concat(dedup_group(algorithm, parameters), F.lit("|"), bucket_time(started))


def dedup_parameters(scalars: Cols, inputs: Cols, outputs: Cols) -> Column:
    """One map of scalars (map<string,string>) and the paths of inputs and outputs by parameter; the last of a repeated key counts."""
    paths = lambda layers: F.transform(F.coalesce(_c(layers), F.array()), lambda x: F.struct(x["param"].alias("key"), x["path"].alias("value")))
    entries = F.concat(F.map_entries(_c(scalars)), paths(inputs), paths(outputs))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(last))


def environment_fingerprint(qgis: Cols, os_info: Cols, python: Cols, plugins: Cols) -> Column:
    body = F.struct(_c(os_info).alias("os_info"), sorted_map(plugins).alias("plugin_versions"), _c(python).alias("python_version"), _c(qgis).alias("qgis_version"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}).cast("binary"), 256)


def derived_id(*parts: Cols) -> Column:
    """An id in UUID form that depends on its parts alone, so that retried tasks agree."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(_c(p).cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def same_probe(size_a: Cols, time_a: Cols, size_b: Cols, time_b: Cols) -> Column:
    """True or false if both probes are there, else null."""
    return F.when(_c(size_a).isNotNull() & _c(time_a).isNotNull() & _c(size_b).isNotNull() & _c(time_b).isNotNull(), (_c(size_a) == _c(size_b)) & (_c(time_a) == _c(time_b)))


def suggested_name(names: Cols) -> Column:
    """A title for steps in order: all of up to three, else the first and last with their number."""
    kept = F.filter(F.transform(_c(names), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    n = F.size(kept)
    many = F.concat(F.element_at(kept, 1), F.lit(" to "), F.element_at(kept, -1), F.lit(" ("), n.cast("string"), F.lit(" steps)"))
    return F.when(n == 0, fixed.UNNAMED).when(n <= fixed.NAMED_STEPS, F.array_join(kept, ", then ")).otherwise(many)
