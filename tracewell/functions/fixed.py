"""Fixed values that results depend on."""

# Values of a parameter that name no file, and prefixes of such values.
NO_FILE = ("TEMPORARY_OUTPUT", "memory", "")
NO_FILE_PREFIXES = ("memory:", "/vsimem/", "/vsizip/", "/vsicurl/", "vsimem/")

# Selectors that follow a path.
SELECTORS = ("|layername=", "|layerid=", "|subset=", "|selectedFeaturesOnly=")

# Format names by lowered driver name.
FORMATS = {
    "esri shapefile": "Shapefile",
    "gpkg": "GeoPackage",
    "geopackage": "GeoPackage",
    "gtiff": "GeoTIFF",
    "memory": "Memory",
    "delimitedtext": "Delimited text",
    "postgres": "PostGIS",
    "spatialite": "SpatiaLite",
    "wfs": "WFS",
    "wms": "WMS",
}

# Kinds of parameters that name datasets.
INPUT_KINDS = ("source", "layer", "vector", "raster", "mesh", "multilayer", "maplayer", "pointcloud", "annotation", "vectortile")
OUTPUT_KINDS = (
    "sink", "vectorDestination", "rasterDestination", "fileDestination", "folderDestination", "pointCloudDestination", "vectorTileDestination",
    "outputVector", "outputRaster", "outputLayer", "outputFile", "outputFolder", "outputMultilayer", "outputPointCloud", "outputVectorTile",
)

# What marks a dataset of which only the selected features were used, the key of parameters that come without keys, and the depth of nesting that is kept.
SELECTED = "|selectedFeaturesOnly=yes"
WRAPPED = "_parameters"
MAX_DEPTH = 6

# Facts of a layer that results may fill in.
FILLED = ("format", "crs", "feature_count", "band_count", "pixel_size", "width", "height")

# How history payloads spell what is looked for; a payload's value is that of the earliest spelling it has. Last, the algorithm in a recorded command.
ALGORITHM_KEYS = ("algorithm_id", "algorithmId", "alg_id", "algorithm")
PARAMETER_KEYS = ("parameters", "algorithm_parameters", "params")
COMMAND_KEYS = ("python_command", "command", "pythonCommand")
COMMAND_PATTERN = r"""run\s*\(\s*["']([^"']+)["']"""

DEDUP_BUCKET_MS = 100
DEDUP_MARGIN_S = 2.0
HANDOVER_MAX_S = 3600
POLL_INTERVAL_MS = 5000

UNNAMED = "Untitled work"
NAMED_STEPS = 3

# Weights of the audit score.
AUDIT_WEIGHTS = {"input_exists": 30, "input_unchanged": 25, "algorithm_available": 20, "environment_similar": 15, "parameters_valid": 10}
