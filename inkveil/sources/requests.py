"""Request rows: reading, checks, tag maps, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The accepted content types, and the messages of the responses.
CONTENT_TYPES = ("image/jpeg", "image/png", "image/jp2", "image/jpeg2000", "image/x-raw", "image/raw", "application/octet-stream")
NO_LIST = "No sensitive data list provided"
NOTHING = "No sensitive data detected"
SCHEMA = (
    "request_id long, image binary, content_type string, filename string, sensitive_data_list string, sop_instance_uid string, rows int, columns int, "
    "bits_allocated int, samples_per_pixel int, rescale_slope double, rescale_intercept double, window_center double, window_width double, "
    "is_monochrome1 boolean, palette_color_lut string, transfer_syntax_uid string, photometric_interpretation string"
)


def read_requests(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMA).format(kind).load(path)


def scan_dicom(spark: SparkSession, folder: str, only: str = "") -> DataFrame:
    """Files that are DICOM by name or by the mark at byte 128, hidden ones left out, by path.

    ``only`` keeps paths that hold it.  Listing and names come first; contents are read when a
    row needs them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(~name.startswith(".") & F.col("path").contains(only))
    named = F.lower(name).endswith(".dcm")
    mark = F.decode(F.substring("content", 129, 4), "US-ASCII") == "DICM"
    return files.filter(F.when(named, F.lit(True)).otherwise((F.col("length") >= 132) & mark)).select("path", "content").orderBy("path")


def golden_name(path: Column) -> Column:
    """Name of the golden file of a relative path."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"\.dcm$", ""), r"[/\\]", "__"), F.lit(".json"))


def api_version(accept: Column) -> Column:
    """Version asked for in an Accept header; 1 if none."""
    asked = F.regexp_extract(F.coalesce(accept, F.lit("")), r"version\s*=\s*(\d+)", 1)
    return F.when(asked == "", 1).otherwise(asked.try_cast("int"))


def check(requests: DataFrame) -> DataFrame:
    """Adds ``status`` and ``error``: 400 for the content type, then the JSON, then its kind; 406 for the version."""
    parsed = F.expr("try_parse_json(sensitive_data_list)")
    is_object = F.expr("schema_of_variant(try_parse_json(sensitive_data_list))").startswith("OBJECT")
    version = api_version(F.col("accept")) if "accept" in requests.columns else F.lit(1)
    good = F.col("content_type").isin(*CONTENT_TYPES)
    status = F.when(~good | parsed.isNull() | ~is_object, 400).when(version.isNull() | (version != 1), 406).otherwise(200)
    error = F.when(~good, "Unsupported file type.").when(parsed.isNull(), "Invalid JSON").when(~is_object, "sensitive_data_list must be a JSON object").when(status == 406, "Unsupported version")
    return requests.withColumn("status", status).withColumn("error", error)


def tag_rows(requests: DataFrame, key: str = "request_id", json: str = "sensitive_data_list") -> DataFrame:
    """(request_id, tag_pos, tag, value): the tag map in the caller's order; a repeated key counts once, with its last value."""
    keys = F.array_distinct(F.json_object_keys(json))
    values = F.from_json(F.col(json), "map<string,string>")
    rows = requests.select(key, values.alias("values"), F.posexplode(keys).alias("tag_pos", "tag"))
    # The parsed map holds a repeated key more than once.
    own = F.filter(F.map_entries("values"), lambda e: e.key == F.col("tag"))
    return rows.select(key, "tag_pos", "tag", F.element_at(own, -1).value.alias("value"))


def to_response(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(request_id, response): JSON without null fields."""
    return rows.select("request_id", F.to_json(F.struct(*columns)).alias("response"))
