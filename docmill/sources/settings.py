"""Settings of many owners over the defaults: JSON documents as a table, merged object by object, and values read from them with coercion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.lines import once
from docmill.registry import query, table

DEPTH = 4  # of objects within objects that are merged; what lies deeper is replaced

# Names and defaults of the settings that programs share.
DEFAULTS = {
    "app": {"schema_version": 4, "onboarding_completed": False, "theme": "system", "update_check_enabled": False},
    "ui": {"last_workspace": "documents"},
    "output_folder_name": "AI素材处理结果",
    "history_directory": "",
    "tools": {"markitdown": "", "ffmpeg": "", "ffprobe": "", "exiftool": "", "libreoffice": "", "winword": "", "powerpoint": ""},
    "tool_management": {"install_directory": ""},
    "video": {
        "compression_crf": 23,
        "compression_preset": "medium",
        "audio_format": "mp3",
        "audio_bitrate": "192k",
        "rename_template": "{date}_{time}_{location}_{index}",
        "project_name": "",
        "organize_mode": "date_location",
        "location_dictionary": {},
        "scene_threshold": 0.30,
        "max_keyframes": 24,
        "contact_sheet_columns": 4,
    },
    "document": {"mode": "enhanced", "split_enabled": True, "target_tokens": 4000, "max_tokens": 6000, "ocr_enabled": False, "context_pack_default_budget": None},
    "task_center": {"state_directory": "", "disk_space_safety_mb": 512},
    "history": {"retention_days": 90, "max_size_mb": 512},
}


def _fields(value: Column) -> Column:
    """The fields of an object as a map; null for what is no object."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.try_variant_get(value, "$", "map<string,variant>"))


def over(base: Column, own: Column, depth: int = DEPTH) -> Column:
    """Variants: own over base. Objects that both hold are merged field by field, anything else of own stands as it is, null included."""
    if not depth:
        return own

    def merged(b: Column, o: Column) -> Column:
        fields = F.map_zip_with(b, o, lambda k, x, y: F.when(~F.map_contains_key(o, k), x).when(~F.map_contains_key(b, k), y).otherwise(over(x, y, depth - 1)))
        return F.when(b.isNull() | o.isNull(), own).otherwise(F.parse_json(F.to_json(fields)))

    # once: else the fields would be read again for each of them
    return once(F.struct(_fields(base).alias("b"), _fields(own).alias("o")), lambda f: merged(f["b"], f["o"]))


def effective(documents: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """owner, settings (variant) of (owner, settings: JSON text): each over the defaults; the defaults where the text is null, malformed or no object."""
    own = F.try_parse_json("settings")
    # a column, as defaults are one constant for all owners
    base = documents.select("owner", own.alias("own"), F.parse_json(F.lit(json.dumps(defaults, ensure_ascii=False))).alias("base"))
    object_ = _fields(F.col("own")).isNotNull()
    return base.select("owner", F.when(object_, over(F.col("base"), F.col("own"))).otherwise(F.col("base")).alias("settings"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """owner (file name without its suffix), settings of the JSON files below path, over the defaults."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return effective(files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("owner"), F.col("value").alias("settings")))


def text(settings: Column, path: str) -> Column:
    """A value as text, null where there is none."""
    return F.try_variant_get(settings, path, "string")


def whole(settings: Column, path: str, other: int, least: int | None = None) -> Column:
    """A whole number, or a text that is one, else other; not below least."""
    kind = F.schema_of_variant(F.try_variant_get(settings, path, "variant"))
    found = F.when(kind.isin("BIGINT", "STRING"), F.try_variant_get(settings, path, "string").try_cast("bigint"))
    value = F.coalesce(found, F.lit(other).cast("bigint"))
    return value if least is None else F.greatest(value, F.lit(least).cast("bigint"))


@query("settings_merged", f"""SELECT c_custkey AS owner, CASE WHEN c_custkey % 5 = 2 THEN greatest(c_custkey % 60, 10) ELSE 23 END AS crf, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'mp3' END AS audio, CASE WHEN c_custkey % 5 = 3 THEN 'none' ELSE '' END AS ffmpeg,
 CASE WHEN c_custkey % 5 = 2 THEN c_name END AS place, CASE WHEN c_custkey % 5 = 3 THEN CAST(c_custkey AS VARCHAR) END AS added, '{DEFAULTS["output_folder_name"]}' AS folder FROM customer""")
def settings_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' settings over the defaults: some malformed or no object, some with objects to merge, values to replace, nulls."""
    k = F.col("c_custkey")
    key = k.cast("string")
    made = (
        F.when(k % 5 == 0, "{")
        .when(k % 5 == 1, "[1]")
        .when(k % 5 == 2, F.concat(F.lit('{"video": {"compression_crf": "'), (k % 60).cast("string"), F.lit('", "location_dictionary": {"x": '), F.regexp_extract(F.to_json(F.array("c_name")), r"^\[(.*)\]$", 1), F.lit("}}}")))
        .when(k % 5 == 3, F.concat(F.lit('{"tools": "none", "new": '), key, F.lit("}")))
        .otherwise('{"video": {"audio_format": null}}')
    )
    e = effective(table(spark, sf, "customer").select(k.alias("owner"), made.alias("settings")))
    s = F.col("settings")
    return e.select(
        "owner", whole(s, "$.video.compression_crf", 23, 10).alias("crf"), text(s, "$.video.audio_format").alias("audio"), F.coalesce(text(s, "$.tools.ffmpeg"), text(s, "$.tools")).alias("ffmpeg"),
        text(s, "$.video.location_dictionary.x").alias("place"), text(s, "$.new").alias("added"), text(s, "$.output_folder_name").alias("folder"),
    )
