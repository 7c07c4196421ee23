"""Media operators: metadata from JSON, places, names, organisation, sizes, collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import format_bytes, safe_component
from docmill.registry import query, table

_FIELDS = "SourceFile string, DateTimeOriginal string, GPSLatitude string, GPSLongitude string, Duration string, ImageWidth string, FrameRate string, Make string"


def exif_records(spark: SparkSession, sf: str) -> DataFrame:
    """event_id and an ExifTool-like JSON record for each event."""
    lat, lon = F.col("user_id") % 90, F.col("user_id") % 180
    fields = F.struct(
        F.concat(F.lit("clip"), (F.col("event_id") % 1000).cast("string"), F.lit(".MP4")).alias("SourceFile"),
        F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("DateTimeOriginal"),
        F.concat(lat.cast("string"), F.lit(".25")).alias("GPSLatitude"),
        F.concat(lon.cast("string"), F.lit(".5")).alias("GPSLongitude"),
        (F.col("event_id") % 600).cast("string").alias("Duration"),
        F.when(F.col("event_id") % 7 == 0, "0").otherwise("1920").alias("ImageWidth"),
        F.when(F.col("event_id") % 3 == 0, "30000/1001").when(F.col("event_id") % 3 == 1, "25/1").otherwise("24/0").alias("FrameRate"),
        F.col("event_type").alias("Make"),
    )
    return table(spark, sf, "events").select("event_id", "user_id", F.to_json(fields).alias("payload"))


def metadata(records: DataFrame) -> DataFrame:
    """Typed metadata of JSON records; what is missing or malformed is null, 0 is null for sizes."""
    r = records.withColumn("r", F.from_json("payload", _FIELDS))
    number = lambda c: F.expr(f"try_cast(nullif(r.{c}, '') as double)")
    rate = F.split("r.FrameRate", "/")
    r = r.select(
        "event_id",
        "user_id",
        F.col("r.SourceFile").alias("source_file"),
        F.expr("try_to_timestamp(r.DateTimeOriginal, 'yyyy:MM:dd HH:mm:ss')").alias("captured_at"),
        number("GPSLatitude").alias("latitude"),
        number("GPSLongitude").alias("longitude"),
        number("Duration").alias("duration_seconds"),
        F.nullif(number("ImageWidth").cast("int"), F.lit(0)).alias("width"),
        F.round(F.try_divide(F.get(rate, 0).cast("double"), F.get(rate, 1).cast("double")), 2).alias("frame_rate"),
        F.col("r.Make").alias("make"),
    )
    return r.withColumn("coordinate_key", F.format_string("%.4f,%.4f", "latitude", "longitude"))


_META_SQL = """
WITH m AS (SELECT event_id, user_id, 'clip' || (event_id % 1000) || '.MP4' AS source_file, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y') AS year, date_trunc('second', ts) AS captured_at,
 (user_id % 90) + 0.25::DOUBLE AS latitude, (user_id % 180) + 0.5::DOUBLE AS longitude, CAST(event_id % 600 AS DOUBLE) AS duration_seconds,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1920 END AS width, CASE WHEN event_id % 3 = 0 THEN 29.97::DOUBLE WHEN event_id % 3 = 1 THEN 25.0::DOUBLE END AS frame_rate, event_type AS make,
 printf('%.4f,%.4f', (user_id % 90) + 0.25::DOUBLE, (user_id % 180) + 0.5::DOUBLE) AS coordinate_key FROM events)"""


@query("media_metadata", _META_SQL + " SELECT event_id, source_file, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured, latitude, longitude, duration_seconds, width, frame_rate, make, coordinate_key FROM m")
def media_metadata(spark: SparkSession, sf: str) -> DataFrame:
    m = metadata(exif_records(spark, sf))
    return m.select("event_id", "source_file", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured"), "latitude", "longitude", "duration_seconds", "width", "frame_rate", "make", "coordinate_key")


def with_place(media: DataFrame, places: DataFrame) -> DataFrame:
    """media with place: the dictionary's name at the coordinates to four places, else the coordinates themselves."""
    label = F.format_string("%.4f_%.4f", "latitude", "longitude")
    return media.join(places, "coordinate_key", "left").withColumn("place", F.coalesce(F.nullif(F.trim("place_name"), F.lit("")), label)).drop("place_name")


def place_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.format_string("%.4f,%.4f", F.col("n_nationkey") + F.lit(0.25), F.col("n_nationkey") + F.lit(0.5))
    return n.select(key.alias("coordinate_key"), F.concat_ws("-", "r_name", "n_name").alias("place_name"))


_PLACE_SQL = _META_SQL + """, d AS (SELECT printf('%.4f,%.4f', n_nationkey + 0.25::DOUBLE, n_nationkey + 0.5::DOUBLE) AS coordinate_key, r_name || '-' || n_name AS place_name FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT m.*, coalesce(nullif(trim(place_name), ''), printf('%.4f_%.4f', latitude, longitude)) AS place FROM m LEFT JOIN d USING (coordinate_key))"""


@query("place_lookup", _PLACE_SQL + " SELECT event_id, coordinate_key, place FROM l")
def place_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return with_place(metadata(exif_records(spark, sf)), place_dictionary(spark, sf)).select("event_id", "coordinate_key", "place")


_NAMES_SQL = _PLACE_SQL + r""", s AS (SELECT *, regexp_replace(regexp_replace(place, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', '-', 'g') AS folder FROM l),
k AS (SELECT *, day || '_' || coalesce(nullif(trim(folder, ' ._-'), ''), 'unknown') || '_' || make || '.mp4' AS name, year || '/' || day || '/' || coalesce(nullif(trim(folder, ' ._-'), ''), 'unknown') AS folder_path FROM s)"""


def planned(spark: SparkSession, sf: str) -> DataFrame:
    m = with_place(metadata(exif_records(spark, sf)), place_dictionary(spark, sf))
    day, folder = F.date_format("captured_at", "yyyy-MM-dd"), safe_component(F.col("place"), "unknown")
    return m.withColumn("name", F.concat(F.concat_ws("_", day, folder, "make"), F.lit(".mp4"))).withColumn("folder_path", F.concat_ws("/", F.date_format("captured_at", "yyyy"), day, folder))


@query("media_names", _NAMES_SQL + " SELECT event_id, name, folder_path FROM k")
def media_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names by template (day, place, make) and folders by day and place."""
    return planned(spark, sf).select("event_id", "name", "folder_path")


@query("batch_collisions", _NAMES_SQL + ", c AS (SELECT event_id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY event_id) AS i FROM k) SELECT event_id, CASE WHEN i = 1 THEN name ELSE replace(name, '.mp4', '_' || i || '.mp4') END AS planned_name, i > 1 AS collision FROM c")
def collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Names that several sources want, letter case aside, get _2, _3, ..."""
    i = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("event_id"))
    rows = planned(spark, sf).select("event_id", "name", i.alias("i"))
    return rows.select("event_id", F.when(F.col("i") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.mp4$", ""), F.lit("_"), F.col("i").cast("string"), F.lit(".mp4"))).alias("planned_name"), (F.col("i") > 1).alias("collision"))


@query("size_estimates", """WITH s AS (SELECT event_id, CAST(event_id * 1000 AS BIGINT) AS size, event_id % 600 AS seconds, 18 + event_id % 15 AS crf FROM events),
c AS (SELECT *, least(1.1::DOUBLE, greatest(0.12::DOUBLE, 0.62::DOUBLE - (crf - 23) * 0.035::DOUBLE)) AS centre FROM s)
SELECT event_id, CAST(round_even(size * centre * 0.65::DOUBLE, 0) AS BIGINT) AS least_bytes, CAST(round_even(size * centre * 1.35::DOUBLE, 0) AS BIGINT) AS most_bytes, CAST(seconds * 48000 * 4 AS BIGINT) AS wav_bytes FROM c""")
def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The range a compressed video may have for its quality factor, and the size of its sound as WAV."""
    crf = 18 + F.col("event_id") % 15
    centre = F.least(F.lit(1.1), F.greatest(F.lit(0.12), F.lit(0.62) - (crf - 23) * F.lit(0.035)))
    size = F.col("event_id") * 1000
    bound = lambda k: F.bround(size * centre * F.lit(k), 0).cast("long")
    return table(spark, sf, "events").select("event_id", bound(0.65).alias("least_bytes"), bound(1.35).alias("most_bytes"), (F.col("event_id") % 600 * 48000 * 4).alias("wav_bytes"))


@query("byte_labels", "SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0::DOUBLE, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round(b / 1073741824.0::DOUBLE, 1)) END AS label FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS BIGINT) AS b FROM orders)")
def byte_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", format_bytes(F.col("o_orderkey") * F.col("o_orderkey")).alias("label"))
