"""Frame metadata (one JSON document a file, in two layouts), datasets, catalogues, labels and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilune.functions.codes import CAMERA_SUFFIXES, REGIONS, encode
from perilune.functions.text import label_name, raw_image_name

REGION = "struct<id:int,confidence:float>"
LANDMARK = "struct<x:float,y:float,height:float,width:float,confidence:float,class_id:int,region_id:int>"
PREFILTER = (
    "struct<passed:boolean,cloudiness:int,color_std:float,contrast_std:float,avg_color_rgb:array<float>,avg_hue:float,avg_saturation:float,avg_value:float,"
    "is_significant:boolean,dominant_type:string,error:string>"
)
CONFIG = "struct<weight_quant:string,input_width:int,input_height:int,embedded_nms:boolean,use_trt:boolean>"
_RESULT = f"rcnet_version:int,ldnet_version:int,ldnet_config:{CONFIG},detected_regions_count:int,detected_landmarks_count:int,regions:array<map<string,{REGION}>>,landmarks:array<map<string,{LANDMARK}>>"
#: Both layouts at once: nested results, and the older flat keys.
FRAME = (
    f"timestamp bigint, cam_id int, annotation_state int, processing_stage int, rank float, prefilter {PREFILTER}, inference_results struct<{_RESULT}>, "
    f"raw_image struct<path:string,format:string,width:int,height:int,size_bytes:bigint>, rcnet_version int, ldnet_version int, regions array<map<string,{REGION}>>, landmarks array<map<string,{LANDMARK}>>"
)


def _elements(array: Column) -> Column:
    """Elements of an array of one-key objects, in order."""
    return F.flatten(F.transform(array, F.map_values))


def decode_frames(texts: DataFrame, value: str = "value") -> DataFrame:
    """Frames from JSON texts, other columns kept: results are attached if a network's version isn't -1 or there is a region or landmark. Texts that aren't JSON objects are dropped."""
    kept = [c for c in texts.columns if c != value]
    x = lambda c: F.col(f"x.{c}")
    rows = texts.select(*kept, F.from_json(F.col(value), FRAME).alias("x")).where(x("timestamp").isNotNull() & x("cam_id").isNotNull())
    pick = lambda c: F.coalesce(x(f"inference_results.{c}"), x(c)) if c in ("rcnet_version", "ldnet_version", "regions", "landmarks") else x(f"inference_results.{c}")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    regions, landmarks = F.coalesce(_elements(pick("regions")), empty(REGION)), F.coalesce(_elements(pick("landmarks")), empty(LANDMARK))
    rc, ld = F.coalesce(pick("rcnet_version"), F.lit(-1)), F.coalesce(pick("ldnet_version"), F.lit(-1))
    result = F.when((rc != -1) | (F.size(regions) > 0) | (F.size(landmarks) > 0), F.struct(rc.alias("rcnet_version"), ld.alias("ldnet_version"), pick("ldnet_config").alias("ldnet_config"), regions.alias("regions"), landmarks.alias("landmarks")))
    state, stage = F.coalesce(x("annotation_state"), F.lit(0)), F.coalesce(x("processing_stage"), F.lit(0))
    return rows.select(*kept, x("timestamp").alias("timestamp_ms"), x("cam_id").alias("cam_id"), state.alias("annotation_state"), stage.alias("processing_stage"), F.coalesce(x("rank"), F.lit(0.0)).cast("float").alias("rank"), x("prefilter").alias("prefilter"), result.alias("inference_results"), x("raw_image").alias("raw_image"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All frame_*.json below a path, with dataset_id (the folder) and file_name; unreadable documents are dropped."""
    files = spark.read.option("pathGlobFilter", "frame_*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return decode_frames(files.select("value", F.element_at(F.split(name, "/"), -2).alias("dataset_id"), F.col("_metadata.file_name").alias("file_name")))


def encode_frames(frames: DataFrame) -> DataFrame:
    """timestamp_ms, cam_id, value: the nested layout as JSON, absent parts left out."""
    named = lambda array, name: F.transform(array, lambda x, k: F.create_map(F.concat(F.lit(f"{name}_"), k.cast("string")), x))
    r = F.col("inference_results")
    result = F.when(r.isNotNull(), F.struct(
        r["rcnet_version"].alias("rcnet_version"), r["ldnet_version"].alias("ldnet_version"), r["ldnet_config"].alias("ldnet_config"), F.size(r["regions"]).alias("detected_regions_count"), F.size(r["landmarks"]).alias("detected_landmarks_count"),
        named(r["regions"], "region").alias("regions"), named(r["landmarks"], "landmark").alias("landmarks"),
    ))
    body = F.struct(F.col("timestamp_ms").alias("timestamp"), "cam_id", "annotation_state", "processing_stage", "rank", "prefilter", result.alias("inference_results"), "raw_image")
    return frames.select("timestamp_ms", "cam_id", F.to_json(body).alias("value"))


def write_frames(frames: DataFrame, path: str) -> None:
    """One JSON document a line, by dataset."""
    encode_frames(frames).select("value").write.text(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """region_id, class_id, lon_deg, lat_deg from <region>/bounding_boxes.csv below a path. class_id numbers the good rows of a file from 0; a file is one table of a few thousand rows."""
    files = spark.read.option("pathGlobFilter", "bounding_boxes.csv").option("recursiveFileLookup", True).text(path, wholetext=True)
    return decode_catalogue(files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("region"), "value"))


def decode_catalogue(files: DataFrame) -> DataFrame:
    lines = files.select("region", F.posexplode(F.split("value", r"\r?\n")).alias("line", "row")).where("line > 0")
    field = lambda k: F.trim(F.try_element_at(F.split("row", ","), F.lit(k))).try_cast("double")
    good = lines.select("region", "line", field(1).alias("lon_deg"), field(2).alias("lat_deg")).dropna(subset=["lon_deg", "lat_deg"])
    place = (F.row_number().over(Window.partitionBy("region").orderBy("line")) - 1).alias("class_id")
    return good.select(encode(F.col("region"), REGIONS, 16).alias("region_id"), place, "lon_deg", "lat_deg")


def read_labels(spark: SparkSession, path: str, width: int = 4608, height: int = 2592) -> DataFrame:
    """True boxes in pixels from label texts (class, centre and size as shares); bad lines are dropped."""
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_name").alias("name"))
    return decode_labels(lines, width, height)


def decode_labels(lines: DataFrame, width: int = 4608, height: int = 2592) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    name = label_name(F.col("name"))
    rows = lines.select(*(c.alias(k) for k, c in name.items()), F.try_element_at(parts, F.lit(1)).try_cast("int").alias("class_id"), *(number(k).alias(c) for k, c in ((2, "cx"), (3, "cy"), (4, "bw"), (5, "bh"))))
    rows = rows.dropna(subset=["timestamp_ms", "class_id", "cx", "cy", "bw", "bh"])
    pixel = lambda c, n: F.floor(F.col(c) * n).cast("int")
    return rows.select("region", "timestamp_ms", encode(F.col("camera"), CAMERA_SUFFIXES, -1).alias("cam_id"), "class_id", F.floor((F.col("cx") - F.col("bw") / 2) * width).cast("int").alias("x"), F.floor((F.col("cy") - F.col("bh") / 2) * height).cast("int").alias("y"), pixel("bw", width).alias("w"), pixel("bh", height).alias("h"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """timestamp_ms, cam_id, path, length of raw images; of a JPG and a PNG of one frame the JPG counts. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "raw_*").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    made = raw_image_name(F.substring_index("path", "/", -1))
    rows = files.select("path", "length", "modificationTime", *(c.alias(k) for k, c in made.items())).where("timestamp_ms is not null")
    return rows.groupBy("timestamp_ms", "cam_id").agg(F.min_by(F.struct("path", "length", "modificationTime"), F.struct(F.col("path").endswith(".png").alias("p"), "path")).alias("f")).select("timestamp_ms", "cam_id", "f.*")


DATASET = (
    "folder_path string, capture_start_time bigint, maximum_period double, target_frame_nb int, dataset_capture_mode int, imu_collection_mode int, image_capture_rate int, imu_sample_rate_hz float, "
    "target_processing_stage int, active_cameras array<boolean>, imu_log_file_path string, frame_id_list array<struct<cam_id:int,timestamp:bigint>>"
)


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """dataset.json documents, all or nothing: those with a missing or mistyped required field are dropped."""
    return decode_datasets(spark.read.option("pathGlobFilter", "dataset.json").option("recursiveFileLookup", True).text(path, wholetext=True))


def decode_datasets(texts: DataFrame) -> DataFrame:
    rows = texts.select(F.from_json("value", DATASET).alias("x")).select("x.*")
    return rows.dropna(subset=["capture_start_time", "maximum_period", "target_frame_nb", "dataset_capture_mode", "imu_collection_mode", "target_processing_stage"]).where("capture_start_time >= 0 and target_frame_nb >= 0")
