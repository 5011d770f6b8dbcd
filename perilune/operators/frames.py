"""Operators on frames (images with nested results): filters, states, ranks, decisions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.functions.codes import mode_stage


def pixel_statistics(pixels: DataFrame, frame: str, r: str = "r", g: str = "g", b: str = "b", white: int = 100) -> DataFrame:
    """Per frame from one row a pixel (0 to 255): deviations, means, hue, saturation, value (0-180, 0-255, 0-255) and the truncated percentage of white pixels."""
    red, green, blue = (F.col(c).cast("double") for c in (r, g, b))
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = high - low
    sector = F.when(high == red, (green - blue) / span).when(high == green, 2 + (blue - red) / span).otherwise(4 + (red - green) / span)
    hue = F.when(span == 0, 0.0).otherwise(F.round(F.pmod(sector * 60, F.lit(360.0)) / 2))
    saturation = F.when(high == 0, 0.0).otherwise(F.round(span / high * 255))
    gray = F.round(0.299 * red + 0.587 * green + 0.114 * blue)
    rows = pixels.select(frame, red.alias("_r"), green.alias("_g"), blue.alias("_b"), gray.alias("_y"), hue.alias("_h"), saturation.alias("_s"), high.alias("_v"), (low > white).alias("_w"))
    return rows.groupBy(frame).agg(
        ((F.stddev_pop("_r") + F.stddev_pop("_g") + F.stddev_pop("_b")) / 3).alias("color_std"), F.stddev_pop("_y").alias("contrast_std"),
        F.array(F.avg("_r"), F.avg("_g"), F.avg("_b")).alias("avg_color_rgb"), F.avg("_h").alias("avg_hue"), F.avg("_s").alias("avg_saturation"), F.avg("_v").alias("avg_value"),
        (F.count_if("_w") / F.count("*") * 100).cast("int").alias("cloudiness"),
    )


def dominant_type(color_std, contrast_std, hue, saturation, value, cloudiness, most_cloud: int = 50, least_color: float = 30, least_contrast: float = 20) -> dict[str, Column]:
    """passed, is_significant and dominant_type; the cases are tried in this order, and varied images have no type."""
    varied = (color_std > least_color) & (contrast_std > least_contrast)
    kind = (
        F.when(varied, "").when(cloudiness > most_cloud, "cloudy").when(value < 50, "black").when((value > 200) & (saturation < 30), "white")
        .when((hue > 34) & (hue < 85) & (saturation > 50), "green").otherwise("single_color")
    )
    return {"dominant_type": kind, "passed": ~kind.isin("cloudy", "black", "white"), "is_significant": kind == "green"}


def annotation_state(landmarks: Column, regions: Column, passed: Column) -> Column:
    """3 with landmarks, 2 with regions, 1 if the prefilter passed, else 0; the arguments are counts and a flag."""
    return F.when(landmarks > 0, 3).when(regions > 0, 2).when(F.coalesce(passed, F.lit(False)), 1).otherwise(0)


def mean_confidence(items: Column, field: str = "confidence") -> Column:
    """Of an array of structs, summed in float order; 0 if there are none."""
    total = F.aggregate(items, F.lit(0.0).cast("float"), lambda a, x: (a + x[field]).cast("float"))
    return F.when(F.size(items) > 0, (total / F.size(items).cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))


def rank(state: Column, cloudiness: Column, region_mean: Column, landmark_sum: Column) -> Column:
    """0, cloudlessness (0.5 if unknown), the regions' mean confidence, or the landmarks' summed confidence over 100."""
    return F.when(state == 3, landmark_sum / 100).when(state == 2, region_mean).when(state == 1, F.coalesce(1 - cloudiness / 100, F.lit(0.5))).otherwise(0.0)


def should_reprocess(stage: Column, target: Column, has_results: Column, same_rc: Column, same_ld: Column, overwrite: Column) -> Column:
    """Whether a frame must be run again for a target stage."""
    matches = F.when(target >= 2, same_rc).otherwise(True) & F.when(target >= 3, same_ld).otherwise(True)
    return F.when(stage < target, True).when(target == 1, False).when(~has_results, True).when(matches, False).otherwise(overwrite)


def captured(mode: Column, state: Column, regions: Column, landmarks: Column) -> Column:
    """Whether a capture mode (2 periodic, 3 earth, 4 region, 5 landmark) stores a frame."""
    return F.when(mode == 3, state >= 1).when(mode == 4, regions > 0).when(mode == 5, landmarks > 0).otherwise(mode.isin(1, 2))


def dataset_counters(frames: DataFrame, dataset: str, stage: str, state: str) -> DataFrame:
    """Frames by stage and state reached, in one pass."""
    at_least = lambda c, k, name: F.count_if(F.col(c) >= k).alias(name)
    return frames.groupBy(dataset).agg(
        F.count("*").alias("num_frames"), at_least(stage, 1, "num_prefiltered"), at_least(stage, 2, "num_rcneted"), at_least(stage, 3, "num_ldneted"),
        at_least(state, 1, "num_earth"), at_least(state, 2, "num_roi"), at_least(state, 3, "num_landmarks"),
    )


def best_frame(frames: DataFrame, dataset: str, order: list[str], frame: str) -> DataFrame:
    """The frame with the largest values of order, the smallest frame on ties: one aggregate, no sort."""
    return frames.groupBy(dataset).agg(F.max_by(frame, F.struct(*order, (-F.col(frame)).alias("_f"))).alias("best_frame"))


def select_unsent(frames: DataFrame, sent: DataFrame, frame: str, order: list[str], n: int) -> DataFrame:
    """The n best frames that haven't been sent; missing values count as 0."""
    rest = frames.join(sent, frame, "left_anti")
    return rest.orderBy(*(F.coalesce(F.col(c), F.lit(0)).desc() if dict(frames.dtypes)[c] not in ("timestamp", "timestamp_ntz") else F.col(c).desc() for c in order), frame).limit(n)


def check_list(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail (are true); a null check doesn't fail."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))


def dataset_checks(period: Column, frames: Column, mode: Column, imu_mode: Column, image_rate: Column, imu_rate: Column, stage: Column) -> dict[str, Column]:
    """What makes a dataset's configuration invalid."""
    return {
        "period": ~period.between(0.1, 10800), "frames": ~frames.between(1, 255), "mode": ~mode.between(2, 5), "imu_mode": ~imu_mode.between(0, 3),
        "image_rate": ~image_rate.between(1, 254), "imu_rate": (imu_rate <= 0) | (imu_rate > 25), "stage": ~stage.between(0, 3), "stage_below_mode": stage < mode_stage(mode),
    }


def usability(frames_with: Column, landmarks: Column, first_landmark: Column, last_landmark: Column, imu_rows: Column, first_imu: Column, last_imu: Column, least_frames: int = 2, least_landmarks: int = 4) -> Column:
    """Why orbit determination can't run on a dataset, or 'ok'; the first reason counts."""
    return (
        F.when(F.coalesce(frames_with, F.lit(0)) < least_frames, "too_few_frames").when(F.coalesce(landmarks, F.lit(0)) < least_landmarks, "too_few_landmarks")
        .when(F.coalesce(imu_rows, F.lit(0)) == 0, "no_imu").when((first_imu > first_landmark) | (last_imu < last_landmark), "imu_does_not_cover").otherwise("ok")
    )


def single_version(frames: DataFrame, dataset: str, version: str) -> DataFrame:
    """Whether all frames of a dataset have one positive version."""
    agg = frames.groupBy(dataset).agg(F.min(version).alias("low"), F.max(version).alias("high"), F.count_if(F.col(version).isNull()).alias("missing"))
    return agg.select(dataset, ((F.col("low") == F.col("high")) & (F.col("low") > 0) & (F.col("missing") == 0)).alias("consistent"), F.col("high").alias("version"))


def tallies(frames: DataFrame, outcome: str) -> DataFrame:
    return frames.groupBy(outcome).agg(F.count("*").alias("n"))


def saturated(total: Column, target: Column) -> dict[str, Column]:
    """A counter that stops at its target, and how much of it is done."""
    return {"counted": F.least(total, target), "completion": F.when(target > 0, F.least(total, target) / target).otherwise(0.0)}


def first_fitting(candidates: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Of each key's candidates in descending order the first that isn't too large (null if none)."""
    return candidates.groupBy(key).agg(F.max(F.when(F.col(size) <= most, F.col(order))).alias(order))


def sweep_best(candidates: DataFrame, key: str, candidate: str, luminance: Column, target: float, saturated_pct: Column, dark_pct: Column) -> DataFrame:
    """The candidate with the least penalty: distance of luminance, 50 for each saturated percent over 0.2, 5 for each dark one over 2."""
    score = F.abs(luminance - target) + 50 * F.greatest(F.lit(0.0), saturated_pct - 0.2) + 5 * F.greatest(F.lit(0.0), dark_pct - 2)
    return candidates.withColumn("score", score).groupBy(key).agg(F.min(F.struct("score", candidate)).alias("_m")).select(key, F.col(f"_m.{candidate}").alias(candidate), F.col("_m.score").alias("score"))


def chronological(files: DataFrame, name: str = "file_name") -> DataFrame:
    """By name, character by character, as the collector lists them: names of one length are in order of time."""
    return files.orderBy(name)


def listing(datasets: DataFrame, name: str) -> DataFrame:
    """The distinct ids of stored datasets, ascending."""
    return datasets.select(name).distinct().orderBy(name)


def files_for_downlink(manifest: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Of each manifest's files the downscaled ones and the results; the raw ones where there are neither."""
    some = manifest.where(F.col(kind).isin("downscaled", "results"))
    raw = manifest.where(F.col(kind) == "raw").join(some.select(key).distinct(), key, "left_anti")
    return some.unionByName(raw.select(*some.columns))


def label_frames(frames: DataFrame, labels: DataFrame, on: tuple[str, ...] = ("timestamp_ms", "cam_id")) -> DataFrame:
    """Each frame with its true boxes (an array of the labels' further columns, empty without any)."""
    rest = [c for c in labels.columns if c not in on]
    boxes = labels.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("truth"))
    rows = frames.join(boxes, list(on), "left")
    return rows.withColumn("truth", F.coalesce("truth", F.array().cast(dict(rows.dtypes)["truth"])))


def stored_metadata(ids: DataFrame, frames: DataFrame, on: tuple[str, ...] = ("timestamp_ms", "cam_id")) -> DataFrame:
    """A dataset's frame ids with the stored frames' columns; `missing` marks those that aren't stored."""
    return ids.join(frames.withColumn("_f", F.lit(True)), list(on), "left").withColumn("missing", F.col("_f").isNull()).drop("_f")


def unprocessed(frames: DataFrame, done: DataFrame, frame: str) -> DataFrame:
    """Frames that aren't among those done."""
    return frames.join(done.select(frame), frame, "left_anti")


def with_image(frames: DataFrame, images: DataFrame, frame: str) -> DataFrame:
    """Frames whose image is there."""
    return frames.join(images.select(frame), frame, "left_semi")


def all_ids(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The distinct ids of several one-column tables, under the first one's name."""
    for o in others:
        first = first.union(o)
    return first.distinct()


def newest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's newest row: one aggregate, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_m")).select(key, *(F.col(f"_m.{c}") for c in values))
