"""Ground reprocessing: decide, match images, run the stages, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilune.operators.detection import non_maximum_suppression
from perilune.operators.frames import annotation_state, should_reprocess


def reprocess(frames: DataFrame, images: DataFrame, frame: str, target: int, overwrite: bool = False) -> DataFrame:
    """frames (frame, stage, has_results, same_rc, same_ld) with `outcome`: failed without an image, processed if it must be run for the target stage, else skipped. Only metadata is read; pixels are joined for what is processed."""
    seen = frames.join(images.select(F.col(frame), F.lit(True).alias("_image")), frame, "left")
    again = should_reprocess(F.col("stage"), F.lit(target), F.col("has_results"), F.col("same_rc"), F.col("same_ld"), F.lit(overwrite))
    return seen.withColumn("outcome", F.when(F.col("_image").isNull(), "failed").when(again, "processed").otherwise("skipped")).drop("_image")


def processed_frames(frames: DataFrame, regions: DataFrame, boxes: DataFrame, frame: str, region_threshold: float = 0.35, box_threshold: float = 0.5, overlap: float = 0.45) -> DataFrame:
    """The stages of a frame from its raw scores: frames (frame, passed: the prefilter's verdict), regions (frame, region_id, score), boxes (frame, box_id, x, y, w, h, class_id, score).

    Regions and landmarks are looked for only in frames that passed, and landmarks only where a region scores above its threshold; overlapping boxes of a
    class are suppressed. Adds regions and landmarks (counts), stage (1 prefiltered, 2 regions, 3 landmarks looked for) and state.
    """
    open_frames = frames.where("passed").select(frame)
    found = regions.where(F.col("score") > region_threshold).join(open_frames, frame, "left_semi").groupBy(frame).agg(F.count_distinct("region_id").cast("int").alias("regions"))
    kept = non_maximum_suppression(boxes.join(found.select(frame), frame, "left_semi"), frame, overlap, box_threshold)
    marks = kept.groupBy(frame).agg(F.count("*").cast("int").alias("landmarks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = frames.join(found, frame, "left").join(marks, frame, "left").select(*frames.columns, zero("regions"), zero("landmarks"))
    stage = F.when(~F.col("passed"), 1).when(F.col("regions") == 0, 2).otherwise(3)
    return rows.withColumn("stage", stage).withColumn("state", annotation_state(F.col("landmarks"), F.col("regions"), F.col("passed")))
