"""Operators on detector output: thresholds, suppression, box geometry, precision and recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def above(scores: DataFrame, keys: list[str], array: str, threshold: float = 0.35) -> DataFrame:
    """One row for each class whose score is strictly above the threshold, as the scores' own type has it: a float score that is the threshold's float isn't above it."""
    rows = scores.select(*keys, F.posexplode(array).alias("class_id", "score"))
    return rows.where(F.col("score") > F.lit(threshold).cast(rows.schema["score"].dataType))


def best_class(scores: Column) -> dict[str, Column]:
    """The largest score of a row and its class, the first on ties."""
    top = F.array_max(scores)
    return {"score": top, "class_id": (F.array_position(scores, top) - 1).cast("int")}


def intersection(a: tuple, b: tuple) -> Column:
    """Of boxes (x, y, width, height)."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def overlap_score(a: tuple, b: tuple, true_iou: bool = False) -> Column:
    """Intersection over the enclosing rectangle (the mission's score), or over the union."""
    both = intersection(a, b)
    if true_iou:
        whole = a[2] * a[3] + b[2] * b[3] - both
    else:
        whole = (F.greatest(a[0] + a[2], b[0] + b[2]) - F.least(a[0], b[0])) * (F.greatest(a[1] + a[3], b[1] + b[3]) - F.least(a[1], b[1]))
    return F.when(whole > 0, both / whole).otherwise(0.0)


def letterbox_inverse(box: tuple, image: tuple, net: tuple) -> tuple:
    """A box (x, y, width, height) of a padded network image on the original, rounded and clipped."""
    gain = F.least(net[0] / image[0], net[1] / image[1])
    pad_x, pad_y = F.round((net[0] - image[0] * gain) / 2 - 0.1), F.round((net[1] - image[1] * gain) / 2 - 0.1)
    x = F.greatest(F.lit(0), F.least(image[0] - 1, F.round((box[0] - pad_x) / gain)))
    y = F.greatest(F.lit(0), F.least(image[1] - 1, F.round((box[1] - pad_y) / gain)))
    return x.cast("int"), y.cast("int"), F.greatest(F.lit(0), F.least(image[0] - x, F.round(box[2] / gain))).cast("int"), F.greatest(F.lit(0), F.least(image[1] - y, F.round(box[3] / gain))).cast("int")


def candidate_boxes(width: Column, height: Column) -> Column:
    """How many boxes a network of this input size proposes."""
    return sum((F.floor(width / s) * F.floor(height / s) for s in (16, 32)), F.floor(width / 8) * F.floor(height / 8))


def _greedy(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, kind: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes of one group, best first, stay."""
    alive = np.ones(len(x), dtype=bool)
    for i in range(len(x) - 1):
        if alive[i]:
            iw = np.minimum(x[i] + w[i], x[i + 1 :] + w[i + 1 :]) - np.maximum(x[i], x[i + 1 :])
            ih = np.minimum(y[i] + h[i], y[i + 1 :] + h[i + 1 :]) - np.maximum(y[i], y[i + 1 :])
            both = np.where((iw > 0) & (ih > 0), iw * ih, 0)
            alive[i + 1 :] &= (kind[i + 1 :] != kind[i]) | (both <= threshold * (w[i] * h[i] + w[i + 1 :] * h[i + 1 :] - both))
    return alive


_BOX = ("x", "y", "w", "h", "class_id")


def suppress(boxes: pd.DataFrame, threshold: float = 0.45) -> pd.DataFrame:
    """Greedy non-maximum suppression of one group: by falling score (then row), a box goes if it overlaps a kept one of its class too much."""
    order = boxes.sort_values(["score", "box_id"], ascending=[False, True], kind="stable")
    return order[_greedy(*(order[c].to_numpy() for c in _BOX), threshold)]


def non_maximum_suppression(boxes: DataFrame, key: str, threshold: float = 0.45, least_score: float = 0.5) -> DataFrame:
    """key, box_id of the boxes that stay. Groups are small and many, so sorted partitions are walked in Arrow batches; what a batch cuts is carried to the next."""

    def kept(rows: pd.DataFrame) -> pd.DataFrame:
        group, columns = rows[key].to_numpy(), [rows[c].to_numpy() for c in _BOX]
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(rows)]
        alive = [_greedy(*(c[i:j] for c in columns), threshold) for i, j in zip(cuts, cuts[1:], strict=False)]
        return rows.loc[np.concatenate(alive), [key, "box_id"]]

    def run(parts):
        carry = None
        for part in parts:
            rows = part if carry is None else pd.concat([carry, part], ignore_index=True)
            if len(rows):
                group = rows[key].to_numpy()
                inside = np.flatnonzero(group != group[-1])
                cut = int(inside[-1]) + 1 if len(inside) else 0
                if cut:
                    yield kept(rows.iloc[:cut])
                carry = rows.iloc[cut:].reset_index(drop=True)
        if carry is not None and len(carry):
            yield kept(carry)

    kind = dict(boxes.dtypes)
    rows = boxes.where(F.col("score") > least_score).select(key, "box_id", "score", *_BOX).repartition(key).sortWithinPartitions(key, F.desc("score"), "box_id")
    return rows.mapInPandas(run, f"{key} {kind[key]}, box_id {kind['box_id']}")


def best_match(predictions: DataFrame, truth: DataFrame, on: list[str], box: list[str], prediction: str) -> DataFrame:
    """Each prediction with the best overlap among the true boxes of its frame and class (0 if none)."""
    right = truth.select(*on, *(F.col(c).alias(f"_{c}") for c in box))
    score = overlap_score(tuple(F.col(c) for c in box), tuple(F.col(f"_{c}") for c in box))
    return predictions.join(right, on, "left").groupBy(prediction).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("best_iou"))


def detection_report(matched: DataFrame, truth: DataFrame, key: str, hit: str) -> DataFrame:
    """Per key: predictions, true positives, truth; precision and recall in thousandths, truncated, null ('n/a') without a denominator. True positives count once for each prediction."""
    p = matched.groupBy(key).agg(F.count("*").alias("predicted"), F.count_if(hit).alias("true_positives"))
    t = truth.groupBy(key).agg(F.count("*").alias("truth"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = p.join(t, key, "full").select(key, zero("predicted"), zero("true_positives"), zero("truth"))
    share = lambda den, name: F.when(F.col(den) > 0, F.floor(F.col("true_positives") * 1000 / F.col(den))).cast("long").alias(name)
    return rows.select("*", share("predicted", "precision_permille"), share("truth", "recall_permille"))


def strongest(boxes: DataFrame, key: str, k: int = 300) -> DataFrame:
    """The k boxes of each group with the highest scores, the smallest box_id on ties."""
    return boxes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "box_id"))).where(F.col("_n") <= k).drop("_n")


def report_order(rows: DataFrame) -> DataFrame:
    """A detection report's order: most true positives first, then region and class."""
    return rows.orderBy(F.desc("true_positives"), "region", "class_id")
