"""Writers of results: dataset summaries, manifests, measurement and estimate tables, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _decimals(c: str, pattern: str) -> Column:
    return F.format_string(pattern, F.col(c)).alias(c)


def dataset_summaries(datasets: DataFrame, counters: DataFrame, frames: DataFrame, imu_lines: DataFrame) -> DataFrame:
    """folder_path, value: a summary document for each dataset. counters: by folder_path; frames: folder_path, cam_id, timestamp; imu_lines: folder_path, lines (header included)."""
    ids = frames.groupBy("folder_path").agg(F.array_sort(F.collect_set(F.struct("cam_id", "timestamp"))).alias("frame_id_list"))
    rows = datasets.join(counters, "folder_path", "left").join(ids, "folder_path", "left").join(imu_lines.withColumnRenamed("lines", "imu_timestamps_collected"), "folder_path", "left")
    return rows.select("folder_path", F.to_json(F.struct(*rows.columns)).alias("value"))


def processing_manifests(datasets: DataFrame, processed: DataFrame) -> DataFrame:
    """folder_path, value: the dataset's document without its frame list, and the frames that were processed, in order. processed: folder_path, cam_id, timestamp, annotation_state, rank."""
    done = processed.groupBy("folder_path").agg(F.array_sort(F.collect_list(F.struct("timestamp", "cam_id", "annotation_state", "rank"))).alias("processed_frames"))
    rows = datasets.drop("frame_id_list").join(done, "folder_path", "left")
    return rows.select("folder_path", F.to_json(F.struct(*rows.columns)).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as text, a folder for each dataset."""
    documents.select(F.regexp_replace("folder_path", "[^A-Za-z0-9_.-]+", "_").alias("dataset"), "value").write.partitionBy("dataset").text(path)


def write_measurements(rows: DataFrame, path: str) -> None:
    """timestamp_ms, bearings, places, group and sigma, numbers with nine decimals."""
    numbers = [f"bearing_{a}" for a in "xyz"] + [f"eci_{a}_km" for a in "xyz"]
    rows.select("timestamp_ms", *(_decimals(c, "%.9f") for c in numbers), "group", _decimals("sigma", "%.9f")).write.option("header", True).csv(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of such tables with nine numbers; others are dropped."""
    names = ["timestamp_ms", *(f"bearing_{a}" for a in "xyz"), *(f"eci_{a}_km" for a in "xyz"), "group", "sigma"]
    parts = F.split("value", ",")
    kinds = ["bigint", *["double"] * 6, "int", "double"]
    rows = spark.read.text(path).where(F.size(parts) >= 9)
    return rows.select(*(F.trim(parts[k]).try_cast(kind).alias(n) for k, (n, kind) in enumerate(zip(names, kinds, strict=True)))).dropna()


RESULTS = ("state_estimates", "initial_trajectory", "covariance", "dynamics_residuals", "landmark_residuals")


def _folder(c: str = "dataset_id") -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_").alias("dataset")


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """A folder for each table, and in it one for each dataset: CSV with twelve significant digits, booleans as 0 and 1; od_result as JSON documents."""
    for name, rows in tables.items():
        if name == "od_result":
            rows.select(_folder(), "value").write.partitionBy("dataset").text(f"{path}/{name}")
            continue
        show = {"double": lambda c: _decimals(c, "%.12g"), "boolean": lambda c: F.col(c).cast("int").alias(c)}
        rows.select(_folder(), *(show.get(kind, F.col)(c) for c, kind in rows.dtypes if c != "dataset_id")).write.partitionBy("dataset").option("header", True).csv(f"{path}/{name}")


def write_trajectory(states: DataFrame, biases: DataFrame, path: str) -> None:
    """States (dataset_id, t, numbers) beside each dataset's gyro bias (dataset_id, bias: three numbers), by dataset."""
    rows = states.join(biases, "dataset_id", "left").select("dataset_id", *(c for c in states.columns if c != "dataset_id"), *(F.col("bias")[k].alias(f"gyro_bias_{a}") for k, a in enumerate("xyz")))
    write_results({"trajectory": rows}, path)


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """The tables of a results folder by name, with the dataset's folder last, and od_result's documents; those that aren't there are None. A folder <name>.csv or od_result.json of one dataset is read as well."""
    from pyspark.errors import AnalysisException

    def read(name: str) -> DataFrame | None:
        for at in (f"{path}/{name}", f"{path}/{name}.{'json' if name == 'od_result' else 'csv'}"):
            try:
                return spark.read.text(at, wholetext=True) if name == "od_result" else spark.read.option("header", True).option("inferSchema", True).csv(at)
            except AnalysisException:
                continue
        return None

    return {name: read(name) for name in (*RESULTS, "od_result")}


def residual_columns(rows: DataFrame, bias_mode: str = "fixed") -> DataFrame:
    """Dynamics residuals without the gyro bias's columns where the bias is fixed."""
    return rows.select(*(c for c in rows.columns if bias_mode != "fixed" or not c.startswith("gyro_bias_res_")))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a report that was aggregated before; nulls show as n/a."""
    show = lambda v: "n/a" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def validation_report(report: DataFrame, detections: DataFrame) -> str:
    """Markdown of a detector's validation: precision and recall of each region (`detection_report`: a row a region), then every class in the report's order (`report_order`). Both are aggregates of a few hundred rows."""
    percent = lambda v: None if v is None else f"{v / 10:.1f} %"
    regions = [{**r.asDict(), "precision": percent(r.precision_permille), "recall": percent(r.recall_permille)} for r in report.orderBy("region").toLocalIterator()]
    classes = [r.asDict() for r in detections.toLocalIterator()]
    total = {c: sum(r[c] for r in regions) for c in ("predicted", "true_positives", "truth")}
    share = lambda den: percent(1000 * total["true_positives"] // total[den]) if total[den] else None
    regions.append({"region": "all", **total, "precision": share("predicted"), "recall": share("truth")})
    names = ["region", "predicted", "true_positives", "truth", "precision", "recall"]
    return "# Detector validation\n\n" + markdown(regions, names) + "\n## Classes\n\n" + markdown(classes, ["region", "class_id", "true_positives", "n"])


def calibration_report(rows: DataFrame, session: str) -> str:
    """TOML of calibration sessions (`calibration`: a row a session), a section for each."""
    return toml({f"session-{r[session]}": {k: v for k, v in r.asDict().items() if k != session and v is not None} for r in rows.orderBy(session).toLocalIterator()})


def toml(sections: dict[str, dict]) -> str:
    """Sections of plain values."""
    return "\n".join(f"[{name}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in values.items()) for name, values in sections.items())
