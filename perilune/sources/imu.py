"""Inertial logs: text lines whose header tells the mode, with dirty rows between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns behind the timestamp for each mode.
GYRO = ("gyro_x_dps", "gyro_y_dps", "gyro_z_dps")
MAGNETIC = ("mag_x_ut", "mag_y_ut", "mag_z_ut")
HEADERS = {"gyro": "Timestamp_ms, Gyro_X_dps, Gyro_Y_dps, Gyro_Z_dps", "gyro_temp": "Timestamp_ms, Gyro_X_dps, Gyro_Y_dps, Gyro_Z_dps, Temperature_C", "gyro_mag_temp": "Timestamp_ms, Gyro_X_dps, Gyro_Y_dps, Gyro_Z_dps, Mag_X_uT, Mag_Y_uT, Mag_Z_uT, Temperature_C"}


def parse_imu(lines: DataFrame, value: str = "value", columns: tuple[str, ...] = GYRO) -> DataFrame:
    """Rows of `value` texts with a timestamp and a number for each column; other rows (headers, blanks, errors, too few or bad fields) are dropped. Further columns of lines are kept."""
    parts = F.split(F.col(value), ",")
    number = lambda k, kind: F.trim(F.try_element_at(F.col("_p"), F.lit(k + 1))).try_cast(kind)
    kept = [c for c in lines.columns if c != value]
    rows = lines.withColumn("_p", parts).where(F.size("_p") > len(columns))
    rows = rows.select(*kept, number(0, "bigint").alias("timestamp_ms"), *(number(k, "double").alias(c) for k, c in enumerate(columns, 1)))
    return rows.dropna(subset=["timestamp_ms", *columns])


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """Gyro columns of all logs below a path, with the file they came from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_imu(lines)


def read_imu_full(spark: SparkSession, path: str) -> DataFrame:
    """All eight columns; rows with fewer are dropped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_imu(lines, columns=(*GYRO, *MAGNETIC, "temperature_c"))


def format_imu(rows: DataFrame, columns: tuple[str, ...] = GYRO) -> DataFrame:
    """`value`: lines with six decimals."""
    return rows.select(F.concat_ws(", ", F.col("timestamp_ms").cast("string"), *(F.format_string("%.6f", F.col(c)) for c in columns)).alias("value"))


COLUMNS = {"gyro": GYRO, "gyro_temp": (*GYRO, "temperature_c"), "gyro_mag_temp": (*GYRO, *MAGNETIC, "temperature_c")}


def _lines(rows: DataFrame, mode: str) -> DataFrame:
    names = HEADERS[mode].split(", ")
    return rows.select(F.col("timestamp_ms").alias(names[0]), *(F.format_string("%.6f", F.col(c)).alias(n) for c, n in zip(COLUMNS[mode], names[1:], strict=True)))


def write_imu(rows: DataFrame, path: str, mode: str = "gyro") -> None:
    """One CSV with the mode's header in each part file."""
    _lines(rows, mode).write.option("header", True).option("sep", ",").csv(path)


def stream_imu(rows: DataFrame, path: str, checkpoint: str, mode: str = "gyro", every: str = "1 second"):
    """The same from a stream, a batch of files for each trigger: what a batch holds is on disk before the next one begins. Returns the query."""
    return _lines(rows, mode).writeStream.format("csv").option("header", True).option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(processingTime=every).start()
