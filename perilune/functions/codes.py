"""Code tables of the mission's enumerations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and names are the mission's.
REGIONS = ("10S", "10T", "11R", "12R", "16T", "17R", "17T", "18S", "32S", "32T", "33S", "33T", "52S", "53S", "54S", "54T", "UNKNOWN")
REGION_PLACES = (
    "California", "Washington / Oregon", "Baja California, Mexico", "Sonora, Mexico", "Minnesota / Wisconsin / Iowa / Illinois", "Florida",
    "Toronto, Canada / Michigan / OH / PA", "New Jersey / Washington DC", "Tunisia (North Africa near Tyrrhenian Sea)", "Switzerland / Italy / Tyrrhenian Sea",
    "Sicilia, Italy", "Italy / Adriatic Sea", "Korea / Kumamoto, Japan", "Hiroshima to Nagoya, Japan", "Tokyo to Hachinohe, Japan", "Sapporo, Japan", "UNKNOWN",
)
PROCESSING_STAGES = ("NotPrefiltered", "Prefiltered", "RCNeted", "LDNeted")
IMAGE_STATES = ("NotEarth", "Earth", "HasRegion", "HasLandmark")
CAPTURE_MODES = ("IDLE", "CAPTURE_SINGLE", "PERIODIC", "PERIODIC_EARTH", "PERIODIC_ROI", "PERIODIC_LDMK")
#: The stage that frames of a capture mode must have reached.
MODE_STAGE = {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
CAMERA_SUFFIXES = ("xp", "yp", "ym", "xm")


def code_map(names: tuple | dict) -> Column:
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return F.create_map(*map(F.lit, chain.from_iterable(pairs)))


def decode(code: Column, names: tuple | dict, default=None) -> Column:
    """A code's name; default for codes that aren't in the table."""
    return F.coalesce(F.try_element_at(code_map(names), code.cast("int")), F.lit(default))


def encode(name: Column, names: tuple, default: int) -> Column:
    return F.coalesce(F.try_element_at(code_map({n: k for k, n in enumerate(names)}), name), F.lit(default))


def region_table(spark: SparkSession) -> DataFrame:
    """region_id, code, place: seventeen rows, so it may be broadcast."""
    return spark.createDataFrame([(k, c, p) for k, (c, p) in enumerate(zip(REGIONS, REGION_PLACES, strict=True))], "region_id int, code string, place string")


def mode_stage(mode: Column) -> Column:
    return decode(mode, MODE_STAGE, 0)
