"""Text parsing without row-at-a-time code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the fields of a host-stats line look like.
HOST_FIELDS = {
    "ram_used": (r"RAM (\d+)/(\d+)MB", 1), "ram_total": (r"RAM (\d+)/(\d+)MB", 2), "swap_used": (r"SWAP (\d+)/(\d+)MB", 1), "swap_total": (r"SWAP (\d+)/(\d+)MB", 2),
    "gpu_freq": (r"GR3D_FREQ (\d+)%?", 1), "cpu_temp": (r"cpu@([\d.]+)C", 1), "gpu_temp": (r"gpu@([\d.]+)C", 1), "vdd_in": (r"VDD_IN (\d+)mW", 1),
    "vdd_cpu_gpu_cv": (r"VDD_CPU_GPU_CV (\d+)mW", 1), "vdd_soc": (r"VDD_SOC (\d+)mW", 1),
}
CORES = 6


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern doesn't match (an empty group counts as no match)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def host_stats(line: Column) -> dict[str, Column]:
    """Fields of a host-stats line; null where a field is absent, so that the previous line's value can be carried on."""
    out = {k: first_group(line, p, g).try_cast("double" if k.endswith("temp") else "int") for k, (p, g) in HOST_FIELDS.items()}
    cores = first_group(line, r"CPU \[((?:\d+%@\d+,?|off,?)+)\]")
    loads = F.transform(F.split(cores, ","), lambda x: F.coalesce(first_group(x, r"(\d+)%@").try_cast("int"), F.lit(0)))
    out["cpu_load"] = F.when(cores.isNotNull(), F.slice(F.concat(loads, F.array_repeat(F.lit(0), CORES)), 1, CORES))
    out["active_cores"] = F.when(cores.isNotNull(), F.regexp_count(cores, F.lit(r"\d+%@")))
    return out


def keyed_number(line: Column, key: str) -> Column:
    """The whole number behind a key ('RAM 3162/7620MB' -> 3162): of the text after the key's first place, the digits that come first behind blanks, signs or letters of a unit."""
    after = F.substring(line, F.instr(line, key) + F.lit(len(key)), F.length(line))
    return F.when(F.instr(line, key) > 0, first_group(after, r"^[^0-9]*?(\d+)").try_cast("long"))


def keyed_power(line: Column, key: str) -> Column:
    """Milliwatts of 'KEY 3913mW/3922mW': the number behind the key if its unit is mW."""
    after = F.substring(line, F.instr(line, key) + F.lit(len(key)), F.length(line))
    return F.when(F.instr(line, key) > 0, first_group(after, r"^\s+(\d+)mW").try_cast("long"))


def raw_image_name(name: Column) -> dict[str, Column]:
    """timestamp and camera of raw_<timestamp>_<camera>.jpg or .png; null for any other name."""
    pattern = r"^raw_(\d+)_(\d+)\.(?:jpg|png)$"
    return {"timestamp_ms": first_group(name, pattern, 1).try_cast("long"), "cam_id": first_group(name, pattern, 2).try_cast("int")}


def label_name(name: Column) -> dict[str, Column]:
    """region, timestamp and camera suffix of a label file's name."""
    pattern = r"^([0-9A-Z]+)_(\d+)_(xp|yp|ym|xm)\.txt$"
    return {"region": first_group(name, pattern, 1), "timestamp_ms": first_group(name, pattern, 2).try_cast("long"), "camera": first_group(name, pattern, 3)}


def model_name(name: Column) -> dict[str, Column]:
    """Parts of <region>_weights_<precision>_sz_<height>[x<width>][_nms].<extension>; one size stands for both."""
    pattern = r"^([0-9A-Za-z]+)_weights_([a-z0-9]+)_sz_(\d+)(?:x(\d+))?(_nms)?\.[a-z]+$"
    height = first_group(name, pattern, 3).try_cast("int")
    return {
        "region": first_group(name, pattern, 1), "precision": first_group(name, pattern, 2), "height": height,
        "width": F.coalesce(first_group(name, pattern, 4).try_cast("int"), height), "nms": F.when(height.isNotNull(), first_group(name, pattern, 5).isNotNull()),
    }


def format_model_name(region: Column, precision: Column, height: Column, width: Column, nms: Column, extension: str = "trt") -> Column:
    size = F.concat_ws("x", height.cast("string"), F.when(height != width, width.cast("string")))
    return F.concat(region, F.lit("_weights_"), precision, F.lit("_sz_"), size, F.when(nms, "_nms").otherwise(""), F.lit(f".{extension}"))


def path_version(path: Column) -> Column:
    """The number of a .../V<n>/... folder, or -1."""
    return F.coalesce(first_group(path, r"/V(\d+)(?:/|$)").try_cast("int"), F.lit(-1))


def extension(path: Column) -> Column:
    return first_group(path, r"\.([^./]+)$")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def option_string(options: dict[str, Column]) -> Column:
    """'name=value' for every option that is set and not negative, blank-separated."""
    return F.concat_ws(" ", *(F.when(c >= 0, F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in options.items()))


def log_result(log: Column) -> dict[str, Column]:
    """Stage, error and results folder that a job's log tells."""
    return {"stage": first_group(log, r"stage[:=]\s*(\w+)"), "error": first_group(log, r"error[:=]\s*(\w+)"), "results": first_group(log, r"results[^:=]*[:=]\s*(\S+)")}
