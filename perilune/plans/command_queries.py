"""Queries on commands, telemetry frames and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions.binary import crc_udf
from perilune.operators import calibration as K
from perilune.operators import commands as C
from perilune.plans.registry import read, register


@register("start_capture_validation", """with x as (select o_orderkey, o_orderkey % 8 as md, o_orderkey % 20000 as pe, o_custkey % 300 as fr, o_orderkey as st, o_custkey % 6 as im, o_orderkey % 256 as ir, o_custkey % 256 as hz, o_orderkey % 5 as sg, o_orderkey % 13 = 0 as cut from orders)
select o_orderkey, case when cut then 'too_short' when md not between 2 and 5 then 'mode' when im > 3 then 'imu_mode' when sg > 3 then 'stage' when fr not between 1 and 255 then 'frames' when pe < 1 or pe > 10800 then 'period' when ir not between 1 and 254 then 'image_rate' when hz not between 1 and 250 then 'imu_rate' end as error,
  greatest(st * 1000, 5000000) as start_ms from x""")
def start_capture_validation(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = {"mode": k % 8, "period": k % 20000, "frames": c % 300, "start_s": k, "imu_mode": c % 6, "image_rate": k % 256, "imu_rate_tenths": c % 256, "stage": k % 5}
    data = C.encode(C.START_CAPTURE, fields)
    rows = read(spark, d, "orders").select("o_orderkey", F.when(k % 13 == 0, F.substring(data, 1, 12)).otherwise(data).alias("b"))
    made = C.start_capture(F.col("b"), F.lit(5_000_000).cast("long"))
    return rows.select("o_orderkey", made["error"].alias("error"), made["start_ms"].alias("start_ms"))


@register("telemetry_frames", "select o_orderkey, o_orderkey * 1000 as system_time, o_custkey as system_uptime, o_orderkey % 101 as ram_usage, o_custkey % 60000 as vdd_soc, 49 as size, 47 as host_size from orders")
def telemetry_frames(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = {"system_time": k * 1000, "system_uptime": c, "ram_usage": k % 101, "vdd_soc": c % 60000, "imu_temperature": k % 500}
    rows = read(spark, d, "orders").select("o_orderkey", C.encode(C.TELEMETRY, fields).alias("b"), C.encode(C.HOST_TELEMETRY, fields).alias("h"))
    made, host = C.decode(C.TELEMETRY, F.col("b")), C.decode(C.HOST_TELEMETRY, F.col("h"))
    return rows.select("o_orderkey", *(made[n].alias(n) for n in ("system_time", "system_uptime", "ram_usage")), host["vdd_soc"].alias("vdd_soc"), F.octet_length("b").cast("int").alias("size"), F.octet_length("h").cast("int").alias("host_size"))


@register("chunk_transfer_packets", """with c as (select conv_id * 100 + turn as id, octet_length(encode(text)) as n from conversations where octet_length(encode(text)) > 0), k as (select id, n, unnest(generate_series(1, cast(ceil(n / 239.0) as bigint))) as chunk_id from c)
select id, cast(chunk_id as integer) as chunk_id, chunk_id = cast(ceil(n / 239.0) as bigint) as last, true as crc_valid from k""")
def chunk_transfer_packets(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").cast("binary").alias("b"))
    made = C.check_packets(C.chunk_packets(rows, "id", "b", crc_udf("crc5")), "packet", crc_udf("crc5"))
    return made.select("id", "chunk_id", "last", "crc_valid")


@register("json_packet_roundtrip", "select event_id, props as text, true as plausible from events where octet_length(encode(props)) > 0")
def json_packet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return C.json_from_packets(C.json_packets(read(spark, d, "events"), "event_id", "props"), "event_id")


@register("command_lines", "select event_id, cast(user_id as integer) as cmd_id, cast(event_id % 100 as integer) as first_argument, 10 as second_argument from events")
def command_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("  "), (F.col("event_id") % 100).cast("string"), F.lit(" 0x0A"))
    rows = C.parse_command(read(spark, d, "events").select("event_id", line.alias("value")))
    return rows.select("event_id", "cmd_id", F.col("arguments")[0].alias("first_argument"), F.col("arguments")[1].alias("second_argument"))


@register("exposure_metrics", """with p as (select l_suppkey as frame, l_partkey % 256 as r, l_orderkey % 256 as g, cast(l_quantity as bigint) * 5 as b from lineitem), y as (select *, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b as y from p)
select frame, round(avg(y), 6) as luminance, count(*) filter (y > 250) * 100.0e0 / count(*) as saturated_pct, count(*) filter (y < 5) * 100.0e0 / count(*) as dark_pct, round(avg(r) / avg(g), 9) as rg_ratio from y group by 1""")
def exposure_metrics(spark: SparkSession, d: str) -> DataFrame:
    pixels = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_orderkey") % 256).alias("g"), (F.col("l_quantity").cast("long") * 5).alias("b"))
    rows = K.exposure_metrics(pixels, "frame")
    return rows.select("frame", F.round("luminance", 6).alias("luminance"), "saturated_pct", "dark_pct", F.round("rg_ratio", 9).alias("rg_ratio"))
