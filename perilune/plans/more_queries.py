"""Queries on names, masks, registries, transfers and error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions import nav, units
from perilune.functions import quaternion as Q
from perilune.functions.text import basename, first_group
from perilune.operators.frames import newest
from perilune.operators.framing import pulled
from perilune.plans.registry import read, register
from perilune.sources.proc import core_counters


@register("camera_enable_mask", """select o_orderkey, array_to_string([i for i in [0, 1, 2, 3] if (o_orderkey & o_custkey) >> i & 1 = 1], ',') as enabled, o_orderkey & o_custkey & 15 = 0 as all_off from orders""")
def camera_enable_mask(spark: SparkSession, d: str) -> DataFrame:
    """Cameras that both the configuration and the dataset enable; with none on before a session they are turned off after it."""
    both = F.col("o_orderkey").bitwiseAND(F.col("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(units.set_bits(both, 4), lambda x: x.cast("string")), ",").alias("enabled"), (both.bitwiseAND(F.lit(15).cast("long")) == 0).alias("all_off"))


@register("timestamped_names", "select o_orderkey, 'log_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || o_orderkey || '.json' as name from orders")
def timestamped_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("log_"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd_HHmmss"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return read(spark, d, "orders").select("o_orderkey", name.alias("name"))


@register("file_names", "select page_id, regexp_extract(url, '[^/]*$') as base, nullif(regexp_extract(regexp_extract(url, '[^/]*$'), '^([^.]+)', 1), '') as stem from pages")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", basename(F.col("url")).alias("base"), first_group(basename(F.col("url")), r"^([^.]+)").alias("stem"))


@register("covariance_rotation", """with v as (select vec_id, cast(embedding[1] as double) * cast(embedding[1] as double) as a, cast(embedding[2] as double) * cast(embedding[2] as double) as b, cast(embedding[3] as double) * cast(embedding[3] as double) as c, vec_id * 0.01e0 as t from embeddings)
select vec_id, round(cos(t) * cos(t) * a + sin(t) * sin(t) * b, 12) as xx, round(sin(t) * sin(t) * a + cos(t) * cos(t) * b, 12) as yy, round(c, 12) as zz, round(3 * sqrt(cos(t) * cos(t) * a + sin(t) * sin(t) * b), 9) as bound from v""")
def covariance_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Diagonal variances seen from a frame turned about z: the squared matrix applied to them."""
    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    t = F.col("vec_id") * 0.01
    c2, s2 = F.cos(t) * F.cos(t), F.sin(t) * F.sin(t)
    zero = F.lit(0.0)
    xx, yy, zz = nav.rotate(tuple(x * x for x in e), [c2, s2, zero, s2, c2, zero, zero, zero, F.lit(1.0)])
    return read(spark, d, "embeddings").select("vec_id", F.round(xx, 12).alias("xx"), F.round(yy, 12).alias("yy"), F.round(zz, 12).alias("zz"), F.round(nav.three_sigma(xx), 9).alias("bound"))


@register("attitude_error", """with v as (select vec_id, """ + ", ".join(f"cast(embedding[{k}] as double) as v{k}" for k in range(1, 9)) + """ from embeddings),
n as (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4) as p, sqrt(v5 * v5 + v6 * v6 + v7 * v7 + v8 * v8) as q from v)
select vec_id, round(2 * acos(least(abs(v1 / p * (v5 / q) + v2 / p * (v6 / q) + v3 / p * (v7 / q) + v4 / p * (v8 / q)), 1.0)), 7) as angle from n""")
def attitude_error(spark: SparkSession, d: str) -> DataFrame:
    """The angle between two attitudes: twice the arc cosine of their product's scalar part."""
    v = [F.col("embedding")[k].cast("double") for k in range(8)]
    w = Q.product_wxyz(Q.conjugate_wxyz(Q.normalized(tuple(v[:4]))), Q.normalized(tuple(v[4:])))[0]
    return read(spark, d, "embeddings").select("vec_id", F.round(2 * F.acos(F.least(F.abs(w), F.lit(1.0))), 7).alias("angle"))


@register("session_registry", """with r as (select o_custkey as name, o_orderkey as session, o_orderstatus as state, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) select name, session, state <> 'F' as active from r where n = 1""")
def session_registry(spark: SparkSession, d: str) -> DataFrame:
    """The newest session of each name, and whether it still runs."""
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("session"), "o_orderstatus", "o_orderdate")
    return newest(rows, "name", ["o_orderdate", "session"], ["session", "o_orderstatus"]).select("name", "session", (F.col("o_orderstatus") != "F").alias("active"))


@register("pull_transfer", """with c as (select doc_id, encode(text) as b, doc_id % 7 + 1 as first from documents where text is not null), k as (select doc_id, b, first, unnest(generate_series(first, first + 2)) as packet from c)
select doc_id, packet, (packet - 1) * 240 >= octet_length(b) as no_more, case when (packet - 1) * 240 < octet_length(b) then sha256(b[(packet - 1) * 240 + 1 : packet * 240]) end as digest from k""")
def pull_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Batches of three packets from a number on (from 1), with a mark where there are no more."""
    files = read(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("b"))
    return pulled(files, ["doc_id"], "b", F.col("doc_id") % 7 + 1).select("doc_id", "packet", "no_more", F.sha2("payload", 256).alias("digest"))


@register("optional_ranges", "select p_partkey, case when p_size % 4 <> 0 or p_partkey % 3 <> 0 then p_size % 4 || '-' || p_partkey % 3 end as range from part")
def optional_ranges(spark: SparkSession, d: str) -> DataFrame:
    pair = units.low_high(F.col("p_size") % 4, F.col("p_partkey") % 3)
    return read(spark, d, "part").select("p_partkey", pair.alias("r")).select("p_partkey", F.when(F.col("r").isNotNull(), F.concat_ws("-", F.col("r.low").cast("string"), F.col("r.high").cast("string"))).alias("range"))


@register("counter_lines", """with x as (select o_orderkey, o_custkey, 'cpu' || o_orderkey % 6 || ' ' || o_custkey || ' 0 7 ' || o_orderkey || ' 3 0 0' as line from orders) select o_orderkey, cast(regexp_extract(line, '^cpu(\\d+)', 1) as integer) as core, o_orderkey + 3 as idle, o_custkey + 7 + o_orderkey + 3 as total from x""".replace("\\\\", "\\"))
def counter_lines(spark: SparkSession, d: str) -> DataFrame:
    """Per-core counters: idle is the fourth and fifth number, the total is their sum."""
    line = F.concat(F.lit("cpu"), (F.col("o_orderkey") % 6).cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" 0 7 "), F.col("o_orderkey").cast("string"), F.lit(" 3 0 0"))
    return core_counters(read(spark, d, "orders").select("o_orderkey", line.alias("value")))


@register("newest_image", "select o_custkey, max(o_orderkey) filter (o_orderpriority like '1%') as newest, count(*) as files, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as bytes from orders group by 1")
def newest_image(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders")
    return rows.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderpriority").like("1%"), F.col("o_orderkey"))).alias("newest"), F.count("*").alias("files"), F.sum(F.floor("o_totalprice")).alias("bytes"))
