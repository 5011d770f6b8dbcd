"""Queries on bytes, texts and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions import binary as B
from perilune.functions import text as T
from perilune.operators import framing as P
from perilune.plans.registry import read, register


@register("chunk_fixed_240", """with c as (select doc_id, encode(text) as b from documents where octet_length(encode(text)) > 0), k as (select doc_id, b, unnest(generate_series(1, cast(ceil(octet_length(b) / 240.0) as bigint))) as chunk_id from c)
select doc_id, cast(chunk_id as integer) as chunk_id, chunk_id = cast(ceil(octet_length(b) / 240.0) as bigint) as last, sha256(b[(chunk_id - 1) * 240 + 1 : chunk_id * 240]) as digest from k""")
def chunk_fixed_240(spark: SparkSession, d: str) -> DataFrame:
    rows = P.chunks(read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b")), ["doc_id"], "b")
    return rows.select("doc_id", "chunk_id", "last", F.sha2("payload", 256).alias("digest"))


@register("packet_counts", "select doc_id, cast(ceil(octet_length(encode(text)) / 240.0) as bigint) as chunks, cast(floor((octet_length(encode(text)) - 5) / 242.0) as bigint) as packets from documents where text is not null")
def packet_counts(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text")
    return read(spark, d, "documents").where("text is not null").select("doc_id", B.chunk_count(size).alias("chunks"), B.packet_count(size).alias("packets"))


@register("fixed_packet_roundtrip", """with c as (select conv_id, turn, encode(text) as b from conversations where octet_length(encode(text)) > 0), k as (select conv_id, turn, b, unnest(generate_series(0, cast(ceil(octet_length(b) / 240.0) as bigint) - 1)) as f from c)
select conv_id, cast(row_number() over (partition by conv_id order by turn, f) - 1 as integer) as packet_id, sha256(b[f * 240 + 1 : (f + 1) * 240]) as digest from k""")
def fixed_packet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every byte of each text, written as files of fixed packets and read back; the packets' order is that of turns, then chunks."""
    rows = P.chunks(read(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("b")), ["conv_id", "turn"], "b")
    rows = rows.select("conv_id", F.struct("turn", "chunk_id").alias("at"), "payload")
    return P.read_packets(P.packet_file(rows, "conv_id", "at", "payload"), "conv_id").select("conv_id", "packet_id", F.sha2("payload", 256).alias("digest"))


@register("tile_fragments", """with c as (select conv_id, turn, encode(text) as b from conversations where octet_length(encode(text)) > 0), k as (select conv_id, turn, b, unnest(generate_series(0, cast(ceil(octet_length(b) / 233.0) as bigint) - 1)) as f from c)
select conv_id, turn as tile_idx, f as frag_idx, cast(octet_length(b[f * 233 + 1 : (f + 1) * 233]) as bigint) as payload_size, cast(1 as bigint) as page_id, sha256(b[f * 233 + 1 : (f + 1) * 233]) as digest from k""")
def tile_fragments(spark: SparkSession, d: str) -> DataFrame:
    rows = P.tile_fragments(read(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("b")), ["conv_id", "turn"], "b")
    made = P.decode_fragment(F.col("packet"))
    return rows.select("conv_id", *(made[c].alias(c) for c in ("tile_idx", "frag_idx", "payload_size", "page_id")), F.sha2(made["payload"], 256).alias("digest"))


@register("tile_status", """with f as (select l_orderkey, l_linenumber % 3 as tile, l_partkey % 4 as frag from lineitem), p as (select l_orderkey, tile, count(distinct frag) = max(frag) + 1 as whole from f group by 1, 2),
s as (select l_orderkey, count(*) filter (whole) complete, count(*) filter (not whole) as partial from p group by 1)
select o_orderkey as l_orderkey, coalesce(complete, 0) complete, coalesce(partial, 0) as partial, 3 - coalesce(complete, 0) - coalesce(partial, 0) as missing from orders left join s on o_orderkey = l_orderkey""")
def tile_status(spark: SparkSession, d: str) -> DataFrame:
    fragments = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("tile"), (F.col("l_partkey") % 4).alias("frag"))
    return P.tile_status(fragments, "l_orderkey", "tile", "frag", read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(3).alias("tiles")))


@register("tile_grid", "select p_partkey, cast(ceil(p_partkey % 640 / 64.0) * ceil(p_size * 9 / 32.0) as integer) as tiles from part")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", P.tile_grid(F.col("p_partkey") % 640, F.col("p_size") * 9).alias("tiles"))


@register("file_chunk", "select doc_id, case when doc_id * 3 < octet_length(encode(text)) then sha256(encode(text)[doc_id * 3 + 1 : doc_id * 3 + 100]) end as digest from documents where text is not null")
def file_chunk(spark: SparkSession, d: str) -> DataFrame:
    part = P.file_chunk(F.col("text").cast("binary"), F.col("doc_id") * 3, F.lit(100))
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(part, 256).alias("digest"))


@register("pack_big_endian", "select o_orderkey, lower(lpad(to_hex(o_orderkey), 8, '0') || lpad(to_hex(o_custkey), 4, '0') || lpad(to_hex(o_orderkey % 200), 2, '0')) as frame, o_orderkey as back_key, o_orderkey % 200 as back_mod from orders")
def pack_big_endian(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", B.serialize([(F.col("o_orderkey"), 4), (F.col("o_custkey"), 2), (F.col("o_orderkey") % 200, 1)]).alias("b"))
    return rows.select("o_orderkey", F.lower(F.hex("b")).alias("frame"), B.unpack_uint(F.col("b"), 0, 4).alias("back_key"), B.unpack_uint(F.col("b"), 6, 1).alias("back_mod"))


@register("message_frames", """with c as (select conv_id, turn, encode(text) as b from conversations where text is not null), k as (select conv_id, turn, b, unnest(generate_series(0, greatest(cast(ceil(octet_length(b) / 240.0) as bigint), 1) - 1)) as f from c)
select conv_id, turn, turn as message_id, f as sequence, octet_length(b[f * 240 + 1 : (f + 1) * 240]) as length, sha256(b[f * 240 + 1 : (f + 1) * 240]) as digest, 245 as size from k""")
def message_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every byte of each text in messages: the sequence counts a text's messages, and an empty text has one."""
    texts = read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").cast("binary").alias("b"))
    rows = P.chunks(texts, ["conv_id", "turn"], "b").select("conv_id", "turn", (F.col("chunk_id") - 1).alias("f"), "payload")
    rows = rows.unionByName(texts.where(F.octet_length("b") == 0).select("conv_id", "turn", F.lit(0).alias("f"), F.col("b").alias("payload")))
    rows = rows.select("conv_id", "turn", B.message(F.col("turn"), F.col("f"), F.col("payload")).alias("m"))
    made = B.decode_message(F.col("m"))
    return rows.select("conv_id", "turn", *(made[c].alias(c) for c in ("message_id", "sequence", "length")), F.sha2(made["data"], 256).alias("digest"), F.octet_length("m").cast("int").alias("size"))


@register("crc16_payload")
def crc16_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("p"))
    return rows.select("conv_id", "turn", B.crc_udf("crc16")("p").alias("crc16"), B.crc_udf("crc5")("p").alias("crc5"))


@register("regex_kv_extract", r"""select page_id, nullif(regexp_extract(url, '^(\w+)://', 1), '') as scheme, nullif(regexp_extract(url, '://([^/]+)', 1), '') as host, try_cast(nullif(regexp_extract(url, '(\d+)', 1), '') as bigint) as number, nullif(regexp_extract(url, '\.([^./]+)$', 1), '') as ext,
  regexp_extract(url, '[^/]*$') as base from pages""")
def regex_kv_extract(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select(
        "page_id", T.first_group(u, r"^(\w+)://").alias("scheme"), T.first_group(u, r"://([^/]+)").alias("host"), T.first_group(u, r"(\d+)").try_cast("bigint").alias("number"), T.extension(u).alias("ext"), T.basename(u).alias("base")
    )


@register("json_props", "select event_id, try_cast(props ->> '$.k' as bigint) as k, coalesce(try_cast(props ->> '$.missing' as bigint), -1) as other from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k long, missing long")
    return read(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("k"), F.coalesce("p.missing", F.lit(-1)).cast("long").alias("other"))


_LINE = """'RAM ' || (o_orderkey % 7000) || '/7620MB (lfb 4x2MB) SWAP ' || (o_custkey % 100) || '/3810MB (cached 0MB) CPU [' || (o_orderkey % 101) || '%@729,' || (case when o_orderkey % 3 = 0 then 'off' else (o_custkey % 101) || '%@883' end) || ',0%@729] ' ||
 (case when o_orderkey % 5 = 0 then '' else 'GR3D_FREQ ' || (o_orderkey % 99) || '% ' end) || 'cpu@' || (o_orderkey % 90) || '.5C gpu@61.687C VDD_IN ' || o_orderkey || 'mW/1mW VDD_SOC 12mW/1mW'"""


@register("host_stats_lines", """select o_orderkey, cast(o_orderkey % 7000 as integer) as ram_used, 7620 as ram_total, cast(o_custkey % 100 as integer) as swap_used, case when o_orderkey % 5 <> 0 then cast(o_orderkey % 99 as integer) end as gpu_freq, cast(o_orderkey % 90 as double) + 0.5 as cpu_temp,
  cast(o_orderkey as integer) as vdd_in, case when o_orderkey % 3 = 0 then 2 else 3 end as active_cores, concat_ws(',', o_orderkey % 101, case when o_orderkey % 3 = 0 then 0 else o_custkey % 101 end, 0, 0, 0, 0) as loads, cast(null as integer) as vdd_cpu_gpu_cv from orders""")
def host_stats_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", F.expr(_LINE).alias("line"))
    made = T.host_stats(F.col("line"))
    return rows.select("o_orderkey", *(made[c].alias(c) for c in ("ram_used", "ram_total", "swap_used", "gpu_freq", "cpu_temp", "vdd_in", "vdd_cpu_gpu_cv", "active_cores")), F.array_join(F.transform(made["cpu_load"], lambda x: x.cast("string")), ",").alias("loads"))


@register("host_stats_carried", """with x as (select o_orderkey, o_custkey, case when o_orderkey % 5 <> 0 then o_orderkey % 99 end as g from orders) select o_orderkey, cast(last_value(g ignore nulls) over (partition by o_custkey order by o_orderkey) as integer) as gpu_freq from x""")
def host_stats_carried(spark: SparkSession, d: str) -> DataFrame:
    """A field that a line lacks keeps the value of the line before it."""
    from pyspark.sql import Window

    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(_LINE).alias("line"))
    seen = T.host_stats(F.col("line"))["gpu_freq"]
    return rows.select("o_orderkey", F.last(seen, ignorenulls=True).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("gpu_freq"))


@register("model_names", """select p_partkey, 'R' || p_size as region, case when p_partkey % 2 = 0 then 'fp16' else 'int8' end as precision, cast(p_size * 32 as integer) as height, cast(case when p_partkey % 3 = 0 then p_size * 32 else p_size * 16 end as integer) as width, p_partkey % 5 = 0 as nms from part""")
def model_names(spark: SparkSession, d: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    name = T.format_model_name(F.concat(F.lit("R"), z.cast("string")), F.when(k % 2 == 0, "fp16").otherwise("int8"), z * 32, F.when(k % 3 == 0, z * 32).otherwise(z * 16), k % 5 == 0)
    rows = read(spark, d, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", *(c.alias(n) for n, c in T.model_name(F.col("name")).items()))


@register("image_names", """select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderkey end as timestamp_ms, case when o_orderkey % 3 <> 0 then cast(o_custkey % 4 as integer) end as cam_id, cast(case when o_orderkey % 2 = 0 then o_orderkey % 9 else -1 end as integer) as version from orders""")
def image_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "frame_").otherwise("raw_"), k.cast("string"), F.lit("_"), (F.col("o_custkey") % 4).cast("string"), F.lit(".png"))
    path = F.concat(F.lit("/models/"), F.when(k % 2 == 0, "V").otherwise("W"), (k % 9).cast("string"), F.lit("/x.bin"))
    made = T.raw_image_name(name)
    return read(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in made.items()), T.path_version(path).alias("version"))


@register("option_strings", """select p_partkey, concat_ws(' ', case when p_size - 10 >= 0 then 'gain=' || (p_size - 10) end, case when p_partkey % 3 - 1 >= 0 then 'wb=' || (p_partkey % 3 - 1) end) as options from part""")
def option_strings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.option_string({"gain": F.col("p_size") - 10, "wb": F.col("p_partkey") % 3 - 1}).alias("options"))


@register("dirty_numbers", """with x as (select p_partkey, case when p_partkey % 4 = 0 then 'bad,row' when p_partkey % 4 = 1 then p_partkey || ' ms, ERROR 3' else p_partkey || ', ' || p_size || ', 1.5, -2' end as line from part)
select p_partkey, cast(trim(split_part(line, ',', 1)) as bigint) as t, cast(trim(split_part(line, ',', 2)) as double) as x from x where p_partkey % 4 >= 2""")
def dirty_numbers(spark: SparkSession, d: str) -> DataFrame:
    from perilune.sources.imu import parse_imu

    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, "bad,row").when(k % 4 == 1, F.concat(k.cast("string"), F.lit(" ms, ERROR 3"))).otherwise(F.concat(k.cast("string"), F.lit(", "), F.col("p_size").cast("string"), F.lit(", 1.5, -2")))
    return parse_imu(read(spark, d, "part").select("p_partkey", line.alias("value"))).select("p_partkey", F.col("timestamp_ms").alias("t"), F.col("gyro_x_dps").alias("x"))
