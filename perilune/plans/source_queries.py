"""Queries on sources and sinks: what is written is read back by the library's own operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions import quaternion as Q
from perilune.functions import text as T
from perilune.functions.binary import crc_udf
from perilune.operators import calibration as K
from perilune.operators import commands as C
from perilune.operators import detection as D
from perilune.operators import framing as P
from perilune.operators import frames as R
from perilune.operators import images as I
from perilune.operators import sequence as S
from perilune.plans.registry import read, register
from perilune.plans.reprocess import processed_frames
from perilune.plans.series_queries import _EV, events
from perilune.sources import frames as SF
from perilune.sources import outputs as O
from perilune.sources.files import scratch, write_files
from perilune.sources.imu import GYRO, MAGNETIC, format_imu, parse_imu
from perilune.sources.proc import memory_used, uptime
from perilune.sources.telemetry import read_tlm, write_tlm

_STAGE = "case o_orderstatus when 'O' then 1 when 'P' then 2 when 'F' then 3 else 0 end"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Orders as frames, their lines as landmarks."""
    s, n = F.col("o_orderstatus"), lambda c: F.lit(None).cast(c)
    mark = F.struct(F.col("l_linenumber").cast("float").alias("x"), F.col("l_quantity").cast("float").alias("y"), F.lit(8.0).cast("float").alias("height"), F.lit(9.0).cast("float").alias("width"), F.lit(0.5).cast("float").alias("confidence"), F.col("l_partkey").cast("int").alias("class_id"), F.lit(3).alias("region_id"))
    marks = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(mark)).alias("landmarks"))
    rows = read(spark, d, "orders").join(marks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    result = F.struct(F.lit(2).alias("rcnet_version"), F.lit(3).alias("ldnet_version"), n(SF.CONFIG).alias("ldnet_config"), F.array().cast(f"array<{SF.REGION}>").alias("regions"), F.coalesce("landmarks", F.array().cast(f"array<{SF.LANDMARK}>")).alias("landmarks"))
    stage = F.when(s == "O", 1).when(s == "P", 2).when(s == "F", 3).otherwise(0)
    return rows.select(
        F.col("o_orderkey").alias("timestamp_ms"), (F.col("o_custkey") % 4).cast("int").alias("cam_id"), F.when(F.size("landmarks") > 0, 3).otherwise(0).alias("annotation_state"), stage.alias("processing_stage"),
        (F.col("o_orderkey") % 8 / 8.0).cast("float").alias("rank"), n(SF.PREFILTER).alias("prefilter"), result.alias("inference_results"), n("struct<path:string,format:string,width:int,height:int,size_bytes:bigint>").alias("raw_image"),
    )


_FRAMES = f"""with l as (select l_orderkey, count(*) as n, sum(l_partkey) as classes from lineitem group by 1)
select o_orderkey as timestamp_ms, cast(o_custkey % 4 as integer) as cam_id, {_STAGE} as stage, cast(o_orderkey % 8 / 8.0 as double) as rank, cast(coalesce(n, 0) as integer) as landmarks, cast(coalesce(classes, 0) as bigint) as classes from orders left join l on o_orderkey = l_orderkey"""


def _summary(frames: DataFrame) -> DataFrame:
    marks = F.coalesce("inference_results.landmarks", F.array().cast(f"array<{SF.LANDMARK}>"))
    return frames.select("timestamp_ms", "cam_id", F.col("processing_stage").alias("stage"), F.col("rank").cast("double").alias("rank"), F.size(marks).alias("landmarks"), F.aggregate(marks, F.lit(0).cast("long"), lambda a, x: a + x["class_id"]).alias("classes"))


@register("frame_documents", _FRAMES)
def frame_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every frame as JSON in the nested layout, decoded again."""
    return _summary(SF.decode_frames(SF.encode_frames(_frames(spark, d)).select("value")))


@register("frame_files", """select n_nationkey as timestamp_ms, cast(n_regionkey as integer) as cam_id, n_name as dataset_id, 'frame_' || n_nationkey || '_' || n_regionkey || '.json' as file_name from nation""")
def frame_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation's frame, in the shared folder, found again by a scan that ignores other files; the folder stands for the dataset."""
    path = scratch(spark)
    rows = read(spark, d, "nation").select(F.concat(F.lit("frame_"), F.col("n_nationkey").cast("string"), F.lit("_"), F.col("n_regionkey").cast("string"), F.lit(".json")).alias("name"), "n_name", F.to_json(F.struct(F.col("n_nationkey").alias("timestamp"), F.col("n_regionkey").alias("cam_id"))).cast("binary").alias("content"))
    other = rows.select(F.concat(F.lit("other_"), "name").alias("name"), F.lit(b"{ definitely not json").alias("content"))
    write_files(rows.select("name", "content").unionByName(other), path)
    found = SF.read_frames(spark, path).select("timestamp_ms", "cam_id", "file_name")
    return found.join(rows.select(F.col("name").alias("file_name"), F.col("n_name").alias("dataset_id")), "file_name").select(F.col("timestamp_ms").cast("int").alias("timestamp_ms"), "cam_id", "dataset_id", "file_name")


@register("catalogue_rows", """with x as (select r_regionkey, n_nationkey, n_nationkey % 4 = 3 as bad from nation join region on n_regionkey = r_regionkey)
select cast(r_regionkey as integer) as region_id, cast(row_number() over (partition by r_regionkey order by n_nationkey) - 1 as integer) as class_id, cast(n_nationkey * 2 - 20 as double) as lon_deg, n_nationkey + 0.5e0 as lat_deg from x where not bad""")
def catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue text for each region with bad lines between; class numbers count the good ones."""
    k = F.col("n_nationkey")
    line = F.when(k % 4 == 3, "not,a,place").otherwise(F.concat((k * 2 - 20).cast("string"), F.lit(", "), (k + 0.5).cast("string"), F.lit(",1,2,3")))
    texts = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("l"))
    names = F.element_at(F.array(*map(F.lit, SF.REGIONS)), (F.col("n_regionkey") + 1).cast("int"))
    return SF.decode_catalogue(texts.select(names.alias("region"), F.concat(F.lit("lon,lat,x1,y1,x2\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value")))


@register("label_lines", """select l_orderkey as timestamp_ms, cast(l_linenumber % 4 as integer) as cam_id, cast(l_partkey as integer) as class_id, cast(floor((l_linenumber / 10.0e0 - 0.125e0) * 4608) as integer) as x, cast(floor((l_quantity / 64.0e0 - 0.03125e0) * 2592) as integer) as y, 1152 as w, 162 as h from lineitem where l_partkey % 10 <> 0""")
def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Label texts, a tenth of them cut short, as boxes in pixels."""
    suffix = F.element_at(F.array(*map(F.lit, SF.CAMERA_SUFFIXES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat_ws(" ", F.col("l_partkey").cast("string"), (F.col("l_linenumber") / 10.0).cast("string"), (F.col("l_quantity") / 64.0).cast("string"), F.when(F.col("l_partkey") % 10 != 0, "0.25"), F.when(F.col("l_partkey") % 10 != 0, "0.0625"))
    rows = read(spark, d, "lineitem").select(F.concat(F.lit("17R_"), F.col("l_orderkey").cast("string"), F.lit("_"), suffix, F.lit(".txt")).alias("name"), text.alias("value"))
    return SF.decode_labels(rows).drop("region")


@register("inertial_lines", """select vec_id as timestamp_ms, """ + ", ".join(f"cast(printf('%.6f', cast(embedding[{k}] as double)) as double) as {c}" for k, c in enumerate((*GYRO, *MAGNETIC, "temperature_c"), 1)) + " from embeddings")
def inertial_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the eight-column log, written with six decimals and parsed; a line with an error stands behind each."""
    names = (*GYRO, *MAGNETIC, "temperature_c")
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("timestamp_ms"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(names)))
    lines = format_imu(rows, names)
    bad = rows.select(F.concat(F.col("timestamp_ms").cast("string"), F.lit(" ms, ERROR 3")).alias("value"))
    return parse_imu(lines.unionByName(bad), columns=names)


@register("measurement_lines", """select vec_id as timestamp_ms, cast(printf('%.9f', cast(embedding[1] as double)) as double) as bearing_x, cast(printf('%.9f', cast(embedding[4] as double) * 7000) as double) as eci_x_km, cast(label as integer) as "group", 0.01e0 as sigma from embeddings""")
def measurement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Landmark measurements written as text and read back from the shared folder."""
    path, e = scratch(spark), lambda k: F.col("embedding")[k].cast("double")
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("timestamp_ms"), *(e(k).alias(f"bearing_{a}") for k, a in enumerate("xyz")), *((e(k + 3) * 7000).alias(f"eci_{a}_km") for k, a in enumerate("xyz")), F.col("label").alias("group"), F.lit(0.01).alias("sigma"))
    O.write_measurements(rows, path)
    return O.read_measurements(spark, path).select("timestamp_ms", "bearing_x", "eci_x_km", "group", "sigma")


@register("dataset_documents", """select 'd' || o_orderkey as folder_path, o_orderkey as capture_start_time, o_custkey / 4.0e0 as maximum_period, cast(o_custkey % 250 as integer) as target_frame_nb, 'true,false' as cameras from orders where o_orderkey % 5 <> 0""")
def dataset_documents(spark: SparkSession, d: str) -> DataFrame:
    """Dataset documents; those that lack a required field are dropped whole."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = [F.concat(F.lit("d"), k.cast("string")).alias("folder_path"), k.alias("capture_start_time"), F.when(k % 5 != 0, c / 4.0).alias("maximum_period"), (c % 250).alias("target_frame_nb"), F.lit(2).alias("dataset_capture_mode"), F.lit(0).alias("imu_collection_mode"), F.lit(1).alias("target_processing_stage"), F.array(F.lit(True), F.lit(False)).alias("active_cameras")]
    rows = SF.decode_datasets(read(spark, d, "orders").select(F.to_json(F.struct(*fields)).alias("value")))
    return rows.select("folder_path", "capture_start_time", "maximum_period", "target_frame_nb", F.array_join(F.transform("active_cameras", lambda x: x.cast("string")), ",").alias("cameras"))


@register("telemetry_logs", """select n_name as log, cast(row_number() over (partition by n_nationkey order by c_custkey) - 1 as integer) as record_id, c_custkey as "SYSTEM_TIME", cast(c_custkey % 101 as integer) as "RAM_USAGE" from customer join nation on c_nationkey = n_nationkey""")
def telemetry_logs(spark: SparkSession, d: str) -> DataFrame:
    """A compressed log for each nation, its customers as records, written to the shared folder and read back."""
    path, k = scratch(spark), F.col("c_custkey")
    rows = read(spark, d, "customer").join(read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    write_tlm(rows.select("n_name", k.alias("SYSTEM_TIME"), (k % 101).alias("RAM_USAGE")), path, "n_name")
    made = F.from_json("json", "SYSTEM_TIME long, RAM_USAGE int")
    log = F.replace(F.regexp_extract("path", r"([^/]*)\.tlm$", 1), F.lit("%20"), F.lit(" "))
    return read_tlm(spark, path).select(log.alias("log"), "record_id", made["SYSTEM_TIME"].alias("SYSTEM_TIME"), made["RAM_USAGE"].alias("RAM_USAGE"))


@register("radio_streams", """with c as (select conv_id, turn, encode(text) as b from conversations where octet_length(encode(text)) > 0), k as (select conv_id, turn, b, unnest(generate_series(0, cast(ceil(octet_length(b) / 233.0) as bigint) - 1)) as f from c)
select conv_id, 1 as page_id, cast(turn as integer) as tile_idx, cast(f as integer) as frag_idx, sha256(b[f * 233 + 1 : (f + 1) * 233]) as digest from k""")
def radio_streams(spark: SparkSession, d: str) -> DataFrame:
    """All fragments of a conversation one after the other, as a raw radio file, taken apart again."""
    made = P.tile_fragments(read(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("b")), ["conv_id", "turn"], "b")
    files = C.radio_files(made.select("conv_id", "packet", F.struct("turn", "frag_idx").alias("at")), "conv_id", "packet", "at", framed=False)
    return C.packet_stream(files, "conv_id", "content").select("conv_id", "page_id", "tile_idx", "frag_idx", F.sha2("payload", 256).alias("digest"))


@register("image_metadata", "select p_partkey, p_partkey % 65536 as page_id, p_size as tiles_x, p_size * 32 as width, 30 as quality, 15 as size from part")
def image_metadata(spark: SparkSession, d: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = read(spark, d, "part").select("p_partkey", C.encode(C.IMAGE_METADATA, {"page_id": k % 65536, "tiles_x": z, "width": z * 32, "quality": F.lit(30)}).alias("b"))
    made = C.decode(C.IMAGE_METADATA, F.col("b"))
    return rows.select("p_partkey", *(made[c].cast("long").alias(c) for c in ("page_id", "tiles_x", "width", "quality")), F.octet_length("b").alias("size"))


@register("packet_answers", """with c as (select conv_id * 100 + turn as id, octet_length(encode(text)) as n from conversations where octet_length(encode(text)) > 0), k as (select id, n, unnest(generate_series(1, cast(ceil(n / 239.0) as bigint))) as chunk_id from c)
select id, cast(chunk_id as integer) as chunk_id, case when (id + chunk_id) % 5 = 0 then 11 else 10 end as answer from k""")
def packet_answers(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of all packets is damaged in one byte: those are refused."""
    rows = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").cast("binary").alias("b"))
    sent = C.chunk_packets(rows, "id", "b", crc_udf("crc5"))
    length = F.octet_length("packet")
    # The last byte of the length field is one off, so the checksum's place moves as well.
    hurt = F.concat(F.substring("packet", 1, 1), F.unhex(F.lpad(F.hex(F.lit(255) - F.conv(F.hex(F.substring("packet", 2, 1)), 16, 10).cast("int")), 2, "0")), F.substring(F.col("packet"), F.lit(3), length))
    sent = sent.withColumn("packet", F.when((F.col("id") + F.col("chunk_id")) % 5 == 0, hurt).otherwise(F.col("packet")))
    return C.answers(C.check_packets(sent, "packet", crc_udf("crc5"))).select("id", "chunk_id", "answer")


@register("file_tallies", "select source, count(*) as files, cast(sum(coalesce(octet_length(encode(text)), 0)) as bigint) as bytes, max('/d/' || doc_id) filter (doc_id = m) as newest from (select *, max(doc_id) over (partition by source) as m from documents) group by 1")
def file_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for files, their sources for folders."""
    rows = read(spark, d, "documents").select("source", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"))
    return P.directory_summary(rows, ["source"])


@register("job_logs", """select o_orderkey, case when o_orderkey % 2 = 0 then 'ld' end as stage, case when o_orderkey % 3 = 0 then 'E' || o_custkey end as error, '/results/' || o_orderkey as results from orders""")
def job_logs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    log = F.concat(F.lit("start\n"), F.when(k % 2 == 0, "stage: ld\n").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("error=E"), F.col("o_custkey").cast("string"), F.lit("\n"))).otherwise(""), F.lit("results saved to: /results/"), k.cast("string"))
    return read(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in T.log_result(log).items()))


@register("keyed_numbers", "select o_orderkey, o_orderkey as ram, o_custkey as power, cast(null as bigint) as missing from orders")
def keyed_numbers(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("RAM "), F.col("o_orderkey").cast("string"), F.lit("/7620MB VDD_IN "), F.col("o_custkey").cast("string"), F.lit("mW/9mW SWAP none"))
    return read(spark, d, "orders").select("o_orderkey", T.keyed_number(line, "RAM").alias("ram"), T.keyed_power(line, "VDD_IN").alias("power"), T.keyed_power(line, "RAM").alias("missing"))


@register("memory_lines", """select o_orderkey as host, cast(floor((7000 - o_custkey % 7000) * 100 / 7000.0) as integer) as ram_pct, case when o_orderkey % 3 = 0 then 0 else cast(floor((500 - o_custkey % 500) * 100 / 500.0) as integer) end as swap_pct, cast(o_orderkey as bigint) as uptime from orders""")
def memory_lines(spark: SparkSession, d: str) -> DataFrame:
    """Memory tables and uptime lines of as many hosts as there are orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    table = F.concat_ws("\n", F.lit("MemTotal:   7000 kB"), F.concat(F.lit("MemAvailable: "), (c % 7000).cast("string"), F.lit(" kB")), F.when(k % 3 == 0, "SwapTotal: 0 kB").otherwise("SwapTotal: 500 kB"), F.concat(F.lit("SwapFree: "), (c % 500).cast("string"), F.lit(" kB")))
    hosts = read(spark, d, "orders").select(k.alias("host"), F.explode(F.split(table, "\n")).alias("value"))
    times = read(spark, d, "orders").select(k.alias("host"), uptime(F.concat(k.cast("string"), F.lit(".75 99.5"))).alias("uptime"))
    return memory_used(hosts, "host").join(times, "host")


_V = "v as (select vec_id, " + ", ".join(f"cast(embedding[{k}] as double) as v{k}" for k in range(1, 9)) + " from embeddings)"


@register("quaternion_matrices", f"""with {_V} select vec_id, round(v1 * v5 - v2 * v6 - v3 * v7 - v4 * v8, 9) as w, round(v1 * v6 + v2 * v5 + v3 * v8 - v4 * v7, 9) as x, round(v1 * v7 - v2 * v8 + v3 * v5 + v4 * v6, 9) as y, round(v1 * v8 + v2 * v7 - v3 * v6 + v4 * v5, 9) as z,
true as same, round(v2 * v7 - v3 * v6, 9) as cross_z, true as tangent from v""")
def quaternion_matrices(spark: SparkSession, d: str) -> DataFrame:
    """A product by the left factor's matrix, by the right one's and by itself; a cross product by a matrix; tangent vectors at right angles."""
    v = [F.col("embedding")[k].cast("double") for k in range(8)]
    a, b = tuple(v[:4]), tuple(v[4:])
    times = lambda m, x: [sum((r[k] * x[k] for k in range(1, len(x))), r[0] * x[0]) for r in m]
    left, right = times(Q.left_matrix_wxyz(a), b), times(Q.right_matrix_wxyz(b), a)
    near = lambda x, y: F.abs(x - y) < 1e-12
    basis = Q.tangent_basis_xyzw(a)
    dots = [sum((p[k] * q[k] for k in range(1, 4)), p[0] * q[0]) for i, p in enumerate((a, *basis)) for q in (a, *basis)[i + 1 :]]
    small = near(dots[0], F.lit(0.0))
    for x in dots[1:]:
        small = small & near(x, F.lit(0.0))
    same = near(left[0], right[0]) & near(left[1], right[1]) & near(left[2], right[2]) & near(left[3], right[3])
    return read(spark, d, "embeddings").select("vec_id", *(F.round(c, 9).alias(n) for c, n in zip(left, "wxyz", strict=True)), same.alias("same"), F.round(times(Q.skew(tuple(v[1:4])), tuple(v[5:8]))[2], 9).alias("cross_z"), small.alias("tangent"))


@register("channels_first", """with p as (select vec_id, [cast(floor(abs(x) * 200) as integer) for x in embedding] as a from embeddings), q as (select vec_id, a || a || a as a from p)
select vec_id, cast(len(a) as integer) as n, round((a[1] / 255.0e0 - 0.485e0) / 0.229e0, 9) as first, round((a[2] / 255.0e0 - 0.456e0) / 0.224e0, 9) as green, round((a[192] / 255.0e0 - 0.406e0) / 0.225e0, 9) as last, round(a[192] / 255.0e0, 9) as plain from q""")
def channels_first(spark: SparkSession, d: str) -> DataFrame:
    """64 pixels of three channels for each vector."""
    a = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 200).cast("int"))
    rows = read(spark, d, "embeddings").select("vec_id", F.concat(a, a, a).alias("a")).select("vec_id", I.channels_first(F.col("a")).alias("c"), I.channels_first(F.col("a"), (0.0,) * 3, (1.0,) * 3).alias("l"))
    return rows.select("vec_id", F.size("c").alias("n"), *(F.round(F.col("c")[k], 9).alias(n) for k, n in ((0, "first"), (64, "green"), (191, "last"))), F.round(F.col("l")[191], 9).alias("plain"))


_PIXELS = "select conv_id * 100 + turn as id, encode(text) as b, octet_length(encode(text)) as n from conversations where octet_length(encode(text)) > 0"


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Texts as gray images 50 pixels wide; the last line is filled up with black."""
    b = F.col("text").cast("binary")
    height = F.ceil(F.octet_length(b) / 50).cast("int")
    rows = read(spark, d, "conversations").where(F.octet_length(b) > 0).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit(50).alias("width"), height.alias("height"), F.substring(F.concat(b, F.lit(bytes(50))), F.lit(1), height * 50).alias("pixels"))
    return rows


@register("tiled_images", f"with c as ({_PIXELS}) select id, cast(ceil(n / 50.0) as integer) as height, cast(ceil(50 / 64.0) * ceil(ceil(n / 50.0) / 32.0) as integer) as tiles, true as same from c")
def tiled_images(spark: SparkSession, d: str) -> DataFrame:
    """Images cut into 64 x 32 tiles and put together again."""
    images = _images(spark, d)
    tiles = I.image_tiles(images, "id", "width", "height", "pixels")
    back = I.paste_tiles(tiles.join(images.select("id", "width", "height"), "id"), "id", "width", "height").withColumnRenamed("pixels", "again")
    counted = tiles.groupBy("id").agg(F.count("*").cast("int").alias("tiles"))
    return images.join(counted, "id").join(back, "id").select("id", "height", "tiles", (F.col("pixels") == F.col("again")).alias("same"))


@register("blurred_images", """with g as (select p_partkey % 7 as frame, (p_partkey // 7) % 12 as x, p_partkey // 84 as y, p_size * 5 as v from part), s as (select frame, max(x) as w, max(y) as h from g group by 1),
k as (select unnest([-4, 1, 1, 1, 1]) as k, unnest([0, 1, -1, 0, 0]) as dx, unnest([0, 0, 0, 1, -1]) as dy),
a as (select frame, x, y, k, case when x + dx < 0 then -(x + dx) when x + dx > w then 2 * w - (x + dx) else x + dx end as u, case when y + dy < 0 then -(y + dy) when y + dy > h then 2 * h - (y + dy) else y + dy end as t from g join s using (frame) cross join k),
l as (select a.frame, a.x, a.y, cast(sum(a.k * g.v) as bigint) as l from a join g on g.frame = a.frame and g.x = a.u and g.y = a.t group by all) select frame, round(var_pop(l), 6) as variance, var_pop(l) < 50.0 as blurred from l group by 1""")
def blurred_images(spark: SparkSession, d: str) -> DataFrame:
    """Seven images, all parts their pixels."""
    k = F.col("p_partkey")
    pixels = read(spark, d, "part").select((k % 7).alias("frame"), (F.floor(k / 7) % 12).alias("x"), F.floor(k / 84).alias("y"), (F.col("p_size") * 5).alias("gray"))
    return K.blurred(pixels, "frame").select("frame", F.round("variance", 6).alias("variance"), "blurred")


@register("chronological_names", "select 'frame_' || o_orderkey || '.json' as file_name from orders order by 1")
def chronological_names(spark: SparkSession, d: str) -> DataFrame:
    return R.chronological(read(spark, d, "orders").select(F.concat(F.lit("frame_"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file_name")))


@register("dataset_listing", "select distinct o_custkey as dataset from orders order by 1")
def dataset_listing(spark: SparkSession, d: str) -> DataFrame:
    return R.listing(read(spark, d, "orders").select(F.col("o_custkey").alias("dataset")), "dataset")


@register("strongest_boxes", """with r as (select l_suppkey, l_orderkey * 10 + l_linenumber as box_id, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey * 10 + l_linenumber) as n from lineitem) select l_suppkey, box_id from r where n <= 300""")
def strongest_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The 300 boxes of each supplier with the highest scores: the limit is the operator's."""
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), F.col("l_quantity").alias("score"))
    return D.strongest(rows, "l_suppkey").select("l_suppkey", "box_id")


@register("downlink_files", """with m as (select o_custkey, o_orderkey as file, case o_orderstatus when 'F' then 'downscaled' when 'P' then 'results' else 'raw' end as kind from orders)
select o_custkey, file, kind from m where kind <> 'raw' union all select o_custkey, file, kind from m where kind = 'raw' and o_custkey not in (select o_custkey from m where kind <> 'raw')""")
def downlink_files(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return R.files_for_downlink(read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("file"), F.when(s == "F", "downscaled").when(s == "P", "results").otherwise("raw").alias("kind")), "o_custkey")


@register("labelled_frames", """with t as (select l_orderkey, count(*) as n, sum(l_partkey) as s from lineitem where l_returnflag = 'R' group by 1) select o_orderkey as timestamp_ms, cast(coalesce(n, 0) as integer) as boxes, cast(coalesce(s, 0) as bigint) as classes from orders left join t on l_orderkey = o_orderkey""")
def labelled_frames(spark: SparkSession, d: str) -> DataFrame:
    """Lines that came back stand for true boxes."""
    labels = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("timestamp_ms"), F.lit(0).alias("cam_id"), F.col("l_partkey").alias("class_id"), F.col("l_linenumber").alias("x"))
    rows = R.label_frames(read(spark, d, "orders").select(F.col("o_orderkey").alias("timestamp_ms"), F.lit(0).alias("cam_id")), labels)
    return rows.select("timestamp_ms", F.size("truth").alias("boxes"), F.aggregate("truth", F.lit(0).cast("long"), lambda a, x: a + x["class_id"]).alias("classes"))


@register("stored_frames", """select l_orderkey as timestamp_ms, l_linenumber as place, o_custkey as stored, o_custkey is null as missing from lineitem left join (select * from orders where o_orderstatus <> 'F') on o_orderkey = l_orderkey""")
def stored_frames(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for ids that a dataset names, orders that aren't closed for stored frames."""
    ids = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("timestamp_ms"), F.col("l_linenumber").alias("place"))
    frames = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("timestamp_ms"), F.col("o_custkey").alias("stored"))
    return R.stored_metadata(ids, frames, ("timestamp_ms",)).select("timestamp_ms", "place", "stored", "missing")


@register("summary_documents", """select 'c' || o_custkey as folder_path, count(*) as frames, cast(min(o_orderkey) as bigint) as first, cast(max(o_orderkey) as bigint) as last, 7 as lines from orders group by o_custkey""")
def summary_documents(spark: SparkSession, d: str) -> DataFrame:
    """A summary document for each customer's dataset, read as JSON."""
    path = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("folder_path")
    frames = read(spark, d, "orders").select(path, (F.col("o_orderkey") * 0).cast("int").alias("cam_id"), F.col("o_orderkey").alias("timestamp"))
    datasets, counters = frames.select("folder_path").distinct(), frames.groupBy("folder_path").agg(F.count("*").alias("num_frames"))
    made = O.dataset_summaries(datasets, counters, frames, datasets.withColumn("lines", F.lit(7)))
    x = F.from_json("value", "num_frames long, imu_timestamps_collected int, frame_id_list array<struct<cam_id:int,timestamp:long>>")
    return made.select("folder_path", x.alias("x")).select("folder_path", F.col("x.num_frames").alias("frames"), F.col("x.frame_id_list")[0]["timestamp"].alias("first"), F.element_at("x.frame_id_list", -1)["timestamp"].alias("last"), F.col("x.imu_timestamps_collected").alias("lines"))


@register("allan_all_factors", f"""with {_EV}, p as (select user_id, v, row_number() over (partition by user_id order by us, event_id) as i, count(*) over (partition by user_id) as n from ev),
m as (select user_id, unnest(generate_series(1, (max(n) - 1) // 2)) as m from p group by 1),
t as (select a.user_id, m.m, c.v - 2 * b.v + a.v as d from p a join m using (user_id) join p b on b.user_id = a.user_id and b.i = a.i + m.m join p c on c.user_id = a.user_id and c.i = a.i + 2 * m.m)
select user_id, cast(m as integer) as m, count(*) as terms, cast(sum(d * d) as double) as squares, cast(floor(sqrt(cast(sum(d * d) as double) / (2.0 * m * m * count(*)))) as bigint) as deviation from t group by user_id, m""")
def allan_all_factors(spark: SparkSession, d: str) -> DataFrame:
    """Every averaging factor of each user's series."""
    return S.allan_all(events(spark, d), "user_id", ["us", "event_id"], "v").withColumn("deviation", F.floor("deviation").cast("long"))


@register("active_duplicates", f"""with recursive {_EV}, c as (select event_id, user_id, event_type, us / 1000000.0e0 as s, case when event_type <> 'error' then us / 1000000.0e0 + abs(v) * 0.6e0 end as e from ev),
n as (select *, row_number() over (partition by user_id, event_type order by s, e nulls last, event_id) as n from c),
r as (select event_id, user_id, event_type, n, false as duplicate, coalesce(e + 60, 'infinity'::double) as until from n where n = 1
  union all select n.event_id, n.user_id, n.event_type, n.n, n.s < r.until, case when n.s >= r.until then coalesce(n.e + 60, 'infinity'::double) else r.until end from r join n on n.user_id = r.user_id and n.event_type = r.event_type and n.n = r.n + 1)
select event_id, duplicate from r""")
def active_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for commands that run for their value in minutes; an error never ends. Equal commands are those of one user and type, within 60 s of an end."""
    rows = events(spark, d).select("event_id", "user_id", "event_type", (F.col("us") / 1_000_000).alias("start"), F.when(F.col("event_type") != "error", F.col("us") / 1_000_000 + F.abs("v") * 0.6).alias("end"))
    return S.duplicate_commands(rows, ["user_id", "event_type"], "start", "end", 60, "event_id").select("event_id", "duplicate")


_CHAIN = """with m as (select l_orderkey, count(*) filter (l_discount > 0.05) as lm, count(distinct l_linenumber) filter (l_tax > 0.04) as rg, max(l_quantity) as q from lineitem group by 1),
s as (select *, q > 30 as passed from m)
select l_orderkey as frame, passed, cast(case when passed then rg else 0 end as integer) as regions, cast(case when passed and rg > 0 then lm else 0 end as integer) as landmarks,
  case when not passed then 1 when rg = 0 then 2 else 3 end as stage, case when not passed then 0 when rg = 0 then 1 when lm = 0 then 2 else 3 end as state from s"""


@register("processed_frames", _CHAIN)
def stages_of_frames(spark: SparkSession, d: str) -> DataFrame:
    """Prefilter, then regions, then landmarks of those that pass: orders are frames, discounts and taxes scores."""
    lines = read(spark, d, "lineitem")
    frames = lines.groupBy(F.col("l_orderkey").alias("frame")).agg((F.max("l_quantity") > 30).alias("passed"))
    regions = lines.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region_id"), F.col("l_tax").alias("score"))
    boxes = lines.select(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") + 100 * F.row_number().over(_by("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).cast("long").alias("box_id"), (F.row_number().over(_by("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) * 10.0).alias("x"), F.lit(5.0).alias("y"), F.lit(4.0).alias("w"), F.lit(4.0).alias("h"), F.col("l_linenumber").alias("class_id"), F.col("l_discount").alias("score"))
    return processed_frames(frames, regions, boxes, "frame", region_threshold=0.04, box_threshold=0.05).select("frame", "passed", "regions", "landmarks", "stage", "state")


def _by(key: str, *order: str | Column):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)
