"""Queries on frames and detections: orders stand for frames, their lines for landmarks, nations for datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions import codes, units
from perilune.operators import detection as D
from perilune.operators import frames as R
from perilune.operators import measure as M
from perilune.operators.crowded import suppress_crowded
from perilune.plans.registry import read, register

_STAGE = "case o_orderstatus when 'O' then 1 when 'P' then 2 when 'F' then 3 else 0 end"


def _stage():
    s = F.col("o_orderstatus")
    return F.when(s == "O", 1).when(s == "P", 2).when(s == "F", 3).otherwise(0)


@register("dataset_summary_counts", f"""with lm as (select l_orderkey, count(*) n_lm from lineitem group by 1),
f as (select n_name, o_orderkey, o_totalprice, o_orderdate, coalesce(n_lm, 0) n_lm, {_STAGE} stage
  from orders left join lm on o_orderkey = l_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
r as (select *, row_number() over (partition by n_name order by stage desc, o_totalprice desc, o_orderdate desc, o_orderkey) rn from f)
select n_name, count(*) frames, count(*) filter (stage >= 2) rcneted, count(*) filter (stage >= 3) ldneted, count(*) filter (n_lm >= 4) with_landmarks, max(o_orderkey) filter (rn = 1) best_frame from r group by 1""")
def dataset_summary_counts(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: counts and the best frame of each dataset in one aggregate behind one shuffle of lines and one of frames."""
    landmarks = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lm"))
    frames = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", _stage().alias("stage")).join(landmarks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    frames = frames.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return frames.groupBy("n_name").agg(
        F.count("*").alias("frames"), F.count_if(F.col("stage") >= 2).alias("rcneted"), F.count_if(F.col("stage") >= 3).alias("ldneted"), F.count_if(F.coalesce("n_lm", F.lit(0)) >= 4).alias("with_landmarks"),
        F.max_by("o_orderkey", F.struct("stage", "o_totalprice", "o_orderdate", (-F.col("o_orderkey")).alias("_f"))).alias("best_frame"),
    )


@register("dataset_stage_counters", f"""with f as (select o_custkey, {_STAGE} s, o_shippriority_like from (select *, o_orderkey % 4 as o_shippriority_like from orders))
select o_custkey, count(*) num_frames, count(*) filter (s >= 1) num_prefiltered, count(*) filter (s >= 2) num_rcneted, count(*) filter (s >= 3) num_ldneted,
  count(*) filter (o_shippriority_like >= 1) num_earth, count(*) filter (o_shippriority_like >= 2) num_roi, count(*) filter (o_shippriority_like >= 3) num_landmarks from f group by 1""")
def dataset_stage_counters(spark: SparkSession, d: str) -> DataFrame:
    return R.dataset_counters(read(spark, d, "orders").select("o_custkey", _stage().alias("stage"), (F.col("o_orderkey") % 4).alias("state")), "o_custkey", "stage", "state")


@register("best_frame_argmax", f"""with r as (select *, row_number() over (partition by o_custkey order by {_STAGE} desc, o_totalprice desc, o_orderdate desc, o_orderkey) n from orders) select o_custkey, o_orderkey best_frame from r where n = 1""")
def best_frame_argmax(spark: SparkSession, d: str) -> DataFrame:
    return R.best_frame(read(spark, d, "orders").withColumn("stage", _stage()), "o_custkey", ["stage", "o_totalprice", "o_orderdate"], "o_orderkey")


@register("topn_unsent", f"""select o_orderkey, {_STAGE} stage, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by stage desc, o_totalprice desc, o_orderdate desc, o_orderkey limit 50""")
def topn_unsent(spark: SparkSession, d: str) -> DataFrame:
    sent = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    frames = read(spark, d, "orders").select("o_orderkey", _stage().alias("stage"), "o_totalprice", "o_orderdate")
    return R.select_unsent(frames, sent, "o_orderkey", ["stage", "o_totalprice", "o_orderdate"], 50).select("o_orderkey", "stage", "o_totalprice")


@register("skip_processed", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')")
def skip_processed(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.unprocessed(read(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@register("metadata_with_image", "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def metadata_with_image(spark: SparkSession, d: str) -> DataFrame:
    images = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.with_image(read(spark, d, "orders").select("o_orderkey", "o_custkey"), images, "o_orderkey")


@register("dim_broadcast_lookup", """select l_orderkey, l_linenumber, l_partkey, p_brand, s_name from lineitem join part on p_partkey = l_partkey and p_size <= 25 join supplier on s_suppkey = l_suppkey""")
def dim_broadcast_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions are broadcast if Spark's statistics prove them small enough, else shuffled."""
    part, supplier = read(spark, d, "part").where("p_size <= 25").select("p_partkey", "p_brand"), read(spark, d, "supplier").select("s_suppkey", "s_name")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return M.looked_up(lines, (part, "l_partkey", "p_partkey"), (supplier, "l_suppkey", "s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_name")


@register("nested_explode_roundtrip", """select l_orderkey, l_linenumber, l_partkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as integer) as place from lineitem""")
def nested_explode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    nested = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("landmarks"))
    return nested.select("l_orderkey", F.posexplode("landmarks").alias("place", "l")).select("l_orderkey", "l.l_linenumber", "l.l_partkey", "place")


@register("classify_cascade", """with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax * 1000 as color, l_discount * 400 as contrast, l_quantity * 3.6 as hue, l_partkey % 256 as sat, l_suppkey * 2.5 as val, cast(l_quantity * 2 as integer) as cloud from lineitem),
k as (select *, case when color > 30 and contrast > 20 then '' when cloud > 50 then 'cloudy' when val < 50 then 'black' when val > 200 and sat < 30 then 'white' when hue > 34 and hue < 85 and sat > 50 then 'green' else 'single_color' end as t from x)
select l_orderkey, l_linenumber, l_partkey, t as dominant_type, t not in ('cloudy', 'black', 'white') as passed, t = 'green' as is_significant from k""")
def classify_cascade(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    made = R.dominant_type(F.col("l_tax") * 1000, F.col("l_discount") * 400, q * 3.6, F.col("l_partkey") % 256, F.col("l_suppkey") * 2.5, (q * 2).cast("int"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(c.alias(k) for k, c in made.items()))


@register("rank_from_children", """with c as (select l_orderkey, count(*) filter (l_linestatus = 'F') lm, count(*) filter (l_linestatus = 'O') rg, sum(cast(l_quantity as bigint)) filter (l_linestatus = 'F') s, sum(cast(l_quantity as bigint)) filter (l_linestatus = 'O') t, max(l_linenumber) * 10 cl from lineitem group by 1),
a as (select *, case when lm > 2 then 3 when rg > 1 then 2 when cl < 60 then 1 else 0 end as state from c)
select l_orderkey, state, case state when 3 then s / 100.0 when 2 then t / cast(rg as double) when 1 then 1 - cl / 100.0 else 0.0 end as rank from a""")
def rank_from_children(spark: SparkSession, d: str) -> DataFrame:
    kind, q = F.col("l_linestatus"), F.col("l_quantity").cast("long")
    c = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(kind == "F").alias("lm"), F.count_if(kind == "O").alias("rg"), F.sum(F.when(kind == "F", q)).alias("s"), F.sum(F.when(kind == "O", q)).alias("t"), (F.max("l_linenumber") * 10).alias("cl")
    )
    c = c.withColumn("state", R.annotation_state(F.greatest(F.col("lm") - 2, F.lit(0)), F.greatest(F.col("rg") - 1, F.lit(0)), F.col("cl") < 60))
    return c.select("l_orderkey", "state", R.rank(F.col("state"), F.col("cl"), F.col("t") / F.when(F.col("rg") > 0, F.col("rg")), F.col("s")).alias("rank"))


@register("reprocess_decision", f"""with f as (select o_orderkey, {_STAGE} stage, o_orderkey % 3 + 1 target, o_orderkey % 5 <> 0 has, o_orderkey % 7 = 0 rc, o_orderkey % 2 = 0 ld, o_orderkey % 11 < 5 ow from orders)
select o_orderkey, case when stage < target then true when target = 1 then false when not has then true when (target < 2 or rc) and (target < 3 or ld) then false else ow end as again from f""")
def reprocess_decision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", R.should_reprocess(_stage(), k % 3 + 1, k % 5 != 0, k % 7 == 0, k % 2 == 0, k % 11 < 5).alias("again"))


@register("capture_gate", """select o_orderkey, case o_orderkey % 6 when 3 then o_orderkey % 4 >= 1 when 4 then o_orderkey % 3 > 0 when 5 then o_orderkey % 5 > 2 else o_orderkey % 6 in (1, 2) end as stored, cast(case when o_orderkey % 6 >= 3 then o_orderkey % 6 - 2 else 0 end as integer) as stage from orders""")
def capture_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", R.captured(k % 6, k % 4, k % 3, F.when(k % 5 > 2, 1).otherwise(0)).alias("stored"), codes.mode_stage(k % 6).cast("int").alias("stage"))


@register("param_validation_errors", """with x as (select p_partkey, p_retailprice * 7 per, p_size * 6 fr, p_partkey % 8 md, p_partkey % 5 im, p_size % 60 * 5 ir, p_size - 20 hz, p_partkey % 6 st from part)
select p_partkey, concat_ws(',', case when not per between 0.1 and 10800 then 'period' end, case when not fr between 1 and 255 then 'frames' end, case when not md between 2 and 5 then 'mode' end, case when not im between 0 and 3 then 'imu_mode' end,
  case when not ir between 1 and 254 then 'image_rate' end, case when hz <= 0 or hz > 25 then 'imu_rate' end, case when not st between 0 and 3 then 'stage' end, case when st < (case when md in (3, 4, 5) then md - 2 else 0 end) then 'stage_below_mode' end) as problems from x""")
def param_validation_errors(spark: SparkSession, d: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    checks = R.dataset_checks(F.col("p_retailprice") * 7, z * 6, k % 8, k % 5, z % 60 * 5, z - 20, k % 6)
    return read(spark, d, "part").select("p_partkey", F.array_join(R.check_list(checks), ",").alias("problems"))


_GATE = """with l as (select user_id, count(*) n, count(distinct epoch_us(ts) // 3600000000) f, min(ts) a, max(ts) b from events where event_type = 'purchase' group by 1),
g as (select user_id, count(*) m, min(ts) c, max(ts) d from events where event_type = 'view' group by 1)"""


@register("usability_gate", _GATE + """ select user_id, case when coalesce(f, 0) < 12 then 'too_few_frames' when coalesce(n, 0) < 13 then 'too_few_landmarks' when coalesce(m, 0) = 0 then 'no_imu' when c > a or d < b then 'imu_does_not_cover' else 'ok' end as verdict from l full join g using (user_id)""")
def usability_gate(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    marks = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(hour).alias("f"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    imu = ev.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("m"), F.min("ts").alias("c"), F.max("ts").alias("d"))
    c = F.col
    return marks.join(imu, "user_id", "full").select("user_id", R.usability(c("f"), c("n"), c("a"), c("b"), c("m"), c("c"), c("d"), 12, 13).alias("verdict"))


@register("single_version_check", """select l_orderkey, min(l_suppkey % 3) = max(l_suppkey % 3) and min(l_suppkey % 3) > 0 as consistent, max(l_suppkey % 3) as version from lineitem group by 1""")
def single_version_check(spark: SparkSession, d: str) -> DataFrame:
    return R.single_version(read(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("v")), "l_orderkey", "v")


@register("processing_tallies", "select case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'skipped' else 'processed' end as outcome, count(*) as n from lineitem group by 1")
def processing_tallies(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return R.tallies(read(spark, d, "lineitem").select(F.when(flag == "R", "failed").when(flag == "A", "skipped").otherwise("processed").alias("outcome")), "outcome")


@register("saturating_counter", "with c as (select o_custkey, count(*) n from orders group by 1) select o_custkey, least(n, 8) as counted, least(n, 8) / 8.0 as completion from c")
def saturating_counter(spark: SparkSession, d: str) -> DataFrame:
    made = R.saturated(F.col("n"), F.lit(8).cast("long"))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", *(c.alias(k) for k, c in made.items()))


@register("thumbnail_quality_ladder", "with c as (select p_partkey, p_retailprice, q from part, (values (100), (95), (85), (60)) t(q)) select p_partkey, max(q) filter (p_retailprice * q <= 90000) as quality from c group by 1")
def thumbnail_quality_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_retailprice", F.explode(F.array(*map(F.lit, (100, 95, 85, 60)))).alias("quality"))
    return R.first_fitting(rows.withColumn("size", F.col("p_retailprice") * F.col("quality")), "p_partkey", "quality", "size", 90000)


@register("sweep_argmin_score", """with s as (select p_brand, p_partkey, abs(p_retailprice - 1200.0) + 50 * greatest(0.0, p_size / 10.0 - 0.2) + 5 * greatest(0.0, p_size / 5.0 - 2) as score from part),
r as (select *, row_number() over (partition by p_brand order by score, p_partkey) n from s) select p_brand, p_partkey, score from r where n = 1""")
def sweep_argmin_score(spark: SparkSession, d: str) -> DataFrame:
    return R.sweep_best(read(spark, d, "part"), "p_brand", "p_partkey", F.col("p_retailprice"), 1200.0, F.col("p_size") / 10.0, F.col("p_size") / 5.0)


@register("union_of_ids", "select o_custkey as id from orders union select c_custkey from customer where c_acctbal > 5000")
def union_of_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.all_ids(read(spark, d, "orders").select(F.col("o_custkey").alias("id")), read(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey"))


@register("kept_and_dropped", "select case when l_discount > 0.05 then 'dropped' else 'kept' end as side, count(*) n, cast(sum(cast(l_quantity as bigint)) as bigint) q from lineitem group by 1")
def kept_and_dropped(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_discount", F.col("l_quantity").cast("long").alias("q"))
    part = lambda cond, name: lines.where(cond).select(F.lit(name).alias("side"), "q")
    return part("l_discount > 0.05", "dropped").unionByName(part("not l_discount > 0.05", "kept")).groupBy("side").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@register("detection_precision_recall", """with p as (select d.lang as region, d.doc_id, l.quality from documents d join labels l using (doc_id) where d.n_chars > 900)
, t as (select d.lang as region, count(*) n from documents d join labels l using (doc_id) where l.quality = 1 group by 1),
a as (select region, count(*) predicted, count(*) filter (quality = 1) true_positives from p group by 1)
select coalesce(a.region, t.region) as region, coalesce(predicted, 0) as predicted, coalesce(true_positives, 0) as true_positives, coalesce(n, 0) as truth,
  case when predicted > 0 then cast(true_positives * 1000 // predicted as bigint) end as precision_permille, case when n > 0 then cast(coalesce(true_positives, 0) * 1000 // n as bigint) end as recall_permille from a full join t on a.region = t.region""")
def detection_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.col("lang").alias("region"), "n_chars").join(read(spark, d, "labels"), "doc_id")
    matched = rows.where("n_chars > 900").select("region", (F.col("quality") == 1).alias("hit"))
    return D.detection_report(matched, rows.where("quality = 1"), "region", "hit")


_BOX = "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as k, l_partkey % 40 as x, l_suppkey % 30 as y, cast(l_quantity as bigint) + 5 as w, l_linenumber * 6 as h, l_partkey % 2 as c, l_linestatus from lineitem"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, d, "lineitem").select(
        "l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("k"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 30).alias("y"), (F.col("l_quantity").cast("long") + 5).alias("w"),
        (F.col("l_linenumber") * 6).cast("long").alias("h"), (F.col("l_partkey") % 2).alias("c"), "l_linestatus",
    )


@register("best_box_overlap", f"""with b as ({_BOX}), p as (select *, l_orderkey * 100 + k as pid from b where l_linestatus = 'F'), t as (select * from b where l_linestatus = 'O'),
j as (select p.pid, greatest(0, least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x)) * greatest(0, least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y)) as i,
  (greatest(p.x + p.w, t.x + t.w) - least(p.x, t.x)) * (greatest(p.y + p.h, t.y + t.h) - least(p.y, t.y)) as u from p left join t on p.l_orderkey = t.l_orderkey and p.c = t.c)
select pid, coalesce(max(cast(i as double) / u), 0.0) as best_iou from j group by 1""")
def best_box_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    p = b.where("l_linestatus = 'F'").withColumn("pid", F.col("l_orderkey") * 100 + F.col("k"))
    return D.best_match(p, b.where("l_linestatus = 'O'").select("l_orderkey", "c", "x", "y", "w", "h"), ["l_orderkey", "c"], ["x", "y", "w", "h"], "pid")


@register("nms_greedy")
def nms_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(spark, d).select("l_orderkey", F.col("k").alias("box_id"), *(F.col(c).cast("double").alias(c) for c in "xywh"), F.col("c").alias("class_id"), ((F.col("x") + F.col("y")) / 70.0 + 0.3).alias("score"))
    return D.non_maximum_suppression(rows, "l_orderkey")


@register("nms_crowded")
def nms_crowded(spark: SparkSession, d: str) -> DataFrame:
    """All boxes on the frames of a few cameras, so that frames grow with the table: boxes lie where their orders put them."""
    key = F.col("l_orderkey")
    at = {"x": F.col("x") + F.pmod(F.xxhash64("l_orderkey"), F.lit(4000)), "y": F.col("y") + F.pmod(F.xxhash64(key + 1), F.lit(4000))}
    score = 0.5 + F.pmod(F.xxhash64("l_orderkey", "k"), F.lit(1000)) / 2000.0
    made = _boxes(spark, d).select(F.pmod(key, F.lit(3)).alias("camera"), (key * 8 + F.col("k")).alias("box_id"), score.alias("score"), *(at.get(c, F.col(c)).cast("double").alias(c) for c in "xywh"), F.col("c").alias("class_id"))
    return suppress_crowded(made, "camera")


@register("score_threshold", """with e as (select vec_id, unnest(embedding) as score, generate_subscripts(embedding, 1) - 1 as class_id from embeddings) select vec_id, cast(class_id as integer) as class_id, score from e where score > 0.15""")
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    return D.above(read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("s")), ["vec_id"], "s", 0.15)


@register("detector_best_class", """select vec_id, list_max(embedding[5:]) as score, cast(list_position(embedding[5:], list_max(embedding[5:])) - 1 as integer) as class_id from embeddings where list_max(embedding[5:]) > 0.2""")
def detector_best_class(spark: SparkSession, d: str) -> DataFrame:
    made = D.best_class(F.slice("embedding", 5, F.size("embedding")))
    return read(spark, d, "embeddings").select("vec_id", *(c.alias(k) for k, c in made.items())).where("score > float(0.2)")


@register("letterbox_inverse", f"""with b as ({_BOX}), g as (select l_orderkey, k, least(416 / 640.0, 416 / 480.0) as gain, x, y, w, h from b), q as (select *, round((416 - 640 * gain) / 2 - 0.1) as px, round((416 - 480 * gain) / 2 - 0.1) as py from g),
z as (select l_orderkey, k, gain, w, h, greatest(0, least(639, round((x * 5 - px) / gain))) as bx, greatest(0, least(479, round((y * 9 - py) / gain))) as by_ from q)
select l_orderkey, k, cast(bx as integer) as bx, cast(by_ as integer) as by, cast(greatest(0, least(640 - bx, round(w / gain))) as integer) as bw, cast(greatest(0, least(480 - by_, round(h / gain))) as integer) as bh from z""")
def letterbox_inverse(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    made = D.letterbox_inverse((F.col("x") * 5, F.col("y") * 9, F.col("w"), F.col("h")), (F.lit(640.0), F.lit(480.0)), (F.lit(416.0), F.lit(416.0)))
    return b.select("l_orderkey", "k", *(c.alias(n) for n, c in zip(("bx", "by", "bw", "bh"), made, strict=True)))


@register("candidate_boxes", "select p_partkey, cast(floor(p_size * 32 / 8) * floor(p_size * 16 / 8) + floor(p_size * 32 / 16) * floor(p_size * 16 / 16) + floor(p_size * 32 / 32) * floor(p_size * 16 / 32) as bigint) as boxes from part")
def candidate_boxes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", D.candidate_boxes(F.col("p_size") * 32, F.col("p_size") * 16).cast("long").alias("boxes"))


@register("camera_mask", "select o_orderkey, array_to_string([i for i in [0, 1, 2, 3] if (o_orderkey >> i) & 1 = 1], ',') as cameras, o_orderkey & 1 = 1 as downscale, o_orderkey & 6 = 2 as prefilter_only from orders")
def camera_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = units.processing_flags(k)
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(units.set_bits(k, 4), lambda x: x.cast("string")), ",").alias("cameras"), flags["downscale"].alias("downscale"), flags["prefilter_only"].alias("prefilter_only"))


@register("downscaled_size", "select p_partkey, cast(greatest(1, round_even(p_size / cast(case when p_partkey % 4 > 0 then p_partkey % 4 else 10 end as double), 0)) as integer) as size from part")
def downscaled_size(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", units.downscaled(F.col("p_size").cast("double"), F.col("p_partkey") % 4).alias("size"))


@register("percent_used", "select l_orderkey, l_linenumber, l_partkey, case when cast(l_quantity as bigint) > 10 then cast(greatest(0, least(100, floor(l_linenumber * 800 / (cast(l_quantity as bigint) - 10)))) as integer) end as pct from lineitem")
def percent_used(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", units.percent(F.col("l_linenumber") * 8, F.col("l_quantity").cast("long") - 10).alias("pct"))


@register("register_bits", "select o_orderkey, cast((o_orderkey >> 6) & 1 as integer) as fatal, cast((o_orderkey >> 1) & 15 as integer) as code, cast((o_orderkey >> 4) & 3 as integer) as power from orders")
def register_bits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", units.register_bits(k, 6, 1).alias("fatal"), units.register_bits(k, 1, 4).alias("code"), units.register_bits(k, 4, 2).alias("power"))


@register("region_codes", "select p_partkey, case p_partkey % 18 when 0 then '10S' when 1 then '10T' when 2 then '11R' when 3 then '12R' when 4 then '16T' when 5 then '17R' when 6 then '17T' when 7 then '18S' when 8 then '32S' when 9 then '32T' when 10 then '33S' when 11 then '33T' when 12 then '52S' when 13 then '53S' when 14 then '54S' when 15 then '54T' else 'UNKNOWN' end as code from part")
def region_codes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", codes.decode(F.col("p_partkey") % 18, codes.REGIONS, "UNKNOWN").alias("code"))


@register("channel_stats_unpivot", """with u as (select 'quantity' as channel, cast(l_quantity as bigint) as v from lineitem union all select 'line', l_linenumber from lineitem union all select 'part', l_partkey from lineitem)
select channel, count(*) as n, cast(sum(v) as bigint) as s, cast(floor(avg(v) * 1000) as bigint) as mean_milli, cast(floor(stddev_pop(v) * 1000 + 0.0001) as bigint) as dev_milli from u group by 1""")
def channel_stats_unpivot(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"))
    long = lines.unpivot([], ["quantity", "line", "part"], "channel", "v")
    return long.groupBy("channel").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.floor(F.avg("v") * 1000).cast("long").alias("mean_milli"), F.floor(F.stddev_pop("v") * 1000 + 0.0001).cast("long").alias("dev_milli"))
