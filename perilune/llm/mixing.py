"""Operator 8 [native]: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in order of their code points, null last, weigh `weights` in turn and share `share` of all words; no target
is above `most` times its source's words, and what is cut off goes to the others by weight until none is above.

A source's documents fall into blocks by a hash of their id. Of a source, each block is taken as often as its target holds
its words in full; for what is left, permuted blocks are taken until the target is met, the last one only in part. These
units, an exact quota of blocks for each source, are dealt to 2^depth output shards by a tree: at each node the quotas of the
left half are one draw from the multivariate hypergeometric distribution. The leaves' quotas are then filled with disjoint
stretches of each source's permuted units, and rows are shuffled inside their shard only. All draws come from hashes of
`seed`, so reruns agree.

Null texts have no words; documents without words are taken with their block and add nothing. Null sources are one source.
Repeated rows, in one source or in several, are rows of their own: those of one source share a block, and of equal ones that only
partly fit, as many as fit are taken. Null doc_ids count as one doc_id. A source without words has target 0. A very long
text is taken or left whole: one that doesn't fit is passed over, and a source misses its target by half of the shortest document left
among `fill` around it at most, and by less where shorter ones fill the gap. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilune.llm.common import released, staged


_STAGED_LEVELS = 3


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    depth: int | None = None  # of the tree; None: so that a shard has about 16 units, at most 2^12 shards
    block_rows: int = 256
    most_blocks: int = 4096  # of a source; blocks only set how finely shards are mixed, so more rows make larger blocks
    fill: int = 256  # groups of equal rows around the first that doesn't fit, among which a part block fills what is left
    seed: int = 17


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, n_docs, source_size, target, k (the source's place from 0) from rows of (source, size). Sources are metadata: one row each."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("k")
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("k") % len(mix.weights) + 1).cast("int")).cast("double")
    rows = total.select("source", "source_size", "n_docs", k).withColumn("w", weight).withColumn("cap", F.col("source_size") * mix.most)
    # Water level: in order of cap for each weight, a source is capped if the level that those from it on would share is at its cap or above.
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    level = (mix.share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    first = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("first", first).select("source", "n_docs", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("first") * F.col("w")).alias("target"), "k")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 7, brought back by the product between."""
    z = n.cast("double") + 7
    back = sum((F.log(n.cast("double") + i) for i in range(2, 7)), F.log(n.cast("double") + 1))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - back


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` from `total`, of which `marked` are marked, are marked: the quantile of u."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    ways = F.transform(F.sequence(low, high), lambda x: F.exp(_ln_choose(marked, x) + _ln_choose(total - marked, drawn - x) - _ln_choose(total, drawn)))
    start = F.struct(F.lit(0.0).alias("p"), low.alias("x"))
    step = lambda a, p: F.struct((a["p"] + p).alias("p"), F.when(a["p"] + p < u, a["x"] + 1).otherwise(a["x"]).alias("x"))
    return F.least(high, F.aggregate(ways, start, step, lambda a: a["x"]))


def split_quotas(quotas: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """k, shard, quota from rows of (k, quota): the leaves of the tree. One row of arrays grows to 2^depth; no shuffle. Every few levels are staged, so that plans stay small."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), F.col("quota").cast("long").alias("quota")))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    kind = "struct<left:bigint,drawn:bigint,x:array<bigint>>"
    for level in range(mix.depth or 0):
        if level and level % _STAGED_LEVELS == 0:
            nodes = staged(nodes)
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, s: a + s["quota"])

        seeds = (F.lit(mix.seed), F.lit(level), F.col("node"))

        def draw(a: Column, s: Column) -> Column:
            x = hypergeometric(a["left"], s["quota"], a["drawn"], _uniform(*seeds, s["k"]))  # noqa: B023  used at once
            return F.struct((a["left"] - s["quota"]).alias("left"), (a["drawn"] - x).alias("drawn"), F.concat(a["x"], F.array(x)).alias("x")).cast(kind)

        start = F.struct(F.col("total").alias("left"), F.floor(F.col("total") / 2).cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("x")).cast(kind)
        drawn = nodes.withColumn("total", total).withColumn("x", F.aggregate("q", start, draw, lambda a: a["x"]))
        left = F.zip_with("q", "x", lambda s, x: F.struct(s["k"].alias("k"), x.alias("quota")))
        right = F.zip_with("q", "x", lambda s, x: F.struct(s["k"].alias("k"), (s["quota"] - x).alias("quota")))
        halves = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q"))))
        nodes = drawn.select(halves.alias("h")).select("h.*")
    return nodes.select(F.col("node").alias("shard"), F.inline("q")).select("k", "shard", "quota")


def _filled(groups: Column, gap: Column) -> Column:
    """Of an array of (r, place, many) those taken into a gap: (place, many, some). One after the other as often as it fits; then one of the shortest that is left, if that comes nearer."""
    kind = "struct<gap:bigint,least:bigint,at:int,some:array<bigint>>"
    size = lambda g: g["place"]["size"]

    def step(a: Column, g: Column) -> Column:
        fit = F.when(size(g) > 0, F.least(g["many"], F.floor(a["gap"] / size(g)))).otherwise(g["many"]).cast("long")
        short = (fit < g["many"]) & (a["least"].isNull() | (size(g) < a["least"]))
        rest = (a["gap"] - fit * size(g)).alias("gap"), F.when(short, size(g)).otherwise(a["least"]).alias("least")
        return F.struct(*rest, F.when(short, F.size(a["some"])).otherwise(a["at"]).alias("at"), F.concat(a["some"], F.array(fit)).alias("some")).cast(kind)

    start = F.struct(F.floor(gap).cast("long").alias("gap"), F.lit(None).cast("long").alias("least"), F.lit(-1).alias("at"), F.array().cast("array<bigint>").alias("some")).cast(kind)
    last = lambda a, i: F.when((i == a["at"]) & (2 * a["gap"] > a["least"]), 1).otherwise(0)
    some = F.aggregate(groups, start, step, lambda a: F.transform(a["some"], lambda x, i: x + last(a, i)))
    taken = F.zip_with(groups, some, lambda g, x: F.struct(g["place"].alias("place"), g["many"].alias("many"), x.cast("long").alias("some")))
    return F.filter(taken, lambda t: t["some"] > 0)


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, copies: array of (copy, shard), and every further column of docs but those names."""
    seed = F.lit(mix.seed)
    names = ("size", "source_size", "target", "copies")
    rest = [c for c in docs.columns if c not in ("doc_id", "source", *names)]
    # Further columns travel as one, so that their names can't clash with those used here.
    end = "_end"
    while end.lower() in (c.lower() for c in rest):
        end += "_"
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias(end)).alias("_rest"))
    sizes = staged(docs.select("doc_id", "source", "size"))
    sources = staged(
        source_targets(sizes, mix).select(
            "*",
            F.least(F.lit(mix.most_blocks), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / mix.block_rows))).alias("n_blocks"),
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("full"),
        ).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    )
    join = lambda df, *cols: df.join(sources.select("source", *cols).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.pmod(F.xxhash64(seed, "doc_id"), "n_blocks").alias("block")
    placed = join(sizes, "k", "n_blocks").select("k", "doc_id", "size", block)
    # Blocks in a hashed order; those before the rest's end are taken once more, the one across it in part.
    blocks = placed.groupBy("k", "block").agg(F.sum("size").alias("words")).join(sources.select("k", "full", "rest"), "k")
    before = F.sum("words").over(Window.partitionBy("k").orderBy(F.xxhash64(seed, F.lit(1), "k", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    blocks = blocks.withColumn("left", F.col("rest") - before).withColumn("state", F.when(F.col("left") >= F.col("words"), "whole").when(F.col("left") > 0, "part").otherwise("none"))
    released(docs.sparkSession)  # plans that are done with are many and large: the driver gives their memory back between steps
    blocks = staged(blocks.select("k", "block", "words", "left", "state", (F.col("full") + (F.col("state") != "none").cast("int")).cast("long").alias("units")))
    if mix.depth is None:
        units = blocks.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
        mix = replace(mix, depth=min(12, max(0, (units // 16).bit_length() - 1)))
    # Each source's units in a hashed order fill its leaves' quotas one after the other.
    released(docs.sparkSession)
    quotas = staged(split_quotas(blocks.groupBy("k").agg(F.sum("units").alias("quota")), mix))
    end = F.sum("quota").over(Window.partitionBy("k").orderBy("shard"))
    slots = quotas.withColumn("end", end).where("quota > 0").select("k", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("rank"))
    units = blocks.where("units > 0").select("k", "block", F.explode(F.sequence(F.lit(1).cast("long"), "units")).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(seed, F.lit(2), "k", "block", "copy"), "block", "copy")).cast("long").alias("rank")
    dealt = units.select("k", "block", "copy", rank).join(slots, ["k", "rank"]).groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    # In a block taken in part, documents in a hashed order are taken while they fit. Around the first that doesn't, the longest that fit
    # are taken, then shorter ones, and at last the shortest if that misses the target by less than leaving it out. Equal rows count
    # as one group, of which `some` are taken.
    place = F.struct(F.xxhash64(seed, F.lit(3), "doc_id").alias("h"), F.col("doc_id"), F.col("size"))
    part = placed.join(blocks.where("state = 'part'").select("k", "block", "left"), ["k", "block"]).groupBy("k", "block", "left", place.alias("place")).agg(F.count("*").alias("many"))
    order = Window.partitionBy("k", "block").orderBy("place")
    part = part.withColumn("upto", F.sum(F.col("many") * F.col("place.size")).over(order)).withColumn("r", F.row_number().over(order))
    full = F.min(F.when(F.col("upto") > F.col("left"), F.col("r"))).over(Window.partitionBy("k", "block"))
    beyond = part.withColumn("full", full).where(F.abs(F.col("r") - F.col("full") + 0.5) < mix.fill / 2)
    beyond = beyond.withColumn("gap", F.col("left") - F.col("upto") + F.col("many") * F.col("place.size"))
    longest = F.struct((-F.col("place.size")).alias("o"), "r", "place", "many")
    cuts = beyond.groupBy("k", "block").agg(F.min("place").alias("cut"), F.min_by("gap", "r").alias("gap"), F.array_sort(F.collect_list(longest)).alias("next"))
    cuts = cuts.select("k", "block", "cut", _filled(F.col("next"), F.col("gap")).alias("more"))
    plan = blocks.join(dealt, ["k", "block"], "left").join(cuts, ["k", "block"], "left")
    whole = lambda c, df: F.coalesce(c, F.array().cast(dict(df.dtypes)[c])).alias(c)
    plan = staged(plan.select("k", "block", "units", whole("dealt", dealt), "cut", whole("more", cuts)))
    released(docs.sparkSession)
    rows = join(docs, "k", "n_blocks", "source_size", "target").withColumn("block", block).withColumn("place", place)
    rows = rows.join(plan, ["k", "block"])
    own = F.filter("more", lambda m: m["place"] == F.col("place"))
    rows = rows.withColumn("some", F.when(F.size(own) > 0, own[0]["some"])).withColumn("many", F.when(F.size(own) > 0, own[0]["many"]))
    beyond = F.coalesce(F.col("place") >= F.col("cut"), F.lit(False))
    tied = F.coalesce(F.col("some") < F.col("many"), F.lit(False))
    if plan.where(F.exists("more", lambda m: m["some"] < m["many"])).limit(1).count():
        # Equal rows of which only some are taken: those whose texts come first.
        text = F.col("_rest.text") if "text" in rest else F.lit("")
        number = F.row_number().over(Window.partitionBy("k", "block", "place").orderBy(text))
        lone = rows.where(~tied).withColumn("dropped", beyond & F.col("some").isNull())
        rows = lone.unionByName(rows.where(tied).withColumn("dropped", number > F.col("some")))
    else:
        rows = rows.withColumn("dropped", beyond & F.col("some").isNull())
    copies = F.filter("dealt", lambda c: (c["copy"] < F.col("units")) | ~F.col("dropped"))
    return rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"), "source", *(F.col("_rest")[c].alias(c) for c in rest))


def mixed_rows(mixed: DataFrame, mix: Mix = Mix(), parts: int = 64) -> DataFrame:
    """The mix itself: a row for each copy, by shard, shuffled inside each. A shard is dealt over `parts` groups by the hash that shuffles it, so no task holds a whole one."""
    kept = [F.col(c) for c in mixed.columns if c not in ("copies", "copy", "shard")]
    rows = mixed.select(*kept, F.explode("copies").alias("_c")).withColumns({"copy": F.col("_c.copy"), "shard": F.col("_c.shard")}).drop("_c")
    place = F.xxhash64(F.lit(mix.seed), F.lit(4), "doc_id", "copy")
    return rows.repartition("shard", F.pmod(place, F.lit(parts))).sortWithinPartitions("shard", place)


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as rows with exactly the columns of docs, whatever their names."""
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return mixed_rows(mix_sources(whole, mix).drop("text"), mix).select("_row.*")
