"""Operators on ordered series: alignment by time, interpolation, groups, differences, gaps and islands.

Every window is partitioned by a key, so a series is one task's work and keys spread over the cluster. Alignment by time and the running
operators can cut long series into stretches (`width`): a stretch is reduced to one row, these are scanned for each key, and stretches
finish by themselves, so one key with very many rows is spread too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilune.sources.files import staged


def _around(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], width: int | float | None = None) -> DataFrame:
    """key, time, _l (a left row), _b and _a (the right rows at or before it, and at or after it).

    Both sides are put in one series and read by two running windows, one in either direction, behind one shuffle; a join on
    inequalities would be a cross product. width: series are cut into stretches of so much time, each a task's work of its own, and
    the ends of the other stretches come from one row a stretch, so that a key with very many rows is spread too.
    """
    columns = [c for c in left.columns if c not in (key, time)]
    found = F.struct(F.col(time).alias("t"), *(F.col(v) for v in values))
    lone = F.struct(*columns, F.lit(0).alias("_end"))
    empty = lambda df, x: F.lit(None).cast(df.select(x.alias("x")).schema["x"].dataType)
    both = left.select(key, time, lone.alias("_l"), empty(right, found).alias("_r")).unionByName(
        right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, empty(left, lone).alias("_l"), found.alias("_r"))
    )
    parts = [key]
    if width is not None:
        both, parts = both.withColumn("_s", F.floor(F.col(time) / width)), [key, "_s"]
        ends = both.groupBy(key, "_s").agg(F.max("_r").alias("last"), F.min("_r").alias("first"))
    near = lambda f, order: f("_r").over(Window.partitionBy(*parts).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", near(F.max, F.asc(time))).withColumn("_a", near(F.min, F.desc(time)))
    if width is not None:
        carry = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(key, "_s", carry("last", F.asc("_s")).alias("_lo"), carry("first", F.desc("_s")).alias("_hi"))
        both = both.where("_l is not null").join(ends, [key, "_s"], "left").withColumn("_b", F.coalesce("_b", "_lo")).withColumn("_a", F.coalesce("_a", "_hi"))
    return both.where("_l is not null").select(key, time, *(F.col("_l")[c].alias(c) for c in columns), "_b", "_a")


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], how: str = "nearest", prefix: str = "r_", max_gap: int | float | None = None, width: int | float | None = None) -> DataFrame:
    """Each left row with the values of the right row nearest in time (how: backward, forward or nearest), of the same key.

    Ties go to the earlier row, rows beyond either end take the end row, and left rows without a match (or beyond max_gap)
    have nulls. Of right rows with equal times the largest values win before, the smallest after. Rows with a null key or time have
    no match and are none. width: see _around.
    """
    both = _around(left, right, key, time, values, width)
    if how == "backward":
        pick = F.col("_b")
    elif how == "forward":
        pick = F.col("_a")
    else:
        pick = F.when(F.col("_a.t").isNull() | (F.col(time) - F.col("_b.t") <= F.col("_a.t") - F.col(time)), F.col("_b")).otherwise(F.col("_a"))
    both = both.withColumn("_p", pick)
    if max_gap is not None:
        both = both.withColumn("_p", F.when(F.abs(F.col(time) - F.col("_p.t")) <= max_gap, F.col("_p")))
    return both.select(*both.columns[:-3], F.col("_p.t").alias(f"{prefix}{time}"), *(F.col(f"_p.{v}").alias(f"{prefix}{v}") for v in values))


def bracket(left: DataFrame, right: DataFrame, key: str, time: str, value: str, width: int | float | None = None) -> DataFrame:
    """Each left row with the right rows just before (or at) and after it, as lo_ and hi_ columns; one shuffle for both."""
    both = _around(left, right, key, time, [value], width)
    ends = [F.col(f"{at}.{c}").alias(f"{prefix}{name}") for at, prefix in (("_b", "lo_"), ("_a", "hi_")) for c, name in (("t", time), (value, value))]
    return both.select(*both.columns[:-2], *ends)


def interpolate(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str = "interpolated", width: int | float | None = None) -> DataFrame:
    """Linear between the neighbours, held at both ends."""
    rows = bracket(left, right, key, time, value, width)
    lo_t, hi_t, lo, hi = (F.col(c).cast("double") for c in (f"lo_{time}", f"hi_{time}", f"lo_{value}", f"hi_{value}"))
    mixed = lo + (hi - lo) * ((F.col(time) - lo_t) / (hi_t - lo_t))
    return rows.withColumn(out, F.when(lo_t.isNull(), hi).when(hi_t.isNull() | (hi_t == lo_t), lo).otherwise(mixed)).drop(f"lo_{time}", f"hi_{time}", f"lo_{value}", f"hi_{value}")


def _pieces(lo: Column, hi: Column, top: int) -> Column:
    """The fewest aligned blocks (level, i), of 2^level buckets each, that make up the buckets lo to hi: two a level at most."""

    def at(level: Column) -> Column:
        first = -F.call_function("shiftright", -lo, level)  # of the blocks that lie inside
        last = F.call_function("shiftright", hi + 1, level) - 1
        left, right = (first <= last) & (F.pmod(first, F.lit(2)) == 1), (first <= last) & (F.pmod(last, F.lit(2)) == 0)
        # A block is taken if the one around it isn't inside; at the top none is looked at.
        taken = F.when(level == top, F.when(first <= last, F.sequence(first, last))).otherwise(F.array_compact(F.array(F.when(left, first), F.when(right, last))))
        return F.transform(F.coalesce(taken, F.array().cast("array<bigint>")), lambda i: F.struct(level.alias("level"), i.alias("i")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))


def _around_blocks(at: Column, top: int) -> Column:
    """The blocks of all levels that hold a bucket."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at, level).alias("i")))


def overlapping(a: DataFrame, b: DataFrame, start: str, end: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of closed intervals that overlap; columns of b have the suffix _b. Intervals that end before they start, or lack an end, match nothing.

    Of two intervals that overlap, one holds the other's first bucket (of `width`). So each interval is stored once as a logarithmic number of
    aligned blocks, and once as the blocks of all levels around its first bucket; the one side's blocks are joined with the other side's
    first buckets and the other way round. Blocks of an interval don't overlap, so each pair is formed once, and an interval costs the logarithm of its length.
    """
    whole = lambda df: df.where(F.col(start) <= F.col(end)).withColumns({"_lo": F.floor(F.col(start) / width).cast("long"), "_hi": F.floor(F.col(end) / width).cast("long")})
    a, b = whole(a), whole(b)
    longest = a.select((F.col("_hi") - F.col("_lo")).alias("n")).unionByName(b.select((F.col("_hi") - F.col("_lo")).alias("n"))).agg(F.max("n")).first()[0]
    top = max(int(longest or 0) + 1, 1).bit_length()
    b = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
    for c in on or []:
        b = b.withColumn(c, F.col(f"{c}_b"))
    stored = lambda df, x: df.withColumn("_k", F.explode(_pieces(F.col(f"_lo{x}"), F.col(f"_hi{x}"), top)))
    begun = lambda df, x: df.withColumn("_k", F.explode(_around_blocks(F.col(f"_lo{x}"), top)))
    keys = ["_k", *(on or [])]
    later = begun(a, "").join(stored(b, "_b"), keys).where("_lo >= _lo_b")
    earlier = stored(a, "").join(begun(b, "_b"), keys).where("_lo < _lo_b")
    pairs = later.unionByName(earlier).where((F.col(start) <= F.col(f"{end}_b")) & (F.col(f"{start}_b") <= F.col(end)))
    return pairs.drop("_k", "_lo", "_hi", "_lo_b", "_hi_b")


def _series(key: str | list[str], *order: str) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def _stretches(df: DataFrame, key: str | list[str], order: list[str], width: int | float | None) -> DataFrame:
    """Adds _k (the key, in which nulls are equal) and _s: the stretch of `width` of the first order column, or one stretch for all."""
    stretch = F.lit(0).cast("long") if width is None else F.coalesce(F.floor(F.col(order[0]) / width).cast("long"), F.lit(-(2**63)))
    return df.withColumn("_k", F.struct(*([key] if isinstance(key, str) else key))).withColumn("_s", stretch)


def _in_stretch(order: list[str]) -> Window:
    return Window.partitionBy("_k", "_s").orderBy(*order)


def _carried(rows: DataFrame, **parts: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """The upper level of a scan: each stretch is reduced to one row, `parts` by name, whose rule then runs over the key's earlier stretches.

    Adds for each name what the earlier stretches come to, null for the first. A key's stretches are one window, narrow and as many as
    its length has widths; its rows never meet in one task."""
    ends = rows.groupBy("_k", "_s").agg(*(reduced.alias(n) for n, (reduced, _) in parts.items()))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ends.select("_k", "_s", *(rule(n).over(before).alias(n) for n, (_, rule) in parts.items())), ["_k", "_s"])


def _latest(name: str) -> Column:
    return F.last(name, ignorenulls=True)


def _with_previous(df: DataFrame, key: str | list[str], order: list[str], columns: list[str], width: int | float | None) -> DataFrame:
    """Adds _b, a struct of the columns of the row before in the series; null for the first row. Keeps _k and _s."""
    rows, value = _stretches(df, key, order, width), F.struct(*columns)
    if width is None:
        return rows.withColumn("_b", F.lag(value).over(_in_stretch(order)))
    rows = _carried(rows, _last=(F.max_by(value, F.struct(*order)), _latest))
    return rows.withColumn("_b", F.coalesce(F.lag(value).over(_in_stretch(order)), F.col("_last"))).drop("_last")


def start_flags(df: DataFrame, key: str, order: list[str], value: str, out: str = "starts", width: int | float | None = None) -> DataFrame:
    """True where the value differs from that of the row before; true for the first row. width: see `_stretches`; order must then be unique in a series."""
    rows = _with_previous(df, key, order, [value], width)
    return rows.withColumn(out, F.col("_b").isNull() | ~F.col(value).eqNullSafe(F.col("_b")[value])).drop("_b", "_k", "_s")


def group_ids(df: DataFrame, key: str, order: list[str], starts: str = "starts", out: str = "group_id", width: int | float | None = None) -> DataFrame:
    """Numbers from 0, one more at each start."""
    rows, one = _stretches(df, key, order, width), F.col(starts).cast("long")
    own = F.sum(one).over(_in_stretch(order).rowsBetween(Window.unboundedPreceding, 0))
    if width is None:
        return rows.withColumn(out, own - 1).drop("_k", "_s")
    rows = _carried(rows, _before=(F.sum(one), F.sum))
    return rows.withColumn(out, own + F.coalesce("_before", F.lit(0)) - 1).drop("_before", "_k", "_s")


def central_difference(df: DataFrame, key: str, order: list[str], time: str, value: str, out: str = "rate") -> DataFrame:
    """(next - previous) / (their times' difference), one-sided at the ends, 0 for a single row or equal times."""
    w = _series(key, *order)
    side = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    return df.withColumn(out, F.when(side(time) != 0, side(value) / side(time)).otherwise(F.lit(0.0)))


def violations(df: DataFrame, key: str, order: list[str], value: str, strict: bool = False, width: int | float | None = None) -> DataFrame:
    """For each key how many rows break the order of the value, and the first of them (its place from 0; null if none)."""
    rows = _with_previous(df, key, order, [value], width)
    before = F.col("_b")[value]
    bad = before >= F.col(value) if strict else before > F.col(value)
    rows = rows.withColumns({"_bad": bad, "_n": F.row_number().over(_in_stretch(order))})
    # Places inside the stretch; only a stretch's first violation and its length go up.
    ends = rows.groupBy("_k", "_s").agg(F.count_if("_bad").alias("_bad"), F.min(F.when(F.col("_bad"), F.col("_n"))).alias("_n"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_at", (before + F.col("_n") - 1).cast("long"))
    return ends.groupBy("_k").agg(F.sum("_bad").alias("violations"), F.min("_at").alias("first_violation")).select("_k.*", "violations", "first_violation")


def counter_load(df: DataFrame, key: str, order: list[str], idle: str, total: str, out: str = "load", width: int | float | None = None) -> DataFrame:
    """Percent busy from two rising counters: truncated, 0 for the first sample or where the total didn't rise, held to 0..100."""
    rows = _with_previous(df, key, order, [idle, total], width)
    d_idle, d_total = F.col(idle) - F.col("_b")[idle], F.col(total) - F.col("_b")[total]
    load = F.when(d_total > 0, F.greatest(F.lit(0), F.least(F.lit(100), ((1 - d_idle / d_total) * 100).cast("int")))).otherwise(0)
    return rows.withColumn(out, F.coalesce(load, F.lit(0)).cast("int")).drop("_b", "_k", "_s")


def first_stable(df: DataFrame, key: str, order: list[str], value: str, rows: int, threshold: int) -> DataFrame:
    """The first place (from 0) at which the population deviation of the last `rows` whole numbers is under the threshold; null if never. Compared without roots, so sums stay exact."""
    w = _series(key, *order)
    last = w.rowsBetween(-(rows - 1), 0)
    n, s, q = F.count("*").over(last), F.sum(value).over(last), F.sum(F.col(value) * F.col(value)).over(last)
    place = (F.row_number().over(w) - 1).cast("long")
    marked = df.select(key, place.alias("at"), ((n == rows) & (n * q - s * s < rows * rows * threshold * threshold)).alias("stable"))
    return marked.groupBy(key).agg(F.min(F.when(F.col("stable"), F.col("at"))).alias("stable_at"))


def stalled(df: DataFrame, key: str, order: list[str], value: str, limit: int, width: int | float | None = None) -> DataFrame:
    """How many rows in a row the value hasn't risen above its best so far (`stalled`), and whether that has reached the limit.

    A row's count is its place less that of the last row that rose. Over stretches that takes two scans: the best so far tells which rows rise, then places and last rises are carried."""
    rows, w = _stretches(df, key, order, width), _in_stretch(order)
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if width is not None:
        rows = _carried(rows, _best=(F.max(value), F.max))
        best = F.greatest(best, F.col("_best"))
    rows = rows.withColumn("_seen", best).withColumn("_at", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("_up", F.when(F.col("_seen").isNull() | (F.col(value) > F.col("_seen")), F.col("_at")))
    rise = F.max("_up").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if width is not None:
        # How far back the last rise is at a stretch's end, counted on through stretches without one.
        back = F.struct(F.count("*").alias("n"), (F.count("*") - F.max("_up")).alias("back"))
        rows = _carried(rows, _since=(back, lambda n: F.collect_list(n)))
        add = lambda a, x: F.coalesce(x["back"], a + x["n"])
        rise = F.coalesce(rise, -F.aggregate("_since", F.lit(0).cast("long"), add))
    rows = rows.withColumn("stalled", F.col("_at") - rise)
    return rows.withColumn("failed", F.col("stalled") >= limit).drop("_seen", "_at", "_up", "_since", "_best", "_k", "_s")


def within_window(df: DataFrame, key: list[str], time: str, gap, tie: str) -> DataFrame:
    """`duplicate`: whether an equal command came less than gap before."""
    before = F.lag(time).over(_series(key, time, tie))
    return df.withColumn("duplicate", F.coalesce(F.col(time) - before < gap, F.lit(False)))


def last_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key, newest first (`place` from 1)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= n)


def gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """key, first, last: each stretch of numbers that a key lacks between 0 and its largest. Stretches, so that one stray large number costs a row."""
    n = F.col(number).cast("long")
    rows = df.where(n >= 0).select(key, n.alias("_n")).distinct()
    before = F.coalesce(F.lag("_n").over(_series(key, "_n")), F.lit(-1).cast("long"))
    return rows.select(key, (before + 1).alias("first"), (F.col("_n") - 1).alias("last")).where("first <= last")


def coverage(df: DataFrame, key: str, number: str) -> DataFrame:
    """For each key: how many distinct numbers are there, the largest, and how many from 0 to it are missing."""
    n = F.when(F.col(number) >= 0, F.col(number).cast("long"))
    rows = df.groupBy(key).agg(F.count_distinct(n).alias("present"), F.max(n).alias("largest"))
    return rows.withColumn("missing", F.coalesce(F.col("largest") + 1 - F.col("present"), F.lit(0).cast("long")))


def first_occurrence(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def reassemble(df: DataFrame, key: str, number: str, payload: str, out: str = "payload") -> DataFrame:
    """Payloads of each key joined in order of their numbers, the first of each number counting. A key's parts are one message, so they fit a task."""
    one = first_occurrence(df, [key, number], [payload])
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(payload).alias("p"))))
    return one.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias(out), F.count("*").alias("parts"))


def allan(df: DataFrame, key: str, order: list[str], value: str, factors: list[int]) -> DataFrame:
    """Overlapping Allan variance sums of phase data at spacing 1, for each averaging factor m: n terms and the sum of (x[i+2m] - 2 x[i+m] + x[i])^2 and its deviation."""
    w = _series(key, *order)
    term = lambda m: F.lead(value, 2 * m).over(w) - 2 * F.lead(value, m).over(w) + F.col(value)
    rows = df.select(key, *(term(m).alias(f"_{m}") for m in factors))
    long = rows.select(key, F.inline(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"_{m}").alias("d")) for m in factors)))).where("d is not null")
    out = long.groupBy(key, "m").agg(F.count("*").alias("terms"), F.sum(F.col("d") * F.col("d")).alias("squares"))
    return out.withColumn("deviation", F.sqrt(F.col("squares") / (2.0 * F.col("m") * F.col("m") * F.col("terms"))))


def numbered(df: DataFrame, key: str | list[str], order: list[str], out: str = "place", width: int | float | None = None) -> DataFrame:
    """Adds each row's place in its series, from 0."""
    rows = _stretches(df, key, order, width)
    place = (F.row_number().over(_in_stretch(order)) - 1).cast("long")
    if width is None:
        return rows.withColumn(out, place).drop("_k", "_s")
    rows = _carried(rows, _before=(F.count("*"), F.sum))
    return rows.withColumn(out, place + F.coalesce("_before", F.lit(0))).drop("_before", "_k", "_s")


def _allan_block(i: int, f: int, size: int, blocks: dict[int, np.ndarray]) -> list[tuple[int, int, float]]:
    """m, terms, squares of the factors of block f over the terms that begin in block i, from the blocks that they reach."""
    out = []
    x0 = blocks[i]
    near, far = (np.concatenate([np.zeros(0), *(blocks[k] for k in range(first, first + n) if k in blocks)]) for first, n in ((i + f, 2), (i + 2 * f, 3)))
    for m in range(f * size + 1, (f + 1) * size + 1):
        b, c = m - f * size, 2 * m - 2 * f * size  # where the first term's other points stand
        n = min(len(x0), len(far) - c)
        if n <= 0:
            break
        d = far[c : c + n] - 2 * near[b : b + n] + x0[:n]
        out.append((m, n, float(d @ d)))
    return out


def allan_all(df: DataFrame, key: str, order: list[str], value: str, size: int = 2048, width: int | float | None = None) -> DataFrame:
    """The same for every averaging factor that leaves a term: key, m, terms, squares, deviation.

    A series is cut into blocks of `size` points. Each pair of a block of first points and a block of `size` factors is a group of its own, with the six
    blocks that its terms reach, so no task holds a whole series. The work is quadratic in a series' length, as its result is a sum over
    all factors and points: n * n / 4 terms, spread over (n / size)^2 / 4 groups. width: see `numbered`."""
    kind = dict(df.dtypes)[key]
    rows = numbered(df.select(key, *order, value), key, order, "_i", width)
    blocks = rows.groupBy(F.struct(key).alias("_k"), F.floor(F.col("_i") / size).cast("long").alias("b"))
    blocks = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).cast("double").alias("x")))), lambda e: e["x"]).alias("x"))
    last = blocks.groupBy("_k").agg(F.max("b").alias("last"))
    # Block b serves first points in i = b, and as the reach of factors f where b is i + f, i + f + 1, or i + 2f to i + 2f + 2.
    f = F.col("f")
    firsts = F.array_distinct(F.array(*(F.col("b") - x for x in (F.lit(0), f, f + 1, 2 * f, 2 * f + 1, 2 * f + 2))))
    dealt = blocks.join(last, "_k").withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 2))))
    dealt = dealt.withColumn("i", F.explode(F.filter(firsts, lambda i: (i >= 0) & (i + 2 * f <= F.col("last"))))).select("_k", "i", "f", "b", "x")

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        _, i, f = (k.as_py() for k in keys)
        held = dict(zip(table.column("b").to_pylist(), (np.array(x) for x in table.column("x").to_pylist()), strict=True))
        found = _allan_block(i, f, size, held)
        m, n, squares = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"_k": table.column("_k").slice(0, 1).take(pa.array([0] * len(m), pa.int64())), "m": pa.array(m, pa.int32()), "terms": pa.array(n, pa.int64()), "squares": pa.array(squares, pa.float64())})

    parts = dealt.groupBy("_k", "i", "f").applyInArrow(run, f"_k struct<`{key}`:{kind}>, m int, terms long, squares double")
    out = parts.groupBy("_k", "m").agg(F.sum("terms").alias("terms"), F.sum("squares").alias("squares"))
    return out.withColumn("deviation", F.sqrt(F.col("squares") / (2.0 * F.col("m") * F.col("m") * F.col("terms")))).select("_k.*", "m", "terms", "squares", "deviation")


def duplicate_commands(df: DataFrame, key: list[str], start: str, end: str, gap: int | float = 60, tie: str | None = None) -> DataFrame:
    """`duplicate`: whether an equal command that was run is still active at the start of this one (a null end: for good), or ended less than gap before. Duplicates aren't run and shield nothing, so each key's commands are walked in order of their starts, ends and ties."""
    import numpy as np
    import pandas as pd

    names = df.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([start, end, *([tie] if tie else [])], kind="stable", na_position="last")
        until, out = -np.inf, []
        for s, e in zip(rows[start].to_numpy(dtype=float), rows[end].to_numpy(dtype=float), strict=True):
            out.append(bool(s < until))
            if s >= until:
                until = np.inf if np.isnan(e) else e + gap
        return rows[names].assign(duplicate=out)

    schema = ", ".join([*(f"`{n}` {kind}" for n, kind in df.dtypes), "duplicate boolean"])
    return df.groupBy(*key).applyInPandas(run, schema)


#: Distinct values of a key that one window may count: narrow rows.
_COUNTED = 1 << 16
_STEPS, _SKETCH = 500, 10_000


def medians(df: DataFrame, key: str, value: str, most: int = _COUNTED) -> DataFrame:
    """key, median: the exact median of each key's values, the mean of the middle two; nulls and NaN are left out.

    Selection in passes: a sketch of bounded size gives each key's quantiles, the middle ranks are bracketed by two of them, what lies below the
    bracket is counted, and only values inside go on, about one in a hundred, until every key has at most `most` distinct ones; these are
    counted and read off by rank. No aggregate holds a group's values."""
    kind, most = dict(df.dtypes)[key], max(most, 16)  # fewer values than that may not narrow
    rows = df.select(F.struct(key).alias("_k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ranks = rows.groupBy("_k").agg(F.count("*").alias("n")).select("_k", "n", F.floor((F.col("n") - 1) / 2).cast("long").alias("r"), F.floor(F.col("n") / 2).cast("long").alias("q"))
    while ranks.where(F.col("n") > most).limit(1).count() and rows.distinct().groupBy("_k").agg(F.count("*").alias("c")).where(F.col("c") > most).limit(1).count():
        cuts = F.percentile_approx("v", [k / _STEPS for k in range(_STEPS + 1)], _SKETCH)
        held = rows.groupBy("_k").agg(cuts.alias("p"), F.min("v").alias("least"), F.max("v").alias("largest")).join(ranks, "_k")
        i, j = F.floor(_STEPS * F.col("r") / F.col("n")).cast("int") - 1, F.ceil(_STEPS * (F.col("q") + 1) / F.col("n")).cast("int") + 1
        whole = F.col("n") <= most
        lo, hi = F.when(whole | (i < 0), F.col("least")).otherwise(F.get("p", i)), F.when(whole | (j > _STEPS), F.col("largest")).otherwise(F.get("p", j))
        bounds = staged(held.select("_k", "r", "q", lo.alias("lo"), hi.alias("hi")))
        placed = rows.join(bounds, "_k")
        rows = staged(placed.where("v >= lo and v <= hi").select("_k", "v"))
        below = placed.groupBy("_k").agg(F.count_if(F.expr("v < lo")).alias("below"), F.count_if(F.expr("v >= lo and v <= hi")).alias("n"))
        ranks = staged(bounds.join(below, "_k").select("_k", "n", (F.col("r") - F.col("below")).alias("r"), (F.col("q") - F.col("below")).alias("q")))
    upto = F.sum("c").over(Window.partitionBy("_k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.groupBy("_k", "v").agg(F.count("*").alias("c")).withColumn("upto", upto).join(ranks, "_k")
    first = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
    found = placed.groupBy("_k").agg(first("r").alias("a"), first("q").alias("b"))
    middle = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b"))
    return found.select(F.col("_k")[key].cast(kind).alias(key), middle.alias("median"))


def closest_to_median(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """For each key the median and the row whose value is nearest to it, the smallest tie on ties."""
    near = df.join(medians(df, key, value), key)
    return near.groupBy(key).agg(F.first("median").alias("median"), F.min(F.struct(F.abs(F.col(value) - F.col("median")).alias("d"), F.col(tie).alias("t"))).alias("_m")).select(key, "median", F.col("_m.t").alias(tie))


def apply_all(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
