"""Suppression of overlapping boxes where one frame may hold any number of them: frames are cut into tiles, which are walked best box first."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.sources.files import scratch, unstaged

_BOX = ("x", "y", "w", "h")
_CELL = ("_lw", "_cx", "_lh", "_cy")
_TILE = ("_key", "class_id", "_bx", "_tx", "_by", "_ty")
_MIX = tuple(np.int64(m) for m in (-7046029254386353131, 7935046062780286179, -4417276706812531889, 2685821657736338717, -8663945395140668459))


class _Grid:
    """Two boxes whose intersection over union is above the threshold t have widths (and heights) within a factor of 1 / t, and centres within
    (1 - t) / (2 + 2 t) of the sum of their widths. So a box has a level for its width, by powers of 1 / t, and a cell of that level's
    size; what it may meet lies in its own level and the two beside it, in a few cells of each."""

    def __init__(self, threshold: float) -> None:
        if not 0 < threshold < 1:
            raise ValueError("the threshold must be between 0 and 1")
        slack = 1 + 1e-9  # for rounding at the edges of levels and cells
        self.threshold = threshold
        self.ratio = slack / threshold
        self.reach = (1 - threshold) / (2 + 2 * threshold) * slack
        # a box is shown to the tiles within `halo` of its widths; so all that may meet a box within 2 `reach` of a tile is shown to the tile, too
        self.halo = (self.reach + 3 * self.reach * self.ratio) * 1.01

    def _size(self, level: Column) -> Column:
        return F.pow(F.lit(self.ratio), level + 1)

    def cell(self, at: str, size: str) -> tuple[Column, Column]:
        level = F.floor(F.log(F.col(size)) / math.log(self.ratio))
        return level, F.floor((F.col(at) + F.col(size) / 2) / self._size(level))

    def around(self, at: str, size: str, level: str) -> Column:
        """An array of the (level, cell) along one axis that a box may meet."""

        def beside(k: int) -> Column:
            other = F.col(level) + k
            middle, far = F.col(at) + F.col(size) / 2, self.reach * (F.col(size) + self._size(other))
            cells = F.sequence(F.floor((middle - far) / self._size(other)), F.floor((middle + far) / self._size(other)))
            return F.transform(cells, lambda c: F.struct(other.alias("level"), c.alias("cell")))

        return F.concat(*(beside(k) for k in (-1, 0, 1)))

    def levels(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(size) / math.log(self.ratio)).astype(np.int64)

    def cells(self, at: np.ndarray, level: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(at / self.ratio ** (level + 1.0)), -(2.0**62), 2.0**62).astype(np.int64)

    def spans(self, middle: np.ndarray, size: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As `around`: level, first cell and number of cells, for each of the three levels."""
        out = []
        for other in (level - 1, level, level + 1):
            far = self.reach * (size + self.ratio ** (other + 1.0))
            low = self.cells(middle - far, other)
            out.append((other, low, self.cells(middle + far, other) - low + 1))
        return out

    def bands(self, levels: list) -> list[dict]:
        """Ranges of sizes, each within a factor of 16, from rows (low, high, n, sum of logarithms) by size. `least` and `most` bound what a band's tiles are shown;
        `side` is a tile's: a tile of boxes of that size is a few times as wide as its halo on both sides."""
        out: list[dict] = []
        for r in levels:
            if out and r.high <= 16 * out[-1]["low"]:
                out[-1] |= {"high": r.high, "n": out[-1]["n"] + r.n, "logs": out[-1]["logs"] + r.logs}
            else:
                out.append({"low": r.low, "high": r.high, "n": r.n, "logs": r.logs})
        for b in out:
            least, most = b["low"] / self.ratio**2, b["high"] * self.ratio**2
            b["least"], b["most"] = 0.0 if least <= levels[0].low else least, math.inf if most >= levels[-1].high else most
            b["side"] = 22 * self.halo * math.exp(b["logs"] / b["n"])
        return out

    def tiles(self, df: DataFrame, at: str, size: str, bands: list[dict], shift: float, axis: str) -> DataFrame:
        """Each box once for each tile along one axis that it is shown to: band, tile, whether it is the box's own, and whether the box may meet some that the tile isn't shown."""
        s, c = F.col(size), F.col(f"_t{axis}")

        def of(name: str) -> Column:
            return F.lit(bands[0][name]) if len(bands) == 1 else F.element_at(F.array(*(F.lit(b[name]) for b in bands)), F.col(f"_b{axis}") + 1)

        seen = F.array_compact(F.array(*(F.when(s.between(b["least"], b["most"]), F.lit(i)) for i, b in enumerate(bands))))
        df = df.withColumn(f"_b{axis}", F.lit(0) if len(bands) == 1 else F.explode(seen))
        middle, far = (F.col(at) + s / 2) / of("side") + shift, self.halo * s / of("side")
        away = F.greatest(c - middle, middle - c - 1, F.lit(0.0)) * of("side")
        short = away + self.reach * s > (self.halo / 1.005 - self.reach) * s / self.ratio
        unseen = ((of("least") > 0) & (s / self.ratio < of("least"))) | (s * self.ratio > of("most"))
        df = df.withColumn(f"_t{axis}", F.explode(F.sequence(F.floor(middle - far), F.floor(middle + far))))
        return df.withColumn(f"_own{axis}", (c == F.floor(middle)) & s.between(of("low"), of("high"))).withColumn(f"_open{axis}", short | unseen)


class _Boxes:
    """Boxes of tiles as arrays. `open`: its fate may hang on boxes that its tile isn't shown."""

    NAMES = ("tile", "x", "y", "w", "h", "right", "top", "area", "open")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__ |= arrays

    @classmethod
    def of(cls, tile, x, y, w, h, open_) -> _Boxes:  # noqa: ANN001
        return cls(tile=tile, x=x, y=y, w=w, h=h, right=x + w, top=y + h, area=w * h, open=open_)

    def __len__(self) -> int:
        return len(self.tile)

    def __getitem__(self, at) -> _Boxes:  # noqa: ANN001
        return _Boxes(**{n: getattr(self, n)[at] for n in self.NAMES})

    def __add__(self, other: _Boxes) -> _Boxes:
        return _Boxes(**{n: np.concatenate([getattr(self, n), getattr(other, n)]) for n in self.NAMES})


class _Index:
    """Boxes by the cells that they may meet, so that another box finds them by its own cell: first those of its own cell, which most likely overlap it, then those of its levels."""

    def __init__(self, grid: _Grid, boxes: _Boxes, more: _Index | None = None) -> None:
        """more: an index whose boxes come before these in this one."""
        self.grid, self.boxes = grid, boxes if more is None else more.boxes + boxes
        base, lw, lh = boxes.tile * _MIX[0], grid.levels(boxes.w), grid.levels(boxes.h)
        middle, centre = boxes.x + boxes.w / 2, boxes.y + boxes.h / 2
        own = grid.cells(middle, lw), grid.cells(centre, lh)
        keys, ids = [], []
        for lx, cx, nx in grid.spans(middle, boxes.w, lw):
            for ly, cy, ny in grid.spans(centre, boxes.h, lh):
                n = nx * ny
                who = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                right, up = step // ny[who], step % ny[who]
                key = base + lx * _MIX[1] + cx * _MIX[2] + ly * _MIX[3] + cy * _MIX[4]
                same = (lx == lw) & (ly == lh)
                home = same[who] & (right == (own[0] - cx)[who]) & (up == (own[1] - cy)[who])
                keys.append((key[who] + right * _MIX[2] + up * _MIX[4]) & ~3 | np.where(home, 0, 2 - same[who]))
                ids.append(who)
        key, who = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        key, who = key[order], who[order]
        if more is not None:
            at = np.searchsorted(more.key, key)
            key, who = np.insert(more.key, at, key), np.insert(more.who, at, who + len(more.boxes))
        self.key, self.who = key, who
        cell = key & ~3
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.first, self.n = cell[first], first, np.diff(np.append(first, len(key)))

    def found(self, boxes: _Boxes) -> tuple[np.ndarray, np.ndarray]:
        """For each box where those that it may meet begin in `who`, and how many there are."""
        if not len(self.keys):
            return np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
        lw, lh = self.grid.levels(boxes.w), self.grid.levels(boxes.h)
        cx, cy = self.grid.cells(boxes.x + boxes.w / 2, lw), self.grid.cells(boxes.y + boxes.h / 2, lh)
        key = (boxes.tile * _MIX[0] + lw * _MIX[1] + cx * _MIX[2] + lh * _MIX[3] + cy * _MIX[4]) & ~3
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.first[at], np.where(self.keys[at] == key, self.n[at], 0)

    def meets(self, boxes: _Boxes, first: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (box, number in the index) that overlap too much, in pieces of about `most` candidates."""
        ends = np.cumsum(n)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            m = n[low:high]
            who = np.repeat(np.arange(low, high), m)
            other = self.who[np.arange(len(who)) + np.repeat(first[low:high] - np.cumsum(m) + m, m)]
            for at in range(0, len(who), most):  # one box alone may have more
                i, j = who[at : at + most], other[at : at + most]
                yield self._clash(boxes, i, j)
            low = high

    def _clash(self, boxes: _Boxes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, t = self.boxes, self.grid.threshold
        wide = np.minimum(boxes.right[i], mine.right[j]) - np.maximum(boxes.x[i], mine.x[j])
        # less than this of both widths is too little whatever the heights are
        hit = np.flatnonzero((wide > (boxes.w[i] + mine.w[j]) * (t / (1 + t) * (1 - 1e-6))) & (boxes.tile[i] == mine.tile[j]))
        i, j, wide = i[hit], j[hit], wide[hit]
        high = np.minimum(boxes.top[i], mine.top[j]) - np.maximum(boxes.y[i], mine.y[j])
        both = np.where((wide > 0) & (high > 0), wide * high, 0.0)
        hit = np.flatnonzero(~(both <= t * (mine.area[j] + boxes.area[i] - both)))
        return i[hit], j[hit]


def _beaten(index: _Index, boxes: _Boxes, some: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes go by a box of the index that stays, and which become open by one that is. A box that has gone is compared no more."""
    gone, doubt = np.zeros(len(boxes), bool), np.zeros(len(boxes), bool)
    first, n = index.found(boxes)
    left = np.flatnonzero(n)
    while len(left):
        part, start, most = boxes[left], first[left], np.minimum(n[left], some)
        for i, j in index.meets(part, start, most):
            unsure = index.boxes.open[j]
            gone[left[i[~unsure]]] = True
            doubt[left[i[unsure]]] = True
        first[left] += most
        n[left] -= most
        left = left[(n[left] > 0) & ~gone[left]]
        some *= 2
    return gone, doubt


def _settle(grid: _Grid, boxes: _Boxes, most: int) -> np.ndarray:
    """Which of some boxes, best first, stay or are open; `boxes.open` is brought up to date. Memory is bounded: where too many could meet, the better half is settled first."""
    index = _Index(grid, boxes)
    first, n = index.found(boxes)
    if n.sum() > most and len(boxes) > 64:
        half, stays = len(boxes) // 2, np.zeros(len(boxes), bool)
        del index
        for part in (np.arange(half), np.arange(half, len(boxes))):
            if part[0]:
                better = np.flatnonzero(stays)
                gone, doubt = _beaten(_Index(grid, boxes[better]), boxes[part])
                boxes.open[part] |= doubt
                part = part[~gone]
            some = boxes[part]
            stays[part] = _settle(grid, some, most)
            boxes.open[part] = some.open
        return stays
    pairs = [(j[j < i], i[j < i]) for i, j in index.meets(boxes, first, n)]
    better, worse = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    gone, left = np.zeros(len(boxes), bool), np.zeros(len(boxes), bool)
    for _ in range(64):  # rounds: what waits for no better box is decided
        left[:] = False
        left[worse] = True
        ready = ~left[better]
        a, b = better[ready], worse[ready]
        gone[b[~boxes.open[a]]] = True
        boxes.open[b[boxes.open[a]]] = True
        rest = ~ready & ~gone[better] & ~gone[worse]
        better, worse = better[rest], worse[rest]
        if not len(better):
            break
    order = np.lexsort((better, worse))
    for a, b in zip(better[order].tolist(), worse[order].tolist(), strict=True):  # long chains: one after the other
        if not gone[a] and not gone[b]:
            if boxes.open[a]:
                boxes.open[b] = True
            else:
                gone[b] = True
    return ~gone


def _walked(parts: Iterable[pa.RecordBatch], grid: _Grid, out: list[str], block: int = 1 << 14, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows of tiles, tile by tile and best first: those of a tile's own that stay or are open. Rows are taken in blocks (in larger ones when there is more
    to compare them with); what is remembered from one to the next are a tile's boxes that stay or are open. `_how` is a hash of the tile, of which only neighbouring rows are compared; its last bits are 2 for a tile's own rows, 1 for open ones."""
    state, last, number = None, None, 0

    def walk(table: pa.Table) -> pa.Table:
        nonlocal state, last, number
        table = table.combine_chunks()
        x, y, w, h = (table[c].to_numpy() for c in _BOX)
        size = len(x)
        new = np.zeros(size, bool)
        twin = np.zeros(size, bool)
        how = table["_how"].to_numpy()
        rows = table if last is None else pa.concat_tables([last, table]).combine_chunks()
        skip = size - len(rows)  # 0, or -1 behind the last block's last row
        name = rows["_how"].to_numpy() & ~3
        same = name[1:] == name[:-1]
        change = ~same
        for c in _BOX:
            v = rows[c].to_numpy()
            same = same & (v[1:] == v[:-1])
        at = np.flatnonzero(same)
        for c in ("score", "box_id"):
            at = at[pc.equal(rows[c].take(at), rows[c].take(at + 1)).to_numpy(zero_copy_only=False).astype(bool)] if len(at) else at
        new[1 + skip :], twin[at + 1 + skip] = change, True
        tile = number + np.cumsum(new)
        boxes = _Boxes.of(tile, x, y, w, h, how & 1 > 0)
        alive = ~twin
        if state is not None:
            head = np.flatnonzero(alive & (tile == number))
            gone, doubt = _beaten(state, boxes[head])
            alive[head[gone]] = False
            boxes.open[head] |= doubt
        here = np.flatnonzero(alive)
        some = boxes[here]
        stays = _settle(grid, some, most)
        boxes.open[here], alive[here] = some.open, stays
        final = boxes[np.flatnonzero(alive & (tile == tile[-1]))]
        if state is None or tile[-1] != number:
            state = _Index(grid, final)
        elif len(final):
            state = _Index(grid, final, state)
        number, last = int(tile[-1]), table.slice(size - 1)
        return table.append_column("_open", pa.array(boxes.open)).take(np.flatnonzero(alive & (how & 2 > 0))).select(out)

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= max(block, min(1 << 17, 2 * len(state.boxes) if state else 0)):
            yield from walk(pa.Table.from_batches(held)).to_batches()
            held, n = [], 0
    if n:
        yield from walk(pa.Table.from_batches(held)).to_batches()


def suppress_crowded(boxes: DataFrame, key: str, threshold: float = 0.45, least_score: float = 0.5, rounds: int = 40, few: int = 1 << 16) -> DataFrame:
    """key, box_id of the boxes that stay: the rows of `non_maximum_suppression`, for frames of any number of boxes. boxes: key, box_id, score, x, y, w, h, class_id.

    Frames are cut into tiles some 30 boxes wide (at a threshold of 0.45), each of which is also shown the boxes around it and walked best first by one task: a box is compared only
    with those of the cells around it that stay, and only these are remembered. A box at the edge of what a tile is shown may meet others beyond it, so it goes
    if a box that stays overlaps it too much, else it is open, as is what waits for an open box. A tile decides on its own boxes; those few that are still open, less what boxes of other tiles
    overlap too much, go to the next round, in which tiles lie elsewhere. Sizes of a factor beyond 16 have tiles of their own, which are shown the sizes beside theirs.

    A round settles chains (boxes of which each waits for a better one that it overlaps) inside a tile. What is open after `rounds` (scores that rise across a whole
    frame), or as soon as all frames together have at most `few` open boxes, is walked frame by frame and class by class in the same way. The result is the same either way.

    Rows whose score is null or not above least_score go. Boxes that are null in frame, class or geometry, without an area or with numbers that
    aren't finite overlap nothing and stay. Ties of scores go to the smallest box_id; of rows that repeat a frame's box_id the one on top by class, then geometry stays,
    if they are of one class. Scores are numbers (not NaN). Frames without boxes have no rows.
    """
    spark, grid = boxes.sparkSession, _Grid(threshold)
    kind = dict(boxes.dtypes)
    base = ["_key", "box_id", "score", "class_id", *_BOX]
    paths: list[str] = []

    def staged(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    rows = staged(boxes.where(F.col("score") > least_score).select(F.col(key).alias("_key"), "box_id", "score", "class_id", *(F.col(c).cast("double").alias(c) for c in _BOX)))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < math.inf)
    able = F.coalesce(F.col("_key").isNotNull() & F.col("class_id").isNotNull() & finite("x") & finite("y") & finite("w") & finite("h") & (F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    alive, done = rows.where(able), [rows.where(~able).select("_key", "box_id")]

    def walked(df: DataFrame) -> DataFrame:
        """Boxes with their tiles, walked: those that stay and those that are open, which `_open` tells."""
        kinds = dict(df.dtypes)
        order = [*_TILE, F.desc("score"), "box_id", *_BOX]
        dealt = df.repartition(*_TILE).sortWithinPartitions(*order)
        how = F.xxhash64(*_TILE).bitwiseAND(F.lit(-4)).bitwiseOR(F.col("_own").cast("long") * 2 + F.col("_open").cast("long"))
        dealt = dealt.select(*base, how.alias("_how"))
        out = [*base, "_open"]
        return staged(dealt.mapInArrow(partial(_walked, grid=grid, out=out), ", ".join(f"{c} {kinds[c]}" for c in out)))

    def tiled(df: DataFrame, shift: float) -> DataFrame:
        size = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).alias("size")) for c in "wh"))).alias("_s")
        log = F.log("size")
        levels = df.select(size).select("_s.*").groupBy("axis", F.floor(log / math.log(2)).alias("level")).agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"), F.sum(log).alias("logs"))
        found = levels.orderBy("level").collect()
        wide, high = (grid.bands([r for r in found if r.axis == c]) for c in "wh")
        shown = grid.tiles(grid.tiles(df, "x", "w", wide, shift, "x"), "y", "h", high, shift, "y")
        return shown.select(*base, *_TILE[2:], (F.col("_ownx") & F.col("_owny")).alias("_own"), (F.col("_openx") | F.col("_openy")).alias("_open"))

    (lw, cx), (lh, cy) = grid.cell("x", "w"), grid.cell("y", "h")
    place = ["_key", "class_id", *_CELL]

    def celled(df: DataFrame) -> DataFrame:
        return df.select(*base, lw.alias("_lw"), cx.alias("_cx"), lh.alias("_lh"), cy.alias("_cy"))

    def near(df: DataFrame) -> DataFrame:
        """Each box once for each cell that it may meet: some 25 rows, of which Spark's estimate of sizes knows nothing, so they are merged and never broadcast."""
        one = celled(df).withColumn("_a", F.explode(grid.around("x", "w", "_lw"))).withColumn("_b", F.explode(grid.around("y", "h", "_lh")))
        cell = F.col("_a.level").alias("_lw"), F.col("_a.cell").alias("_cx"), F.col("_b.level").alias("_lh"), F.col("_b.cell").alias("_cy")
        return one.select(*base, *cell).hint("merge")

    wide = F.least(F.col("l.x") + F.col("l.w"), F.col("r.x") + F.col("r.w")) - F.greatest("l.x", "r.x")
    high = F.least(F.col("l.y") + F.col("l.h"), F.col("r.y") + F.col("r.h")) - F.greatest("l.y", "r.y")
    both = F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)
    clash = both > threshold * (F.col("l.w") * F.col("l.h") + F.col("r.w") * F.col("r.h") - both)
    meet = [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in place), clash]

    left = alive.count()
    for turn in range(rounds):
        if left <= few:
            break
        old, before = paths[-1] if turn else None, left
        out = walked(tiled(alive, turn * 0.618 % 1))
        kept, unsure = out.where("not _open"), out.where("_open").select(base)
        done.append(kept.select("_key", "box_id"))
        if not (left := unsure.count()):
            break
        beaten = celled(kept).alias("l").join(near(unsure).alias("r"), meet).select(*(f"r.{c}" for c in base)).distinct()
        alive = staged(unsure.join(beaten, base, "left_anti"))
        left = alive.count()
        if old:
            unstaged(spark, old)
        if left == before:  # tiles beyond what numbers can tell apart
            break
    if left:
        whole = alive.select(*base, *(F.lit(0).alias(c) for c in _TILE[2:]), F.lit(True).alias("_own"), F.lit(False).alias("_open"))
        done.append(walked(whole).select("_key", "box_id"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_key").cast(kind[key]).alias(key), "box_id")
