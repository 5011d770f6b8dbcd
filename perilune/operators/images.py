"""Images as rows of bytes: tiles, reassembly and network input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Means and deviations of the channels that the region network was trained with.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def image_tiles(images: DataFrame, key: str, width: str, height: str, pixels: str, tile_width: int = 64, tile_height: int = 32, depth: int = 1) -> DataFrame:
    """key, tile_idx (by rows of tiles), tile: the bytes of each tile, row by row; what lies beyond the image is black. pixels: bytes by row, `depth` a pixel."""
    across, down = F.ceil(F.col(width) / tile_width).cast("int"), F.ceil(F.col(height) / tile_height).cast("int")
    rows = images.select(key, F.col(width).alias("_w"), F.col(height).alias("_h"), F.col(pixels).alias("_p"), across.alias("_n"), F.explode(F.sequence(F.lit(0), across * down - 1)).alias("tile_idx"))
    x, y = F.col("tile_idx") % F.col("_n") * tile_width, F.floor(F.col("tile_idx") / F.col("_n")).cast("int") * tile_height
    black = F.lit(bytes(tile_width * depth))
    room = F.least(F.lit(tile_width), F.col("_w") - x) * depth

    def line(a: Column, k: Column) -> Column:
        part = F.substring(F.col("_p"), (((y + k) * F.col("_w") + x) * depth + 1).cast("int"), room.cast("int"))
        return F.concat(a, F.when(y + k < F.col("_h"), F.substring(F.concat(part, black), 1, tile_width * depth)).otherwise(black))

    tile = F.aggregate(F.sequence(F.lit(0), F.lit(tile_height - 1)), F.lit(b""), line)
    return rows.select(key, "tile_idx", tile.alias("tile"))


def paste_tiles(tiles: DataFrame, key: str, width: str, height: str, tile: str = "tile", tile_width: int = 64, tile_height: int = 32, depth: int = 1) -> DataFrame:
    """key, pixels: images put together again from tiles (key, tile_idx, width, height); missing tiles are black, padding goes. Lines are joined first, so an image reaches its task as whole lines."""
    n = F.ceil(F.col(width) / tile_width).cast("int")
    line = F.substring(F.col(tile), F.col("_k") * tile_width * depth + 1, F.lit(tile_width * depth))
    rows = tiles.select(key, F.col(width).alias("_w"), F.col(height).alias("_h"), n.alias("_n"), "tile_idx", tile, F.explode(F.sequence(F.lit(0), F.lit(tile_height - 1))).alias("_k"))
    rows = rows.select(key, "_w", "_h", "_n", (F.col("tile_idx") % F.col("_n")).alias("_x"), (F.floor(F.col("tile_idx") / F.col("_n")).cast("int") * tile_height + F.col("_k")).alias("_y"), line.alias("_l")).where("_y < _h")
    lines = rows.groupBy(key, "_w", "_h", "_n", "_y").agg(F.map_from_entries(F.collect_list(F.struct("_x", "_l"))).alias("_m"))
    black = F.lit(bytes(tile_width * depth))
    whole = F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), F.lit(b""), lambda a, x: F.concat(a, F.coalesce(F.try_element_at("_m", x), black)))
    lines = lines.select(key, "_w", "_h", "_y", F.substring(whole, F.lit(1), (F.col("_w") * depth).cast("int")).alias("_l"))
    images = lines.groupBy(key, "_w", "_h").agg(F.map_from_entries(F.collect_list(F.struct("_y", "_l"))).alias("_m"))
    none = F.unhex(F.repeat(F.lit("00"), (F.col("_w") * depth).cast("int")))
    pixels = F.aggregate(F.sequence(F.lit(0), F.col("_h") - 1), F.lit(b""), lambda a, y: F.concat(a, F.coalesce(F.try_element_at("_m", y), none)))
    return images.select(key, pixels.alias("pixels"))


def channels_first(pixels: Column, means: tuple[float, ...] = MEANS, deviations: tuple[float, ...] = DEVIATIONS) -> Column:
    """An array of pixel values (0 to 255, channels of a pixel together) as one plane a channel, each value / 255 less the mean, by the deviation. With means 0 and deviations 1: the landmark network's input."""
    n, depth = F.size(pixels), len(means)
    plane = lambda k: F.transform(F.filter(pixels, lambda x, i: i % depth == k), lambda x: (x / 255.0 - means[k]) / deviations[k])
    return F.when(n % depth == 0, F.concat(*(plane(k) for k in range(depth))))
