"""Pixel arithmetic on images: colour, heat maps, augmentation, resizing, wavelets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.scalars import clip, unit_draw

# Channel means and deviations of the usual pretrained models, palette saturation
# and brightness, jitter ranges, confidence bands, luminance weights.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}
PALETTE_S, PALETTE_V = 0.65, 0.95
JITTER = {"brightness": 0.15, "contrast": 0.15, "saturation": 0.10}
BAND_HIGH, BAND_MEDIUM = 0.85, 0.60
LUMA = {"r": 0.299, "g": 0.587, "b": 0.114}
CHANNELS = ("r", "g", "b")


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= BAND_HIGH, "high").when(conf >= BAND_MEDIUM, "medium").otherwise("low")


def palette_colour(class_id: Column, classes: Column) -> Column:
    """Struct ``r, g, b`` of a class in a hue sweep over ``classes`` colours; class 0 is black."""
    hue = class_id / F.greatest(classes, F.lit(1))
    sector = F.floor(hue * 6.0)
    f = hue * 6.0 - sector
    v = F.lit(PALETTE_V)
    p = v * (1.0 - PALETTE_S)
    q = v * (1.0 - PALETTE_S * f)
    t = v * (1.0 - PALETTE_S * (1.0 - f))
    wheel = {
        "r": (v, q, p, p, t, v),
        "g": (t, v, v, q, p, p),
        "b": (p, p, t, v, v, q),
    }

    def channel(name: str) -> Column:
        values = wheel[name]
        value = values[5]
        for i in range(4, -1, -1):
            value = F.when(sector % 6 == i, values[i]).otherwise(value)
        return F.when(class_id == 0, 0).otherwise(F.floor(value * 255.0)).cast("int").alias(name)

    return F.struct(*[channel(c) for c in CHANNELS])


def colour_mask(pixels: DataFrame, value: str = "class_id") -> DataFrame:
    """Add ``r, g, b``; the palette size of a scene is its largest class id plus one."""
    sizes = pixels.groupBy("scene_id").agg((F.max(value) + 1).alias("_n"))
    rows = pixels.join(sizes, "scene_id").withColumn("_c", palette_colour(F.col(value), F.col("_n")))
    return rows.select(*pixels.columns, *[F.col(f"_c.{c}").alias(c) for c in CHANNELS])


def confidence_heat(pixels: DataFrame, conf: str = "confidence") -> DataFrame:
    """Add ``heat``: confidence stretched to 0..255 over its scene and truncated."""
    spread = pixels.groupBy("scene_id").agg(F.min(conf).alias("_lo"), F.max(conf).alias("_hi"))
    c, lo, hi = F.col(conf), F.col("_lo"), F.col("_hi")
    heat = F.floor((c - lo) / (hi - lo + 1e-8) * 255.0).cast("int")
    return pixels.join(spread, "scene_id").select(*pixels.columns, heat.alias("heat"))


def overlay(left: Column, right: Column, alpha: float = 0.5) -> Column:
    """Blend of two channel values."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    return left * (1.0 - alpha) + right * alpha


def normalise(pixels: DataFrame) -> DataFrame:
    """Scale 8-bit channels to 0..1 and standardise them."""
    return pixels.withColumns(
        {c: (F.col(c) / 255.0 - CHANNEL_MEAN[c]) / CHANNEL_STD[c] for c in CHANNELS}
    )


# ------------------------------------------------------------------ augmentation


def augmentation(sample: Column, seed: int, epoch: int, hflip: float = 0.5, vflip: float = 0.5, angles: Sequence[int] = (0, 90, 180, 270)) -> Column:
    """Struct ``hflip, vflip, angle`` drawn from (seed, epoch, sample).

    Image and mask rows of a sample compute the same draw, so they can be transformed separately.
    """
    if set(angles) - {0, 90, 180, 270}:
        raise ValueError("angles must be multiples of 90 below 360")

    def draw(what: str) -> Column:
        return unit_draw(seed, F.lit(epoch), sample, F.lit(what))

    choices = F.array(*[F.lit(a) for a in angles])
    index = F.floor(draw("angle") * len(angles)).cast("int")
    return F.struct(
        (draw("hflip") < hflip).alias("hflip"),
        (draw("vflip") < vflip).alias("vflip"),
        F.get(choices, index).alias("angle"),
    )


def transform_pixels(pixels: DataFrame, change: Column, height: Column, width: Column) -> DataFrame:
    """Move pixels by flips and a counter-clockwise turn about the centre; the canvas keeps its
    size, so a turned non-square image loses the pixels that leave it."""
    rows = pixels.withColumns({"_t": change, "_h": height, "_w": width})
    h, w = F.col("_h"), F.col("_w")
    col = F.when(F.col("_t.hflip"), w - 1 - F.col("col_idx")).otherwise(F.col("col_idx"))
    row = F.when(F.col("_t.vflip"), h - 1 - F.col("row_idx")).otherwise(F.col("row_idx"))
    rows = rows.withColumns({"_c": col, "_r": row})
    c, r, angle = F.col("_c"), F.col("_r"), F.col("_t.angle")
    shift = F.floor((w - h) / 2.0)
    turned_row = (
        F.when(angle == 90, w - 1 - c - shift).when(angle == 180, h - 1 - r).when(angle == 270, c - shift).otherwise(r)
    )
    turned_col = (
        F.when(angle == 90, r + shift).when(angle == 180, w - 1 - c).when(angle == 270, h - 1 - r + shift).otherwise(c)
    )
    moved = rows.withColumns({"row_idx": turned_row.cast("long"), "col_idx": turned_col.cast("long")})
    inside = (F.col("row_idx") >= 0) & (F.col("row_idx") < h) & (F.col("col_idx") >= 0) & (F.col("col_idx") < w)
    return moved.where(inside).select(*pixels.columns)


def jitter_factors(sample: Column, seed: int, epoch: int) -> Column:
    """Struct of brightness, contrast and saturation factors around 1."""
    return F.struct(
        *[
            (1.0 - span + 2.0 * span * unit_draw(seed, F.lit(epoch), sample, F.lit(name))).alias(name)
            for name, span in JITTER.items()
        ]
    )


def colour_jitter(pixels: DataFrame, seed: int, epoch: int, sample: str = "scene_id") -> DataFrame:
    """Random brightness, contrast and saturation of an image; its mask is left alone."""
    rows = pixels.withColumn("_f", jitter_factors(F.col(sample), seed, epoch))

    def luma(columns: dict[str, Column]) -> Column:
        return sum((LUMA[c] * columns[c] for c in CHANNELS), F.lit(0.0))

    bright = {c: clip(F.col(c) * F.col("_f.brightness"), 0.0, 255.0) for c in CHANNELS}
    rows = rows.withColumns({f"_{c}": v for c, v in bright.items()})
    means = rows.groupBy(sample).agg(F.avg(luma({c: F.col(f"_{c}") for c in CHANNELS})).alias("_mean"))
    rows = rows.join(means, sample)
    k = F.col("_f.contrast")
    contrast = {c: clip(F.col(f"_{c}") * k + F.col("_mean") * (1.0 - k), 0.0, 255.0) for c in CHANNELS}
    rows = rows.withColumns({f"_{c}": v for c, v in contrast.items()})
    grey = luma({c: F.col(f"_{c}") for c in CHANNELS})
    s = F.col("_f.saturation")
    final = {c: clip(F.col(f"_{c}") * s + grey * (1.0 - s), 0.0, 255.0).alias(c) for c in CHANNELS}
    return rows.select(*[final.get(c, F.col(c)) for c in pixels.columns])


# ------------------------------------------------------------------ resizing


def resize_nearest(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Each output pixel copies the input pixel under its centre."""

    def outputs(position: Column, old: int, new: int) -> Column:
        # candidates around the inverse image, then the exact forward rule
        low = F.greatest(F.floor(position * new / old) - 1, F.lit(0))
        high = F.least(F.ceil((position + 1) * new / F.lit(old)) + 1, F.lit(new - 1))
        source = lambda i: F.floor((i + 0.5) * (old / new))
        return F.filter(F.sequence(low, high), lambda i: source(i) == position)

    rows = pixels.withColumn("_row", F.explode(outputs(F.col("row_idx"), height, new_height)))
    rows = rows.withColumn("_col", F.explode(outputs(F.col("col_idx"), width, new_width)))
    return rows.select(
        *[
            F.col("_row").cast("long").alias(c) if c == "row_idx"
            else F.col("_col").cast("long").alias(c) if c == "col_idx"
            else F.col(c)
            for c in pixels.columns
        ]
    )


def _bilinear_targets(position: Column, old: int, new: int) -> Column:
    """Output positions an input position contributes to, with normalised triangle weights.

    The triangle widens with the scale when the image shrinks.
    """
    scale = old / new
    reach = max(scale, 1.0)

    def span(i: Column) -> tuple[Column, Column, Column]:
        centre = (i + 0.5) * scale
        low = F.greatest(F.floor(centre - reach + 0.5), F.lit(0)).cast("int")
        high = F.least(F.floor(centre + reach + 0.5), F.lit(old)).cast("int")
        return centre, low, high

    def weight(i: Column, j: Column) -> Column:
        centre, _, _ = span(i)
        return F.greatest(1.0 - F.abs((j + 0.5 - centre) / reach), F.lit(0.0))

    def share(i: Column) -> Column:
        _, low, high = span(i)
        total = F.aggregate(F.sequence(low, high - 1), F.lit(0.0), lambda s, j: s + weight(i, j))
        return weight(i, position) / total

    first = F.greatest(F.floor((position + 0.5 - reach) / scale - 0.5) - 1, F.lit(0)).cast("int")
    last = F.least(F.ceil((position + 0.5 + reach) / scale - 0.5) + 1, F.lit(new - 1)).cast("int")
    touching = F.filter(
        F.sequence(first, last),
        lambda i: (span(i)[1] <= position) & (position < span(i)[2]) & (weight(i, position) > 0),
    )
    return F.transform(touching, lambda i: F.struct(i.alias("at"), share(i).alias("w")))


def resize_bilinear(pixels: DataFrame, values: Sequence[str], height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Separable triangle filter: rows are spread to the outputs they feed and summed there."""
    rows = pixels.withColumn("_r", F.explode(_bilinear_targets(F.col("row_idx"), height, new_height)))
    rows = rows.withColumn("_c", F.explode(_bilinear_targets(F.col("col_idx"), width, new_width)))
    w = F.col("_r.w") * F.col("_c.w")
    return rows.groupBy(
        "scene_id", F.col("_r.at").cast("long").alias("row_idx"), F.col("_c.at").cast("long").alias("col_idx")
    ).agg(*[F.sum(w * F.col(v)).alias(v) for v in values])


# ------------------------------------------------------------------ wavelet

# Signs of the four 2 x 2 filters at (0,0), (0,1), (1,0), (1,1)
HAAR = {
    "ll": (1, 1, 1, 1),
    "lh": (-1, -1, 1, 1),
    "hl": (-1, 1, -1, 1),
    "hh": (1, -1, -1, 1),
}
HAAR_SCALE = 0.5 * 2.0**-0.5


def haar(pixels: DataFrame, value: str, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Four sub-bands of each 2 x 2 cell; an odd last row or column is dropped."""
    place = (F.col("row_idx") % 2) * 2 + F.col("col_idx") % 2

    def band(signs: tuple[int, ...]) -> Column:
        sign = F.get(F.array(*[F.lit(s) for s in signs]), place.cast("int"))
        return F.sum(sign * F.col(value)) * HAAR_SCALE

    return (
        pixels.groupBy(
            *by,
            F.floor(F.col("row_idx") / 2).cast("long").alias("row_idx"),
            F.floor(F.col("col_idx") / 2).cast("long").alias("col_idx"),
        )
        .agg(F.count("*").alias("_n"), *[band(signs).alias(name) for name, signs in HAAR.items()])
        .where("_n = 4")
        .drop("_n")
    )
