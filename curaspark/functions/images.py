"""Checks on encoded images. Only the header is read; pixels are never decoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.text import let, strip

# Limits of the vision models and of the renderer.
MAX_PIXELS = 1280 * 1280
MAX_RATIO = 199
MAX_RENDER_RATIO = 100
MAX_RENDER_SIDE = 16384


def is_image_text(image: Column) -> Column:
    """Looks like an encoded image: longer than 100 characters, and marked as one or longer than 200."""
    return F.coalesce(
        let(strip(image), lambda s: (F.length(s) > 100) & (s.startswith("data:image") | (F.length(s) > 200))), F.lit(False)
    )


def image_bytes(image: Column) -> Column:
    """Decoded bytes of a base64 text with or without a ``data:`` prefix; NULL when it does not decode."""
    return F.try_to_binary(F.when(image.contains(","), F.get(F.split(image, ","), F.lit(1))).otherwise(image), F.lit("base64"))


def png_size(image: Column) -> Column:
    """Width and height from the header of a base64 PNG; NULL for anything else.

    The header sits in the first 24 bytes, so only the first 32 base64 characters are decoded.
    """
    body = F.when(image.contains(","), F.get(F.split(image, ",", 2), F.lit(1))).otherwise(image)
    head = F.hex(F.try_to_binary(F.substring(strip(body), 1, 32), F.lit("base64")))

    def size(h: Column) -> Column:
        def number(start: int) -> Column:
            return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")

        return F.when(
            h.startswith("89504E470D0A1A0A") & (F.length(h) >= 48),
            F.struct(number(33).alias("width"), number(41).alias("height")),
        )

    return let(head, size)


def ratio(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))


def is_renderable_size(width: Column, height: Column) -> Column:
    """Neither side zero or above the limit, and not stretched beyond the aspect limit."""
    return (
        (width > 0)
        & (height > 0)
        & (ratio(width, height) <= MAX_RENDER_RATIO)
        & (width <= MAX_RENDER_SIDE)
        & (height <= MAX_RENDER_SIDE)
    )


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))


def _cap_ratio(s: Column) -> Column:
    w, h = s["width"], s["height"]
    wide = _size(F.greatest(F.when(w >= h, h * MAX_RATIO).otherwise(w), F.lit(1)), F.greatest(F.when(w >= h, h).otherwise(w * MAX_RATIO), F.lit(1)))
    return F.when(F.greatest(w, h) / F.least(w, h) > MAX_RATIO, wide).otherwise(s)


def target_size(width: Column, height: Column, max_pixels: int = MAX_PIXELS) -> Column:
    """Size an image is brought to: aspect capped, then pixels, then the aspect again if rounding moved it."""

    def cap_pixels(s: Column) -> Column:
        w, h = s["width"], s["height"]
        scale = F.sqrt(F.lit(float(max_pixels)) / (w * h))
        smaller = _size(F.greatest(F.floor(w * scale), F.lit(1)), F.greatest(F.floor(h * scale), F.lit(1)))
        return F.when(w * h > max_pixels, let(smaller, _cap_ratio)).otherwise(s)

    size = _size(width, height)
    return F.when((width == 0) | (height == 0), size).otherwise(let(let(size, _cap_ratio), cap_pixels))


def bounded_size(width: Column, height: Column, min_pixels: int | None, max_pixels: int | None) -> Column:
    """Size under an upper and over a lower pixel bound, aspect kept; then the aspect is capped at the model limit.

    A size with a zero side has no aspect and stays as it is.
    """

    def scaled(s: Column, pixels: int) -> Column:
        factor = F.sqrt(F.try_divide(F.lit(float(pixels)), s["width"] * s["height"]))
        return _size(F.floor(s["width"] * factor), F.floor(s["height"] * factor))

    size = _size(width, height)
    if max_pixels is not None:
        size = let(size, lambda s: F.when(s["width"] * s["height"] > max_pixels, scaled(s, max_pixels)).otherwise(s))
    if min_pixels is not None:
        size = let(size, lambda s: F.when(s["width"] * s["height"] < min_pixels, scaled(s, min_pixels)).otherwise(s))

    def cap(s: Column) -> Column:
        w, h = s["width"], s["height"]
        at_limit = (w > 0) & (h > 0) & (F.greatest(w, h) / F.least(w, h) >= MAX_RATIO + 1)
        return F.when(at_limit, _size(F.least(w, h * MAX_RATIO), F.least(h, w * MAX_RATIO))).otherwise(s)

    return F.when((width == 0) | (height == 0), _size(width, height)).otherwise(let(size, cap))
