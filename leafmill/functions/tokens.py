"""Image, video and prompt sizes in tokens, and strategies chosen by size. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 32
MOST, LEAST = 16384 * 1024, 4 * 1024


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def image_tokens(width: Column, height: Column) -> Column:
    """What a vision model charges: sides in multiples of 32, the area held within bounds by scaling.

    A side under 16 rounds to nothing, for which there is no scale: null.
    """
    w, h = width.cast("double"), height.cast("double")
    wr, hr = js_round(w / SIDE) * SIDE, js_round(h / SIDE) * SIDE
    area = (wr * hr).cast("double")
    shrink, grow = F.sqrt(w * h / MOST), F.sqrt(F.lit(float(LEAST)) / area)
    small = F.floor(w / shrink / SIDE) * SIDE * F.floor(h / shrink / SIDE) * SIDE
    large = F.ceil(wr * grow / SIDE) * SIDE * F.ceil(hr * grow / SIDE) * SIDE
    scaled = F.when(area > MOST, small.cast("double")).when(area < LEAST, large.cast("double")).otherwise(area)
    return F.when(area > 0, js_round(scaled / 1024).cast("long") + 2)


def image_tokens_simple(width: Column, height: Column) -> Column:
    return (F.ceil(width / SIDE) * F.ceil(height / SIDE)).cast("long") + 2


def video_tokens(frames: Column, frame_tokens: Column) -> Column:
    return (F.ceil(frames / 2) * (frame_tokens - 2)).cast("long") + 2


def frames_of(size_bytes: Column, fps: Column, most: int | None = 2000) -> Column:
    """Frames of a video of 5 MBit a second."""
    n = js_round(size_bytes / F.lit(5 * 2**20 / 8) * fps).cast("long")
    return n if most is None else F.least(n, F.lit(most))


def strategy(pages: Column, asked: Column | None = None) -> Column:
    """50 pages at most one by one, 200 at most in packs, more as a batch; a known name overrides."""
    auto = F.when(pages <= 50, "concurrent").when(pages <= 200, "multi-image").otherwise("batch")
    if asked is None:
        return auto
    named = translate_strategy(asked)
    return F.when(named.isin("concurrent", "multi-image", "batch"), named).otherwise(auto)


def translate_strategy(asked: Column) -> Column:
    return F.when(asked == "realtime", "concurrent").when(asked == "multi_image", "multi-image").otherwise(asked)


def media_chunks(duration: Column, chunk: float) -> Column:
    """``index, start, end`` of the stretches of a recording; none for one without length."""
    n = F.ceil(duration / chunk).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), (i * F.lit(chunk)).alias("start"), F.least((i + 1) * F.lit(chunk), duration).alias("end")))
    return F.when(duration > 0, each).otherwise(F.array().cast("array<struct<index:int,start:double,end:double>>"))


def native_scale(probes: Column, megapixels: Column, ladder: list[float], gain: float = 0.75, most: float = 25.0) -> Column:
    """The scale at which a scanned page gives no more detail.

    ``probes``: bytes per pixel at each step of the ladder, ``megapixels`` the size at each. Goes up
    while the size is allowed and the detail doesn't fall under ``gain`` of the step before.
    """
    steps = F.array(*[F.lit(float(s)) for s in ladder])
    rows = F.arrays_zip(steps.alias("s"), probes.alias("b"), megapixels.alias("m"))
    start = F.struct(F.element_at(steps, 1).alias("best"), F.lit(None).cast("double").alias("last"), F.lit(False).alias("done"))

    def step(a, r):
        stop = a["done"] | (r["m"] > most) | (a["last"].isNotNull() & (r["b"] < a["last"] * gain))
        return F.when(stop, F.struct(a["best"].alias("best"), a["last"].alias("last"), F.lit(True).alias("done"))).otherwise(
            F.struct(r["s"].alias("best"), r["b"].cast("double").alias("last"), F.lit(False).alias("done"))
        )

    return F.aggregate(rows, start, step, lambda a: a["best"])


def pdf_kind(bpp1: Column, bpp2: Column) -> Column:
    """``image`` if doubling the scale adds hardly any detail, or there is much detail to begin with.

    A first share of 0 is ``image`` if the second isn't 0, as a ratio without bound is.
    """
    ratio = F.when(bpp1 != 0, bpp2 / bpp1)
    return F.when(((bpp1 == 0) & (bpp2 > 0)) | (ratio > 0.8) | ((bpp1 > 0.35) & (ratio > 0.7)), "image").otherwise("text")


def render_scale(asked: Column, native: Column, kind: Column, width_pt: Column, height_pt: Column, max_side: float = 4096.0, max_megapixels: float = 25.0) -> Column:
    """Asked scale for text pages, 80 % of the native one at least for scans; both sizes limited."""
    base = F.when((kind == "image") & (asked < native * 0.8), native).otherwise(F.coalesce(asked, native))
    by_side = F.lit(max_side) / F.greatest(width_pt, height_pt)
    by_area = F.sqrt(F.lit(max_megapixels * 1e6) / (width_pt * height_pt))
    return F.least(base, by_side, by_area)


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, padding: float = 0.4) -> Column:
    """A box on the 0..1000 grid with padding, in whole pixels inside the image."""
    pw, ph = (x2 - x1) * padding, (y2 - y1) * padding
    left, top = F.greatest(F.lit(0), F.floor((x1 - pw) / 1000 * width)), F.greatest(F.lit(0), F.floor((y1 - ph) / 1000 * height))
    right, bottom = F.least(width, F.ceil((x2 + pw) / 1000 * width)), F.least(height, F.ceil((y2 + ph) / 1000 * height))
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), (right - left).cast("int").alias("width"), (bottom - top).cast("int").alias("height"))


def output_quality(size_bytes: Column) -> Column:
    return F.when(size_bytes > 10 * 2**20, 80).when(size_bytes > 5 * 2**20, 88).otherwise(95)


#: Image quality that a document's image has at least, and those taken where none is asked for (fixed values).
LEAST_OCR_QUALITY, OCR_QUALITY, PLAIN_QUALITY = 92, 95, 90


def image_quality(asked: Column, is_document: Column) -> Column:
    """The quality an image is encoded with: a document's has a floor."""
    given = F.coalesce(asked, F.when(is_document, OCR_QUALITY).otherwise(PLAIN_QUALITY))
    return F.when(is_document, F.greatest(given, F.lit(LEAST_OCR_QUALITY))).otherwise(given)


def too_large(size_bytes: Column, media: Column, local_video: int = 100 * 2**20, image: int = 20 * 2**20) -> Column:
    """``Too large: x MB`` for images and recordings above their limits, else null."""
    said = F.concat(F.lit("Too large: "), F.format_string("%.1f", size_bytes / F.lit(float(2**20))), F.lit(" MB"))
    return F.when((media == "image") & (size_bytes > image), said).when((media == "video") & (size_bytes > local_video), F.concat(said, F.lit(". Use chunks.")))
