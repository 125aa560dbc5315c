"""Where on an image its table lies: the window of 40 % of the height that holds most boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

SHARE, LEAST, WIDTH = 0.4, 4, 0.2


def text_blocks(boxes: DataFrame) -> DataFrame:
    """Boxes (x1, y1, x2, y2, width, height of the image) shaped like text: 2 to 60 times as wide as tall, over 200 and under 15 % of the image in area."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect, area = w / F.greatest(h, F.lit(1)), w * h
    return boxes.where((aspect > 2) & (aspect < 60) & (area > 200) & (area < F.col("width") * F.col("height") * 0.15))


def densest_window(boxes: DataFrame, share: float = SHARE, least: int = LEAST, width: float = WIDTH) -> DataFrame:
    """(image_id, x1, y1, x2, y2, n): what encloses the boxes of the densest window.

    A window begins at the top of a box and holds the boxes that lie within ``share`` of the image's
    height; of equal ones the highest counts, which must hold ``least`` boxes and span
    more than ``width`` of the image. Boxes (image_id, x1, y1, x2, y2, width, height) of an image meet in one
    row and are counted by height: those that end in time less those that began before; taller ones than
    the window fit in none.
    """
    images = boxes.groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"), F.first("width").alias("width"), F.first("height").alias("height"))
    return densest_of_images(images, share, least, width)


def text_images(tokens: DataFrame) -> DataFrame:
    """(image_id, width, height, boxes): the ``text_blocks`` of each image, whose size is that of its tokens."""
    # What a box must have besides the share of the image's area, which is not known yet.
    one = tokens.select("image_id", F.struct("x1", "y1", "x2", "y2").alias("box"), *(F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = w / F.greatest(h, F.lit(1))
    shaped = (aspect > 2) & (aspect < 60) & (w * h > 200)
    images = one.groupBy("image_id").agg(F.max("x2").alias("width"), F.max("y2").alias("height"), F.collect_list(F.when(shaped, F.col("box"))).alias("_all"))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    small = F.filter("_all", lambda b: area(b) < F.col("width") * F.col("height") * 0.15)
    return images.select("image_id", "width", "height", small.alias("boxes"))


def densest_of_images(images: DataFrame, share: float = SHARE, least: int = LEAST, width: float = WIDTH) -> DataFrame:
    """``densest_window`` of images (image_id, width, height, boxes) whose boxes are an array."""
    room = F.floor(F.col("height") * share).cast("long")
    images = R.once(images.where(F.size("boxes") >= least), _room=room)
    fit = F.filter("boxes", lambda b: b["y2"] - b["y1"] <= F.col("_room"))
    images = R.once(images, boxes=fit, _tops=F.array_distinct(F.col("boxes")["y1"]))
    # Places doubled, so that tops come after ends that equal them among ``_ended`` and before tops among ``_began``. A top is as far from
    # the beginning as there are earlier tops and, here, boxes that end in time, there, boxes that began before.
    twice = lambda c, more=0: F.transform(c, lambda y: y.cast("long") * 2 + more)
    ended = F.concat(twice(F.col("boxes")["y2"], -2 * F.col("_room")), twice("_tops", 1))
    began = F.concat(twice(F.col("boxes")["y1"], 1), twice("_tops"))
    images = R.once(images, _ended=F.sort_array(ended), _began=F.sort_array(began))
    at = lambda c, y: F.array_position(c, y.cast("long") * 2 + (1 if c == "_ended" else 0))
    best = F.array_min(F.transform("_tops", lambda y: F.struct((at("_began", y) - at("_ended", y)).alias("k"), y.alias("top"))))
    images = R.once(images, _b=best).where(F.col("_b.k") <= -least)
    images = R.once(images, _in=F.filter("boxes", lambda b: (b["y1"] >= F.col("_b.top")) & (b["y2"] <= F.col("_b.top") + F.col("_room"))))
    hull = images.select("image_id", *(f(F.col(f"_in.{c}")).alias(c) for c, f in (("x1", F.array_min), ("y1", F.array_min), ("x2", F.array_max), ("y2", F.array_max))), F.size("_in").cast("long").alias("n"), "width")
    return hull.where(F.col("x2") - F.col("x1") > F.col("width") * width).drop("width")


def file_name(number: Column, name: Column) -> Column:
    """The number with the name's extension in lower case."""
    return F.concat(number.cast("string"), F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)))


def dense_ids(rows: DataFrame, order: list[str], ranges: int = 256) -> DataFrame:
    """``rows`` with ``id``: 1, 2, ... in ``order``, whose values together are distinct.

    Rows are dealt to about ``ranges`` ranges of the order, bounded by values drawn by hash; each is numbered
    by itself, after the numbers of the ranges before it. Only the bounds and the ranges'
    counts, ``ranges`` of each, pass through the driver; no window holds all rows.
    """
    key = F.struct(*order)
    drawn = rows.select(key.alias("_k")).groupBy(F.pmod(F.xxhash64("_k"), F.lit(ranges)).alias("_h")).agg(F.min_by("_k", F.xxhash64("_k", F.lit(1))).alias("_k"))
    bounds = drawn.agg(F.array_sort(F.collect_list("_k")).alias("_bounds"))
    # One row, of at most ``ranges`` values.
    dealt = rows.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")
    counts = sorted(dealt.groupBy("_range").count().collect())
    start, total = {}, 0
    for r, n in counts:
        start[r], total = total, total + n
    first = F.create_map(*(F.lit(x) for r, n in start.items() for x in (r, n))) if start else F.create_map(F.lit(0), F.lit(0))
    by = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("id", (F.row_number().over(by) + F.element_at(first, F.col("_range"))).cast("long")).drop("_range")
