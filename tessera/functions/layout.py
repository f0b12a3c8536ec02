"""Crop rectangles and the grid, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
# The canvas.
CANVAS_W, CANVAS_H, PAD, HEADER = 1080, 1920, 40, 200


def _box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1"))


def _low(x: Column, at) -> Column:
    return F.greatest(F.lit(0.0) if isinstance(at, int) else at, x)


def crop_embed(margin: float = 0.20) -> Column:
    """Box grown by a margin, whole pixels (towards zero), inside the frame, at least one pixel."""
    mx, my = c("face_w") * margin, c("face_h") * margin
    left = F.least(F.greatest((c("box_left") - mx).cast("int"), F.lit(0)), c("frame_w") - 1)
    top = F.least(F.greatest((c("box_top") - my).cast("int"), F.lit(0)), c("frame_h") - 1)
    right = F.greatest(left + 1, F.least((c("box_right") + mx).cast("int"), c("frame_w")))
    bottom = F.greatest(top + 1, F.least((c("box_bottom") + my).cast("int"), c("frame_h")))
    return _box(left, top, right, bottom)


def crop_best(margin: float = 0.40) -> Column:
    mx, my = c("face_w") * margin, c("face_h") * margin
    left = F.least(F.greatest((c("box_left") - mx).cast("int"), F.lit(0)), c("frame_w") - 1)
    top = F.least(F.greatest((c("box_top") - my).cast("int"), F.lit(0)), c("frame_h") - 1)
    right = F.least(F.greatest((c("box_right") + mx).cast("int"), left + 1), c("frame_w"))
    bottom = F.least(F.greatest((c("box_bottom") + my).cast("int"), top + 1), c("frame_h"))
    return _box(left, top, right, bottom)


def _around(side: Column, up: Column, down: Column) -> Column:
    x, y = (c("box_left") + c("box_right")) / 2, (c("box_top") + c("box_bottom")) / 2
    return _box(F.greatest(F.lit(0.0), x - side), F.greatest(F.lit(0.0), y - up), F.least(c("frame_w").cast("double"), x + side), F.least(c("frame_h").cast("double"), y + down))


def crop_context(image_w: Column | None = None, image_h: Column | None = None) -> Column:
    """Centre of the box, 2.2 widths to the sides, 2.8 heights up and 3.5 down, inside the image.

    With the size of the image, in its pixels: the box is scaled from the frame that it was found in, by 1 where that frame has no size.
    """
    image_w, image_h = c("frame_w") if image_w is None else image_w, c("frame_h") if image_h is None else image_h
    sx = F.when(c("frame_w") > 0, image_w / c("frame_w")).otherwise(1.0)
    sy = F.when(c("frame_h") > 0, image_h / c("frame_h")).otherwise(1.0)
    x, y = (c("box_left") + c("box_right")) / 2 * sx, (c("box_top") + c("box_bottom")) / 2 * sy
    w, h = (c("box_right") - c("box_left")) * sx, (c("box_bottom") - c("box_top")) * sy
    return _box(F.greatest(F.lit(0.0), x - w * 2.2), F.greatest(F.lit(0.0), y - h * 2.8), F.least(image_w.cast("double"), x + w * 2.2), F.least(image_h.cast("double"), y + h * 3.5))


def crop_thumbnail() -> Column:
    return _around(c("face_w") / 2 + c("face_w"), c("face_h") / 2 + c("face_h") * 1.5, c("face_h") / 2 + c("face_h") * 3.0)


def fit(inner_w: Column, inner_h: Column, crop_w: Column, crop_h: Column) -> Column:
    """Cover the inner rectangle: scale, centred sideways, a tenth of the excess above."""
    scale = F.greatest(inner_w / crop_w, inner_h / crop_h)
    return F.struct(scale.alias("scale"), ((inner_w - crop_w * scale) / 2).alias("dx"), ((inner_h - crop_h * scale) * 0.10).alias("dy"))


def grid(df: DataFrame, partition: str, order: str) -> DataFrame:
    """Place, cell and columns of each row of a partition: one column for one row, else two."""
    n = F.count("*").over(Window.partitionBy(partition))
    i = F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1
    df = df.withColumn("columns", F.when(n == 1, 1).otherwise(2)).withColumn("n_rows", F.ceil(n / F.col("columns")).cast("int"))
    df = df.withColumn("grid_col", (i % F.col("columns")).cast("int")).withColumn("grid_row", F.floor(i / F.col("columns")).cast("int"))
    df = df.withColumn("cell_w", (CANVAS_W - PAD * (F.col("columns") + 1)) / F.col("columns")).withColumn("cell_h", (CANVAS_H - HEADER - PAD * (F.col("n_rows") + 1)) / F.col("n_rows"))
    return df.withColumn("cell_x", PAD + F.col("grid_col") * (F.col("cell_w") + PAD)).withColumn("cell_y", HEADER + PAD + F.col("grid_row") * (F.col("cell_h") + PAD))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def relabel(df: DataFrame, partition: str, order: str, prefix: str = "Person ") -> DataFrame:
    at = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    return df.withColumn("display_id", at).withColumn("label", F.concat(F.lit(prefix), at.cast("string")))
