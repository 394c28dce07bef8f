"""Box tables: coordinates, overlap joins, suppression, tiling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.text import round_half_up
from redactframe.session import cut_lineage


def unletterbox(faces: DataFrame) -> DataFrame:
    """Relative boxes in the padded square back to clamped pixels of the original image.

    Input: width, height, ymin, xmin, ymax, xmax.
    """
    side = F.lit(float(rules.LETTERBOX_SIDE))
    scale = F.least(side / F.col("width"), side / F.col("height"))
    dx, dy = (side - F.col("width") * F.col("scale")) / 2, (side - F.col("height") * F.col("scale")) / 2

    def back(v: str, offset: Column, most: str) -> Column:
        px = round_half_up((F.col(v) * side - offset) / F.col("scale"))
        return F.greatest(F.lit(0).cast("long"), F.least(F.col(most).cast("long"), px))

    return faces.withColumn("scale", scale).withColumn("dx", dx).withColumn("dy", dy).select(
        "face_id", back("xmin", F.col("dx"), "width").alias("x1"), back("ymin", F.col("dy"), "height").alias("y1"),
        back("xmax", F.col("dx"), "width").alias("x2"), back("ymax", F.col("dy"), "height").alias("y2"))


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x2") - F.col(f"{p}x1")) * F.greatest(F.lit(0.0), F.col(f"{p}y2") - F.col(f"{p}y1"))


def intersection(a: str, b: str) -> Column:
    w = F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")
    h = F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1")
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: str, b: str, epsilon: float = 1e-6) -> Column:
    """Overlap over union; a small epsilon in the denominator, or 0 for an empty union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter + epsilon
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def overlap_pairs(
    left: DataFrame, right: DataFrame, group: str, min_iou: float, epsilon: float = 1e-6
) -> DataFrame:
    """Pairs of boxes of the same group with IoU >= ``min_iou`` (> 0), as l_*, r_* and iou.

    A group join would form every pair of a group. Two necessary conditions make an
    equi-join: areas within a factor 1/min_iou (so size classes differ by a bounded number of
    steps), and a shared cell of a grid whose cells grow with the size class. A pair is
    reported only in the cell of its intersection's top left corner, so nothing is counted
    twice and no distinct is needed. The cells are always shuffled: sized by its table, a side
    would be broadcast through the driver with many times the rows that the planner knows of.
    """
    reach = max(1, math.ceil(math.log(1 / min_iou, 4)))

    def sized(df: DataFrame, p: str) -> DataFrame:
        named = df.select(group, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != group])
        usable = named.filter((F.col(f"{p}x2") > F.col(f"{p}x1")) & (F.col(f"{p}y2") > F.col(f"{p}y1")))
        return usable.withColumn(f"{p}level", F.floor(F.log2(area(p)) / 2).cast("int"))

    def cells(df: DataFrame, p: str) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("level") + 2)
        at = lambda c: F.floor(F.col(f"{p}{c}") / side)
        return df.withColumn("cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn(
            "cy", F.explode(F.sequence(at("y1"), at("y2"))))

    l = cells(sized(left, "l_").withColumn("level", F.col("l_level")), "l_")
    steps = F.sequence(F.col("r_level") - reach, F.col("r_level") + reach)
    r = cells(sized(right, "r_").withColumn("level", F.explode(steps)), "r_")
    side = F.pow(F.lit(2.0), F.col("level") + 2)
    home = (F.floor(F.greatest("l_x1", "r_x1") / side) == F.col("cx")) & (F.floor(F.greatest("l_y1", "r_y1") / side) == F.col("cy"))
    pairs = l.join(r.hint("merge"), [group, "level", "cx", "cy"]).filter(home).withColumn("iou", iou("l_", "r_", epsilon))
    return pairs.filter(F.col("iou") >= min_iou).drop("level", "cx", "cy", "l_level", "r_level")


def iou_pairs(boxes: DataFrame, min_iou: float) -> DataFrame:
    """Unordered overlapping pairs within an image."""
    slim = boxes.select("image_id", "box_id", "x1", "y1", "x2", "y2")
    return overlap_pairs(slim, slim, "image_id", min_iou).filter("l_box_id < r_box_id").select(
        "image_id", F.col("l_box_id").alias("box_a"), F.col("r_box_id").alias("box_b"), "iou")


MAX_FOLD_BOXES = 500


def nms(boxes: DataFrame, max_iou: float = rules.NMS_IOU, max_fold: int = MAX_FOLD_BOXES) -> DataFrame:
    """Greedy suppression per image: larger boxes first (then box_id), overlap below ``max_iou``.

    Images up to ``max_fold`` boxes are folded inside one row. Bigger ones, whatever their size, go
    through rounds on the conflict pairs: a box without an undecided earlier rival is kept,
    its later rivals fall; the result is the same as the sequential rule.
    """
    side = rules.NMS_MIN_SIDE
    usable = boxes.filter((F.col("x2") > F.col("x1") + side) & (F.col("y2") > F.col("y1") + side)).select(
        "image_id", "box_id", "x1", "y1", "x2", "y2")
    # Copies of one box stand or fall with the first of them, so they never meet as pairs.
    usable = usable.groupBy("image_id", "x1", "y1", "x2", "y2").agg(F.min("box_id").alias("box_id"))
    sizes = usable.groupBy("image_id").agg(F.count("*").alias("n"))
    sized = usable.join(sizes, "image_id")
    small = sized.filter(F.col("n") <= max_fold)
    entry = F.struct((-area()).alias("neg"), "box_id", "x1", "y1", "x2", "y2")
    rows = small.groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("all"))

    def overlap(a, b):
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
        return inter / (-a["neg"] - b["neg"] - inter + F.lit(1e-6))

    none = F.array().cast("array<struct<neg:double,box_id:bigint,x1:double,y1:double,x2:double,y2:double>>")
    fold = F.aggregate(
        "all", none,
        lambda kept, b: F.when(F.forall(kept, lambda k: overlap(k, b) < max_iou), F.concat(kept, F.array(b))).otherwise(kept))
    out = rows.select("image_id", F.explode(fold).alias("b")).select("image_id", F.col("b.box_id").alias("box_id"))
    big_ids = sizes.filter(F.col("n") > max_fold)
    if big_ids.isEmpty():
        return out
    return out.unionByName(_nms_rounds(sized.filter(F.col("n") > max_fold).drop("n"), max_iou))


def _nms_rounds(boxes: DataFrame, max_iou: float) -> DataFrame:
    pairs = overlap_pairs(boxes, boxes, "image_id", max_iou)
    earlier = (area("l_") > area("r_")) | ((area("l_") == area("r_")) & (F.col("l_box_id") < F.col("r_box_id")))
    edges = cut_lineage(pairs.filter(earlier & (F.col("l_box_id") != F.col("r_box_id"))).select(
        "image_id", F.col("l_box_id").alias("first"), F.col("r_box_id").alias("later")))
    open_boxes = cut_lineage(boxes.select("image_id", "box_id"))
    kept = None
    key = lambda c: [F.col("image_id"), F.col(c).alias("box_id")]
    while True:
        live = edges.join(open_boxes.withColumnRenamed("box_id", "first"), ["image_id", "first"], "left_semi").join(
            open_boxes.withColumnRenamed("box_id", "later"), ["image_id", "later"], "left_semi")
        edges = cut_lineage(live.select("image_id", "first", "later"))
        fresh = cut_lineage(open_boxes.join(edges.select(*key("later")).distinct(), ["image_id", "box_id"], "left_anti"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        fallen = edges.join(fresh.withColumnRenamed("box_id", "first"), ["image_id", "first"], "left_semi").select(*key("later")).distinct()
        open_boxes = cut_lineage(
            open_boxes.join(fresh, ["image_id", "box_id"], "left_anti").join(fallen, ["image_id", "box_id"], "left_anti"))
        if open_boxes.isEmpty():
            return kept


def tile_grid(images: DataFrame) -> DataFrame:
    """Overlapping tiles of large images in scan order, at most 24 per image. All inside the row."""
    w, h = F.col("width"), F.col("height")
    tile = F.least(F.lit(rules.TILE_MAX).cast("long"), w, h)
    stride = F.greatest(F.lit(rules.TILE_MIN_STRIDE).cast("long"), F.floor(tile * 0.5))
    d = images.select("image_id", "width", "height", tile.alias("tile"), stride.alias("stride"))
    needs = (F.col("tile") >= rules.TILE_MIN) & (
        (F.col("width") > F.col("tile") * rules.TILE_RATIO) | (F.col("height") > F.col("tile") * rules.TILE_RATIO))

    def starts(extent: str) -> Column:
        """Starts whose previous tile did not yet reach the edge, and whose tile is not too narrow."""
        every = F.sequence(F.lit(0).cast("long"), F.col(extent) - 1, F.col("stride"))
        return F.filter(every, lambda p: ((p == 0) | (p - F.col("stride") + F.col("tile") < F.col(extent)))
                        & (F.col(extent) - p >= rules.TILE_MIN_EDGE))

    tiles = F.flatten(F.transform(starts("height"), lambda y: F.transform(starts("width"), lambda x: F.struct(
        x.alias("x"), y.alias("y"), F.least(F.col("tile"), F.col("width") - x).alias("w"), F.least(F.col("tile"), F.col("height") - y).alias("h")))))
    return d.filter(needs).select("image_id", F.posexplode(F.slice(tiles, 1, rules.TILE_CAP)).alias("tile_no", "t")).select(
        "image_id", F.col("tile_no").cast("long").alias("tile_no"), "t.*")


def faces_without_photo(faces: DataFrame, photos: DataFrame, cell: float = 256.0) -> DataFrame:
    """Faces that overlap no known photo of their page (anti range join through grid cells).

    ``faces``: page_id, box_id, x1, y1, x2, y2 in CSS pixels. ``photos``: page_id, x, y, w, h.
    """
    solid = faces.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))

    def spread(df: DataFrame, x1, y1, x2, y2) -> DataFrame:
        at = lambda v: F.floor(v / cell)
        return df.withColumn("cx", F.explode(F.sequence(at(x1), at(x2)))).withColumn("cy", F.explode(F.sequence(at(y1), at(y2))))

    f = spread(solid, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("f")
    p = spread(photos, F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("p")
    meet = (
        (F.col("f.page_id") == F.col("p.page_id")) & (F.col("f.cx") == F.col("p.cx")) & (F.col("f.cy") == F.col("p.cy"))
        & (F.col("f.x1") < F.col("p.x") + F.col("p.w")) & (F.col("f.x2") > F.col("p.x"))
        & (F.col("f.y1") < F.col("p.y") + F.col("p.h")) & (F.col("f.y2") > F.col("p.y"))
    )
    covered = f.join(p, meet, "left_semi").select("page_id", "box_id").distinct()
    return solid.join(covered, ["page_id", "box_id"], "left_anti")


def match_regions(truth: DataFrame, predicted: DataFrame, min_iou: float = rules.EVAL_IOU) -> DataFrame:
    """One-to-one matches in order of falling IoU (then ids), as the greedy rule would pick them.

    Each round takes every pair that is the best open pair of both its boxes; such pairs
    are exactly the ones the sequential greedy order takes before any rival.
    """
    pairs = overlap_pairs(truth, predicted, "image_id", min_iou, epsilon=0.0).select(
        "image_id", F.col("l_box_id").alias("box_id"), F.col("r_pred_id").alias("pred_id"), "iou")
    left = cut_lineage(pairs)
    done = None
    rank = F.struct((-F.col("iou")).alias("n"), "box_id", "pred_id")
    while not left.isEmpty():
        by_truth = left.groupBy("image_id", "box_id").agg(F.min_by("pred_id", rank).alias("pred_id"))
        by_pred = left.groupBy("image_id", "pred_id").agg(F.min_by("box_id", rank).alias("box_id"))
        mutual = by_truth.join(by_pred, ["image_id", "box_id", "pred_id"], "left_semi")
        taken = cut_lineage(left.join(mutual, ["image_id", "box_id", "pred_id"], "left_semi"))
        done = taken if done is None else done.unionByName(taken)
        left = cut_lineage(
            left.join(taken.select("image_id", "box_id"), ["image_id", "box_id"], "left_anti").join(
                taken.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti"))
    return pairs.limit(0) if done is None else done
