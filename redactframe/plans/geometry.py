"""Queries: boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe.operators import boxes
from redactframe.plans.registry import query
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived

IOU_SQL = """(CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) THEN
 (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) /
 (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)
  - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) + {eps}) ELSE 0 END)"""


def iou_sql(a: str, b: str, eps: str = "cast(1e-6 AS DOUBLE)") -> str:
    return IOU_SQL.format(a=a, b=b, eps=eps)


@query("unletterbox", oracle=f"""{cte('raw_faces')}, s AS (SELECT *, least(cast(128 AS DOUBLE) / width, cast(128 AS DOUBLE) / height) AS k FROM raw_faces),
 o AS (SELECT *, (128 - width * k) / 2 AS dx, (128 - height * k) / 2 AS dy FROM s)
 SELECT face_id, """ + ", ".join(
    f"greatest(0, least(cast({m} AS BIGINT), cast(floor(({v} * 128 - {d}) / k + 0.5) AS BIGINT))) AS {n}"
    for v, d, m, n in (("xmin", "dx", "width", "x1"), ("ymin", "dy", "height", "y1"), ("xmax", "dx", "width", "x2"), ("ymax", "dy", "height", "y2"))
) + " FROM o")
def unletterbox(spark, sf):
    return boxes.unletterbox(derived(spark, sf, "raw_faces"))


@query("iou_pairs", oracle=f"""{cte('boxes')} SELECT a.image_id, a.box_id AS box_a, b.box_id AS box_b, round({iou_sql('a', 'b')}, 6) AS iou FROM boxes a JOIN boxes b
 ON a.image_id = b.image_id AND a.box_id < b.box_id WHERE {iou_sql('a', 'b')} >= 0.1""")
def iou_pairs(spark, sf):
    return boxes.iou_pairs(derived(spark, sf, "boxes"), 0.1).withColumn("iou", F.round("iou", 6))


NMS_SQL = f"""WITH RECURSIVE {cte('boxes')[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_id) AS rn FROM boxes WHERE x2 > x1 + 2 AND y2 > y1 + 2),
 g AS (SELECT image_id, rn, [{{'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.image_id, o.rn, CASE WHEN len(list_filter(g.kept, lambda k: {iou_sql('k', 'o')} >= 0.4)) = 0
    THEN list_append(g.kept, {{'box_id': o.box_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE g.kept END
  FROM g JOIN o ON o.image_id = g.image_id AND o.rn = g.rn + 1),
 l AS (SELECT image_id, max_by(kept, rn) AS kept FROM g GROUP BY image_id)
 SELECT image_id, unnest(list_transform(kept, lambda k: k.box_id)) AS box_id FROM l"""


@query("nms_boxes", oracle=NMS_SQL)
def nms_boxes(spark, sf):
    return boxes.nms(derived(spark, sf, "boxes"))


@query("tile_grid", oracle=f"""{cte('images')}, t AS (SELECT *, least(512, width, height) AS tile FROM images),
 s AS (SELECT *, greatest(128, cast(floor(tile * 0.5) AS BIGINT)) AS stride FROM t WHERE tile >= 160 AND (width > tile * 1.2 OR height > tile * 1.2)),
 y AS (SELECT *, unnest(range(0, height, stride)) AS y FROM s), x AS (SELECT *, unnest(range(0, width, stride)) AS x FROM y),
 k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS n FROM x WHERE (y = 0 OR y - stride + tile < height) AND (x = 0 OR x - stride + tile < width)
   AND height - y >= 96 AND width - x >= 96)
 SELECT image_id, n - 1 AS tile_no, x, y, least(tile, width - x) AS w, least(tile, height - y) AS h FROM k WHERE n <= 24""")
def tile_grid(spark, sf):
    return boxes.tile_grid(derived(spark, sf, "images"))


@query("face_photo_anti", oracle=f"""{cte('boxes', 'photos')}, f AS (SELECT image_id AS page_id, box_id, x1 / 1.25 AS x1, y1 / 1.25 AS y1, x2 / 1.25 AS x2, y2 / 1.25 AS y2 FROM boxes WHERE x2 > x1 AND y2 > y1)
 SELECT page_id, box_id FROM f WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE p.page_id = f.page_id AND f.x1 < p.x + p.w AND f.x2 > p.x AND f.y1 < p.y + p.h AND f.y2 > p.y)""")
def face_photo_anti(spark, sf):
    css = derived(spark, sf, "boxes").select(
        F.col("image_id").alias("page_id"), "box_id", *[(F.col(c) / 1.25).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return boxes.faces_without_photo(css, derived(spark, sf, "photos")).select("page_id", "box_id")


MATCH_SQL = f"""WITH RECURSIVE {cte('boxes', 'predicted_boxes')[5:]}, p AS (SELECT b.image_id, b.box_id, q.pred_id, {iou_sql('b', 'q', '0')} AS iou FROM boxes b JOIN predicted_boxes q ON q.image_id = b.image_id),
 o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, box_id, pred_id) AS rn FROM p WHERE iou >= 0.5),
 g AS (SELECT image_id, rn, [box_id] AS t, [pred_id] AS m, true AS took, box_id, pred_id, iou FROM o WHERE rn = 1
  UNION ALL SELECT o.image_id, o.rn, CASE WHEN list_contains(g.t, o.box_id) OR list_contains(g.m, o.pred_id) THEN g.t ELSE list_append(g.t, o.box_id) END,
   CASE WHEN list_contains(g.t, o.box_id) OR list_contains(g.m, o.pred_id) THEN g.m ELSE list_append(g.m, o.pred_id) END,
   NOT (list_contains(g.t, o.box_id) OR list_contains(g.m, o.pred_id)), o.box_id, o.pred_id, o.iou FROM g JOIN o ON o.image_id = g.image_id AND o.rn = g.rn + 1)
 SELECT image_id, box_id, pred_id, round(iou, 6) AS iou FROM g WHERE took"""


@query("eval_iou", oracle=MATCH_SQL)
def eval_iou(spark, sf):
    return boxes.match_regions(derived(spark, sf, "boxes").drop("confidence"), derived(spark, sf, "predicted_boxes")).withColumn("iou", F.round("iou", 6))
