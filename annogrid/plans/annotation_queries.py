"""Queries over the annotation relations, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from annogrid.functions import polygons as pg
from annogrid.operators import density, features, keypoints, merge, pixels, rects, stats, tiles
from annogrid.operators.graph import checkpoint_folder
from annogrid.plans import derive
from annogrid.plans.derive import sql
from annogrid.sources import coco, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, *relations: str, body: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = sql(*relations, body=body) if relations else body
        return fn

    return register


def _flat(spark, sf_dir):
    return stats.flat_annotations(derive.annotations(spark, sf_dir), derive.categories(spark, sf_dir))


def _rects(spark, sf_dir):
    return derive.rectangles(derive.annotations(spark, sf_dir))


def _relations(spark, sf_dir):
    return {"images": (derive.images(spark, sf_dir), "id"), "annotations": (derive.annotations(spark, sf_dir), "uid"), "categories": (derive.categories(spark, sf_dir), "id"), "duplicated": (derive.annotations(spark, sf_dir), "dup_id")}


_IDS = [("images", "id", "images"), ("annotations", "uid", "annotations"), ("categories", "id", "categories"), ("duplicated", "dup_id", "annotations")]


@query(
    "ids_validate", "images", "annotations", "categories",
    body=" UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS n, count(DISTINCT {c}) AS n_distinct, count(*) = count(DISTINCT {c}) AS is_unique FROM {t}" for e, c, t in _IDS),
)
def ids_validate(spark, sf_dir):
    return stats.validate_ids(_relations(spark, sf_dir))


@query(
    "ids_summary", "images", "annotations", "categories",
    body=" UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS n, CAST(min({c}) AS BIGINT) AS min_id, CAST(max({c}) AS BIGINT) AS max_id FROM {t}" for e, c, t in _IDS),
)
def ids_summary(spark, sf_dir):
    return stats.summarise_ids(_relations(spark, sf_dir))


@query("ids_duplicate", "annotations", body="SELECT dup_id, count(*) AS n FROM annotations GROUP BY dup_id HAVING count(*) > 1")
def ids_duplicate(spark, sf_dir):
    return stats.duplicates(derive.annotations(spark, sf_dir), "dup_id")


@query("category_distribution", "annotations", body="SELECT category_id AS key, count(*) AS n FROM annotations GROUP BY 1")
def category_distribution(spark, sf_dir):
    return stats.count_by(derive.annotations(spark, sf_dir), "category_id")


@query("annotations_per_image", "annotations", body="SELECT image_id AS key, count(*) AS n FROM annotations GROUP BY 1")
def annotations_per_image(spark, sf_dir):
    return stats.count_by(derive.annotations(spark, sf_dir), "image_id")


@query("area_stats", "annotations", body="SELECT count(w * h) AS n, min(w * h) AS min_area, max(w * h) AS max_area, round(avg(w * h), 6) AS mean_area FROM annotations")
def area_stats(spark, sf_dir):
    return stats.area_stats(derive.annotations(spark, sf_dir), F.col("w") * F.col("h"))


@query("images_without_annotations", "images", "annotations", body="SELECT id AS image_id FROM images WHERE id NOT IN (SELECT image_id FROM annotations)")
def images_without_annotations(spark, sf_dir):
    return stats.without_match(derive.images(spark, sf_dir), derive.annotations(spark, sf_dir), "id", "image_id").withColumnRenamed("id", "image_id")


@query("filter_by_category", "annotations", body="SELECT uid, image_id, category_id FROM annotations WHERE category_id IN (11, 23, 55)")
def filter_by_category(spark, sf_dir):
    return stats.keep_ids(derive.annotations(spark, sf_dir), "category_id", [11, 23, 55]).select("uid", "image_id", "category_id")


@query("filter_by_image", "images", "annotations", body="SELECT uid, image_id, category_id FROM annotations WHERE image_id IN (SELECT id FROM images WHERE width = 640)")
def filter_by_image(spark, sf_dir):
    wanted = derive.images(spark, sf_dir).where("width = 640").select("id")
    return stats.keep_ids(derive.annotations(spark, sf_dir), "image_id", wanted).select("uid", "image_id", "category_id")


@query("category_names", "categories", body="SELECT id, name FROM categories")
def category_names(spark, sf_dir):
    return derive.categories(spark, sf_dir)


@query("image_file_names", "images", body="SELECT id, file_name FROM images")
def image_file_names(spark, sf_dir):
    return derive.images(spark, sf_dir).select("id", "file_name")


@query(
    "resolution_groups", "images", "annotations",
    body="""SELECT width, height, count(*) AS n_images, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_annotations
    FROM images LEFT JOIN (SELECT image_id, count(*) AS k FROM annotations GROUP BY 1) ON id = image_id GROUP BY 1, 2""",
)
def resolution_groups(spark, sf_dir):
    return stats.resolution_groups(derive.images(spark, sf_dir), derive.annotations(spark, sf_dir))


_FLAT = """flat AS (SELECT a.*, coalesce(c.name, 'Unknown') AS category_name, x AS bbox_x, y AS bbox_y, w AS bbox_width, h AS bbox_height, w * h AS bbox_area,
  CASE WHEN h > 0 THEN w / h ELSE 0 END AS bbox_aspect_ratio FROM annotations a LEFT JOIN categories c ON a.category_id = c.id)"""


@query("annotation_frame", "annotations", "categories", body=f"WITH {_FLAT} SELECT uid, category_name, bbox_x, bbox_y, bbox_width, bbox_height, bbox_area, round(bbox_aspect_ratio, 6) AS aspect FROM flat")
def annotation_frame(spark, sf_dir):
    return _flat(spark, sf_dir).select("uid", "category_name", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "bbox_area", F.round("bbox_aspect_ratio", 6).alias("aspect"))


@query(
    "category_summary", "annotations", "categories",
    body=f"""WITH {_FLAT} SELECT category_name AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM flat), 6) AS percentage,
    round(avg(bbox_area), 6) AS avg_area, round(avg(bbox_aspect_ratio), 6) AS avg_aspect_ratio FROM flat GROUP BY 1""",
)
def category_summary(spark, sf_dir):
    return stats.category_summary(_flat(spark, sf_dir))


@query(
    "categorical_property", "annotations", "categories",
    body=f"""WITH {_FLAT} SELECT category_name, status AS prop, count(*) AS n, round(100.0 * count(*) / any_value(t.total), 6) AS percentage
    FROM flat JOIN (SELECT category_name, count(*) AS total FROM flat GROUP BY 1) t USING (category_name) GROUP BY 1, 2""",
)
def categorical_property(spark, sf_dir):
    return stats.categorical_property(_flat(spark, sf_dir), "status")


@query(
    "numerical_property", "annotations", "categories",
    body=f"""WITH {_FLAT} SELECT category_name, count(*) AS n, round_even(avg(bbox_area), 3) AS mean, round_even(stddev_samp(bbox_area), 3) AS std, round_even(min(bbox_area), 3) AS min,
    round_even(max(bbox_area), 3) AS max, round_even(quantile_cont(bbox_area, 0.25), 3) AS q25, round_even(quantile_cont(bbox_area, 0.5), 3) AS median,
    round_even(quantile_cont(bbox_area, 0.75), 3) AS q75 FROM flat GROUP BY 1""",
)
def numerical_property(spark, sf_dir):
    return stats.numerical_property(_flat(spark, sf_dir), "bbox_area")


@query("property_types", body="SELECT * FROM (VALUES ('x', 'numerical'), ('status', 'categorical'), ('iscrowd', 'numerical')) AS t(prop, kind)")
def property_types(spark, sf_dir):
    return stats.property_types(derive.annotations(spark, sf_dir), "uid", ["x", "status", "iscrowd"])


@query("per_image_category_counts", "annotations", "categories", body=f"WITH {_FLAT} SELECT category_name, image_id, count(*) AS n FROM flat GROUP BY 1, 2")
def per_image_category_counts(spark, sf_dir):
    return _flat(spark, sf_dir).groupBy("category_name", "image_id").agg(F.count(F.lit(1)).alias("n"))


_CROSS = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_PAIRS = f"pairs AS (SELECT a.idx AS a, b.idx AS b FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.idx < b.idx AND {_CROSS})"


@query("overlap_pairs", "annotations", "rects", body=f"WITH {_PAIRS} SELECT a, b FROM pairs")
def overlap_pairs(spark, sf_dir):
    return rects.overlap_pairs(_rects(spark, sf_dir)).select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))


_TYPED = f"""typed AS (
  SELECT a.idx AS a, b.idx AS b, (b.x0 < a.x0) AS le, (b.x1 > a.x1) AS ri, (b.y0 < a.y0) AS tp, (b.y1 > a.y1) AS bo
  FROM rects a JOIN rects b ON a.image_id = b.image_id AND {_CROSS} WHERE a.idx % 2 = 0 AND b.idx % 2 = 1)"""
_KIND = "CASE WHEN (le OR ri) AND (tp OR bo) THEN 'both' WHEN le OR ri THEN 'vertical' ELSE 'horizontal' END"


def _halves(spark, sf_dir):
    r = _rects(spark, sf_dir)
    return r.where("idx % 2 = 0"), r.where("idx % 2 = 1")


@query(
    "overlap_classified", "annotations", "rects",
    body=f"""WITH {_TYPED} SELECT a, b, {_KIND} AS type,
    array_to_string(list_filter([CASE WHEN le THEN 'left' END, CASE WHEN ri THEN 'right' END, CASE WHEN tp THEN 'top' END, CASE WHEN bo THEN 'bottom' END], lambda v: v IS NOT NULL), ',') AS boundaries
    FROM typed WHERE le OR ri OR tp OR bo""",
)
def overlap_classified(spark, sf_dir):
    return rects.classified(*_halves(spark, sf_dir)).select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), "type", "boundaries")


@query("b_intersections", "annotations", "rects", body=f"WITH {_TYPED} SELECT b, count(*) AS intersection_count FROM typed WHERE le OR ri OR tp OR bo GROUP BY b")
def b_intersections(spark, sf_dir):
    return rects.intersections_of_b(*_halves(spark, sf_dir))


_NESTED = """nested AS (
  SELECT DISTINCT i.idx FROM rects o JOIN rects i ON o.image_id = i.image_id AND o.idx <> i.idx
  WHERE (o.x0 < i.x0 OR (o.x0 = i.x0 AND (o.y0 < i.y0 OR (o.y0 = i.y0 AND o.idx < i.idx)))) AND o.y0 <= i.y0 AND i.y1 <= o.y1
    AND (i.x1 < o.x1 OR (i.x1 = o.x1 AND i.y0 = o.y0 AND i.idx < o.idx)))"""


@query("nested_annotations", "annotations", "rects", body=f"WITH {_NESTED} SELECT idx AS uid FROM nested")
def nested_annotations(spark, sf_dir):
    return rects.nested(_rects(spark, sf_dir)).select(F.col("idx").alias("uid"))


_GROUPS = f"""{_PAIRS},
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk(node, far) AS (SELECT a, a FROM both_ways UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON w.far = e.a),
comps AS (SELECT node AS idx, min(far) AS comp FROM walk GROUP BY node)"""
_SMALLER = """smaller AS (
  SELECT idx FROM (SELECT c.idx, row_number() OVER (PARTITION BY comp ORDER BY (x1 - x0) * (y1 - y0) DESC, c.idx DESC) AS r FROM comps c JOIN rects USING (idx)) WHERE r > 1)"""


@query("overlap_groups", "annotations", "rects", body=f"WITH {_GROUPS} SELECT idx AS uid, comp FROM comps")
def overlap_groups(spark, sf_dir):
    return rects.overlap_groups(_rects(spark, sf_dir)).select(F.col("idx").alias("uid"), "comp")


@query("overlap_invalid", "annotations", "rects", body=f"WITH {_GROUPS}, {_SMALLER} SELECT idx AS uid FROM smaller")
def overlap_invalid(spark, sf_dir):
    r = _rects(spark, sf_dir)
    return rects.smaller_members(r, rects.overlap_groups(r)).select(F.col("idx").alias("uid"))


@query("all_invalid", "annotations", "rects", body=f"WITH {_GROUPS}, {_SMALLER}, {_NESTED} SELECT idx AS uid FROM smaller UNION SELECT idx FROM nested")
def all_invalid(spark, sf_dir):
    return rects.invalid(_rects(spark, sf_dir)).select(F.col("idx").alias("uid"))


_STRIPS = """cuts AS (SELECT DISTINCT image_id, unnest([y0, y1]) AS y FROM rects),
  strips AS (SELECT image_id, y AS y_low, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS y_high FROM cuts),
  cover AS (SELECT s.image_id, y_low, y_high, idx, x0, x1 FROM strips s JOIN rects r ON r.image_id = s.image_id AND y0 <= y_low AND y_high <= y1)"""


@query(
    "coverage_depth", "annotations", "rects",
    body=f"""WITH {_STRIPS}, xs AS (SELECT DISTINCT image_id, y_low, y_high, unnest([x0, x1]) AS x FROM cover),
    cells AS (SELECT *, lead(x) OVER w AS x_next, row_number() OVER w AS k FROM xs WINDOW w AS (PARTITION BY image_id, y_low ORDER BY x)),
    depths AS (SELECT c.image_id, c.y_low, any_value(c.y_high) AS y_high, x, any_value(x_next) AS x_next, any_value(k) AS k, count(*) AS n
      FROM cells c JOIN cover r ON r.image_id = c.image_id AND r.y_low = c.y_low AND x0 <= x AND x_next <= x1 GROUP BY c.image_id, c.y_low, x),
    levels AS (SELECT *, unnest(range(2, n + 1)) AS depth FROM depths),
    islands AS (SELECT *, k - row_number() OVER (PARTITION BY image_id, y_low, depth ORDER BY k) AS island FROM levels),
    regions AS (SELECT image_id, y_low, any_value(y_high) AS y_high, depth, min(x) AS x0, max(x_next) AS x1 FROM islands GROUP BY image_id, y_low, depth, island),
    open AS (SELECT g.*, r.idx, row_number() OVER (PARTITION BY g.image_id, g.y_low, g.depth, g.x0 ORDER BY r.x0 = g.x0, r.idx) AS place
      FROM regions g JOIN cover r ON r.image_id = g.image_id AND r.y_low = g.y_low AND r.x0 <= g.x0 AND g.x0 <= r.x1),
    named AS (SELECT image_id, x0, x1, y_low, y_high, depth, string_agg(idx, ',' ORDER BY idx) AS members FROM open WHERE place <= depth GROUP BY ALL)
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY depth DESC, x0, y_low) - 1 AS INT) AS position, x0, x1, y_low, y_high, depth, members FROM named""",
)
def coverage_depth(spark, sf_dir):
    return rects.coverage_depth(_rects(spark, sf_dir)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(
    "active_sets", "annotations", "rects",
    body=f"""WITH {_STRIPS}, events AS (SELECT image_id, y_low, y_high, idx, x0 AS x, 0 AS ends FROM cover UNION ALL SELECT image_id, y_low, y_high, idx, x1, 1 FROM cover)
    SELECT e.image_id, e.y_low, any_value(e.y_high) AS y_high, e.x, CAST(e.ends AS INT) AS ends, e.idx, string_agg(r.idx, ',' ORDER BY r.idx) AS members
    FROM events e JOIN cover r ON r.image_id = e.image_id AND r.y_low = e.y_low AND (r.x0 < e.x OR (r.x0 = e.x AND (e.ends = 1 OR r.idx <= e.idx))) AND (r.x1 > e.x OR (r.x1 = e.x AND (e.ends = 0 OR r.idx > e.idx)))
    GROUP BY e.image_id, e.y_low, e.x, e.ends, e.idx""",
)
def active_sets(spark, sf_dir):
    found = rects.active_sets(_rects(spark, sf_dir)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
    return found.select("image_id", "y_low", "y_high", "x", "ends", "idx", "members")


@query("overlap_pairs_one_plane", "annotations", "rects", body=f"SELECT a.idx AS a, b.idx AS b FROM rects a JOIN rects b ON a.image_id = b.image_id AND {_CROSS} WHERE a.idx % 2 = 0 AND b.idx % 2 = 1")
def overlap_pairs_one_plane(spark, sf_dir):
    """All images side by side in one plane, 1024 apart, so that no key is left to join on."""
    r = _rects(spark, sf_dir)
    right, down = 1024.0 * (F.col("image_id") % 128), 1024.0 * F.floor(F.col("image_id") / 128)
    r = r.select("idx", (F.col("x0") + right).alias("x0"), (F.col("y0") + down).alias("y0"), (F.col("x1") + right).alias("x1"), (F.col("y1") + down).alias("y1"))
    found = rects.overlap_pairs_on_grid(r.where("idx % 2 = 0"), r.where("idx % 2 = 1"), 256.0)
    return found.select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))


_PI = "3.141592653589793"
_BOX = f"""round(w, 6) AS bbox_width, round(h, 6) AS bbox_height, round(w * h, 6) AS bbox_area, round(w / h, 6) AS bbox_aspect_ratio, round(x + w / 2, 6) AS bbox_x_center,
  round(y + h / 2, 6) AS bbox_y_center, round(2 * (w + h), 6) AS bbox_perimeter, round(sqrt(w * w + h * h), 6) AS bbox_diagonal, round(4 * {_PI} * w * h / (2 * (w + h) * (2 * (w + h))), 6) AS bbox_compactness,
  round(greatest(w, h) / least(w, h), 6) AS bbox_elongation, round(w * h / ((w + h) / 2 * ((w + h) / 2)), 6) AS bbox_rectangularity"""


@query("bbox_features", "annotations", body=f"SELECT uid, {_BOX} FROM annotations")
def bbox_features(spark, sf_dir):
    return features.with_features(derive.annotations(spark, sf_dir), features.box_features(*map(F.col, "xywh")), ["uid"])


# Area and perimeter by the shoelace sum over the polygon's corners in their order, which the SQL lists itself.
_SEG = """corners AS (SELECT uid, w, h, k, x + CASE WHEN line % 3 = 0 THEN [0, 1, 1, 0] ELSE [0, 1, 1, 0] END[k + 1] * w AS px,
    y + CASE WHEN line % 3 = 0 THEN [0, 1, 0, 1] ELSE [0, 0, 1, 1] END[k + 1] * h AS py FROM annotations CROSS JOIN range(4) AS r(k)),
  sides AS (SELECT c.*, n.px AS qx, n.py AS qy FROM corners c JOIN corners n ON n.uid = c.uid AND n.k = (c.k + 1) % 4),
  segs AS (SELECT uid, any_value(w) AS w, any_value(h) AS h, abs(sum(px * qy - qx * py ORDER BY k)) / 2 AS area, sum(sqrt(pow(qx - px, 2) + pow(qy - py, 2)) ORDER BY k) AS peri, count(*) AS n FROM sides GROUP BY uid)"""


@query(
    "segmentation_features", "annotations",
    body=f"""WITH {_SEG} SELECT uid, n::DOUBLE AS segmentation_points, round(area, 6) AS segmentation_area, round(CASE WHEN area > 0 THEN w * h / area ELSE 1 END, 6) AS bbox_to_seg_ratio,
    round(peri, 6) AS segmentation_perimeter, round(4 * {_PI} * area / (peri * peri), 6) AS seg_circularity FROM segs""",
)
def segmentation_features(spark, sf_dir):
    boxes = derive.with_segmentation(derive.annotations(spark, sf_dir))
    return features.with_features(boxes, features.segmentation_features(F.col("segmentation"), F.col("w"), F.col("h")), ["uid"])


_SPATIAL = """x / iw AS relative_x, y / ih AS relative_y, w / iw AS relative_width, h / ih AS relative_height, w * h / (iw * ih) AS relative_area,
  round(sqrt(pow(x + w / 2 - iw / 2, 2) + pow(y + h / 2 - ih / 2, 2)) / far, 6) AS distance_from_center, least(x, y, iw - (x + w), ih - (y + h)) / least(iw, ih) AS edge_proximity,
  round(sqrt(x * x + y * y) / far, 6) AS corner_distance_tl, round(sqrt(pow(iw - (x + w), 2) + pow(ih - (y + h), 2)) / far, 6) AS corner_distance_br,
  (x + w / 2) / iw AS horizontal_position, (y + h / 2) / ih AS vertical_position"""
_PLACED = "placed AS (SELECT a.*, i.width::DOUBLE AS iw, i.height::DOUBLE AS ih, sqrt(i.width * i.width + i.height * i.height) AS far FROM annotations a JOIN images i ON a.image_id = i.id)"


def _placed(spark, sf_dir):
    sizes = derive.images(spark, sf_dir).select(F.col("id").alias("image_id"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    return derive.annotations(spark, sf_dir).join(sizes, "image_id")


def _spatial():
    return features.spatial_features(*map(F.col, ("x", "y", "w", "h", "image_width", "image_height")))


@query("spatial_features", "images", "annotations", body=f"WITH {_PLACED} SELECT uid, {_SPATIAL} FROM placed")
def spatial_features(spark, sf_dir):
    return features.with_features(_placed(spark, sf_dir), _spatial(), ["uid"], exact=features.RATIOS)


@query("combined_features", "images", "annotations", body=f"WITH {_PLACED} SELECT category_id, uid, image_id, {_BOX}, {_SPATIAL} FROM placed")
def combined_features(spark, sf_dir):
    """Box features and place features of every annotation, joined by its ids."""
    keys = ["category_id", "uid", "image_id"]
    box = features.with_features(derive.annotations(spark, sf_dir), features.box_features(*map(F.col, "xywh")), keys)
    return box.join(features.with_features(_placed(spark, sf_dir), _spatial(), keys, exact=features.RATIOS), keys)


@query(
    "scaled_features", "annotations",
    body="""SELECT uid, round((w - avg(w) OVER ()) / stddev_pop(w) OVER (), 6) AS w, round((h - avg(h) OVER ()) / stddev_pop(h) OVER (), 6) AS h, 0.0::DOUBLE AS one FROM annotations""",
)
def scaled_features(spark, sf_dir):
    return features.standardised(derive.annotations(spark, sf_dir).withColumn("one", F.lit(1.0)), ["w", "h", "one"], ["uid"])


@query("self_intersections", "annotations", body="SELECT uid, line % 3 = 0 AS is_self_intersecting FROM annotations")
def self_intersections(spark, sf_dir):
    boxes = derive.with_segmentation(derive.annotations(spark, sf_dir))
    return boxes.select("uid", pg.is_self_intersecting(pg.polygon_points(F.col("segmentation"))).alias("is_self_intersecting"))


@query("intersection_points", "annotations", body="SELECT uid, round(x + w / 2, 6) AS x, round(y + h / 2, 6) AS y FROM annotations WHERE line % 3 = 0")
def intersection_points(spark, sf_dir):
    boxes = derive.with_segmentation(derive.annotations(spark, sf_dir))
    found = boxes.select("uid", F.get(pg.crossings(pg.polygon_points(F.col("segmentation"))), 0).alias("p")).where(F.col("p").isNotNull())
    return found.select("uid", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_RATIOS = "SELECT DISTINCT width, height, (width % 500) / 500.0::DOUBLE AS x_overlap, (height % 350) / 350.0::DOUBLE AS y_overlap FROM images"


def _ratios(spark, sf_dir):
    return tiles.overlap_ratios(derive.images(spark, sf_dir).select("width", "height").distinct(), 500, 350)


@query("overlap_ratios", "images", body=f"WITH r AS ({_RATIOS}) SELECT width, height, round(x_overlap, 6) AS x_overlap, round(y_overlap, 6) AS y_overlap FROM r")
def overlap_ratios(spark, sf_dir):
    return _ratios(spark, sf_dir).select("width", "height", F.round("x_overlap", 6).alias("x_overlap"), F.round("y_overlap", 6).alias("y_overlap"))


def _axis(side: str, overlap: str, name: str) -> str:
    return f"""{name}_a AS (SELECT DISTINCT {side} AS len, least(greatest({overlap}, 0), 0.99) AS o FROM r),
    {name}_b AS (SELECT *, greatest(2, floor(1 / (1 - o))) AS n FROM {name}_a),
    {name}_c AS (SELECT *, CAST(least(floor(len / (n * (1 - o))), len) AS INT) AS tile FROM {name}_b),
    {name}_d AS (SELECT *, CAST(greatest(1, floor(tile * (1 - o))) AS INT) AS stride FROM {name}_c),
    {name}_k AS (SELECT len, tile, stride, unnest(range(0, CAST(ceil(len / stride::DOUBLE) AS BIGINT))) * stride AS s FROM {name}_d),
    {name}_l AS (SELECT len, min(CASE WHEN s > 0 AND s + tile >= len AND s < len - stride THEN s END) AS last FROM {name}_k GROUP BY len),
    {name} AS (SELECT DISTINCT len, tile, s FROM (SELECT k.len, tile, s FROM {name}_k k JOIN {name}_l USING (len) WHERE last IS NULL OR s < last
      UNION ALL SELECT k.len, tile, greatest(0, k.len - tile) FROM {name}_k k JOIN {name}_l USING (len) WHERE last IS NOT NULL))"""


@query(
    "tiles_by_resolution", "images",
    body=f"""WITH r AS ({_RATIOS}), {_axis("width", "x_overlap", "xs")}, {_axis("height", "y_overlap", "ys")}
    SELECT width, height, CAST(xs.s AS INT) AS x0, CAST(ys.s AS INT) AS y0, CAST(least(xs.s + xs.tile, width) AS INT) AS x1, CAST(least(ys.s + ys.tile, height) AS INT) AS y1
    FROM r JOIN xs ON xs.len = width JOIN ys ON ys.len = height""",
)
def tiles_by_resolution(spark, sf_dir):
    return tiles.tiles(_ratios(spark, sf_dir))


_HIST = """hist AS (SELECT g.bx, g.by, count(c.cx) AS n FROM (SELECT CAST(a.range AS INT) AS bx, CAST(b.range AS INT) AS by FROM range(20) a, range(12) b) g
  LEFT JOIN (SELECT x + w / 2 AS cx, y + h / 2 AS cy FROM annotations) c
    ON cx >= 0 AND cx <= 500 AND cy >= 0 AND cy <= 300 AND least(floor(cx / 500 * 20), 19) = g.bx AND least(floor(cy / 300 * 12), 11) = g.by GROUP BY 1, 2)"""


def _hist(spark, sf_dir):
    centres = derive.annotations(spark, sf_dir).select((F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    return density.histogram_2d(centres, 500.0, 300.0, 25.0)


@query("hist2d", "annotations", body=f"WITH {_HIST} SELECT hist.bx, hist.by, n FROM hist")
def hist2d(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(
    "hist2d_smoothed", "annotations",
    body=f"""WITH {_HIST}, raw AS (SELECT sigma, d, exp(-0.5 * pow(d / sigma, 2)) AS e FROM (SELECT sigma, unnest(range(-CAST(floor(4 * sigma + 0.5) AS BIGINT), CAST(floor(4 * sigma + 0.5) AS BIGINT) + 1)) AS d
      FROM (VALUES (0.5::DOUBLE), (1.0), (2.0)) AS s(sigma))),
    kernel AS (SELECT sigma, d, e / sum(e) OVER (PARTITION BY sigma) AS weight FROM raw),
    along_x AS (SELECT sigma, g.bx, g.by, sum(weight * s.n) AS v FROM hist g CROSS JOIN kernel JOIN hist s
      ON s.by = g.by AND s.bx = CASE WHEN (g.bx + d + 80) % 40 < 20 THEN (g.bx + d + 80) % 40 ELSE 39 - (g.bx + d + 80) % 40 END GROUP BY 1, 2, 3)
    SELECT g.sigma, g.bx, g.by, round(sum(k.weight * s.v), 6) AS value FROM along_x g JOIN kernel k ON k.sigma = g.sigma JOIN along_x s
      ON s.sigma = g.sigma AND s.bx = g.bx AND s.by = CASE WHEN (g.by + d + 48) % 24 < 12 THEN (g.by + d + 48) % 24 ELSE 23 - (g.by + d + 48) % 24 END GROUP BY 1, 2, 3""",
)
def hist2d_smoothed(spark, sf_dir):
    return density.gaussian_smoothed(_hist(spark, sf_dir), 20, 12, [0.5, 1.0, 2.0])


def _two_datasets(spark, sf_dir):
    a = derive.annotations(spark, sf_dir)
    base = a.where("image_id % 2 = 0").select(F.col("dup_id").alias("id"))
    return base, a.where("image_id % 2 = 1").select((F.col("dup_id") - 8 * (F.col("image_id") % 3)).alias("id"), F.col("uid").alias("position"))


_TWO = "base AS (SELECT dup_id AS id FROM annotations WHERE image_id % 2 = 0), fresh AS (SELECT dup_id - 8 * (image_id % 3) AS id, uid AS position FROM annotations WHERE image_id % 2 = 1)"


@query(
    "merge_annotation_flags", "annotations",
    body=f"WITH {_TWO} SELECT position, id, id IN (SELECT id FROM base) AS in_base, row_number() OVER (PARTITION BY id ORDER BY position) > 1 AS repeated FROM fresh",
)
def merge_annotation_flags(spark, sf_dir):
    return merge.collision_flags(*_two_datasets(spark, sf_dir)).select("position", "id", "in_base", "repeated")


@query(
    "merge_annotation_ids_strict", "annotations",
    body=f"""WITH {_TWO}, flags AS (SELECT position, id, id IN (SELECT id FROM base) OR row_number() OVER (PARTITION BY id ORDER BY position) > 1 AS f FROM fresh)
    SELECT position, id, CAST(CASE WHEN f THEN (SELECT max(id) FROM (SELECT id FROM base UNION ALL SELECT id FROM fresh)) + count(*) FILTER (f) OVER (ORDER BY position) ELSE id END AS BIGINT) AS new_id, f AS collided FROM flags""",
)
def merge_annotation_ids_strict(spark, sf_dir):
    return merge.remapped_ids(*_two_datasets(spark, sf_dir), strict=True)


def _fold(base: str, fresh: str) -> str:
    """SQL for the running collisions of fresh (position, id) with base (id), as the fixed point of whole passes."""
    return f"""top AS MATERIALIZED (SELECT coalesce(max(id), 0) AS t FROM {base}),
    flags AS MATERIALIZED (SELECT position, id, id - (SELECT t FROM top) AS over_top, id IN (SELECT id FROM {base}) OR row_number() OVER (PARTITION BY id ORDER BY position) > 1 AS flagged FROM {fresh}),
    passes AS (SELECT 0 AS n, *, flagged AS hit, true AS changed FROM flags
      UNION ALL SELECT n + 1, position, id, over_top, flagged, now, bool_or(now <> hit) OVER () FROM (
        SELECT *, flagged OR (over_top >= 1 AND over_top <= coalesce(sum(hit::INT) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS now FROM passes WHERE changed)),
    folded AS (SELECT position, id, hit, CAST(CASE WHEN hit THEN (SELECT t FROM top) + count(*) FILTER (hit) OVER (ORDER BY position) ELSE id END AS BIGINT) AS new_id FROM passes WHERE NOT changed)"""


@query("merge_annotation_ids", "annotations", body=f"WITH {_TWO}, {_fold('base', 'fresh')} SELECT position, id, new_id, hit AS collided FROM folded")
def merge_annotation_ids(spark, sf_dir):
    return merge.remapped_ids(*_two_datasets(spark, sf_dir)).select("position", "id", "new_id", "collided")


@query(
    "merge_images", "images",
    body=f"WITH base AS (SELECT id FROM images WHERE id % 3 <> 0), fresh AS (SELECT id, id AS position FROM images WHERE id % 2 = 0), {_fold('base', 'fresh')} SELECT id AS old_id, new_id FROM folded",
)
def merge_images(spark, sf_dir):
    i = derive.images(spark, sf_dir)
    return merge.merged_images(i.where("id % 3 <> 0"), i.where("id % 2 = 0"))


@query(
    "merge_categories", "categories",
    body="""WITH base AS (SELECT id, name FROM categories WHERE id % 2 = 0 UNION ALL SELECT id + 500, name FROM categories WHERE id % 4 = 0),
    fresh AS (SELECT id + 1000 AS id, name FROM categories WHERE id % 3 <> 0 UNION ALL SELECT id + 2000, name FROM categories WHERE id % 5 = 1),
    known AS (SELECT name, max(id) AS k FROM base GROUP BY 1), firsts AS (SELECT name, min(id) AS f FROM fresh WHERE name NOT IN (SELECT name FROM base) GROUP BY 1),
    given AS (SELECT name, f, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY f) AS number FROM firsts)
    SELECT f.id AS old_id, CAST(coalesce(k, number) AS BIGINT) AS new_id, coalesce(f.id = g.f, false) AS added FROM fresh f LEFT JOIN known USING (name) LEFT JOIN given g USING (name)""",
)
def merge_categories(spark, sf_dir):
    """Names that come twice on either side."""
    c = derive.categories(spark, sf_dir)
    moved = lambda where, by: c.where(where).withColumn("id", F.col("id") + by)
    return merge.merged_categories(c.where("id % 2 = 0").unionByName(moved("id % 4 = 0", 500)), moved("id % 3 <> 0", 1000).unionByName(moved("id % 5 = 1", 2000)))


@query(
    "image_headers", "images",
    body="SELECT file_name, width, height FROM images WHERE id % 5 <> 4",
)
def image_headers(spark, sf_dir):
    """Sizes read back from the first bytes of a PNG, GIF, BMP or WebP file of each image; every fifth is damaged."""
    number = lambda c, bytes_: F.lpad(F.hex(F.col(c)), 2 * bytes_, "0")

    def little(c: str, bytes_: int, less: int = 0):
        digits = F.lpad(F.hex(F.col(c) - less), 2 * bytes_, "0")
        return F.concat(*(F.substring(digits, 2 * (bytes_ - k) - 1, 2) for k in range(bytes_)))

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number("width", 4), number("height", 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little("width", 2), little("height", 2), F.lit("000000"))
    bmp = F.concat(F.lit("424D" + "00" * 16), little("width", 4), little("height", 4), F.lit("01001800"))
    webp = F.concat(F.lit("52494646000000005745425056503858" + "0A000000" + "00000000"), little("width", 3, 1), little("height", 3, 1))
    kind = F.col("id") % 5
    content = F.unhex(F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).when(kind == 3, webp).otherwise(F.substring(png, 1, 24)))
    made = derive.images(spark, sf_dir).select(F.col("file_name").alias("path"), content.alias("content"))
    return files.image_sizes(made).withColumnRenamed("path", "file_name")


@query(
    "image_problems", "images",
    body="""SELECT id AS image_id, CASE WHEN id % 7 = 0 THEN 'no pixels' ELSE 'not 2D or 3D' END AS problem FROM images WHERE id % 7 = 0 OR id % 4 IN (0, 2)""",
)
def image_problems(spark, sf_dir):
    """Images of one to four channels or none; every seventh has no rows."""
    i = derive.images(spark, sf_dir)
    height, channels = F.when(F.col("id") % 7 > 0, F.col("height")).otherwise(0), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("int")
    return pixels.image_problems(i.select(F.col("id").alias("image_id"), height.alias("height"), "width", channels.alias("channels")))


@query(
    "keypoints_both_sources", "annotations",
    body="""SELECT image_id, uid, round(x, 6) AS x, round(y, 6) AS y, 'Original' AS img_source, 'corner' AS detector, CAST(row_number() OVER (PARTITION BY image_id ORDER BY uid) - 1 AS INT) AS keypoint_id FROM annotations
    UNION ALL SELECT image_id, uid, round(x / 2, 6), round(y / 2, 6), 'Normalized', 'corner', CAST(row_number() OVER (PARTITION BY image_id ORDER BY uid) - 1 AS INT) FROM annotations WHERE line % 2 = 1""",
)
def keypoints_both_sources(spark, sf_dir):
    """First corners as keypoints, and half of them in an image of half the size."""
    a = derive.annotations(spark, sf_dir)
    small = a.where("line % 2 = 1").select("image_id", "uid", F.round(F.col("x") / 2, 6).alias("x"), F.round(F.col("y") / 2, 6).alias("y"))
    return keypoints.both_sources(small, a.select("image_id", "uid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), "corner", "uid", image="image_id")


@query("coco_round_trip", "images", "annotations", body="SELECT uid AS id, image_id, category_id, round(w * h, 6) AS area, x, y, w, h, iscrowd, i.file_name, i.width, i.height FROM annotations JOIN images i ON i.id = image_id")
def coco_round_trip(spark, sf_dir):
    """The tables written as COCO documents, one for each 64th of the images, and read back into relations."""
    import uuid

    from annogrid.operators.graph import checkpointed

    i, a, c = derive.images(spark, sf_dir), derive.annotations(spark, sf_dir), derive.categories(spark, sf_dir)
    boxes = a.select(F.col("uid").alias("id"), "image_id", "category_id", (F.col("w") * F.col("h")).alias("area"), F.array("x", "y", "w", "h").alias("bbox"), "iscrowd")
    folder = f"{checkpoint_folder(spark)}/coco-{uuid.uuid4().hex}"
    coco.documents(i, boxes, c, 64).write.text(folder)
    got = coco.read(spark, folder, lines=True)
    found = got["annotations"].join(got["images"].select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id")
    rows = found.select("id", "image_id", "category_id", F.round("area", 6).alias("area"), *(F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")), "iscrowd", "file_name", "width", "height")
    return checkpointed(rows)
