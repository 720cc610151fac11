"""Queries on homographies, clusters, sketches, collisions, metadata and frames, each with SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from annogrid.functions import polygons as pg
from annogrid.functions import strings
from annogrid.operators import advice, clusters, collisions, dashboard, features, frames, homography, sketches, stats
from annogrid.plans import annotation_queries, derive
from annogrid.plans.derive import sql
from annogrid.sources import generate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, *relations: str, body: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = sql(*relations, body=body) if relations else body
        return fn

    return register


# A fixed homography for each image, with all nine entries in use.
_H = {"h00": "1.0 + (image_id % 7) / 64.0", "h01": "(image_id % 3) / 32.0", "h02": "(image_id % 11) - 5.0", "h10": "(image_id % 5) / 64.0", "h11": "1.0 - (image_id % 4) / 32.0", "h12": "3.0 - (image_id % 6)",
      "h20": "(image_id % 2) / 65536.0", "h21": "(image_id % 3) / 131072.0", "h22": "1.0"}


def _warped(spark, sf_dir):
    sizes = derive.images(spark, sf_dir).select(F.col("id").alias("image_id"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    a = derive.with_segmentation(derive.annotations(spark, sf_dir)).join(sizes, "image_id")
    return a.withColumns({k: F.expr(v.replace(".0", ".0D")).cast("double") for k, v in _H.items()})


_WARP = "w AS (SELECT a.uid, a.image_id, a.line, x, y, w, h, i.width::DOUBLE AS width, i.height::DOUBLE AS height, " + ", ".join(f"({v.replace('.0', '.0::DOUBLE')})::DOUBLE AS {k}" for k, v in _H.items()) + " FROM annotations a JOIN images i ON a.image_id = i.id)"
_PLACED = """c AS (SELECT p.*, least(greatest((h00 * px + h01 * py + h02) / (h20 * px + h21 * py + h22), 0), width - 1) AS mx, least(greatest((h10 * px + h11 * py + h12) / (h20 * px + h21 * py + h22), 0), height - 1) AS my
  FROM (SELECT w.*, k.cx, k.cy, x + k.cx * w AS px, y + k.cy * h AS py FROM w CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(cx, cy)) p)"""
_BOXES = f"{_WARP}, {_PLACED}, b AS (SELECT uid, image_id, min(mx) AS x, min(my) AS y, max(mx) - min(mx) AS w, max(my) - min(my) AS h FROM c GROUP BY 1, 2)"


@query("homography_bbox", "images", "annotations", body=f"WITH {_BOXES} SELECT uid, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM b WHERE w > 1 AND h > 1")
def homography_bbox(spark, sf_dir):
    box = homography.moved_box(*map(F.col, ("x", "y", "w", "h", "width", "height")))
    moved = _warped(spark, sf_dir).select("uid", box.alias("m")).where(F.col("m").isNotNull())
    return moved.select("uid", *(F.round(f"m.{c}", 4).alias(c) for c in "xywh"))


_ORDER = "CASE WHEN line % 3 = 0 THEN CASE WHEN cx = 0 AND cy = 0 THEN 0 WHEN cx = 1 AND cy = 1 THEN 1 WHEN cx = 1 THEN 2 ELSE 3 END ELSE CASE WHEN cx = 0 AND cy = 0 THEN 0 WHEN cx = 1 AND cy = 0 THEN 1 WHEN cx = 1 THEN 2 ELSE 3 END END"


@query(
    "homography_segmentation", "images", "annotations",
    body=f"""WITH {_WARP}, {_PLACED}, o AS (SELECT uid, mx, my, {_ORDER} AS k FROM c), n AS (SELECT *, coalesce(lead(mx) OVER s, first_value(mx) OVER s) AS nx, coalesce(lead(my) OVER s, first_value(my) OVER s) AS ny FROM o WINDOW s AS (PARTITION BY uid ORDER BY k)),
    kept AS (SELECT uid FROM n GROUP BY uid HAVING abs(sum(mx * ny - nx * my)) / 2 > 1)
    SELECT uid, CAST(k AS INT) AS k, round(mx, 4) AS x, round(my, 4) AS y FROM o WHERE uid IN (SELECT uid FROM kept)""",
)
def homography_segmentation(spark, sf_dir):
    moved = homography.moved_polygon(pg.polygon_points(F.col("segmentation")), F.col("width"), F.col("height"))
    points = _warped(spark, sf_dir).select("uid", F.posexplode(moved).alias("k", "p"))
    return points.select("uid", "k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(
    "homography_keypoints", "images", "annotations",
    body=f"""WITH {_WARP}, {_PLACED} SELECT uid, CAST(cx AS INT) AS k, round(CASE WHEN (line + cx) % 3 > 0 THEN mx ELSE px END, 4) AS x, round(CASE WHEN (line + cx) % 3 > 0 THEN my ELSE py END, 4) AS y, ((line + cx) % 3)::DOUBLE AS v FROM c WHERE cx = cy""",
)
def homography_keypoints(spark, sf_dir):
    w = _warped(spark, sf_dir)
    v = lambda k: ((F.col("line") + k) % 3).cast("double")
    flat = F.array(F.col("x"), F.col("y"), v(0), F.col("x") + F.col("w"), F.col("y") + F.col("h"), v(1))
    moved = w.select("uid", homography.moved_keypoints(flat, F.col("width"), F.col("height")).alias("m"))
    k = moved.select("uid", "m", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return k.select("uid", "k", F.round(F.get("m", 3 * F.col("k")), 4).alias("x"), F.round(F.get("m", 3 * F.col("k") + 1), 4).alias("y"), F.get("m", 3 * F.col("k") + 2).alias("v"))


@query("transform_stats", "images", "annotations", body=f"WITH {_BOXES} SELECT count(DISTINCT image_id) AS images, count(*) FILTER (w > 1 AND h > 1) AS kept, count(*) FILTER (NOT (w > 1 AND h > 1)) AS skipped FROM b")
def transform_stats(spark, sf_dir):
    box = homography.moved_box(*map(F.col, ("x", "y", "w", "h", "width", "height")))
    kept = _warped(spark, sf_dir).select("image_id", box.isNotNull().alias("kept"))
    return kept.agg(F.count_distinct("image_id").alias("images"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


def points(spark, sf_dir):
    """Whole embeddings as points; the label is the table's."""
    return derive.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


_POINTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), long AS (SELECT id, label, CAST(k AS INT) AS feature, v[k + 1] AS x FROM (SELECT id, label, v, unnest(range(len(v))) AS k FROM pts))"
_CENTRES = "m AS (SELECT label, feature, avg(x) AS c, count(*) AS n FROM long GROUP BY 1, 2), cen AS (SELECT label, max(n) AS n, list(c ORDER BY feature) AS centre FROM m GROUP BY 1)"


@query("cluster_means", body=f"WITH {_POINTS} SELECT label, feature, round(avg(x), 6) AS mean, count(*) AS n FROM long GROUP BY 1, 2")
def cluster_means(spark, sf_dir):
    return clusters.cluster_means(points(spark, sf_dir))


@query("between_cluster_variance", body=f"WITH {_POINTS}, {_CENTRES} SELECT feature, round(var_pop(c), 6) AS value FROM m GROUP BY 1")
def between_cluster_variance(spark, sf_dir):
    return clusters.between_cluster_variance(points(spark, sf_dir))


@query(
    "calinski_harabasz",
    body=f"""WITH {_POINTS}, {_CENTRES}, g AS (SELECT list(c ORDER BY feature) AS mid FROM (SELECT feature, avg(x) AS c FROM long GROUP BY 1)),
    b AS (SELECT sum(n * pow(list_distance(centre, mid), 2)) AS b, count(*) AS k, sum(n) AS n FROM cen, g), w AS (SELECT sum(pow(list_distance(v, centre), 2)) AS w FROM pts JOIN cen USING (label))
    SELECT round(b * (n - k) / (w * (k - 1)), 6) AS calinski_harabasz FROM b, w""",
)
def calinski_harabasz(spark, sf_dir):
    return clusters.calinski_harabasz(points(spark, sf_dir))


@query(
    "davies_bouldin",
    body=f"""WITH {_POINTS}, {_CENTRES}, s AS (SELECT label, avg(list_distance(v, centre)) AS s, any_value(centre) AS c FROM pts JOIN cen USING (label) GROUP BY 1)
    SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)""",
)
def davies_bouldin(spark, sf_dir):
    return clusters.davies_bouldin(points(spark, sf_dir))


@query(
    "silhouette",
    body=f"""WITH {_POINTS}, d AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS d, count(*) AS n FROM pts a, pts b GROUP BY 1, 2, 3),
    s AS (SELECT id, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS near, min(CASE WHEN own <> other THEN d / n END) AS next FROM d GROUP BY 1)
    SELECT id, round(coalesce((next - near) / nullif(greatest(next, near), 0), 0), 6) AS silhouette FROM s""",
)
def silhouette(spark, sf_dir):
    return clusters.silhouette(points(spark, sf_dir))


@query(
    "hard_clusters", "annotations",
    body="""WITH k AS (SELECT image_id % 100 AS label, category_id, count(*) AS k FROM annotations GROUP BY 1, 2), s AS (SELECT label, sum(k) AS n, max(k) AS top FROM k GROUP BY 1)
    SELECT label, CAST(n AS BIGINT) AS n, top / n AS top_share FROM s WHERE n >= 10 AND top / n < 0.7""",
)
def hard_clusters(spark, sf_dir):
    return clusters.hard_clusters(derive.annotations(spark, sf_dir).withColumn("label", F.col("image_id") % 100), "label", "category_id")


@query(
    "anchors", "annotations",
    body="""WITH RECURSIVE means AS (SELECT avg(w) AS w, avg(h) AS h FROM annotations GROUP BY line, category_id % 5), ranked AS (SELECT w, h, row_number() OVER (ORDER BY w * h DESC, w, h) AS r FROM means),
    walk AS (SELECT 0 AS r, []::STRUCT(w DOUBLE, h DOUBLE)[] AS kept UNION ALL SELECT k.r, CASE WHEN len(kept) >= 6 OR len(list_filter(kept, lambda c: abs(k.w - c.w) <= 1e-8 + 0.1 * abs(c.w) AND abs(k.h - c.h) <= 1e-8 + 0.1 * abs(c.h))) > 0
      THEN kept ELSE list_append(kept, {'w': k.w, 'h': k.h}) END FROM walk JOIN ranked k ON k.r = walk.r + 1)
    SELECT CAST(i AS INT) AS rank, round(kept[i].w, 6) AS w, round(kept[i].h, 6) AS h FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS i FROM walk ORDER BY r DESC LIMIT 1000) WHERE len(kept) = (SELECT max(len(kept)) FROM walk)
    GROUP BY ALL""".replace("WITH RECURSIVE ", "WITH "),
)
def anchors(spark, sf_dir):
    means = derive.annotations(spark, sf_dir).groupBy("line", F.col("category_id") % 5).agg(F.avg("w").alias("w"), F.avg("h").alias("h"))
    return clusters.anchors(means)


@query(
    "mutual_nn",
    body=f"""WITH {_POINTS}, d AS (SELECT a.id AS left_id, b.id AS right_id, list_distance(a.v, b.v) AS d FROM pts a, pts b WHERE a.id % 2 = 0 AND b.id % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS i, row_number() OVER (PARTITION BY right_id ORDER BY d, left_id) AS j FROM d)
    SELECT left_id, right_id, round(d, 6) AS distance FROM r WHERE i = 1 AND j = 1""",
)
def mutual_nn(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "v")
    return clusters.mutual_nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"))


_EPS = 0.9


@query(
    "dbscan_labels",
    body=f"""WITH RECURSIVE {_POINTS}, near AS (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE list_distance(a.v, b.v) <= {_EPS}), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5),
    e AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), walk(s, t) AS (SELECT a, a FROM core UNION SELECT w.s, e.b FROM walk w JOIN e ON w.t = e.a),
    comp AS (SELECT s, min(t) AS c FROM walk GROUP BY s)
    SELECT p.id, CAST(coalesce(any_value(own.c), min(comp.c), -1) AS BIGINT) AS label FROM pts p LEFT JOIN comp own ON own.s = p.id LEFT JOIN near ON near.a = p.id LEFT JOIN comp ON comp.s = near.b GROUP BY p.id""",
)
def dbscan_labels(spark, sf_dir):
    return clusters.dbscan(points(spark, sf_dir).select("id", "v"), _EPS)


@query("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return clusters.kmeans_labels(points(spark, sf_dir).select("id", "v"), 8)


@query("gmm_labels")
def gmm_labels(spark, sf_dir):
    return clusters.gmm_labels(clusters.pca(points(spark, sf_dir).select("id", "v"), 8), 4)


@query("best_k")
def best_k(spark, sf_dir):
    return clusters.best_k(points(spark, sf_dir).select("id", "v"))


@query("rf_importance")
def rf_importance(spark, sf_dir):
    return clusters.forest_importance(points(spark, sf_dir))


@query(
    "mutual_information",
    body=f"""WITH {_POINTS}, e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1), b AS (SELECT feature, label, least(9, floor(coalesce((x - lo) * 10 / nullif(hi - lo, 0), 0))) AS bin FROM long JOIN e USING (feature)),
    j AS (SELECT feature, label, bin, count(*) AS n FROM b GROUP BY 1, 2, 3), s AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, label) AS l, sum(n) OVER (PARTITION BY feature, bin) AS o FROM j)
    SELECT feature, round(sum(n / t * ln(n * t / (l * o))), 6) AS value FROM s GROUP BY 1""",
)
def mutual_information(spark, sf_dir):
    return clusters.binned_mutual_information(points(spark, sf_dir))


_TAG = "regexp_extract(html, '<html([^>]*)>', 1)"


@query("xmp_attributes", body=f"""SELECT page_id, kv[1] AS key, kv[2] AS value FROM (SELECT page_id, unnest(list_transform(regexp_extract_all({_TAG}, '([\\w:]+)="([^"]*)"', 0), lambda s: [regexp_extract(s, '([\\w:]+)="([^"]*)"', 1), regexp_extract(s, '([\\w:]+)="([^"]*)"', 2)])) AS kv FROM pages)""")
def xmp_attributes(spark, sf_dir):
    found = derive.table(spark, sf_dir, "pages").select("page_id", strings.attributes(F.regexp_extract("html", "<html([^>]*)>", 1)).alias("m"))
    return found.select("page_id", F.explode("m").alias("key", "value"))


@query(
    "rational_parse", "annotations",
    body="""SELECT uid, CASE uid % 5 WHEN 0 THEN CAST(line AS DOUBLE) WHEN 1 THEN line / 4.0::DOUBLE WHEN 2 THEN 2 + line / 8.0::DOUBLE WHEN 3 THEN -line / 2.0::DOUBLE END AS value FROM annotations""",
)
def rational_parse(spark, sf_dir):
    line = F.col("line").cast("string")
    k = F.col("uid") % 5
    text = F.when(k == 0, line).when(k == 1, F.concat(line, F.lit("/4"))).when(k == 2, F.concat(F.lit("2 "), line, F.lit("/8"))).when(k == 3, F.concat(F.lit("-"), line, F.lit("/2"))).otherwise(F.concat(line, F.lit("/0")))
    return derive.annotations(spark, sf_dir).select("uid", strings.rational(text).alias("value"))


@query(
    "bloom_parameters",
    body="""SELECT n, p, m, k, CAST(ceil(m / 8.0) AS BIGINT) AS memory_bytes FROM (SELECT *, greatest(1, CAST(floor(m / n * ln(2)) AS INT)) AS k FROM (SELECT n, p, CAST(ceil(-(n * ln(p)) / pow(ln(2), 2)) AS BIGINT) AS m
    FROM (SELECT o_orderkey + 1 AS n, 1.0::DOUBLE / (2 + o_custkey % 999) AS p FROM orders)))""",
)
def bloom_parameters(spark, sf_dir):
    n, p = (F.col("o_orderkey") + 1).alias("n"), (1.0 / (2 + F.col("o_custkey") % 999)).alias("p")
    rows = derive.table(spark, sf_dir, "orders").select(n, p)
    return rows.withColumns({"m": sketches.parameters(F.col("n"), F.col("p"))["m"]}).select("n", "p", "m", *(v.alias(k) for k, v in sketches.parameters(F.col("n"), F.col("p")).items() if k != "m"))


_GAP = "greatest(abs(a.x + a.w / 2 - b.x - b.w / 2) - (a.w + b.w) / 2, 0)"
_DOWN = _GAP.replace(".x", ".y").replace(".w", ".h")
#: Pixels within which pairs of an image are listed.
_REACH = 16.0


@query(
    "box_collisions", "annotations",
    body=f"""SELECT a.uid AS a, b.uid AS b, {_GAP} = 0 AND {_DOWN} = 0 AS hit, round(sqrt(pow({_GAP}, 2) + pow({_DOWN}, 2)), 6) AS distance
    FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.uid < b.uid WHERE sqrt(pow({_GAP}, 2) + pow({_DOWN}, 2)) <= {_REACH}""",
)
def box_collisions(spark, sf_dir):
    """Boxes of an image that meet or lie near each other."""
    d = collisions.box_gap(*(F.col(c) for c in ("a_x", "a_y", "a_w", "a_h", "b_x", "b_y", "b_w", "b_h")))
    return _pairs(spark, sf_dir).where(d <= _REACH).select("a", "b", (d == 0).alias("hit"), F.round(d, 6).alias("distance"))


def _pairs(spark, sf_dir):
    """Pairs of an image's annotations: centres and half sides."""
    half = derive.annotations(spark, sf_dir).select("image_id", F.col("uid").alias("i"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), (F.col("w") / 2).alias("w"), (F.col("h") / 2).alias("h"))
    a, b = (half.select("image_id", F.col("i").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in "xywh")) for s in "ab")
    return a.join(b, "image_id").where(F.col("a") < F.col("b"))


_CIRCLE = "sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) - (a.w + b.w) / 2"


@query("circle_distance", "annotations", body=f"SELECT a.uid AS a, b.uid AS b, {_CIRCLE} <= 0 AS hit, round(greatest({_CIRCLE}, 0), 6) AS distance FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.uid < b.uid WHERE {_CIRCLE} <= {_REACH}")
def circle_distance(spark, sf_dir):
    d = collisions.circle_gap(*(F.col(c) for c in ("a_x", "a_y", "a_w", "b_x", "b_y", "b_w")))
    return _pairs(spark, sf_dir).where(d <= _REACH).select("a", "b", (d <= 0).alias("hit"), F.round(d, 6).alias("distance"))


_TRIANGLE = "[{s}.x, {s}.x + {s}.w, {s}.x + {s}.w / 2] AS {s}_x, [{s}.y, {s}.y, {s}.y + {s}.h] AS {s}_y"


@query(
    "gjk_polygons", "annotations",
    body=f"""WITH p AS (SELECT a.uid AS a, b.uid AS b, {_TRIANGLE.format(s="a")}, {_TRIANGLE.format(s="b")} FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.uid < b.uid WHERE {_GAP} = 0 AND {_DOWN} = 0),
    sides AS (SELECT a, b, a_x, a_y, b_x, b_y, a_x AS ox, a_y AS oy, b_x AS tx, b_y AS ty FROM p UNION ALL SELECT a, b, a_x, a_y, b_x, b_y, b_x, b_y, a_x, a_y FROM p),
    edges AS (SELECT *, ox[e + 1] AS px, oy[e + 1] AS py, ox[(e + 1) % 3 + 1] AS qx, oy[(e + 1) % 3 + 1] AS qy FROM (SELECT *, unnest(range(3)) AS e FROM sides)),
    axes AS (SELECT a, b, list_transform([1, 2, 3], lambda i: a_x[i] * (qy - py) - a_y[i] * (qx - px)) AS u, list_transform([1, 2, 3], lambda i: b_x[i] * (qy - py) - b_y[i] * (qx - px)) AS v FROM edges),
    apart AS (SELECT a, b, bool_or(list_min(u) > list_max(v) OR list_min(v) > list_max(u)) AS apart FROM axes GROUP BY 1, 2),
    feet AS (SELECT a, b, px, py, qx, qy, tx[i] AS cx, ty[i] AS cy, least(greatest(((tx[i] - px) * (qx - px) + (ty[i] - py) * (qy - py)) / (pow(qx - px, 2) + pow(qy - py, 2)), 0), 1) AS t FROM (SELECT *, unnest([1, 2, 3]) AS i FROM edges)),
    nearest AS (SELECT a, b, min(sqrt(pow(px + t * (qx - px) - cx, 2) + pow(py + t * (qy - py) - cy, 2))) AS d FROM feet GROUP BY 1, 2)
    SELECT a, b, NOT apart AS hit, round(CASE WHEN apart THEN d ELSE 0 END, 6) AS distance FROM apart JOIN nearest USING (a, b)""",
)
def gjk_polygons(spark, sf_dir):
    """Boxes of an image against each other as polygons, where their bounding boxes meet."""
    p = _pairs(spark, sf_dir)
    meet = collisions.box_gap(*(F.col(c) for c in ("a_x", "a_y", "a_w", "a_h", "b_x", "b_y", "b_w", "b_h"))) == 0

    def shape(s: str):
        x, y, w, h = (F.col(f"{s}_{c}") for c in "xywh")
        return F.struct(F.lit("polygon").alias("kind"), F.array(x - w, y - h, x + w, y - h, x, y + h).alias("params"))

    found = collisions.collide(p.where(meet).select("a", "b", shape("a").alias("shape_a"), shape("b").alias("shape_b")))
    return found.select("a", "b", F.col("collision.hit").alias("hit"), F.round("collision.distance", 6).alias("distance"))


_FRAMES = "f AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since FROM events)"


def _frames(spark, sf_dir):
    return derive.table(spark, sf_dir, "events")


@query("frames_sampled", body=f"WITH {_FRAMES} SELECT event_id, user_id, frame_no FROM f WHERE since / 1e6 >= 3600 AND since / 1e6 < 3600 + 864000 AND frame_no % 3 = 0")
def frames_sampled(spark, sf_dir):
    return frames.sampled(_frames(spark, sf_dir), "user_id", "ts", ["ts", "event_id"], 3, 3600.0, 864000.0).select("event_id", "user_id", F.col("frame_no").cast("long").alias("frame_no"))


@query("frames_chunked", body=f"WITH {_FRAMES} SELECT event_id, CAST(frame_no // 4 AS INT) AS chunk FROM f")
def frames_chunked(spark, sf_dir):
    return frames.chunked(frames.numbered(_frames(spark, sf_dir), "user_id", ["ts", "event_id"]), 4).select("event_id", "chunk")


@query("frames_parts", body=f"WITH {_FRAMES} SELECT event_id, CAST(floor(coalesce(sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200.0) AS INT) AS part FROM f")
def frames_parts(spark, sf_dir):
    f = frames.numbered(_frames(spark, sf_dir), "user_id", ["ts", "event_id"]).withColumn("bytes", F.col("event_id") % 97)
    return frames.parts(f, "user_id", "bytes", 200.0).select("event_id", "part")


@query("frames_too_short", body="SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1 HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 < 100000 + 2400000")
def frames_too_short(spark, sf_dir):
    return frames.check_window(_frames(spark, sf_dir), "user_id", "ts", 100000.0, 2400000.0)


_FEATURES = ("bbox_width", "bbox_height", "bbox_area", "bbox_aspect_ratio", "bbox_x_center", "bbox_y_center", "bbox_perimeter", "bbox_diagonal", "bbox_compactness", "bbox_elongation", "bbox_rectangularity",
             "relative_x", "relative_y", "relative_width", "relative_height", "relative_area", "distance_from_center", "edge_proximity", "corner_distance_tl", "corner_distance_br", "horizontal_position", "vertical_position")


def _importance(spark, sf_dir):
    """How much each feature of the annotations separates the categories."""
    return features.separation(annotation_queries.combined_features(spark, sf_dir), list(_FEATURES), "category_id")


_IMPORTANCE = f"""feats AS ({annotation_queries.ORACLES["combined_features"]}), wide AS (UNPIVOT (SELECT category_id, {", ".join(f"{c}::DOUBLE AS {c}" for c in _FEATURES)} FROM feats) ON {", ".join(_FEATURES)} INTO NAME feature VALUE x),
  totals AS (SELECT feature, avg(x) AS m, var_pop(x) * count(x) AS whole FROM wide GROUP BY 1), means AS (SELECT feature, category_id, avg(x) AS c, count(x) AS n FROM wide GROUP BY 1, 2),
  shares AS (SELECT feature, sum(n * pow(c - m, 2)) / any_value(whole) AS share FROM means JOIN totals USING (feature) GROUP BY 1), imp AS (SELECT feature, round(share / (SELECT sum(share) FROM shares), 9) AS importance FROM shares)"""


@query("feature_importance", body=f"WITH {_IMPORTANCE} SELECT feature, round(importance, 6) AS importance FROM imp")
def feature_importance(spark, sf_dir):
    return _importance(spark, sf_dir).withColumn("importance", F.round("importance", 6))


@query("top_features", body=f"WITH {_IMPORTANCE} SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank, feature, round(importance, 6) AS importance FROM imp QUALIFY rank <= 8")
def top_features(spark, sf_dir):
    return advice.top_features(_importance(spark, sf_dir), 8).withColumn("importance", F.round("importance", 6))


@query(
    "augmentation_advice",
    body=f"""WITH {_IMPORTANCE}, s AS (SELECT 'Apply random translations, crops, and spatial flips.' AS a, 0 AS k WHERE EXISTS (SELECT 1 FROM imp WHERE feature IN ('bbox_x_center', 'bbox_y_center', 'horizontal_position', 'vertical_position') AND importance > 0.02)
    UNION ALL SELECT 'Apply random scaling and aspect ratio jitter.', 1 WHERE EXISTS (SELECT 1 FROM imp WHERE feature IN ('bbox_area', 'bbox_width', 'bbox_height', 'bbox_aspect_ratio') AND importance > 0.02)
    UNION ALL SELECT 'Consider random rotations and stretching.', 2 WHERE EXISTS (SELECT 1 FROM imp WHERE feature = 'bbox_elongation' AND importance > 0.02))
    SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS position, a AS advice FROM s""",
)
def augmentation_advice(spark, sf_dir):
    return advice.augmentations(_importance(spark, sf_dir), 0.02)


@query("weak_features", body=f"WITH {_IMPORTANCE} SELECT feature FROM imp WHERE importance < (SELECT avg(importance) / 2 FROM imp)")
def weak_features(spark, sf_dir):
    return advice.weak_features(_importance(spark, sf_dir))


def _flat(spark, sf_dir):
    return stats.flat_annotations(derive.annotations(spark, sf_dir), derive.categories(spark, sf_dir))


@query(
    "dashboard_area_histogram", "annotations", "categories",
    body="""WITH f AS (SELECT name AS category_name, w * h AS v FROM annotations JOIN categories c ON category_id = c.id), e AS (SELECT category_name, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1)
    SELECT category_name, CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, lo, hi, count(*) AS n FROM f JOIN e USING (category_name) GROUP BY 1, 2, 3, 4""",
)
def dashboard_area_histogram(spark, sf_dir):
    return dashboard.binned(_flat(spark, sf_dir), "bbox_area", 30)


def _trace(name: str, bins: int) -> str:
    return f"""SELECT '{name}' AS trace, category_name, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) ELSE 0 END AS bin, lo, hi, count(*) AS n
    FROM {name} JOIN (SELECT category_name, min(v) AS lo, max(v) AS hi FROM {name} GROUP BY 1) USING (category_name) GROUP BY 1, 2, 3, 4, 5"""


@query(
    "dashboard_traces", "annotations", "categories",
    body=f"""WITH f AS (SELECT name AS category_name, image_id, w, h FROM annotations JOIN categories c ON category_id = c.id), area AS (SELECT category_name, w * h AS v FROM f),
    aspect_ratio AS (SELECT category_name, w / h AS v FROM f), per_image AS (SELECT category_name, count(*)::DOUBLE AS v FROM f GROUP BY category_name, image_id)
    {_trace("area", 30)} UNION ALL {_trace("aspect_ratio", 30)} UNION ALL {_trace("per_image", 20)}""",
)
def dashboard_traces(spark, sf_dir):
    return dashboard.category_traces(_flat(spark, sf_dir))


@query("dashboard_scatter", "annotations", "categories", body="SELECT name AS category_name, w / h AS x, w * h AS y FROM annotations JOIN categories c ON category_id = c.id")
def dashboard_scatter(spark, sf_dir):
    return dashboard.scatter(_flat(spark, sf_dir))


@query("box_shapes", "annotations", "rects", body="SELECT idx, x0, y0, x1, y1, concat('Box ', row_number() OVER (ORDER BY idx)) AS name FROM rects")
def box_shapes(spark, sf_dir):
    return dashboard.box_shapes(derive.rectangles(derive.annotations(spark, sf_dir)))


@query("ward_labels")
def ward_labels(spark, sf_dir):
    """Ward linkage of all embeddings."""
    return clusters.ward_labels(points(spark, sf_dir).select("id", "v"), 8)


@query("generated_dataset")
def generated_dataset(spark, sf_dir):
    """A generated dataset with as many images as the customer table has rows."""
    n = derive.table(spark, sf_dir, "customer").count()
    a = generate.dataset(spark, n)["annotations"]
    return a.select("id", "image_id", "category_id", F.round("area", 6).alias("area"), pg.is_self_intersecting(pg.polygon_points(F.get("segmentation", 0))).alias("crosses_itself"))
