import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annogrid.functions import polygons as pg
from annogrid.functions import strings
from annogrid.operators import advice, clusters, collisions, features, graph, homography, keypoints, merge, pixels, rects, sketches, spectrum, stats
from annogrid.sources import coco, files
from annogrid.streaming import frames as stream

RECTS = "idx long, image_id long, x0 double, y0 double, x1 double, y1 double"
relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def made(spark, rows):
    return spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(rows)], RECTS)


@pytest.mark.parametrize(
    ("rows", "inner", "groups", "bad"),
    [
        ([(0, 0, 10, 10), (2, 2, 5, 5)], {1}, {0: 0, 1: 0}, {1}),
        ([(0, 0, 10, 10), (2, 2, 10, 5)], set(), {0: 0, 1: 0}, {1}),
        ([(0, 0, 4, 4), (0, 0, 4, 4)], set(), {0: 0, 1: 0}, {0}),
        ([(0, 0, 4, 4), (4, 0, 8, 4)], set(), {}, set()),
        ([(0, 0, 4, 4), (3, 0, 7, 4), (6, 0, 10, 4)], set(), {0: 0, 1: 0, 2: 0}, {0, 1}),
        ([(2, 0, 2, 4), (0, 0, 4, 4)], {0}, {}, {0}),
        ([(4, 4, 0, 0), (1, 1, 2, 2)], {1}, {0: 0, 1: 0}, {1}),
        ([], set(), {}, set()),
    ],
)
def test_rectangle_cases(spark, rows, inner, groups, bad):
    df = made(spark, rows)
    assert {r.idx for r in rects.nested(df).collect()} == inner
    assert {r.idx: r.comp for r in rects.overlap_groups(df).collect()} == groups
    assert {r.idx for r in rects.invalid(df).collect()} == bad


def test_crossing_types(spark):
    a = made(spark, [(0, 0, 10, 10)])
    b = spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate([(2, 2, 5, 5), (-2, 2, 5, 5), (2, -2, 5, 5), (-2, -2, 5, 5), (20, 20, 30, 30)])], RECTS)
    found = {r.b_idx: (r.type, r.boundaries) for r in rects.classified(a, b).collect()}
    assert found == {1: ("vertical", "left"), 2: ("horizontal", "top"), 3: ("both", "left,top")}
    assert {r.b: r.intersection_count for r in rects.intersections_of_b(a, b).collect()} == {1: 1, 2: 1, 3: 1}


@relaxed
@given(st.integers(0, 10**6), st.sampled_from([1.5, 4.0, 50.0]))
def test_grid_join_is_the_plain_join(spark, seed, cell):
    rng = random.Random(seed)
    rows = [tuple(rng.randint(-10, 10) for _ in range(4)) for _ in range(25)]
    a, b = made(spark, rows[:12]), made(spark, rows[12:])
    want = {(r.a_idx, r.b_idx) for r in rects.overlap_pairs(a, b).collect()}
    grid = [(r.a_idx, r.b_idx) for r in rects.overlap_pairs_on_grid(a, b, cell).collect()]
    assert len(grid) == len(set(grid)) and set(grid) == want


def test_depth(spark):
    got = [(r.x0, r.x1, r.y_low, r.y_high, r.depth, r.members) for r in rects.coverage_depth(made(spark, [(0, 0, 4, 4), (3, 0, 7, 4), (3, 0, 5, 4)])).orderBy("position").collect()]
    assert got == [(3.0, 4.0, 0.0, 4.0, 3, [0, 1, 2]), (3.0, 5.0, 0.0, 4.0, 2, [0, 1])]
    stacked = made(spark, [(0, 0, 4, 2), (0, 3, 4, 5)])
    assert rects.coverage_depth(stacked).count() == 0  # one above the other
    shifted = [(r.x0, r.x1, r.y_low, r.y_high, r.depth) for r in rects.coverage_depth(made(spark, [(0, 0, 4, 4), (2, 2, 6, 6), (9, 1, 9, 3)])).orderBy("position").collect()]
    assert shifted == [(2.0, 4.0, 2.0, 3.0, 2), (2.0, 4.0, 3.0, 4.0, 2)]
    sets = {(r.y_low, r.x, r.ends): r.members for r in rects.active_sets(made(spark, [(0, 0, 4, 4), (2, 0, 6, 4)])).collect()}
    assert sets == {(0.0, 0.0, 0): [0], (0.0, 2.0, 0): [0, 1], (0.0, 4.0, 1): [1]}


def test_crowded_images(spark):
    rng = random.Random(7)
    rows = [(i, i % 2, *(float(rng.randint(0, 60)) for _ in range(4))) for i in range(120)]
    df = spark.createDataFrame(rows, RECTS)
    assert {tuple(r) for r in rects.nested(df).collect()} == {tuple(r) for r in rects.nested(df, most=10).collect()}
    plain, grid = ({(r.idx, r.comp) for r in rects.overlap_groups(df, most=m).collect()} for m in (500, 10))
    assert plain == grid and plain


def test_features_by_hand(spark):
    row = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 100, 200)], "x double, y double, w double, h double, iw int, ih int")
    f = features.spatial_features(*map(F.col, ("x", "y", "w", "h", "iw", "ih")))
    got = row.select(*(v.alias(k) for k, v in f.items())).first().asDict()
    far = math.hypot(100, 200)
    want = {"relative_x": 0.1, "relative_y": 0.1, "relative_width": 0.3, "relative_height": 0.2, "relative_area": 0.06, "distance_from_center": math.hypot(25, 60) / far, "edge_proximity": 0.1,
            "corner_distance_tl": math.hypot(10, 20) / far, "corner_distance_br": math.hypot(60, 140) / far, "horizontal_position": 0.25, "vertical_position": 0.2}
    assert got == pytest.approx(want)
    polygons = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 3.0],), ([0.0, 0.0, 1.0, 1.0],), ([0.0] * 7,), (None,), ([1.0, 1.0] * 3,)], "p array<double>")
    rows = [tuple(r) for r in polygons.select(*(v.alias(k) for k, v in features.segmentation_features(F.col("p"), F.lit(4.0), F.lit(3.0)).items())).collect()]
    assert rows[0] == pytest.approx((3.0, 6.0, 2.0, 12.0, 4 * math.pi * 6 / 144)) and rows[1] == rows[2] == rows[3] == (0.0, 0.0, 1.0, 0.0, 0.0) and rows[4] == (3.0, 0.0, 1.0, 0.0, 0.0)
    assert {n for names, _ in advice.SENTENCES for n in names} <= set(got) | set(features.box_features(*map(F.col, "xywh")))


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_polygons(spark):
    cases = [("bow", [10, 10, 90, 90, 90, 10, 10, 90], (50.0, 50.0)), ("eight", [0, 0, 3, 0, 2, 1, 0, 3, 3, 2], (1.8, 1.2)), ("square", [0, 0, 4, 0, 4, 4, 0, 4], None), ("triangle", [0, 0, 4, 0, 4, 4], None)]
    df = spark.createDataFrame([(n, [float(x) for x in f]) for n, f, _ in cases], "name string, flat array<double>").withColumn("p", pg.polygon_points(F.col("flat")))
    got = {r["name"]: r for r in df.select("name", pg.is_self_intersecting(F.col("p")).alias("s"), F.get(pg.crossings(F.col("p")), 0).alias("at"), pg.polygon_area(F.col("p")).alias("area"), pg.polygon_perimeter(F.col("p")).alias("around"), pg.bounds(F.col("p")).alias("box")).collect()}
    for name, _, at in cases:
        assert got[name].s == (at is not None)
        assert at is None or (got[name]["at"].x, got[name]["at"].y) == pytest.approx(at)
    assert (got["square"].area, got["square"].around, tuple(got["square"].box)) == (16.0, 16.0, (0.0, 0.0, 4.0, 4.0))


def fold(base, new):
    top, seen, count, out = max(base, default=0), set(), 0, []
    for v in new:
        if v in base or v in seen or top < v <= top + count:
            count += 1
            out.append(top + count)
        else:
            out.append(v)
        seen.add(v)
    return out


@relaxed
@given(st.lists(st.integers(1, 12), max_size=8), st.lists(st.integers(1, 20), max_size=14))
def test_id_remap_is_the_fold(spark, base, new):
    b = spark.createDataFrame([(x,) for x in base], "id long")
    n = spark.createDataFrame([(x, k) for k, x in enumerate(new)], "id long, position long")
    got = [r.new_id for r in merge.remapped_ids(b, n).orderBy("position").collect()]
    assert got == fold(set(base), new)
    strict = [r.new_id for r in merge.remapped_ids(b, n, strict=True).orderBy("position").collect()]
    fresh = [x for x, y in zip(strict, new, strict=True) if x != y]
    assert len(set(strict)) == len(strict) and not set(fresh) & (set(base) | set(new))


def test_remap_over_ranges(spark):
    new = [k % 40 + 1 for k in range(200)]
    b, n = spark.createDataFrame([(x,) for x in range(1, 21)], "id long"), spark.createDataFrame([(x, k) for k, x in enumerate(new)], "id long, position long").repartition(5)
    assert [r.new_id for r in merge.remapped_ids(b, n).orderBy("position").collect()] == fold(set(range(1, 21)), new)


def test_merged_categories_by_name(spark):
    base = spark.createDataFrame([(1, "a"), (4, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([(1, "x", 5), (2, "a", 4), (3, "x", 2), (4, "y", 9)], "id long, name string, position long")
    got = {r.old_id: (r.new_id, r.added) for r in merge.merged_categories(base.withColumn("position", F.col("id")), new, "position").collect()}
    assert got == {1: (5, False), 2: (4, False), 3: (5, True), 4: (6, True)}


def test_merge(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    ann = "id long, image_id long, category_id long, position long"
    base = {"images": frame([(1, "a"), (2, "b")], "id long, file_name string"), "categories": frame([(1, "cat")], "id long, name string"), "annotations": frame([(1, 1, 1, 0), (2, 2, 1, 1)], ann)}
    new = {"images": frame([(2, "c"), (9, "d")], "id long, file_name string"), "categories": frame([(1, "dog"), (2, "cat")], "id long, name string"), "annotations": frame([(2, 2, 1, 0), (7, 9, 2, 1)], ann)}
    out, counts = merge.merge(base, new)
    assert {tuple(r)[:3] for r in out["annotations"].collect()} == {(1, 1, 1), (2, 2, 1), (3, 3, 2), (7, 9, 1)}
    assert {tuple(r) for r in out["images"].collect()} == {(1, "a"), (2, "b"), (3, "c"), (9, "d")}
    assert {tuple(r) for r in out["categories"].collect()} == {(1, "cat"), (2, "dog")}
    assert tuple(counts.first()) == (2, 1, 1, 1)


def test_coco_documents(spark, tmp_path):
    doc = {
        "info": {"year": "2024"}, "licenses": [{"id": 1, "name": "x"}], "categories": [{"id": 1, "name": "cat", "supercategory": "s"}],
        "images": [{"id": 5, "width": 10, "height": 20, "file_name": "p/a.jpg", "license": 1, "date_captured": "d"}, {"id": 6, "width": 10, "height": 20, "file_name": "b.jpg"}],
        "annotations": [
            {"id": 1, "image_id": 5, "category_id": 1, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0, "segmentation": [[0, 0, 4, 0, 4, 4]], "flag": True, "note": "n"},
            {"id": 2, "image_id": 5, "category_id": 9, "segmentation": {"counts": "abc", "size": [1, 2]}},
            {"id": 1, "image_id": 7, "category_id": 1, "bbox": [0, 0, 0, 0], "score": 0.5},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = coco.read(spark, str(tmp_path / "c.json"))
    ann = got["annotations"].orderBy("position").collect()
    assert [(a.id, a.bbox, a.segmentation) for a in ann] == [(1, [1, 2, 3, 4], [[0, 0, 4, 0, 4, 4]]), (2, None, None), (1, [0, 0, 0, 0], None)]
    assert got["annotations"].select(F.try_variant_get("extra", "$.flag", "boolean")).first()[0] is True
    assert got["images"].count() == 2 and got["info"].first().info == {"year": "2024"} and got["licenses"].first().license["name"] == "x"
    assert {r.idx for r in coco.boxes(got["annotations"]).collect()} == {1}
    assert [r.image_id for r in coco.last_by_id(got["annotations"], "position").orderBy("id").collect()] == [7, 5]
    assert stats.without_match(got["images"], got["annotations"], "id", "image_id").collect()[0].id == 6
    one = json.loads(coco.document(got["images"], got["annotations"].drop("extra", "position"), got["categories"]).first().value)
    assert len(one["annotations"]) == 3 and one["categories"][0]["name"] == "cat"
    coco.write_parts(got["images"], got["annotations"].drop("extra"), str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "parts")).count() == 2


def test_image_files(spark, tmp_path):
    import struct
    import zlib

    def png(w, h):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (h * (3 * w + 1)))) + chunk(b"IEND", b"")

    (tmp_path / "a.PNG").write_bytes(png(4, 3))
    (tmp_path / "undistorted_b.png").write_bytes(png(7, 2))
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8nothing")
    (tmp_path / "c.txt").write_text("x")
    found = files.list_images(spark, str(tmp_path))
    assert found.count() == 3
    sizes = files.image_sizes(found)
    assert {(r.width, r.height) for r in sizes.collect()} == {(4, 3), (7, 2)}
    assert {r.destination for r in files.planned_moves(sizes, "/t").collect()} == {"/t/4x3/a.PNG", "/t/7x2/undistorted_b.png"}
    assert spark.range(1).select(files.without_prefix(F.lit("undistorted_b.png"))).first()[0] == "b.png"
    (tmp_path / "s.yaml").write_text("over: 200\nunknown: 1\n")
    assert files.load_settings(pixels.ExposureLimits, str(tmp_path / "s.yaml")).over == 200 and files.load_settings(pixels.ExposureLimits, "/none").over == 240


def test_header_sizes():
    import struct

    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    late = b"\xff\xd8" + segment(0xE1, b"x" * 65000) + segment(0xE2, b"y" * 65000) + segment(0xC0, struct.pack(">BHHB", 8, 480, 640, 3) + b"\0" * 9)
    assert files.header_size(late) == (640, 480)
    for order, mark in (("<", b"II"), (">", b"MM")):
        pixels_ = b"\0" * 70000  # the directory is the end of the file
        entry = lambda tag, kind, value: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "H", value) + b"\0\0" if kind == 3 else struct.pack(order + "I", value))  # noqa: E731, B023
        tiff = mark + struct.pack(order + "HI", 42, 8 + len(pixels_)) + pixels_ + struct.pack(order + "H", 3) + entry(254, 4, 0) + entry(256, 3, 70) + entry(257, 4, 1000) + b"\0" * 4
        assert files.header_size(tiff) == (70, 1000) and files.header_size(tiff[:-30]) is None
    webp = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(body)) + body
    assert files.header_size(webp(b"VP8X", b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))) == (100, 50)
    assert files.header_size(webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little"))) == (100, 50)
    assert files.header_size(webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 100, 50))) == (100, 50)
    assert files.header_size(webp(b"VP8 ", b"")) is files.header_size(b"") is files.header_size(b"\xff\xd8\xff") is None


def test_ward_chains_are_the_greedy_merges(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (25, 3)) for c in (0, 3, 9)])
    groups = [[i] for i in range(len(x))]

    def cost(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()

    df = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    while len(groups) > 2:
        i, j = min(((i, j) for j in range(len(groups)) for i in range(j)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
        if len(groups) in (7, 3, 2):
            found = {}
            for r in clusters.ward_labels(df, len(groups)).collect():
                found.setdefault(r.label, set()).add(r.id // 2)
            assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
    assert {r.label for r in clusters.ward_labels(df, 1).collect()} == {0} and clusters.ward_labels(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        clusters.ward_labels(df, 2, most=10)


def test_search_takes_ward_beyond_four_thousand(spark, monkeypatch):
    p = spark.createDataFrame([(i, [float(i % 2) * 50 + i % 13 * 0.01, float(i % 7)]) for i in range(4001)], "id long, v array<double>")
    for name in ("kmeans_labels", "gmm_labels"):
        monkeypatch.setattr(clusters, name, lambda points, k: points.select("id", (F.col("id") % 4 % 3 % k).alias("label")))
    got = {r.name: r for r in clusters.search(p, range(2, 3), eps=()).collect()}
    assert got["agglomerative_2"].best and got["agglomerative_2"].silhouette > 0.8


def test_nearest_and_dbscan_by_blocks(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 6, (40, 2)).astype(float), rng.integers(0, 6, (50, 2)).astype(float)  # many ties
    frame = lambda z, by: spark.createDataFrame([(i * by, v.tolist()) for i, v in enumerate(z)], "id long, v array<double>")
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    want = {(i, int(d[i].argmin()) * 3) for i in range(40) if d[:, d[i].argmin()].argmin() == i}
    for blocks in (1, 3):
        assert {(r.left_id, r.right_id) for r in clusters.mutual_nearest(frame(x, 1), frame(y, 3), blocks).collect()} == want
    one, many = ({(r.id, r.label) for r in clusters.dbscan(frame(rng.permutation(x) * 0 + x, 1), 1.0, 5, b).collect()} for b in (1, 3))
    assert one == many


def test_models_are_kept(spark, tmp_path):
    from pyspark.ml.clustering import KMeansModel

    p = spark.createDataFrame([(i, [float(i % 3) * 10, float(i % 2)]) for i in range(30)], "id long, v array<double>")
    model = clusters.kmeans_model(p, 3, starts=2)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = clusters.labelled_by(KMeansModel.load(str(tmp_path / "m")), p)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in clusters.labelled_by(model, p).collect()}


def test_keypoint_tables(spark):
    a = spark.createDataFrame([("i", 1.0, 2.0), ("i", 3.0, 4.0), ("j", 5.0, 6.0)], "image_name string, x double, y double")
    got = {(r.image_name, r.img_source, r.keypoint_id, r.x) for r in keypoints.both_sources(a.where("x < 5"), a, "corner", "x").collect()}
    assert got == {("i", "Normalized", 0, 1.0), ("i", "Normalized", 1, 3.0), ("i", "Original", 0, 1.0), ("i", "Original", 1, 3.0), ("j", "Original", 0, 5.0)}
    images = spark.createDataFrame([("i",), ("j",)], "image_name string")
    assert keypoints.checked(a, images).count() == 3
    with pytest.raises(Exception, match="no keypoints in j"):
        keypoints.checked(a.where("x < 5"), images).collect()


def test_bloom_state_and_pixels(spark, tmp_path):
    state = sketches.exported(spark.range(50), "id", 200)
    state.write.parquet(str(tmp_path / "bloom"))
    back, m, k = sketches.imported(spark.read.parquet(str(tmp_path / "bloom")))
    assert all(r.might_exist for r in sketches.might_contain(back, spark.range(50), "id", m, k).collect())
    more = sketches.with_more(spark.read.parquet(str(tmp_path / "bloom")), spark.range(50, 60), "id")
    assert {tuple(r) for r in more.collect()} == {tuple(r) for r in sketches.exported(spark.range(60), "id", 200).collect()}
    with pytest.raises(ValueError):
        sketches.imported(state.unionByName(sketches.exported(spark.range(5), "id", 300)))
    images = spark.createDataFrame([(1, 2, 2, 3), (2, 2, 2, 1), (3, 0, 2, 3), (4, 2, 2, 2), (5, 2, 2, None)], "image_id int, height int, width int, channels int")
    assert {r.image_id: r.problem for r in pixels.image_problems(images).collect()} == {3: "no pixels", 4: "not 2D or 3D", 5: "not 2D or 3D"}
    assert {r.image_id for r in pixels.image_problems(images, colour=True).collect()} == {2, 3, 4, 5}
    p = spark.range(16).select(F.lit(1).alias("image_id"), (F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"))
    assert {(r["row"], r["col"]) for r in pixels.cropped(p, 1, 2, 2, 5).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_moved_solids(spark):
    cube = [float(x) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for x in (a, b, c)]
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(("polyhedron", cube), ("capsule", [0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.5]), (turn, [5.0, 0.0, 0.0])), (("polyhedron", cube), ("line", [-9.0, 0.0, 0.0, 9.0, 0.0, 0.0]), None), (("coco_bbox", [0.0, 0.0, 2.0, 2.0]), ("coco_segmentation", [5.0, 0.0, 6.0, 0.0, 5.0, 1.0]), None)]
    df = spark.createDataFrame(rows, f"shape_a {collisions.SHAPE}, shape_b {collisions.SHAPE}, move struct<rotation:array<double>,translation:array<double>>")
    got = {(r.shape_b.kind, r.collision.hit, round(r.collision.distance, 6)) for r in collisions.collide(df, moved="move").collect()}
    assert got == {("capsule", False, 3.5), ("line", True, 0.0), ("coco_segmentation", False, 3.0)}
    assert collisions.support_index(np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), np.array([1.0, 0.0]))[1] == 1


def test_metadata_strings(spark):
    values = ["24", "7/2", "1 1/2", "-7/2", "a", "1/0", None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in df.select(strings.rational(F.col("t"))).collect()] == [24.0, 3.5, 1.5, -3.5, None, None, None]
    body = b'junk\xff<x:xmpmeta a="1"><rdf:Description ns:Key="v" ns:Key="w" drone:Alt="+1.5"/></x:xmpmeta>tail'
    df = spark.createDataFrame([(bytearray(body),), (bytearray(b"none"),), (bytearray(b"<x:xmpmeta></x:xmpmeta>"),)], "c binary")
    got = [r[0] for r in df.select(strings.xmp_attributes(F.col("c"))).collect()]
    assert got[0] == {"ns:Key": "w", "drone:Alt": "+1.5"} and list(got[1]) == list(got[2]) == ["XMP_error"]
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    row = spark.range(1).select(strings.local_names(m({"a:K": "1", "b:K": "2", "L": "3"})).alias("n"), strings.merged_maps(m({"x": "1", "y": "1"}), m({"y": "2"})).alias("m"), strings.number_or_null(F.lit("+1.5")).alias("v"), strings.number_or_null(F.lit("1e5")).alias("w")).first()
    assert (row.n, row.m, row.v, row.w) == ({"K": "2", "L": "3"}, {"x": "1", "y": "2"}, 1.5, None)


def test_murmur_and_bloom(spark):
    # published values of the 32-bit hash
    assert [sketches.murmur3_32(b"", 0), sketches.murmur3_32(b"", 1) & 0xFFFFFFFF, sketches.murmur3_32(b"test", 0) & 0xFFFFFFFF, sketches.murmur3_32(b"Hello, world!", 0) & 0xFFFFFFFF] == [0, 0x514E28B7, 0xBA6BD213, 0xC0363E43]
    items, m, k = spark.range(500), *sketches.size_for(1000, 0.001)
    state = sketches.positions(items, "id", m, k)
    got = {r["item"]: r.might_exist for r in sketches.might_contain(state, spark.range(1500), "id", m, k).collect()}
    assert all(got[i] for i in range(500)) and sum(got[i] for i in range(500, 1500)) < 10
    with pytest.raises(ValueError):
        sketches.size_for(0, 0.1)


GJK = [
    (("box", [0, 0, 1, 1]), ("box", [1.5, 0, 1, 1]), True, 0.0), (("circle", [0, 0, 1]), ("circle", [3, 0, 1]), False, 1.0), (("polygon", [0, 0, 2, 0, 1, 2]), ("polygon", [0.5, 0.5, 2.5, 0.5, 1.5, 2.5]), True, 0.0),
    (("polyhedron", [x for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for x in (a, b, c)]), ("sphere", [3, 0, 0, 1.5]), False, 0.5),
    (("polyhedron", [x for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for x in (a, b, c)]), ("polyhedron", [x for a in (1.5, 3.5) for b in (-1, 1) for c in (-1, 1) for x in (a, b, c)]), False, 0.5),
    (("polyhedron", [x for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for x in (a, b, c)]), ("capsule", [0, 3, 0, 0, 5, 0, 0.5]), False, 1.5), (("ellipse", [0, 0, 2, 1]), ("circle", [4, 0, 1]), False, 1.0), (("box", [0, 0, 1, 1]), ("box", [2, 0, 1, 1]), True, 0.0),
]


def test_collisions(spark):
    shape = lambda s: (s[0], [float(x) for x in s[1]])
    df = spark.createDataFrame([(i, shape(a), shape(b)) for i, (a, b, *_) in enumerate(GJK)] + [(99, None, shape(GJK[0][0]))], f"i int, shape_a {collisions.SHAPE}, shape_b {collisions.SHAPE}")
    for r in collisions.collide(df).collect():
        if r.i == 99:
            assert r.collision is None
        else:
            *_, hit, distance = GJK[r.i]
            assert r.collision.hit == hit and r.collision.distance == pytest.approx(distance, abs=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_gjk_against_boxes(seed):
    rng = random.Random(seed)
    a, b = ([rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.1, 3), rng.uniform(0.1, 3)] for _ in range(2))
    gap = math.hypot(*(max(0.0, abs(a[k] - b[k]) - a[k + 2] - b[k + 2]) for k in range(2)))
    hit, distance, *_ = collisions.gjk("box", a, "box", b)
    assert distance == pytest.approx(gap, abs=1e-6) and (hit == (gap == 0) or gap < 1e-6)


def test_homography_estimate(spark):
    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.02, 5], [0.01, 0.95, -3], [1e-4, 2e-5, 1]])
    p = rng.uniform(0, 500, (60, 2))
    z = np.column_stack([p, np.ones(60)]) @ h.T
    q = z[:, :2] / z[:, 2:]
    q[:15] += rng.uniform(30, 90, (15, 2))
    rows = [(1, *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)] + [(2, 0.0, 0.0, 1.0, 1.0)]
    got = {r.image_id: r for r in homography.estimate(spark.createDataFrame(rows, "image_id long, x double, y double, u double, v double")).collect()}
    assert got[1].inliers >= 45 and np.allclose([got[1][m] for m in homography.MATRIX], h.ravel(), atol=1e-5) and got[2].h00 is None
    names = homography.match_by_name(spark.createDataFrame([("p/a.jpg",), ("b.jpg",)], "file_name string"), spark.createDataFrame([("x/a.jpg",), ("y/a.jpg",)], "path string")).collect()
    assert [(r.file_name, r.corrected_path) for r in names] == [("p/a.jpg", "y/a.jpg")]


def test_spectrum_of_a_wave(spark):
    rows = [(1, r, c, 127.5 + 127.5 * math.cos(2 * math.pi * 2 * c / 8)) for r in range(8) for c in range(8)]
    s = spectrum.magnitudes(spark.createDataFrame(rows, "image_id long, row int, col int, value double"))
    top = {(r.row, r.col) for r in s.where("magnitude > 1").collect()}
    assert top == {(4, 4), (4, 2), (4, 6)}
    bands = spectrum.band_energy(s).first()
    assert bands.low_freq_energy_ratio + bands.mid_freq_energy_ratio + bands.high_freq_energy_ratio == pytest.approx(1)


def test_clusters(spark):
    rows = [(i, [float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3)], i % 3) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, v array<double>, label int")
    assert clusters.silhouette(p).agg(F.min("silhouette")).first()[0] > 0.8
    assert len({(r.id % 3, r.label) for r in clusters.kmeans_labels(p.select("id", "v"), 3).collect()}) == 3
    assert {r.label for r in clusters.dbscan(p.select("id", "v"), 1.0).collect()} == {0, 1, 2}
    assert clusters.best_k(p.select("id", "v"), range(2, 4)).orderBy(F.desc("silhouette"), "k").first().k == 3


def test_best_k_tries_two_to_eight_with_ten_starts(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    p = spark.createDataFrame([(i, [float(i % 6) * 10, float(i % 6 // 3) * 50 + i % 5 * 0.01]) for i in range(60)], "id long, v array<double>")
    fitted, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data: fitted.append((self.getK(), self.getSeed())) or fit(self, data))
    scores = {r.k: r.silhouette for r in clusters.best_k(p).collect()}
    assert set(scores) == set(range(2, 9)) and max(scores, key=scores.get) == 6
    assert len(set(fitted)) == 70


def test_streams_match_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, None, i % 3, "ab"[i % 2], float(i), None) for i in range(200)]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 30))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_frames(spark, str(tmp_path / "in"))
    q = stream.to_parquet(stream.every_nth(source, "event_id", 7), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(range(0, 200, 7))
    again = stream.to_parquet(stream.every_nth(stream.read_frames(spark, str(tmp_path / "in")), "event_id", 7), str(tmp_path / "out"), str(tmp_path / "cp"))
    again.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 29
    q = stream.windowed_counts(source, "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from windows").first()[0] == 200
    q = stream.sessions(source, "ts", "user_id").writeStream
    q = q.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from sessions").first()[0] == 200


def test_grid_within_images(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, *(float(rng.randint(0, 20)) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(rows, RECTS)
    pairs = lambda f: sorted((r.a_idx, r.b_idx) for r in f.collect())
    assert pairs(rects.overlap_pairs(df)) == pairs(rects.overlap_pairs(df, cell=4.0))


def test_rectangles_of_images(spark):
    ann = spark.createDataFrame([(10, 1, [0.0, 0.0, 2.0, 2.0], 0), (11, 2, [1.0, 1.0, 1.0, 1.0], 1), (12, 1, [3.0, 3.0, 1.0, 1.0], 2)], "id long, image_id long, bbox array<double>, position long")
    wanted = spark.createDataFrame([(2, 0), (1, 1)], "id long, position long")
    got = {r.idx: (r.id, r.x1) for r in coco.rectangles_of_images(ann, wanted).collect()}
    assert got == {0: (11, 2.0), 1: (10, 2.0), 2: (12, 4.0)}


def test_murmur_of_arrays():
    rng = random.Random(5)
    texts = [b"", b"a", b"\xff" * 7, *(rng.randbytes(rng.randrange(40)) for _ in range(300))]
    for seed in (0, 1, 0x9747B28C):
        assert sketches.murmur3_32_of(pa.array(texts, pa.binary()), seed).tolist() == [sketches.murmur3_32(t, seed) for t in texts]
    part = pa.array(texts, pa.binary())[5:9]
    assert sketches.murmur3_32_of(part).tolist() == [sketches.murmur3_32(t) for t in texts[5:9]]
    assert not len(sketches.murmur3_32_of(pa.array([], pa.binary())))
    assert sketches._bytes_of(pa.array([7, None, -2])).to_pylist() == [b"7", b"None", b"-2"]
