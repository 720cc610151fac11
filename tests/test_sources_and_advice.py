import math
import struct

import pytest
from pyspark.sql import functions as F

from annogrid import cli
from annogrid.functions import polygons as pg
from annogrid.operators import advice, chroma, clusters, dashboard, lens, rects, registry
from annogrid.sources import exif, generate


def test_generated_data(spark):
    data = generate.dataset(spark, 20)
    ann = data["annotations"].join(data["images"].select(F.col("id").alias("image_id"), "width", "height"), "image_id").collect()
    assert data["images"].count() == 20 and len({a.id for a in ann}) == len(ann) >= 20
    for a in ann:
        x, y, w, h = a.bbox
        assert 0 <= x and x + w <= a.width and 0 <= y and y + h <= a.height and a.area > 0 and len(a.segmentation[0]) >= 8
    assert sorted(map(str, data["annotations"].collect())) == sorted(map(str, generate.dataset(spark, 20)["annotations"].collect()))
    assert [r.supercategory for r in data["categories"].orderBy("id").collect()] == [f"supercategory_{k}" for k in (1, 2, 1, 2, 1)]


def test_fixtures(spark):
    eight = spark.createDataFrame([([{"x": x, "y": y} for x, y in generate.FIGURE_EIGHT],)], "p array<struct<x:double,y:double>>")
    assert eight.select(pg.is_self_intersecting(F.col("p"))).first()[0]
    boxes = [(min(x for x, _ in s), max(x for x, _ in s)) for s in generate.separated_shapes()]
    assert boxes[0][1] < boxes[1][0] and boxes[1][1] < boxes[2][0]
    rows, inner, _ = generate.nested_rectangles(seed=7)
    df = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "idx long, image_id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.idx for r in rects.nested(df).collect()) == inner


def test_fringe_image_is_corrected(spark):
    image = generate.fringe_image(spark, 24, 24, 6.0, (1.0, 0.0, -1.0))
    done = chroma.corrected(image, chroma.ChromaSettings(radius=2, guide=1)).join(image.select("image_id", "row", "col", F.col("c0").alias("o0")), ["image_id", "row", "col"])
    off = done.agg(F.avg(F.abs(F.col("c0") - F.col("c1"))), F.avg(F.abs(F.col("o0") - F.col("c1")))).first()
    assert off[0] < off[1]
    twice = chroma.staged(image, [(2, chroma.ChromaSettings(radius=1)), (1, chroma.ChromaSettings(radius=2))])
    assert twice.count() == 576


def jpeg_with_exif():
    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    make, lens_name = b"Maker\0", b"Lens 24\0"
    head = b"II*\0" + struct.pack("<I", 8)
    ifd0_at, data0 = 8, 8 + 2 + 2 * 12 + 4
    exif_at = data0 + len(make)
    ifd0 = struct.pack("<H", 2) + entry(0x010F, 2, len(make), struct.pack("<I", data0)) + entry(0x8769, 4, 1, struct.pack("<I", exif_at)) + b"\0" * 4
    data1 = exif_at + 2 + 2 * 12 + 4
    ifd1 = struct.pack("<H", 2) + entry(0x920A, 5, 1, struct.pack("<I", data1)) + entry(0xA434, 2, len(lens_name), struct.pack("<I", data1 + 8)) + b"\0" * 4
    tiff = head + ifd0 + make + ifd1 + struct.pack("<II", 7, 2) + lens_name
    assert ifd0_at == 8
    iptc = b"\x1c\x02\x5a" + struct.pack(">H", 5) + b"Paris" + b"\x1c\x02\x19" + struct.pack(">H", 1) + b"a" + b"\x1c\x02\x19" + struct.pack(">H", 1) + b"b" + b"\x1c\x02\x69" + struct.pack(">H", 0)
    shop = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(iptc)) + iptc
    segment = lambda m, c: b"\xff" + bytes([m]) + struct.pack(">H", len(c) + 2) + c
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xED, shop) + b"\xff\xd9"


def test_metadata_and_lens_plan(spark):
    files = spark.createDataFrame([("a.jpg", bytearray(jpeg_with_exif())), ("b.jpg", bytearray(b"\xff\xd8broken")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in exif.file_metadata(files).collect()}
    assert got["a.jpg"].exif == {"Image Make": "Maker", "EXIF FocalLength": "7/2", "EXIF LensModel": "Lens 24"} and got["a.jpg"].iptc == {"city": "Paris", "keywords": "a; b"}
    assert got["b.jpg"].exif == got["c"].exif == {}
    rows = [(1, {"Image Make": "maker", "Image Model": "m", "EXIF FocalLength": "7/2", "EXIF ApertureValue": "4", "RelativeAltitude": "+1.5"}), (2, {"Image Make": "x"}), (3, {"Image Make": "Maker", "Image Model": "M", "EXIF LensModel": "other"}), (4, {"Image Make": "Maker", "Image Model": "M", "EXIF FocalLength": "a"})]
    profiles = spark.createDataFrame([("Maker", "M", 1.5, "L", 0.1, 0.0, 0.0)], "make string, model string, crop_factor double, lens string, k1 double, k2 double, k3 double")
    plan = lens.planned(spark.createDataFrame(rows, "image_id long, m map<string,string>"), profiles)
    assert {r.image_id: r.status for r in plan.collect()} == {1: "corrected", 2: "camera not found", 3: "lens not found", 4: "focal length or aperture missing"}
    assert plan.where("image_id = 1").first().distance == 1.5 and tuple(lens.counts(plan).first()) == (1, 3)
    pixels = generate.fringe_image(spark, 9, 9).withColumn("image_id", F.lit(1).cast("long"))
    moved = {(r["row"], r["col"]): r.c1 for r in lens.remapped(pixels, plan, ["c1"]).collect()}
    plain = {(r["row"], r["col"]): r.c1 for r in pixels.collect()}
    assert moved[4, 4] == pytest.approx(plain[4, 4]) and moved[0, 0] < plain[0, 0]
    none = lens.remapped(pixels, plan.withColumns({"k1": F.lit(0.0)}), ["c1"])
    assert all(plain[r["row"], r["col"]] == pytest.approx(r.c1) for r in none.collect())


def test_advice(spark):
    importance = spark.createDataFrame([("bbox_area", 0.5), ("bbox_elongation", 0.1), ("seg_area", 0.05), ("relative_x", 0.4)], "feature string, importance double")
    assert [r.advice for r in advice.augmentations(importance).collect()] == ["Apply random scaling and aspect ratio jitter."]
    assert [r.advice for r in advice.augmentations(importance.limit(0)).collect()] == [advice.STANDARD]
    assert {r.feature for r in advice.weak_features(importance).collect()} == {"bbox_elongation", "seg_area"}
    rows = spark.createDataFrame([(k % 2, (k % 4) if k % 2 else 0) for k in range(60)], "cluster long, category_id long")
    said = [r.advice for r in advice.class_weight_advice(rows, "cluster", "category_id").orderBy("position").collect()]
    assert said[0].startswith("Increase loss weight for objects in clusters: [1]") and "[1, 3]" in said[1]
    calm = advice.class_weight_advice(rows.where("cluster = 0"), "cluster", "category_id").collect()
    assert [r.advice for r in calm] == [advice.BALANCED]
    sizes = spark.createDataFrame([(10.0, 10.0), (10.2, 10.1), (3.0, 4.0)], "w double, h double")
    bundle = advice.recommendations("kmeans", 2, importance, sizes, rows, "cluster", "category_id").collect()
    assert sum(r.part == "anchor_boxes" for r in bundle) == 2 and sum(r.part == "top_features" for r in bundle) == 4
    results = spark.createDataFrame([("kmeans_2", 2, 0.5), ("gmm_2", 2, 0.7)], "name string, k int, silhouette double")
    text = advice.report("REPORT", [("Total", "60")], importance, results)
    assert text.index("gmm_2") < text.index("kmeans_2") and " 1. bbox_area" in text


def test_ward_and_search(spark):
    rows = [(i, [float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3)]) for i in range(45)]
    p = spark.createDataFrame(rows, "id long, v array<double>")
    labels = {r.id: r.label for r in clusters.ward_labels(p, 3).collect()}
    assert len(set(labels.values())) == 3 and all(labels[i] == labels[i % 3] for i in labels)
    with pytest.raises(ValueError):
        clusters.ward_labels(p, 3, most=10)
    found = clusters.search(p, range(2, 4), eps=(1.0,)).collect()
    assert {r.name for r in found} >= {"kmeans_2", "kmeans_3", "gmm_2", "agglomerative_3", "dbscan_1.0"}
    (best,) = [r for r in found if r.best]
    assert best.k == 3


def test_search_tries_ten_eps_and_names_what_it_leaves_out(spark):
    import inspect

    from annogrid.operators import analysis

    for fn in (clusters.search, analysis.cluster_run):
        assert inspect.signature(fn).parameters["eps"].default == pytest.approx([0.1 + 1.9 * i / 9 for i in range(10)])
    p = spark.createDataFrame([(i, [float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3)]) for i in range(45)], "id long, v array<double>")
    found = {r.name: r for r in clusters.search(p, range(2, 4), eps=(1.0,), most=44).collect()}
    assert found["agglomerative_2"].silhouette is None and found["agglomerative_3"].k == 3 and not found["agglomerative_3"].best
    assert sum(r.best for r in found.values()) == 1 and found["dbscan_1.0"].silhouette > 0.8


def test_dashboard_and_registry(spark):
    flat = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 1, 5.0, 2.0), ("b", 2, 4.0, 1.0)], "category_name string, image_id long, bbox_area double, bbox_aspect_ratio double")
    traces = dashboard.category_traces(flat).collect()
    assert {(r.category_name, r.bin, r.n) for r in traces if r.trace == "area"} == {("a", 0, 1), ("a", 29, 1), ("b", 0, 1)}
    heat = dashboard.heatmap(spark.createDataFrame([(1.0, 1.0), (20.0, 10.0), (21.0, 1.0)], "cx double, cy double"), 20.0, 10.0, 0.5)
    sums = {r.sigma: r.s for r in heat.groupBy("sigma").agg(F.sum("value").alias("s")).collect()}
    assert sums[0.0] == 2.0 and all(math.isclose(v, 2.0, abs_tol=1e-3) for v in sums.values())
    own = registry.Registry("analysis")
    own.register("good")(lambda df: df.select("bbox_area"))
    own.register("bad")(lambda df: df.select("nothing"))
    done, failed = own.run_all(flat)
    assert list(done) == ["good"] and "nothing" in failed["bad"]
    with pytest.raises(ValueError):
        registry.detectors.get("sift")
    assert "exposure_grade" in registry.analyses.known


def test_command_line(spark, tmp_path):
    import json

    doc = {"images": [{"id": 1, "width": 700, "height": 500, "file_name": "a.jpg"}], "categories": [], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    config = tmp_path / "c.yaml"
    config.write_text(f"coco_json_path: {tmp_path}/c.json\noutput_dir: {tmp_path}/out\ntile_width: 500\ntile_height: 350\n")
    assert cli.main([str(config), "split"]) == 0 and spark.read.json(f"{tmp_path}/out").first().width == 700
    assert cli.main([str(config), "preprocess"]) == 0 and spark.read.option("header", True).csv(f"{tmp_path}/out").count() > 1
    spark.range(100).select(F.lit("v").alias("video"), F.timestamp_seconds(F.col("id")).alias("ts")).write.parquet(f"{tmp_path}/frames")
    config.write_text(f"frames: {tmp_path}/frames\noutput_dir: {tmp_path}/s\nevery: 10\nsample: {{offset_seconds: 20, duration_seconds: 40}}\n")
    assert cli.main([str(config), "sample"]) == 0 and spark.read.parquet(f"{tmp_path}/s").count() == 4
    config.write_text(f"frames: {tmp_path}/frames\noutput_dir: {tmp_path}/s\nsample: {{offset_seconds: 90, duration_seconds: 40}}\n")
    assert cli.main([str(config), "sample"]) == 2
    config.write_text(f"frames: {tmp_path}/frames\noutput_dir: {tmp_path}/s\nsample: {{offset_seconds: 500}}\n")
    assert cli.main([str(config), "sample"]) == 3
    assert cli.main([str(tmp_path / "none.yaml"), "sample"]) == 1
