import struct
import zlib

import pytest
from pyspark.sql import functions as F

from annogrid.operators import analysis, homography
from annogrid.sources import files


def test_transform_annotations(spark):
    shift = [1.0, 0.0, 5.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0]
    matrices = spark.createDataFrame([(1, *shift), (2, *[None] * 9), (3, *shift)], "image_id long, " + ", ".join(f"{m} double" for m in homography.MATRIX))
    images = spark.createDataFrame([(1, 100, 50, "p/a.jpg"), (2, 100, 50, "b.jpg"), (3, 100, 50, "none.jpg")], "id long, width int, height int, file_name string")
    corrected = spark.createDataFrame([("out/a.jpg",), ("out/b.jpg",)], "path string")
    square = [10.0, 10.0, 20.0, 10.0, 20.0, 20.0, 10.0, 20.0]
    rows = [
        (1, 1, [10.0, 10.0, 10.0, 10.0], [square, [1.0, 1.0]], [10.0, 10.0, 2.0, 0.0, 0.0, 0.0]), (2, 1, [98.0, 0.0, 5.0, 5.0], None, None), (3, 1, None, [[0.0, 0.0, 1.0, 1.0]], None),
        (4, 2, [1.0, 1.0, 5.0, 5.0], None, None), (5, 3, [1.0, 1.0, 5.0, 5.0], None, None), (6, 9, [1.0, 1.0, 5.0, 5.0], None, None), (7, 1, None, None, None),
    ]
    ann = spark.createDataFrame(rows, "id long, image_id long, bbox array<double>, segmentation array<array<double>>, keypoints array<double>")
    out, counts = homography.transform_annotations(ann, images, corrected, matrices)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {1, 7} and got[1].bbox == [15.0, 8.0, 10.0, 10.0] and got[7].bbox is None
    assert got[1].segmentation == [[15.0, 8.0, 25.0, 8.0, 25.0, 18.0, 15.0, 18.0]] and got[1].keypoints == [15.0, 8.0, 2.0, 0.0, 0.0, 0.0]
    c = counts.first()
    assert (c.annotations, c.kept, c.skipped, c.homographies) == (7, 2, 5, 2)


def test_encoding_and_importance(spark):
    rows = [(i, [float(i), 2.0 * i, float(i % 3)]) for i in range(30)]
    p = spark.createDataFrame(rows, "id long, v array<double>")
    z, error, loadings = analysis.encoding(p, 3)
    assert error == pytest.approx(0, abs=1e-9) and len(loadings) == 3 and len(z.first().v) == 3
    assert analysis.encoding(p, 1)[1] > 0.1
    assert sum(analysis.projected_importance([0.5, 0.5, 0.0], loadings)) == pytest.approx(1)
    a = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "feature string, importance double")
    b = spark.createDataFrame([("x", 1.0)], "feature string, importance double")
    assert {r.feature: r.importance for r in analysis.combined_importance([a, b]).collect()} == {"x": 0.875, "y": 0.25}


def test_cluster_run(spark, tmp_path):
    rows = [(i, float(i % 2) * 9 + (i % 5) * 0.1, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "uid long, a double, b double").withColumn("b", F.col("b") * 0.001)
    analysis.cluster_run(df, ["a", "b"], str(tmp_path / "run"), range(2, 4))
    assert spark.read.option("header", True).csv(str(tmp_path / "run/clusters.csv")).count() == 60
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "run/report.txt")).collect())
    assert "TOP 10 SEPARATING FEATURES" in text and "kmeans_2" in text


def test_pixels_of_files(spark, tmp_path):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"\0" + bytes([10, 20, 30, 1, 2, 3])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"x")
    got = {(r["row"], r["col"]): (r.b, r.g, r.r) for r in files.pixel_table(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (30, 20, 10), (0, 1): (3, 2, 1)}
    files.write_csv(spark.createDataFrame([(1, [1.0, 2.0])], "id long, d array<double>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().d == "1.0 2.0"
