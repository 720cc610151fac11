"""What keeps the work of a query in proportion to its input: plans without joins of pixels, blocks of bounded size."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annogrid.operators import chroma, clusters, homography, lens
from annogrid.plans import catalog, image_queries

DATA = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"(?<!Reused)Exchange \w+", text)


def test_guided_filter_moves_no_pixels(spark):
    text = plan(catalog.QUERIES["guided_filter"](spark, DATA))
    assert "Join" not in text
    assert exchanges(text) == ["Exchange hashpartitioning"]  # of the images, before they have pixels
    assert text.rindex("Generate") < text.index("Exchange ")


def test_percentile_normalised_broadcasts_no_pixels(spark):
    text = plan(catalog.QUERIES["percentile_normalised"](spark, DATA))
    assert "Broadcast" not in text and "SortMergeJoin" not in text
    assert set(exchanges(text)) == {"Exchange hashpartitioning"} and text.count("REPARTITION_BY_NUM") == len(exchanges(text))


def test_lens_remapped_joins_images_only(spark):
    text = plan(catalog.QUERIES["lens_remapped"](spark, DATA))
    joins = [line for line in text.split("\n") if re.search(r"Join \[", line)]
    assert joins and not any("qr#" in line for line in joins)


def test_remap_takes_missing_pixels_as_nothing(spark):
    """One image of 3 x 3 without its middle, drawn outwards by a half of its radius: corners come from outside."""
    rows = [(7, r, c, 3, 3, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    pixels = spark.createDataFrame(rows, "image_id long, row int, col int, rows int, cols int, g double")
    profile = spark.createDataFrame([(7, "corrected", 0.5, 0.0, 0.0), (8, "corrected", 0.0, 0.0, 0.0)], "image_id long, status string, k1 double, k2 double, k3 double")
    found = {(r["row"], r["col"]): r["g"] for r in lens.remapped(pixels, profile, ["g"]).collect()}
    source = {(r, c): v for _, r, c, _, _, v in rows}
    for (r, c), v in found.items():
        f = 1 + 0.5 * ((r - 1) ** 2 + (c - 1) ** 2) / 2
        y, x = (r - 1) * f + 1, (c - 1) * f + 1
        m, n = math.floor(y), math.floor(x)
        assert v == pytest.approx(sum((1 - abs(y - m - a)) * (1 - abs(x - n - b)) * source.get((m + a, n + b), 0.0) for a in (0, 1) for b in (0, 1)))
    assert found.keys() == source.keys()


def test_ca_corrected_moves_no_pixels(spark):
    text = plan(catalog.QUERIES["ca_corrected"](spark, DATA))
    assert "Join" not in text
    assert exchanges(text) == ["Exchange hashpartitioning"]


def test_ca_corrected_sorts_pixels_once(spark):
    text = plan(catalog.QUERIES["ca_corrected"](spark, DATA))
    assert len(re.findall(r"\bSort \[", text)) == 1 and len(re.findall(r"\bGenerate ", text)) == 1


def test_ca_corrected_with_holes_is_its_sql(spark):
    """One image lacks pixels, others have channels that are null, one is black, one is there twice, one has no id."""
    rng = np.random.default_rng(1)
    rows = [(i, r, c, *(int(v) for v in rng.integers(0, 256, 3) * (i != 3))) for i in range(5) for r in range(16) for c in range(16)]
    rows = [x for k, x in enumerate(rows) if x[0] != 1 or (k % 7 and x[1] != 5)]
    rows = [x if x[0] != 2 or k % 11 else (*x[:3], *((None, x[4], x[5]) if k % 2 else (x[3], x[4], None))) for k, x in enumerate(rows)]
    rows += [x for x in rows if x[0] == 4]
    p = spark.createDataFrame([*rows, *((None, *x[1:]) for x in rows if x[0] == 0)], "image_id long, row int, col int, b int, g int, r int")
    found = image_queries.ca_corrected(p).toPandas().sort_values(["image_id", "row", "col"])
    con = duckdb.connect()
    con.execute('CREATE TABLE p (image_id BIGINT, "row" INT, col INT, b INT, g INT, r INT)')
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?, ?, ?)", [tuple(r) for r in p.collect()])
    body = catalog.ORACLES["ca_corrected"].replace(image_queries._PIXELS, "pixels AS (SELECT * FROM p)")
    wanted = con.execute(f"SELECT * FROM ({body}) ORDER BY 1, 2, 3").df()
    assert len(found) == len(rows) and found["c0"].isna().sum() == sum(x[5] is None for x in rows) > 0
    assert np.allclose(found.to_numpy(float), wanted.to_numpy(float), atol=1.1e-3, equal_nan=True)


@pytest.mark.parametrize("refine", [True, False])
def test_correction_of_images_cut_by_batches_and_strips(monkeypatch, refine):
    """Images of several shapes, one with holes and one with a pixel twice, all in batches of 7 rows: each as if it were alone."""
    rng, settings, images = np.random.default_rng(4), chroma.ChromaSettings(radius=2, refine=refine), []
    for i, (h, w) in enumerate([(1, 1), (9, 4), (40, 5), (3, 30), (9, 4), (25, 8)]):
        at = [(r, c) for r in range(h) for c in range(w) if i != 5 or (r * w + c) % 9]
        at += at[3:4] * (i == 2)
        values = rng.integers(0, 256, (h, w, 3)).astype(float)
        images.append(pa.table({"image_id": [f"image {i}"] * len(at), "row": pa.array([r for r, _ in at], pa.int32()), "col": pa.array([c for _, c in at], pa.int32()), "rows": pa.array([h] * len(at), pa.int32()), "cols": pa.array([w] * len(at), pa.int32()), **{f"c{k}": [values[r, c, k] for r, c in at] for k in range(3)}, "n": [len(at)] * len(at)}))
    order = [(c, "ascending") for c in ("image_id", "row", "col")]
    run = lambda tables, size: pa.Table.from_batches(chroma.correct_batches((b for t in tables for b in t.to_batches(size)), settings)).sort_by(order)
    alone = pa.concat_tables(run([t], 1000) for t in images)
    for pixels, large in ((1 << 14, 1 << 18), (30, 1 << 18), (30, 100)):
        monkeypatch.setattr(chroma, "PIXELS", pixels)
        monkeypatch.setattr(chroma, "LARGE", large)
        found = run([pa.concat_tables(images).combine_chunks()], 7)
        assert found.select(["image_id", "row", "col"]).equals(alone.select(["image_id", "row", "col"])) and found.num_rows == sum(t.num_rows for t in images)
        assert all(np.allclose(found.column(c).to_numpy(), alone.column(c).to_numpy(), rtol=0, atol=1e-9) for c in chroma.CHANNELS)
    with pytest.raises(ValueError, match="outside"):
        run([images[1].set_column(1, "row", pa.array([9] * 36, pa.int32()))], 1000)


def test_matched_files_beyond_five_digits(spark, tmp_path):
    """Names are cut to five digits: 10000, 100002, 100003 and 100009 share theirs, and 100002 has no file."""
    ids = [5, 6, 10000, 100002, 100003, 100009]
    spark.createDataFrame([(i, i) for i in ids], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = sorted(tuple(r) for r in catalog.QUERIES["matched_files"](spark, str(tmp_path)).collect())
    assert found == [(5, "b/image_00005.jpg"), (10000, "b/image_10000.jpg"), (100003, "b/image_10000.jpg"), (100009, "b/image_10000.jpg")]


def test_homographies_are_not_solved_group_by_group(spark):
    text = plan(catalog.QUERIES["homography_estimated"](spark, DATA))
    assert "GroupsInArrow" not in text
    assert exchanges(text) == ["Exchange hashpartitioning"] and text.rindex("Generate") < text.index("Exchange ")


def test_homographies_of_images_cut_by_batches(spark):
    """Images of 3 to 40 points, some exact and some with noise, in batches of 7 rows: each as if it were alone."""
    rng, rows, truth = np.random.default_rng(3), [], {}
    for i in range(24):
        n = [3, 4, 9, 9, 12, 40][i % 6]
        h = np.array([[1 + i / 50, 0.02, 5 - i], [0.01, 0.95, -3], [1e-4, 2e-5, 1]])
        p = rng.uniform(0, 500, (n, 2))
        z = np.column_stack([p, np.ones(n)]) @ h.T
        q = z[:, :2] / z[:, 2:] + (rng.normal(0, 0.2, (n, 2)) if i % 4 == 3 else 0)
        q[: n // 8] += 90
        truth[i] = (n, n - n // 8, h, i % 4 == 3)
        rows += [(i, *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        found = homography.estimate(spark.createDataFrame(rows, "image_id long, x double, y double, u double, v double"), confidence=1 - 1e-9).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r.image_id for r in found) == sorted(truth)
    for r in found:
        n, inliers, h, noisy = truth[r.image_id]
        got = [r[m] for m in homography.MATRIX]
        if n < 4:
            assert got == [None] * 9 and r.inliers == 0
            continue
        assert r.inliers == inliers
        p = np.array([x[1:3] for x in rows if x[0] == r.image_id])
        place = lambda m: (lambda z: z[:, :2] / z[:, 2:])(np.column_stack([p, np.ones(n)]) @ np.reshape(m, (3, 3)).T)  # noqa: B023, E731
        assert np.abs(place(got) - place(h)).max() < (3 if noisy else 1e-8)


def test_ward_takes_all_points(spark):
    """More than 60000 points, 601 of them distinct, about three places."""
    n = 60_100
    p = spark.range(n).select("id", F.array((F.col("id") % 3 * 100 + F.col("id") % 601 % 29).cast("double"), (F.col("id") % 601).cast("double") / 100).alias("v"))
    groups = {(r.place, r.label): r.n for r in clusters.ward_labels(p, 3).groupBy((F.col("id") % 3).alias("place"), "label").agg(F.count("id").alias("n")).collect()}
    assert {k[0] for k in groups} == {0, 1, 2} and len(groups) == 3 and sum(groups.values()) == n


@pytest.mark.parametrize("copies", [False, True])
def test_ward_rounds_make_the_merges_of_chains(copies):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 4)) + rng.integers(0, 4, (300, 1)) * 3
    if copies:
        x[150:] = x[rng.integers(0, 150, 150)]
    for y in (x, np.eye(60)):  # a unit matrix has equal distances only
        (pairs, heights), (chains, wanted) = clusters._ward_merges(y), clusters._ward_chains(y, np.ones(len(y)), np.arange(len(y)))
        assert len(pairs) == len(y) - 1 and np.allclose(np.sort(heights), np.sort(wanted))
    assert len({i for i in pairs.ravel()}) == 60


def test_silhouettes_of_labellings_at_once(spark):
    """Three labellings, one with a cluster of one and one with an empty one, copies among the points: as one by one."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (90, 3)) + rng.integers(0, 3, (90, 1)) * 4 + 1000
    x[60:80] = x[:20]
    labels = np.column_stack([np.arange(90) % 2, np.where(np.arange(90) == 7, 2, x[:, 0] > 1003), np.where(x[:, 1] > 1003, 3, 0)])
    rows = [(i, v.tolist(), [int(k) for k in a]) for i, (v, a) in enumerate(zip(x, labels, strict=True))]
    p = spark.createDataFrame(rows, "id long, v array<double>, labels array<int>")
    for blocks in (1, 5):
        got = {r["at"]: r["silhouette"] for r in clusters._mean_silhouettes(p, [2, 3, 4], blocks).collect()}
        for at in range(3):
            alone = clusters.silhouette(p.select("id", "v", F.get("labels", F.lit(at)).alias("label"))).agg(F.round(F.avg("silhouette"), 6)).first()[0]
            assert got[at] == pytest.approx(alone, abs=1.5e-6)


def test_best_k_deals_points_out_once(spark, monkeypatch):
    """A point goes to a cell for each block, whatever the number of labellings."""
    p = spark.createDataFrame([(i, [float(i % 4) * 10, i % 5 * 0.01]) for i in range(40)], "id long, v array<double>")
    text = plan(clusters.best_k(p, range(2, 5), starts=1))
    assert len(re.findall("Generate explode", text)) == 1 and "Union" not in text
