"""Annotations under a homography given by nine columns h00 .. h22 (row by row), and its estimation from point pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATRIX = [f"h{r}{c}" for r in range(3) for c in range(3)]


def moved(x: Column, y: Column) -> tuple[Column, Column]:
    h = {n: F.col(n) for n in MATRIX}
    bottom = h["h20"] * x + h["h21"] * y + h["h22"]
    return (h["h00"] * x + h["h01"] * y + h["h02"]) / bottom, (h["h10"] * x + h["h11"] * y + h["h12"]) / bottom


def clamped(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return F.least(F.greatest(x, F.lit(0.0)), width - 1.0), F.least(F.greatest(y, F.lit(0.0)), height - 1.0)


def moved_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The bounding box (x, y, w, h) of the four moved and clamped corners; null if a side is at most 1."""
    corners = [clamped(*moved(a, b), width, height) for a in (x, x + w) for b in (y, y + h)]
    x0, y0 = F.least(*(c[0] for c in corners)), F.least(*(c[1] for c in corners))
    dx, dy = F.greatest(*(c[0] for c in corners)) - x0, F.greatest(*(c[1] for c in corners)) - y0
    return F.when((dx > 1) & (dy > 1), F.struct(x0.alias("x"), y0.alias("y"), dx.alias("w"), dy.alias("h")))


def moved_polygon(points: Column, width: Column, height: Column) -> Column:
    """Moved and clamped points; null if fewer than three or an area of at most 1 is left."""
    from annogrid.functions.polygons import polygon_area

    def place(p: Column) -> Column:
        x, y = clamped(*moved(p["x"], p["y"]), width, height)
        return F.struct(x.alias("x"), y.alias("y"))

    new = F.transform(points, place)
    return F.when((F.size(points) >= 3) & (polygon_area(new) > 1), new)


def moved_keypoints(flat: Column, width: Column, height: Column) -> Column:
    """(x, y, visibility) triples; those not visible stay. A length that isn't a multiple of three raises an error."""
    n = (F.size(flat) / 3).cast("int")

    def place(i: Column) -> Column:
        x, y, v = (F.get(flat, 3 * i + k) for k in range(3))
        a, b = clamped(*moved(x, y), width, height)
        return F.when(v > 0, F.array(a, b, v)).otherwise(F.array(x, y, v))

    triples = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), place))
    wrong = F.raise_error(F.lit("keypoints are not triples")).cast("array<double>")
    return F.when(F.size(flat) % 3 != 0, wrong).when(F.size(flat) == 0, flat).otherwise(triples)


def match_by_name(images: DataFrame, corrected: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Images with the corrected file of the same base name (of several, the last path).

    Columns `within` of both tables tell apart images that share a base name: only files with their values count.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    files = corrected.groupBy(*within, base(F.col("path")).alias("_base")).agg(F.max("path").alias("corrected_path"))
    return images.withColumn("_base", base(F.col("file_name"))).join(files, [*within, "_base"]).drop("_base")


def _framed(z: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (image, point, xy) about the middle of the used ones, at a mean distance of the root of 2; the middles and scales."""
    n = np.maximum(used.sum(axis=1), 1)
    centre = np.where(used[..., None], z, 0.0).sum(axis=1) / n[:, None]
    moved_ = z - centre[:, None]
    scale = np.sqrt(2) / np.maximum(np.where(used, np.hypot(moved_[..., 0], moved_[..., 1]), 0.0).sum(axis=1) / n, 1e-12)
    return moved_ * scale[:, None, None], centre, scale


def _unframed(h: np.ndarray, p: tuple, q: tuple) -> np.ndarray:
    """Homographies (image, 3, 3) between framed points as those between the points, their last entry 1; NaN where it can't be."""
    (_, pc, ps), (_, qc, qs) = p, q
    t, s = np.zeros_like(h), np.zeros_like(h)
    t[:, 0, 0] = t[:, 1, 1] = ps
    t[:, :2, 2] = -ps[:, None] * pc
    s[:, 0, 0] = s[:, 1, 1] = 1 / qs
    s[:, :2, 2] = qc
    t[:, 2, 2] = s[:, 2, 2] = 1
    out = s @ (h / np.linalg.norm(h, axis=(1, 2), keepdims=True)) @ t
    last = out[:, 2:, 2:]
    return np.where(np.abs(last) < 1e-12, np.nan, out / np.where(last == 0, 1, last))


def _through_four(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The homography of each sample of four points (xy, point, image, sample), in closed form, as (image, column, row, sample)."""

    def turn(z, i, j, k):  # twice the area of a triangle
        return (z[0][j] - z[0][i]) * (z[1][k] - z[1][i]) - (z[0][k] - z[0][i]) * (z[1][j] - z[1][i])

    (x, y), out = p, np.zeros((p.shape[2], 3, 3, p.shape[3]))
    of = [turn(p, 3, 1, 2), turn(p, 0, 3, 2), turn(p, 0, 1, 3)]  # the fourth point's coordinates in the other three
    to = [turn(q, 3, 1, 2), turn(q, 0, 3, 2), turn(q, 0, 1, 3)]
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        weight = to[i] * of[j] * of[k]
        for c, side in enumerate((y[j] - y[k], x[k] - x[j], x[j] * y[k] - x[k] * y[j])):
            side = side * weight
            out[:, c, 0] += side * q[0][i]
            out[:, c, 1] += side * q[1][i]
            out[:, c, 2] += side
    return out


def _fitted(p: np.ndarray, q: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The homography of least squares through the used points of each image (image, point, xy)."""
    frames = _framed(p, used), _framed(q, used)
    a, b = (np.where(used[..., None], f[0], 0.0) for f in frames)
    left = np.concatenate([a, used[..., None].astype(float)], axis=2)  # points not used are rows of zeros
    zero = np.zeros_like(left)
    rows = np.concatenate([np.concatenate([left, zero, -b[..., :1] * left], axis=2), np.concatenate([zero, left, -b[..., 1:] * left], axis=2)], axis=1)
    # The last right vector; eight equations have it only in the full decomposition.
    least = np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3)
    return _unframed(least, *frames)


#: Residuals of framed points below which a fit by least squares is the sample's own homography.
_EXACT = 1e-12


def _consensus(p: np.ndarray, q: np.ndarray, threshold: float, confidence: float, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Homographies and numbers of inliers of images (image, point, xy) with one number of points."""
    m, n = p.shape[:2]
    h, best = np.full((m, 3, 3), np.nan), np.zeros((m, n), bool)
    if n < 4:
        return h, best.sum(axis=1)
    finite = np.isfinite(p).all(axis=2) & np.isfinite(q).all(axis=2)
    a, b = _framed(p, finite), _framed(q, finite)
    near = (threshold * b[2]) ** 2
    wide = np.concatenate([a[0], np.ones((m, n, 1))], axis=2)
    sample, off = np.zeros((m, 3, 3)), np.full(m, np.inf)
    rng, k, need = np.random.default_rng(seed), 0, np.full(m, rounds if n > 4 else 1)
    while len(live := np.flatnonzero(need > k)):
        size = min(max(1, min(32, (1 << 20) // n)), int(need[live].max()) - k)  # samples at once, the same for all images
        pick = rng.random((size, n)).argpartition(3, axis=1)[:, :4].T if n > 4 else np.arange(4)[:, None]
        k += size
        for at in np.array_split(live, -(-len(live) * n * size // (1 << 16))):  # so many that arrays stay small
            four = [np.ascontiguousarray(z[0][at][:, pick].transpose(3, 1, 0, 2)) for z in (a, b)]
            found = _through_four(*four)
            z = (wide[at] @ found.reshape(len(at), 3, -1)).reshape(len(at), n, 3, size)
            d = (z[:, :, 0] / z[:, :, 2] - b[0][at, :, :1]) ** 2
            d += (z[:, :, 1] / z[:, :, 2] - b[0][at, :, 1:]) ** 2
            good = d < near[at, None, None]
            count = good.sum(axis=1)
            first = count.argmax(axis=1)
            better = np.flatnonzero(count.max(axis=1) > best[at].sum(axis=1))
            who, which = at[better], first[better]
            best[who] = good[better, :, which]
            sample[who] = found[better, :, :, which].swapaxes(1, 2)
            off[who] = np.where(best[who], d[better, :, which], 0.0).max(axis=1)
            share = best[who].mean(axis=1) ** 4
            more = np.ceil(np.log(1 - confidence) / np.log(np.maximum(1 - share, 1e-12))).astype(np.int64) + 1
            need[who] = np.where(share < 1, np.minimum(rounds, more), k) if n > 4 else k
    inliers = best.sum(axis=1)
    exact = np.flatnonzero((inliers >= 4) & (off < _EXACT**2))
    h[exact] = _unframed(sample[exact], *(tuple(x[exact] for x in z) for z in (a, b)))
    rest = np.flatnonzero((inliers >= 4) & ~(off < _EXACT**2))
    for at in np.array_split(rest, max(1, -(-len(rest) * n // (1 << 16)))):
        if len(at):
            h[at] = _fitted(np.where(finite[at][..., None], p[at], 0.0), np.where(finite[at][..., None], q[at], 0.0), best[at])
    return h, inliers


def estimate(pairs: DataFrame, threshold: float = 5.0, confidence: float = 0.99, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """A homography for each image_id from (image_id, x, y, u, v), by random samples of four and a fit to the inliers.

    Images with one number of points are solved together, as many as a batch of rows has.
    """

    def solved(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        x = np.column_stack([table.column(c).to_numpy().astype(float) for c in "xyuv"])
        h, inliers = np.full((len(starts), 9), np.nan), np.zeros(len(starts), np.int64)
        with np.errstate(all="ignore"):
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                points = x[starts[at][:, None] + np.arange(n)]
                found, inliers[at] = _consensus(points[..., :2], points[..., 2:], threshold, confidence, rounds, seed)
                h[at] = found.reshape(-1, 9)
        bad = np.isnan(h).any(axis=1)
        ids = table.column("image_id").take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(inliers), *(pa.array(h[:, k], mask=bad) for k in range(9))], ["image_id", "inliers", *MATRIX])

    def run(batches):
        """Rows of an image follow each other, also across batches."""
        held, rows = [], 0
        for batch in (b for b in batches if b.num_rows):
            held.append(batch)
            rows += batch.num_rows
            if rows < held[0].column("n")[0].as_py():
                continue
            table = pa.Table.from_batches(held)
            counts, starts, at = table.column("n").to_numpy(), [], 0
            while at < rows and at + counts[at] <= rows:
                starts.append(at)
                at += int(counts[at])
            yield solved(table, np.array(starts), counts[starts])
            held, rows = (table.slice(at).to_batches(), rows - at) if at < rows else ([], 0)

    image = Window.partitionBy("image_id")
    plain = pairs.select(F.col("image_id").cast("long").alias("image_id"), *(F.col(c).cast("double").alias(c) for c in "xyuv"))
    # The window lays the rows of an image together; it moves none that already lie with their image.
    counted = plain.withColumn("n", F.count(F.lit(1)).over(image))
    return counted.mapInArrow(run, "image_id long, inliers long, " + ", ".join(f"{m} double" for m in MATRIX))


def transform_annotations(annotations: DataFrame, images: DataFrame, corrected: DataFrame, matrices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations (id, image_id, bbox, segmentation, keypoints) of images that have a corrected file and a homography, moved; and one row of counts.

    Dropped: annotations without an image, a corrected file or a homography; those whose box gets a side of at most 1;
    those with polygons of which none is left. Null boxes, segmentations and keypoints stay null. The area is kept.
    """
    from annogrid.functions.polygons import polygon_points

    sized = match_by_name(images, corrected).select(F.col("id").alias("image_id"), F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"))
    usable = matrices.where(F.col("h00").isNotNull()).select("image_id", *MATRIX)
    a = annotations.join(sized, "image_id").join(usable, "image_id")
    b, w, h = F.col("bbox"), F.col("_w"), F.col("_h")
    box = F.when(b.isNotNull() & (F.size(b) == 4), moved_box(b[0], b[1], b[2], b[3], w, h))
    flat = lambda p: F.flatten(F.transform(p, lambda q: F.array(q["x"], q["y"])))
    polygons = F.filter(F.transform("segmentation", lambda p: F.when((F.size(p) >= 6) & (F.size(p) % 2 == 0), flat(moved_polygon(polygon_points(p), w, h)))), lambda p: p.isNotNull())
    moved_rows = a.withColumns({"_box": box, "_polygons": F.when(F.col("segmentation").isNotNull(), polygons), "_keypoints": F.when(F.col("keypoints").isNotNull(), moved_keypoints(F.col("keypoints"), w, h))})
    kept = moved_rows.where((b.isNull() | F.col("_box").isNotNull()) & (F.col("segmentation").isNull() | (F.size("_polygons") > 0)))
    x = F.col("_box")
    out = kept.withColumns({"bbox": F.when(x.isNotNull(), F.array(x["x"], x["y"], x["w"], x["h"])), "segmentation": F.col("_polygons"), "keypoints": F.col("_keypoints")}).select(*annotations.columns)
    counts = annotations.agg(F.count(F.lit(1)).alias("annotations")).crossJoin(out.agg(F.count(F.lit(1)).alias("kept"))).crossJoin(usable.agg(F.count(F.lit(1)).alias("homographies")))
    return out, counts.withColumn("skipped", F.col("annotations") - F.col("kept"))
