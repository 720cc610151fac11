"""Rectangle joins: overlap, nesting, boundary classification, overlap groups and coverage depth.

Joins are equi-joins on the image with the rectangle predicate as residual condition. For rectangles without a key
(one plane), overlap_pairs_on_grid deals both sides into grid cells and reports a pair in the first cell they share.
Nesting and overlap groups deal images of more than CROWDED rectangles into a grid of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = ["x0", "y0", "x1", "y1"]
#: Rectangles of one image that are compared pair by pair in one task; images with more go through the grid.
CROWDED = 512


def normalised(rects: DataFrame) -> DataFrame:
    """Corners in order."""
    low = {"x0": F.least("x0", "x1"), "x1": F.greatest("x0", "x1"), "y0": F.least("y0", "y1"), "y1": F.greatest("y0", "y1")}
    return rects.withColumns(low)


def _sides(a: DataFrame, b: DataFrame, key: str | None) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*([F.col(key)] if key else []), *(F.col(c).alias(f"{s}_{c}") for c in ["idx", *CORNERS])) for df, s in ((a, "a"), (b, "b")))


def overlaps() -> Column:
    """Positive-area overlap of a and b; empty rectangles never overlap."""
    c = F.col
    crossing = (c("a_x0") < c("b_x1")) & (c("b_x0") < c("a_x1")) & (c("a_y0") < c("b_y1")) & (c("b_y0") < c("a_y1"))
    solid = (c("a_x0") < c("a_x1")) & (c("a_y0") < c("a_y1")) & (c("b_x0") < c("b_x1")) & (c("b_y0") < c("b_y1"))
    return crossing & solid


def overlap_pairs(a: DataFrame, b: DataFrame | None = None, key: str = "image_id", cell: float | None = None) -> DataFrame:
    """Pairs with overlap and the same key; of one relation with itself, each pair once. cell: deal images into a grid."""
    if cell is not None:
        return overlap_pairs_on_grid(a, b, cell, key)
    left, right = _sides(normalised(a), normalised(a if b is None else b), key)
    where = overlaps() & (F.col("a_idx") < F.col("b_idx")) if b is None else overlaps()
    return left.join(right, key).where(where)


def overlap_pairs_on_grid(a: DataFrame, b: DataFrame | None, cell: float | Column, key: str | None = None) -> DataFrame:
    """Pairs with overlap in one plane, or in one plane for each key whose rectangles may be very many.

    cell: the cells' side, or a column of both sides that has it (the same for all rectangles of a key).

    A rectangle is copied into every cell of the grid that it touches, and a pair is reported in the first cell it shares.
    """

    cell = F.lit(cell) if not isinstance(cell, Column) else cell

    def dealt(df: DataFrame, s: str) -> DataFrame:
        own = normalised(df).withColumn("_side", cell.cast("double"))
        out = own.select(*([F.col(key)] if key else []), *(F.col(c).alias(f"{s}_{c}") for c in ["idx", *CORNERS]), F.col("_side").alias(f"{s}_side"))
        c = lambda x: F.floor(F.col(f"{s}_{x}") / F.col(f"{s}_side")).cast("long")
        return out.withColumn("gx", F.explode(F.sequence(c("x0"), c("x1")))).withColumn("gy", F.explode(F.sequence(c("y0"), c("y1"))))

    both = dealt(a, "a").join(dealt(a if b is None else b, "b"), [*([key] if key else []), "gx", "gy"]).where(overlaps())
    both = both.where(F.col("a_idx") < F.col("b_idx")) if b is None else both
    at = lambda x: F.floor(F.greatest(f"a_{x}", f"b_{x}") / F.col("a_side"))
    return both.where((F.col("gx") == at("x0")) & (F.col("gy") == at("y0"))).drop("gx", "gy", "a_side", "b_side")


def crossing_type() -> dict[str, Column]:
    """How b crosses a's boundary: contained, none, vertical, horizontal or both, and the crossed sides in order."""
    c = F.col
    inside = (c("b_x0") >= c("a_x0")) & (c("b_y0") >= c("a_y0")) & (c("b_x1") <= c("a_x1")) & (c("b_y1") <= c("a_y1"))
    sides = {"left": c("b_x0") < c("a_x0"), "right": c("b_x1") > c("a_x1"), "top": c("b_y0") < c("a_y0"), "bottom": c("b_y1") > c("a_y1")}
    upright, level = sides["left"] | sides["right"], sides["top"] | sides["bottom"]
    kind = F.when(inside, "contained").when(~overlaps(), "none").when(upright & level, "both").when(upright, "vertical").otherwise("horizontal")
    crossed = F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in sides.items())))
    return {"type": kind, "boundaries": F.array_join(crossed, ",")}


def classified(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """Overlapping pairs with type and crossed boundaries, without those contained."""
    kinds = crossing_type()
    return overlap_pairs(a, b, key).withColumns(kinds).where(~F.col("type").isin("contained", "none"))


def intersections_of_b(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """For each b with a crossing: how many a's it crosses."""
    return classified(a, b, key).groupBy(F.col("b_idx").alias("b")).agg(F.count(F.lit(1)).alias("intersection_count"))


def _split(rects: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rectangles of ordinary images, and those of crowded ones with a grid cell `_cell` of their image (None if there are none)."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    counts = rects.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.greatest(2 * F.avg(side), F.lit(1e-9)).alias("_cell"))
    crowded = counts.where(F.col("_n") > most).select(key, "_cell")
    if not crowded.limit(1).count():
        return rects, None
    return rects.join(crowded.select(key), key, "left_anti"), rects.join(crowded, key)


def _nested_pairs() -> Column:
    """a is the outer rectangle and b the inner one, under the sweep's order for shared corners."""
    c = F.col
    starts = (c("a_x0") < c("b_x0")) | (c("a_x0") == c("b_x0")) & ((c("a_y0") < c("b_y0")) | (c("a_y0") == c("b_y0")) & (c("a_idx") < c("b_idx")))
    ends = (c("b_x1") < c("a_x1")) | (c("b_x1") == c("a_x1")) & (c("b_y0") == c("a_y0")) & (c("b_idx") < c("a_idx"))
    within = (c("a_y0") <= c("b_y0")) & (c("b_y1") <= c("a_y1"))
    return (c("a_idx") != c("b_idx")) & starts & ends & within


def nested(rects: DataFrame, key: str = "image_id", most: int = CROWDED) -> DataFrame:
    """Distinct inner rectangles. In crowded images an inner one is looked for only in the cell of its first corner."""
    plain, crowded = _split(normalised(rects), key, most)
    left, right = _sides(plain, plain, key)
    found = left.join(right, key).where(_nested_pairs()).select(F.col("b_idx").alias("idx"))
    if crowded is not None:
        cells = crowded.select(key, "_cell").distinct()
        left, right = _sides(crowded, crowded, key)
        at = lambda x: F.floor(F.col(x) / F.col("_cell")).cast("long")
        left = left.join(cells, key).withColumn("gx", F.explode(F.sequence(at("a_x0"), at("a_x1")))).withColumn("gy", F.explode(F.sequence(at("a_y0"), at("a_y1")))).drop("_cell")
        right = right.join(cells, key).withColumns({"gx": at("b_x0"), "gy": at("b_y0")}).drop("_cell")
        found = found.unionByName(left.join(right, [key, "gx", "gy"]).where(_nested_pairs()).select(F.col("b_idx").alias("idx")))
    return found.distinct()


def _groups_of(keys: np.ndarray, corners: list[np.ndarray], idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and smallest indices of the overlap groups of rectangles that are sorted by key."""
    x0, y0, x1, y1 = corners
    border = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    end = np.repeat(border[1:], np.diff(border))
    partners = end - np.arange(len(keys)) - 1
    label, linked = idx.copy(), np.zeros(len(idx), bool)
    lefts, rights = [], []
    cuts = np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()) + 1, 1 << 20))
    for low, high in zip(cuts, [*cuts[1:], len(keys)], strict=True):  # about a million pairs at a time
        n = partners[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
        meet = (x0[a] < x1[b]) & (x0[b] < x1[a]) & (y0[a] < y1[b]) & (y0[b] < y1[a])
        meet &= (x0[a] < x1[a]) & (y0[a] < y1[a]) & (x0[b] < x1[b]) & (y0[b] < y1[b])
        lefts.append(a[meet])
        rights.append(b[meet])
    a, b = np.concatenate(lefts), np.concatenate(rights)
    linked[a] = linked[b] = True
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            return idx[linked], label[linked]


def overlap_groups(rects: DataFrame, key: str = "image_id", most: int = CROWDED) -> DataFrame:
    """(idx, comp): rectangles with an overlap and the smallest index of their connected group.

    Groups lie within an image: ordinary images are grouped where their rectangles lie, whole images at a time; only
    crowded ones exchange labels.
    """
    from annogrid.operators.graph import connected_components

    rects = normalised(rects).select(key, F.col("idx").cast("long").alias("idx"), *(F.col(c).cast("double").alias(c) for c in CORNERS))
    plain, crowded = _split(rects, key, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = table.column(0).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last image may go on
            rest = table.slice(whole).combine_chunks()
            if whole:
                yield grouped(table.slice(0, whole))
        if rest is not None and rest.num_rows:
            yield grouped(rest)

    def grouped(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in ("_k", "idx", *CORNERS)]
        idx, comp = _groups_of(columns[0], columns[2:], columns[1])
        return pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(comp, pa.int64())], ["idx", "comp"])

    numbered = plain.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"), "idx", *CORNERS)  # image ids are whole numbers
    found = numbered.repartition("_k").sortWithinPartitions("_k").mapInArrow(run, "idx long, comp long")
    if crowded is not None:
        edges = overlap_pairs_on_grid(crowded, None, F.col("_cell"), key).select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))
        found = found.unionByName(connected_components(edges).select(F.col("node").alias("idx"), F.col("component").alias("comp")))
    return found


def smaller_members(rects: DataFrame, groups: DataFrame) -> DataFrame:
    """All members of a group but the one with the largest area (of equal ones, the largest index)."""
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")
    order = Window.partitionBy("comp").orderBy(F.desc("area"), F.desc("idx"))
    sized = groups.join(normalised(rects).select("idx", area), "idx")
    return sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > 1).select("idx")


def invalid(rects: DataFrame, key: str = "image_id") -> DataFrame:
    """Union of the smaller members of overlap groups and of nested rectangles."""
    return smaller_members(rects, overlap_groups(rects, key)).unionByName(nested(rects, key)).distinct()


def strip_events(rects: DataFrame, key: str = "image_id") -> DataFrame:
    """Starts and ends of rectangles along x in each horizontal strip between two neighbouring y of their image.

    Columns: the key, y_low, y_high, idx, x, ends (0 or 1), x0, x1. Events come in the order of (x, ends, idx): what ends
    at an x is still open when something starts there. Rectangles without height are in no strip.
    """
    r = normalised(rects).select(key, "idx", *CORNERS)
    cuts = r.select(key, F.explode(F.array("y0", "y1")).alias("y_low")).distinct()
    strips = cuts.withColumn("y_high", F.lead("y_low").over(Window.partitionBy(key).orderBy("y_low"))).where(F.col("y_high").isNotNull())
    placed = r.join(strips, key).where((F.col("y0") <= F.col("y_low")) & (F.col("y_low") < F.col("y1")))
    events = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(0).alias("ends")), F.struct(F.col("x1").alias("x"), F.lit(1).alias("ends"))))
    return placed.select(key, "y_low", "y_high", "idx", "x0", "x1", events.alias("e")).select(key, "y_low", "y_high", "idx", "e.x", "e.ends", "x0", "x1")


def _with_members(events: DataFrame, all_events: DataFrame, key: str) -> DataFrame:
    """Adds members: the sorted rectangles that are open after each event."""
    others = all_events.where("ends = 0").select(key, "y_low", F.col("idx").alias("_i"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    now = F.struct("x", "ends", "idx")
    begun = F.struct(F.col("_x0").alias("x"), F.lit(0).alias("ends"), F.col("_i").alias("idx")) <= now
    going = F.struct(F.col("_x1").alias("x"), F.lit(1).alias("ends"), F.col("_i").alias("idx")) > now
    kept = [c for c in events.columns if c not in ("x0", "x1")]
    found = events.select(*kept).join(others, [key, "y_low"], "left").withColumn("_open", begun & going)
    return found.groupBy(*kept).agg(F.array_sort(F.collect_list(F.when(F.col("_open"), F.col("_i")))).alias("members"))


def active_sets(rects: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, y_low, y_high, x, ends, idx, members): what is open after each event, where something is."""
    events = strip_events(rects, key)
    return _with_members(events, events, key).where(F.size("members") > 0)


def coverage_depth(rects: DataFrame, least: int = 2, key: str = "image_id") -> DataFrame:
    """Regions of a strip in which at least `depth` rectangles lie over each other, for each depth from `least`.

    A region of a depth begins where the number of open rectangles rises to it and ends where it falls below; members are
    those open when it begins. Regions without width are left out; position numbers an image's regions by falling
    depth, then x0 and y_low.
    """
    events = strip_events(rects, key)
    strip = Window.partitionBy(key, "y_low").orderBy("x", "ends", "idx")
    running = F.sum(F.when(F.col("ends") == 0, 1).otherwise(-1)).over(strip.rowsBetween(Window.unboundedPreceding, 0))
    counted = events.withColumn("depth", (running + F.col("ends")).cast("long")).where(F.col("depth") >= least)
    # At one depth a rise is followed by the fall that ends it.
    after = F.lead("x").over(Window.partitionBy(key, "y_low", "depth").orderBy("x", "ends", "idx"))
    regions = counted.withColumn("end", after).where((F.col("ends") == 0) & (F.col("end") > F.col("x")))
    order = Window.partitionBy(key).orderBy(F.desc("depth"), "x", "y_low")
    out = _with_members(regions, events, key).withColumn("position", F.row_number().over(order) - 1)
    return out.select(key, "position", F.col("x").alias("x0"), F.col("end").alias("x1"), "y_low", "y_high", "depth", "members")
