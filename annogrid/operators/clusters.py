"""Scores of a clustering, density clusters, nearest neighbours, anchors, and the search for a model.

Tables have (id, v array<double>, label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def cluster_means(points: DataFrame, digits: int | None = 6) -> DataFrame:
    """(label, feature, mean, n)."""
    long = points.select("label", F.posexplode("v").alias("feature", "x"))
    mean = F.avg("x") if digits is None else F.round(F.avg("x"), digits)
    return long.groupBy("label", "feature").agg(mean.alias("mean"), F.count(F.lit(1)).alias("n"))


def between_cluster_variance(points: DataFrame, digits: int = 6) -> DataFrame:
    """Population variance of the clusters' means for each feature."""
    return cluster_means(points, None).groupBy("feature").agg(F.round(F.var_pop("mean"), digits).alias("value"))


def _centres(points: DataFrame) -> DataFrame:
    means = cluster_means(points, None).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("feature", "mean"))).alias("f"), F.max("n").alias("n"))
    return means.select("label", "n", F.transform("f", lambda s: s["mean"]).alias("centre"))


def _sums(points: DataFrame) -> DataFrame:
    """One row: n, k, between- and within-cluster sums of squares."""
    centres = _centres(points)
    total = points.select(F.posexplode("v").alias("feature", "x")).groupBy("feature").agg(F.avg("x").alias("m"))
    middle = total.agg(F.array_sort(F.collect_list(F.struct("feature", "m"))).alias("f")).select(F.transform("f", lambda s: s["m"]).alias("middle"))
    between = centres.crossJoin(F.broadcast(middle)).agg(F.sum(F.col("n") * _square(F.col("centre"), F.col("middle"))).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    within = points.join(F.broadcast(centres.select("label", "centre")), "label").agg(F.sum(_square(F.col("v"), F.col("centre"))).alias("w"))
    return between.crossJoin(within)


def calinski_harabasz(points: DataFrame, digits: int = 6) -> DataFrame:
    b, w, k, n = (F.col(c) for c in ("b", "w", "k", "n"))
    return _sums(points).select(F.round(F.when(w == 0, F.lit(1.0)).otherwise(b * (n - k) / (F.nullif(w, F.lit(0.0)) * (k - 1))), digits).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame, digits: int = 6) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / distance; pairs of clusters only meet here."""
    centres = F.broadcast(_centres(points).select("label", "centre"))
    scatter = points.join(centres, "label").groupBy("label").agg(F.avg(F.sqrt(_square(F.col("v"), F.col("centre")))).alias("s"), F.any_value("centre").alias("c"))
    a, b = scatter.toDF("la", "sa", "ca"), scatter.toDF("lb", "sb", "cb")
    d = F.sqrt(_square(F.col("ca"), F.col("cb")))
    pairs = a.join(F.broadcast(b), F.col("la") != F.col("lb")).withColumn("r", F.try_divide(F.col("sa") + F.col("sb"), d))
    return pairs.groupBy("la").agg(F.max("r").alias("r")).agg(F.round(F.avg("r"), digits).alias("davies_bouldin"))


def _blocks(points: DataFrame, blocks: int | None, size: int = 2048) -> int:
    """Blocks of about `size` points, so that a task's share of all pairs stays the same at any number of points."""
    return blocks or max(4, -(-points.count() // size))


def _block_pairs(left: DataFrame, right: DataFrame, blocks: int):
    """Both sides (id, v, ...) dealt into cells of a block of the left against a block of the right, grouped for cogroup."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (left, right))  # two relations, also of one table
    a = left.withColumn("_o", own).withColumn("_e", every).withColumn("cell", F.col("_o") * blocks + F.col("_e"))
    b = right.withColumn("_o", own).withColumn("_e", every).withColumn("cell", F.col("_e") * blocks + F.col("_o"))
    return a.drop("_o", "_e").groupBy("cell"), b.drop("_o", "_e").groupBy("cell")


def silhouette(points: DataFrame, blocks: int | None = None, digits: int = 6) -> DataFrame:
    """Exact Euclidean silhouette of each point, by blocks of points against blocks; a cluster of one gives 0."""
    import numpy as np
    import pyarrow as pa

    p = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    left, right = _block_pairs(p, p, _blocks(points, blocks))

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        """For each point of the left block, the distances to each label of the right one, added up."""
        out = {k: [] for k in ("i", "own", "other", "d", "n")}
        if a.num_rows and b.num_rows:
            x, y = (np.array(t.column("v").to_pylist()) for t in (a, b))
            ids, own = a.column("id").to_numpy(), a.column("label").to_numpy()
            labels, where = np.unique(b.column("label").to_numpy(), return_inverse=True)
            order = np.argsort(where, kind="stable")
            y, n = y[order], np.bincount(where)
            starts = np.cumsum(n) - n
            for k in range(0, len(x), 64):
                d = np.sqrt(((x[k : k + 64, None, :] - y[None, :, :]) ** 2).sum(axis=2))
                total = np.add.reduceat(d, starts, axis=1)
                m = len(total)
                for name, values in (("i", np.repeat(ids[k : k + 64], len(labels))), ("own", np.repeat(own[k : k + 64], len(labels))), ("other", np.tile(labels, m)), ("d", total.ravel()), ("n", np.tile(n, m))):
                    out[name].append(values)
        kinds = {"i": np.int64, "own": np.int64, "other": np.int64, "d": np.float64, "n": np.int64}
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, kinds[k])) for k, v in out.items()})

    parts = left.cogroup(right).applyInArrow(sums, "i long, own long, other long, d double, n long")
    summed = parts.groupBy("i", "own", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    inner = F.max(F.when(F.col("own") == F.col("other"), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("near")
    outer = F.min(F.when(F.col("own") != F.col("other"), F.col("d") / F.col("n"))).alias("next")
    by = summed.groupBy("i").agg(inner, outer)
    score = F.coalesce(F.try_divide(F.col("next") - F.col("near"), F.greatest("next", "near")), F.lit(0.0))
    return by.select(F.col("i").alias("id"), F.round(score, digits).alias("silhouette"))


def hard_clusters(rows: DataFrame, label: str, category: str, least: int = 10, share: float = 0.7) -> DataFrame:
    """Clusters of at least `least` rows whose most frequent category has less than `share` of them."""
    counts = rows.groupBy(label, category).agg(F.count(F.lit(1)).alias("k"))
    by = counts.groupBy(label).agg(F.sum("k").alias("n"), F.max("k").alias("top"))
    return by.where((F.col("n") >= least) & (F.col("top") / F.col("n") < share)).select(F.col(label).alias("label"), "n", (F.col("top") / F.col("n")).alias("top_share"))


def anchors(boxes: DataFrame, limit: int = 6, rtol: float = 0.1, atol: float = 1e-8) -> DataFrame:
    """From mean sizes (w, h): by falling area, each that isn't close to one kept before, up to `limit`. As many rows as clusters."""
    listed = boxes.agg(F.array_sort(F.collect_list(F.struct((-F.col("w") * F.col("h")).alias("k"), F.col("w").alias("w"), F.col("h").alias("h")))).alias("all"))
    near = lambda b, c: (F.abs(b["w"] - c["w"]) <= atol + rtol * F.abs(c["w"])) & (F.abs(b["h"] - c["h"]) <= atol + rtol * F.abs(c["h"]))
    none = F.slice(F.col("all"), 1, 0)
    kept = F.aggregate("all", none, lambda acc, b: F.when((F.size(acc) >= limit) | F.exists(acc, lambda c: near(b, c)), acc).otherwise(F.array_append(acc, b)))
    return listed.select(F.posexplode(kept).alias("rank", "b")).select((F.col("rank") + 1).alias("rank"), F.round("b.w", 6).alias("w"), F.round("b.h", 6).alias("h"))


def _squares(x, y):
    """Squared distances of all rows of x to all rows of y, each by its own differences."""
    import numpy as np

    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        d = x[:, k, None] - y[None, :, k]
        out += d * d
    return out


def _plain(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))


def mutual_nearest(left: DataFrame, right: DataFrame, blocks: int | None = None, digits: int = 6) -> DataFrame:
    """Pairs (of tables id, v) that are each other's nearest, ties to the smaller id.

    Blocks of one side meet blocks of the other as arrays; a pair of blocks gives each point's nearest there and no pairs.
    """
    import numpy as np
    import pyarrow as pa

    a, b = _block_pairs(_plain(left), _plain(right), _blocks(right, blocks))

    def nearest(s: pa.Table, t: pa.Table) -> pa.Table:
        out = {k: [] for k in ("side", "own", "other", "d")}
        if s.num_rows and t.num_rows:
            s, t = s.sort_by("id"), t.sort_by("id")
            x, y = (np.array(z.column("v").to_pylist()) for z in (s, t))
            i, j = (z.column("id").to_numpy() for z in (s, t))
            best, far = np.zeros(len(y), np.int64), np.full(len(y), np.inf)
            for k in range(0, len(x), 256):
                d = _squares(x[k : k + 256], y)
                at = d.argmin(axis=1)
                for name, values in (("side", np.zeros(len(at), np.int32)), ("own", i[k : k + 256]), ("other", j[at]), ("d", d[np.arange(len(at)), at])):
                    out[name].append(values)
                here = d.argmin(axis=0)
                value = d[here, np.arange(len(y))]
                nearer = value < far  # of equal ones the first, with the smaller id
                best[nearer], far[nearer] = here[nearer] + k, value[nearer]
            for name, values in (("side", np.ones(len(y), np.int32)), ("own", j), ("other", i[best]), ("d", far)):
                out[name].append(values)
        kinds = {"side": np.int32, "own": np.int64, "other": np.int64, "d": np.float64}
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, kinds[k])) for k, v in out.items()})

    found = a.cogroup(b).applyInArrow(nearest, "side int, own long, other long, d double").groupBy("side", "own").agg(F.min(F.struct("d", "other")).alias("m"))
    best_right = found.where("side = 0").select(F.col("own").alias("left_id"), F.col("m.other").alias("right_id"), "m.d")
    best_left = found.where("side = 1").select(F.col("own").alias("right_id"), F.col("m.other").alias("left_id"))
    return best_right.join(best_left, ["left_id", "right_id"]).select("left_id", "right_id", F.round(F.sqrt("d"), digits).alias("distance"))


def _near(points: DataFrame, eps: float, blocks: int | None) -> DataFrame:
    """Ordered pairs (a, b) of points at most eps apart, each point with itself; blocks meet as arrays and give such pairs only."""
    import numpy as np
    import pyarrow as pa

    p = _plain(points)
    left, right = _block_pairs(p, p, _blocks(points, blocks))

    def pairs(s: pa.Table, t: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if s.num_rows and t.num_rows:
            x, y = (np.array(z.column("v").to_pylist()) for z in (s, t))
            i, j = (z.column("id").to_numpy() for z in (s, t))
            for k in range(0, len(x), 256):
                at = np.nonzero(_squares(x[k : k + 256], y) <= eps * eps)
                a.append(i[k + at[0]])
                b.append(j[at[1]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return left.cogroup(right).applyInArrow(pairs, "a long, b long")


def dbscan(points: DataFrame, eps: float, min_points: int = 5, blocks: int | None = None) -> DataFrame:
    """(id, label): -1 for noise, else the smallest core id of the cluster; border points go to the smallest cluster nearby."""
    from annogrid.operators.graph import checkpointed, connected_components

    near = checkpointed(_near(points, eps, blocks))  # read four times below
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("core"))
    between = near.join(core.toDF("a"), "a", "left_semi").join(core.toDF("b"), "b", "left_semi").select("a", "b")
    comps = connected_components(between)
    alone = core.join(comps, F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("component"))
    reach = near.join(alone, near["b"] == alone["core"]).groupBy("a").agg(F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("own"), F.min("component").alias("any"))
    return points.select("id").join(reach, points["id"] == reach["a"], "left").select("id", F.coalesce("own", "any", F.lit(-1)).cast("long").alias("label"))


def _vectors(points: DataFrame, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return points.withColumn(out, array_to_vector("v"))


def kmeans_models(points: DataFrame, ks: range | list[int], starts: int = 10, seed: int = 42) -> dict:
    """For each k the model of the start with the lowest cost, on vectors in the column `features`; of equal ones the first."""
    from pyspark.ml.clustering import KMeans

    kept = _vectors(points).select("features").persist()
    try:
        return {k: min((KMeans(k=k, seed=seed + i, featuresCol="features").fit(kept) for i in range(starts)), key=lambda m: m.summary.trainingCost) for k in ks}
    finally:
        kept.unpersist()


def kmeans_model(points: DataFrame, k: int, starts: int = 10, seed: int = 42):
    """The model of the start with the lowest cost, on vectors in the column `features`; model.write().save(path) keeps it."""
    return kmeans_models(points, [k], starts, seed)[k]


def labelled_by(model, points: DataFrame) -> DataFrame:
    """(id, label) of points under a model, also one that was loaded."""
    return model.transform(_vectors(points)).select("id", F.col("prediction").alias("label"))


def kmeans_labels(points: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """The labels of the start with the lowest cost."""
    return labelled_by(kmeans_model(points, k, starts, seed), points)


def gmm_labels(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture

    data = _vectors(points)
    return GaussianMixture(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("label"))


def pca(points: DataFrame, k: int) -> DataFrame:
    """id and the first k principal components; stands in for the learned encoder."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _vectors(points)
    return PCA(k=k, inputCol="features", outputCol="z").fit(data).transform(data).select("id", vector_to_array("z").alias("v"))


def _mean_silhouettes(points: DataFrame, sizes: list[int], blocks: int | None = None, digits: int = 6) -> DataFrame:
    """(at, silhouette): the mean over points (id, v, labels) for each place in `labels`, whose labels count from 0 below sizes[at].

    Distances are met once for all labellings, each pair of points in one cell of two blocks of about 8 MB. A cell gives each of
    its points a sum of distances for each label. Distances come from products, near ones from their own differences.
    """
    import numpy as np
    import pyarrow as pa

    p = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("labels").cast("array<int>").alias("labels"))
    shape = p.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), *(F.array(*(F.count_if(F.get("labels", F.lit(at)) == x) for x in range(k))).alias(f"n{at}") for at, k in enumerate(sizes))).first()
    blocks = blocks or max(4, -(-shape["n"] * (shape["d"] or 1) * 8 // (8 << 20)))
    starts, total = np.cumsum([0, *sizes]), sum(sizes)
    members = np.array([x for at in range(len(sizes)) for x in shape[f"n{at}"]], float)

    def member(labels: np.ndarray) -> np.ndarray:
        """1 for each label of a point."""
        out = np.zeros((len(labels), total))
        out[np.arange(len(labels))[:, None], labels + starts[:-1]] = 1
        return out

    def summed(x, y, of_x, of_y) -> tuple[np.ndarray, np.ndarray]:
        """Distances of x to the labels of y, and of y to those of x."""
        to_y, to_x = np.zeros((len(x), total)), np.zeros((len(y), total))
        middle = x.mean(axis=0)
        a, b = x - middle, y - middle
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        left, right = np.column_stack([-2 * a, aa, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), bb])
        for i in range(0, len(x), 256):
            for j in range(0, len(y), 2048):
                r, c = slice(i, i + 256), slice(j, j + 2048)
                d = left[r] @ right[c].T
                if d.min() < 1e-6 * (aa[r].max() + bb[c].max()):
                    m, n = np.nonzero(d < 1e-6 * (aa[r, None] + bb[c]))
                    for k in range(0, len(m), 1 << 16):
                        s, t = m[k : k + (1 << 16)], n[k : k + (1 << 16)]
                        d[s, t] = ((x[r][s] - y[c][t]) ** 2).sum(axis=1)
                np.sqrt(d, out=d)
                to_y[r] += d @ of_y[c]
                to_x[c] += d.T @ of_x[r]
        return to_y, to_x

    def cell(table: pa.Table) -> pa.Table:
        column = lambda name, width: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        own, ids = table.column("own").to_numpy(), table.column("id").to_numpy()
        x, of = column("v", shape["d"]), member(column("labels", len(sizes)))
        low = own == own.min()
        on_diagonal = table.column("cell")[0].as_py() // blocks == table.column("cell")[0].as_py() % blocks
        if on_diagonal:
            out = [(ids, summed(x, x, of, of)[0])]
        elif low.all():
            out = [(ids, np.zeros((len(ids), total)))]  # nothing in the other block
        else:
            to_high, to_low = summed(x[low], x[~low], of[low], of[~low])
            out = [(ids[low], to_high), (ids[~low], to_low)]
        d = np.concatenate([z for _, z in out])
        return pa.table({"id": pa.array(np.concatenate([i for i, _ in out])), "d": pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * total, d.ravel())})

    def scored(batches):
        for batch in batches:
            sums = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, total)
            own = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sizes))
            for at in range(len(sizes)):
                part, n, label = sums[:, starts[at] : starts[at + 1]], members[starts[at] : starts[at + 1]], own[:, at]
                rows = np.arange(len(part))
                with np.errstate(all="ignore"):
                    near = part[rows, label] / (n[label] - 1)
                    other = np.where(n > 0, part / n, np.inf)
                    other[rows, label] = np.inf
                    next_ = other.min(axis=1)
                    s = (next_ - near) / np.maximum(next_, near)
                s = np.where((n[label] > 1) & np.isfinite(next_) & (np.maximum(next_, near) > 0), s, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), at, np.int32)), pa.array(s)], ["at", "s"])

    own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = p.withColumn("own", own).withColumn("_e", other).withColumn("cell", F.least("own", "_e") * blocks + F.greatest("own", "_e")).drop("_e")
    cells = dealt.repartition(2 * blocks * (blocks + 1), "cell").groupBy("cell").applyInArrow(cell, "id long, d array<double>")
    lists = cells.groupBy("id").agg(F.collect_list("d").alias("ds"))
    zero = F.array_repeat(F.lit(0.0), total)
    sums = lists.select("id", F.aggregate("ds", zero, lambda s, d: F.zip_with(s, d, lambda a, b: a + b)).alias("d")).join(p.select("id", "labels"), "id")
    each = sums.select("id", "d", "labels").mapInArrow(scored, "at int, s double")
    return each.groupBy("at").agg(F.round(F.avg(F.round("s", digits)), digits).alias("silhouette"))


def best_k(points: DataFrame, ks: range = range(2, 9), starts: int = 10, seed: int = 42) -> DataFrame:
    """(k, silhouette) of each number of clusters, by the best of several starts; the best is the first by falling score, then k."""
    ks = list(ks)
    labelled = _vectors(points.select("id", "v"))
    for k, model in kmeans_models(points, ks, starts, seed).items():
        labelled = model.setPredictionCol(f"_k{k}").transform(labelled)
    means = _mean_silhouettes(labelled.select("id", "v", F.array(*(F.col(f"_k{k}") for k in ks)).alias("labels")), ks)
    return means.select(F.get(F.array(*(F.lit(k) for k in ks)), F.col("at")).alias("k"), "silhouette")


def forest_importance(points: DataFrame, seed: int = 42) -> DataFrame:
    """(feature, importance) of a random forest that predicts the label; its size follows the number of rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    n = points.count()
    data = StringIndexer(inputCol="label", outputCol="y").fit(points).transform(_vectors(points))
    model = RandomForestClassifier(labelCol="y", numTrees=50 if n < 1000 else 100, maxDepth=5 if n < 1000 else 10, minInstancesPerNode=5, seed=seed).fit(data)
    values = [(i, float(x)) for i, x in enumerate(model.featureImportances.toArray())]
    return points.sparkSession.createDataFrame(values, "feature int, importance double")


def binned_mutual_information(points: DataFrame, bins: int = 10, digits: int = 6) -> DataFrame:
    """(feature, value): mutual information in nats of equal-width bins and the label; an approximation by counts."""
    long = points.select("label", F.posexplode("v").alias("feature", "x"))
    ends = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    binned = long.join(F.broadcast(ends), "feature").select("feature", "label", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))).alias("bin"))
    joint = binned.groupBy("feature", "label", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    parts = joint.select("feature", (F.col("n") / w() * F.log(F.col("n") * w() / (w("label") * w("bin")))).alias("i"))
    return parts.groupBy("feature").agg(F.round(F.sum("i"), digits).alias("value"))


#: Points up to which the model search tries Ward linkage, whose time grows with the square of their number.
WARD_POINTS = 60_000


def _ward_nearest(rows, mean, size):
    """The nearest cluster by Ward's criterion for each of some rows of all clusters, ties to the first, and at what distance."""
    import numpy as np

    middle = np.average(mean, axis=0, weights=size)
    m, one = mean - middle, np.ones((len(mean), 1))
    square = (m * m).sum(axis=1, keepdims=True)
    right = np.concatenate([m, one, square], axis=1)  # the product of left and right is the squared distance
    left, inverse, single = np.concatenate([-2 * m[rows], square[rows], one[rows]], axis=1), 1 / size, bool((size == size[0]).all())
    at = np.zeros(len(rows), np.int64)
    for k in range(0, len(rows), 256):
        own = rows[k : k + 256]
        far, best = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
        for c in range(0, len(mean), 2048):
            d = left[k : k + 256] @ right[c : c + 2048].T
            if not single:
                d /= inverse[own, None] + inverse[c : c + 2048]
            inside = np.flatnonzero((own >= c) & (own < c + 2048))
            d[inside, own[inside] - c] = np.inf
            j = d.argmin(axis=1)
            value = d[np.arange(len(own)), j]
            nearer = value < far
            far[nearer], best[nearer] = value[nearer], j[nearer] + c
        at[k : k + 256] = best
    height = ((mean[at] - mean[rows]) ** 2).sum(axis=1) * (size[at] * size[rows] / (size[at] + size[rows]))
    return at, height


def _ward_chains(mean, size, point):
    """All merges of clusters (mean, size, a point of each) by chains of nearest neighbours: pairs of points, distances."""
    import numpy as np

    n = len(mean)
    mean, size, live = mean.copy(), size.copy(), np.ones(n, bool)
    chain, pairs, heights = [], np.zeros((max(0, n - 1), 2), np.int64), np.zeros(max(0, n - 1))
    for step in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            i = chain[-1]
            d = ((mean - mean[i]) ** 2).sum(axis=1) * (size * size[i] / (size + size[i]))
            d[~live] = np.inf
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        low, high = min(i, j), max(i, j)
        pairs[step], heights[step] = (point[low], point[high]), d[j]
        mean[low] = (mean[low] * size[low] + mean[high] * size[high]) / (size[low] + size[high])
        size[low] += size[high]
        live[high] = False
    return pairs, heights


def _ward_merges(x):
    """Pairs of points whose clusters are merged, and at what distance, in any order that keeps equal distances' first ones first.

    Equal points are merged first. Then, in rounds, all clusters that are each other's nearest; only clusters that were merged,
    or whose nearest was, are asked again. Where few of those asked are merged, as among many equal distances, chains do the rest.
    """
    import numpy as np

    _, first, which, size = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True, return_counts=True)
    which = which.ravel()
    copies = np.flatnonzero(first[which] != np.arange(len(x)))
    pairs, heights = [np.column_stack([first[which[copies]], copies])], [np.zeros(len(copies))]
    order = np.argsort(first)
    point, size = first[order], size[order].astype(float)
    mean = x[point].astype(float)
    nearest, height, asked = np.zeros(len(point), np.int64), np.zeros(len(point)), np.ones(len(point), bool)
    while len(mean) > 1:
        rows = np.flatnonzero(asked)
        nearest[rows], height[rows] = _ward_nearest(rows, mean, size)
        every = np.arange(len(mean))
        a = np.flatnonzero((nearest[nearest] == every) & (every < nearest))
        b = nearest[a]
        if len(a) * 32 < len(rows):
            break
        pairs.append(np.column_stack([point[a], point[b]]))
        heights.append(height[a])
        mean[a] = (mean[a] * size[a, None] + mean[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        touched, kept = np.zeros(len(mean), bool), np.ones(len(mean), bool)
        touched[a] = touched[b] = True
        kept[b] = False
        asked = (touched | touched[nearest])[kept]
        nearest = (np.cumsum(kept) - 1)[nearest][kept]
        mean, size, point, height = mean[kept], size[kept], point[kept], height[kept]
    if len(mean) > 1:
        more = _ward_chains(mean, size, point)
        pairs.append(more[0])
        heights.append(more[1])
    return np.concatenate(pairs), np.concatenate(heights)


def ward_labels(points: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """Agglomerative clusters by Ward's criterion, in one task; a number of points over `most`, if given, raises an error.

    Clusters that are each other's nearest can be merged at once, as no later merge comes between them. A cluster is its size
    and mean, so that no matrix of distances is kept. The merges of least distance, all but the last k - 1, make the clusters;
    labels count them by their smallest id.
    """
    import numpy as np
    import pyarrow as pa

    if most is not None and points.limit(most + 1).count() > most:
        raise ValueError(f"Ward linkage takes at most {most} points here; use kmeans_labels or dbscan for more")

    def run(table: pa.Table) -> pa.Table:
        ids, v = table.column("id").to_numpy(), table.column("v").combine_chunks()
        order = np.argsort(ids, kind="stable")
        sizes = np.unique(v.value_lengths().to_numpy(zero_copy_only=False))
        if len(sizes) > 1:
            raise ValueError("points of several lengths")
        ids, x = ids[order], v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        pairs, heights = _ward_merges(x)
        root = np.arange(len(x))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for step in np.argsort(heights, kind="stable")[: max(0, len(x) - k)].tolist():
            a, b = sorted(top(int(i)) for i in pairs[step])
            root[b] = a
        label = np.array([top(i) for i in range(len(x))], np.int64)
        return pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(np.unique(label, return_inverse=True)[1].astype(np.int32))})

    one = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).withColumn("_g", F.lit(0))
    return one.groupBy("_g").applyInArrow(lambda t: run(t.select(["id", "v"])), "id long, label int")


def scores(points: DataFrame) -> DataFrame:
    """One row: silhouette, Calinski-Harabasz and Davies-Bouldin of a labelled table."""
    mean = silhouette(points).agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))
    return mean.crossJoin(calinski_harabasz(points)).crossJoin(davies_bouldin(points))


#: Ten values from 0.1 to 2.
EPS = tuple(0.1 + 1.9 * i / 9 for i in range(10))


def search(points: DataFrame, ks: range = range(2, 9), eps: tuple[float, ...] = EPS, seed: int = 42, most: int = WARD_POINTS) -> DataFrame:
    """(name, k, silhouette, calinski_harabasz, davies_bouldin, best) of every model; DBSCAN results with noise are left out.

    The best is the first by falling silhouette, in the order in which the models were tried. Above `most` points Ward
    linkage isn't tried: its models have rows without scores.
    """
    from functools import reduce

    plain, found = points.select("id", "v"), []
    tried = [(f"kmeans_{k}", kmeans_labels, k) for k in ks] + [(f"gmm_{k}", gmm_labels, k) for k in ks]
    left_out = [] if plain.limit(most + 1).count() <= most else [(f"agglomerative_{k}", k) for k in ks]
    tried += [] if left_out else [(f"agglomerative_{k}", ward_labels, k) for k in ks]
    labelled = [(name, fn(plain, k)) for name, fn, k in tried] + [(f"dbscan_{e}", dbscan(plain, e)) for e in eps]
    for position, (name, labels) in enumerate(labelled):
        row = labels.agg(F.count_distinct("label").alias("k"), F.min("label").alias("least")).first()
        if row["k"] < 2 or row["least"] < 0:
            continue
        found.append(scores(plain.join(labels, "id")).select(F.lit(position).alias("position"), F.lit(name).alias("name"), F.lit(row["k"]).alias("k"), "silhouette", "calinski_harabasz", "davies_bouldin"))
    if not found:
        raise ValueError("no clustering with two clusters or more")
    table = reduce(DataFrame.unionByName, found)
    for name, k in left_out:
        row = table.limit(1).select(F.lit(len(labelled)).alias("position"), F.lit(name).alias("name"), F.lit(k).alias("k"))
        table = table.unionByName(row, allowMissingColumns=True)
    return table.withColumn("best", F.row_number().over(Window.orderBy(F.desc("silhouette"), "position")) == 1)
