"""Queries over pixel tables, each with the SQL that gives the same rows.

Every supplier gives an image of 16 x 16 pixels whose channels are formulas of place and key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annogrid.operators import chroma, pixels, spectrum
from annogrid.plans import derive

SIDE = 16
#: Images whose pixels a partition has.
IMAGES = 256
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PIXELS = f"""pixels AS (SELECT CAST(s_suppkey AS BIGINT) AS image_id, CAST(y.range AS INT) AS "row", CAST(x.range AS INT) AS col,
  CAST((y.range * 7 + x.range * 13 + s_suppkey * 31) % 256 AS INT) AS b, CAST((y.range * x.range * 5 + s_suppkey * 17) % 256 AS INT) AS g, CAST((y.range * 11 + s_suppkey * (x.range + 3)) % 256 AS INT) AS r
  FROM supplier, range({SIDE}) y, range({SIDE}) x),
grays AS (SELECT *, CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS INT) AS y FROM pixels)"""


def pixel_table(spark, sf_dir):
    """The images are dealt out before their pixels are made, so that what is done by image moves no pixels."""
    place = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("k")
    ids = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("image_id"))
    p = ids.repartition(max(1, -(-ids.count() // IMAGES)), "image_id").select("image_id", place)
    p = p.select("image_id", F.floor(F.col("k") / SIDE).cast("int").alias("row"), (F.col("k") % SIDE).cast("int").alias("col"))
    row, col, i = F.col("row"), F.col("col"), F.col("image_id")
    return p.withColumns({"b": ((row * 7 + col * 13 + i * 31) % 256).cast("int"), "g": ((row * col * 5 + i * 17) % 256).cast("int"), "r": ((row * 11 + i * (col + 3)) % 256).cast("int")})


def query(name: str, body: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(pixel_table(spark, sf_dir))
        if body is not None:
            ORACLES[name] = f"WITH {_PIXELS}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().lstrip('+')}"
        return fn

    return register


_LINEAR = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_Y = "0.212671 * ({}) + 0.715160 * ({}) + 0.072169 * ({})".format(*(_LINEAR.format(c=c) for c in "rgb"))


@query(
    "luminance_metrics",
    f"""+ l AS (SELECT image_id, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l, {_Y} AS yy, greatest(r, g, b)::DOUBLE AS v FROM pixels)
    SELECT image_id, round(avg(l), 4) AS avg_luminance, round(median(l), 4) AS median_luminance, round(stddev_pop(l), 4) AS std_luminance,
    round(avg(CASE WHEN yy > 0.008856 THEN 116 * cbrt(yy) - 16 ELSE 903.3 * yy END * 2.55), 4) AS avg_brightness_lab, round(avg(v), 4) AS avg_brightness_hsv,
    round(min(l), 4) AS min_luminance, round(max(l), 4) AS max_luminance, round(max(l) - min(l), 4) AS luminance_range FROM l GROUP BY 1""",
)
def luminance_metrics(p):
    return pixels.luminance_metrics(p)


_CLIPPED = ", ".join(
    f"round(100.0 * count(*) FILTER ({c} {op}) / count(*), 6) AS {n}_clipped_{k}_percent" for k, op in (("high", ">= 250"), ("low", "<= 5")) for n, c in (("blue", "b"), ("green", "g"), ("red", "r"))
)


@query(
    "exposure_issues",
    f"""+ e AS (SELECT image_id, count(*) FILTER (y >= 240) AS overexposed_pixels, round(100.0 * count(*) FILTER (y >= 240) / count(*), 6) AS overexposure_percentage,
    count(*) FILTER (y <= 15) AS underexposed_pixels, round(100.0 * count(*) FILTER (y <= 15) / count(*), 6) AS underexposure_percentage, {_CLIPPED} FROM grays GROUP BY 1)
    SELECT *, overexposure_percentage > 2 AS is_overexposed, underexposure_percentage > 2 AS is_underexposed, overexposure_percentage > 2 OR underexposure_percentage > 2 AS has_exposure_issues FROM e""",
)
def exposure_issues(p):
    return pixels.exposure_issues(p)


_TONES = """+ n AS (SELECT image_id, y, count(*) AS n FROM grays GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS p FROM n),
t AS (SELECT image_id, coalesce(sum(p) FILTER (y < 85), 0) AS s, coalesce(sum(p) FILTER (y >= 85 AND y < 171), 0) AS m, coalesce(sum(p) FILTER (y >= 171), 0) AS h,
  sum(y * p) AS c, -sum(p * log2(p)) AS e, arg_max(y, n * 1000 - y) AS peak FROM p GROUP BY 1)"""
_LABEL = "CASE WHEN s > 0.5 THEN 'shadows-heavy' WHEN h > 0.5 THEN 'highlights-heavy' ELSE 'balanced' END"


@query(
    "tonal_histogram",
    f"""{_TONES} SELECT image_id, round(100 * s, 6) AS shadows_percentage, round(100 * m, 6) AS midtones_percentage, round(100 * h, 6) AS highlights_percentage,
    round(c, 6) AS histogram_center, round(e, 6) AS histogram_entropy, peak AS histogram_peak, {_LABEL} AS tonal_distribution FROM t""",
)
def tonal_histogram(p):
    return pixels.tonal_histogram(p)


_RANGE = "+ q AS (SELECT image_id, quantile_cont(y, [0.01, 0.05, 0.95, 0.99]) AS q, CAST(max(y) - min(y) AS DOUBLE) AS dynamic_range_full FROM grays GROUP BY 1)"


@query(
    "dynamic_range",
    f"""{_RANGE} SELECT image_id, dynamic_range_full, round(q[4] - q[1], 6) AS dynamic_range_99p, round(q[3] - q[2], 6) AS dynamic_range_95p,
    round((q[4] - q[1]) / 255.0 * 100, 6) AS range_utilization_percent, round(q[1], 6) AS p1_percentile, round(q[4], 6) AS p99_percentile, (q[4] - q[1]) / 255.0 * 100 > 70 AS has_good_dynamic_range FROM q""",
)
def dynamic_range(p):
    return pixels.dynamic_range(p)


@query(
    "exposure_grade",
    """+ e AS (SELECT image_id, 100.0 * count(*) FILTER (y >= 240) / count(*) AS o, 100.0 * count(*) FILTER (y <= 15) / count(*) AS u, avg(y) AS m, count(*) FILTER (y < 50) AS low, count(*) FILTER (y >= 200) AS high FROM grays GROUP BY 1),
    a AS (SELECT *, CASE WHEN o > 10 THEN -2.0 WHEN o > 5 THEN -1.0 WHEN o > 2 THEN -0.5 WHEN u > 10 THEN 2.0 WHEN u > 5 THEN 1.0 WHEN u > 2 THEN 0.5 WHEN m < 85 THEN 0.5 WHEN m > 170 THEN -0.5 ELSE 0.0 END::DOUBLE AS s,
      CASE WHEN o > 10 THEN 'Significantly overexposed - reduce exposure by 2.0 stops' WHEN o > 5 THEN 'Overexposed - reduce exposure by 1.0 stops' WHEN o > 2 THEN 'Slightly overexposed - reduce exposure by 0.5 stops'
      WHEN u > 10 THEN 'Significantly underexposed - increase exposure by 2.0 stops' WHEN u > 5 THEN 'Underexposed - increase exposure by 1.0 stops' WHEN u > 2 THEN 'Slightly underexposed - increase exposure by 0.5 stops'
      WHEN m < 85 THEN 'Image appears dark - consider increasing exposure' WHEN m > 170 THEN 'Image appears bright - consider reducing exposure' ELSE 'Exposure appears well-balanced' END AS t FROM e)
    SELECT image_id, s AS exposure_compensation_stops, t AS recommendation,
      CASE WHEN t LIKE '%well-balanced' AND low > high THEN 'Consider slight exposure increase for better shadow detail' WHEN t LIKE '%well-balanced' AND high > low THEN 'Consider slight exposure decrease to prevent highlight clipping' END AS second_recommendation,
      CASE WHEN o > 10 OR u > 10 THEN 'Poor' WHEN o > 5 OR u > 5 THEN 'Fair' WHEN o < 1 AND u < 1 AND m BETWEEN 85 AND 170 THEN 'Excellent' ELSE 'Good' END AS overall_exposure_quality FROM a""",
)
def exposure_grade(p):
    return pixels.exposure_grade(p)


@query(
    "brightness_summary",
    f"""{_TONES}, {_RANGE[2:]}, l AS (SELECT image_id, avg(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) AS l FROM pixels GROUP BY 1)
    SELECT image_id, round(l, 4) AS average_brightness, {_LABEL} AS brightness_distribution, round((q[4] - q[1]) / 255.0 * 100, 6) AS dynamic_range_utilization, round(c, 6) AS histogram_center
    FROM t JOIN q USING (image_id) JOIN l USING (image_id)""",
)
def brightness_summary(p):
    return pixels.brightness_summary(p)


@query(
    "percentile_normalised",
    """+ q AS (SELECT image_id, quantile_cont(y, [0.01, 0.998]) AS q FROM grays GROUP BY 1)
    SELECT image_id, "row", col, round(least(greatest(255.0 * (y - q[1]) / (q[2] - q[1] + 1e-20), 0), 255), 6) AS value FROM grays JOIN q USING (image_id)""",
)
def percentile_normalised(p):
    return pixels.percentile_normalised(p)


def _spectra(p):
    return spectrum.magnitudes(p.select("image_id", "row", "col", pixels.gray().alias("value")))


_DFT = f"""+ dft AS (SELECT image_id, u.range AS u, v.range AS v, sum(y / 255.0::DOUBLE * cos(2 * pi() * (u.range * "row" + v.range * col) / {SIDE})) AS re,
  sum(y / 255.0::DOUBLE * sin(2 * pi() * (u.range * "row" + v.range * col) / {SIDE})) AS im FROM grays, range({SIDE}) u, range({SIDE}) v GROUP BY 1, 2, 3),
spectra AS (SELECT image_id, CAST((u + {SIDE // 2}) % {SIDE} AS INT) AS "row", CAST((v + {SIDE // 2}) % {SIDE} AS INT) AS col, sqrt(re * re + im * im) AS m FROM dft),
placed AS (SELECT *, "row" - {SIDE // 2} AS dy, col - {SIDE // 2} AS dx, sqrt(pow("row" - {SIDE // 2}, 2) + pow(col - {SIDE // 2}, 2)) AS d, floor(sqrt(2.0 * {SIDE // 2} * {SIDE // 2})) AS top FROM spectra)"""


@query("fft_magnitude", f'{_DFT} SELECT image_id, "row", col, round(m, 4) + 0.0 AS magnitude FROM spectra')
def fft_magnitude(p):
    return _spectra(p).select("image_id", "row", "col", F.round("magnitude", 4).alias("magnitude"))


@query("radial_profile", f"{_DFT} SELECT image_id, CAST(floor(d) AS INT) AS radius, round(avg(m), 4) AS value FROM placed WHERE floor(d) < top GROUP BY 1, 2")
def radial_profile(p):
    return spectrum.radial_profile(_spectra(p))


@query(
    "band_energy",
    f"""{_DFT} SELECT image_id, round(sum(m * m) FILTER (d <= top * 0.25) / sum(m * m), 6) AS low_freq_energy_ratio, round(sum(m * m) FILTER (d > top * 0.25 AND d < top * 0.75) / sum(m * m), 6) AS mid_freq_energy_ratio,
    round(sum(m * m) FILTER (d >= top * 0.75) / sum(m * m), 6) AS high_freq_energy_ratio FROM placed GROUP BY 1""",
)
def band_energy(p):
    return spectrum.band_energy(_spectra(p))


@query(
    "directional_energy",
    f"""{_DFT}, binned AS (SELECT image_id, CAST(floor((atan2(dy, dx) + pi()) / (2 * pi() / 35)) AS INT) AS bin, sum(m * m) AS e FROM placed GROUP BY 1, 2)
    SELECT i.image_id, CAST(k.range AS INT) AS bin, round(coalesce(e, 0), 3) AS value FROM (SELECT DISTINCT image_id FROM pixels) i CROSS JOIN range(35) k LEFT JOIN binned b ON b.image_id = i.image_id AND b.bin = k.range""",
)
def directional_energy(p):
    return spectrum.directional_energy(_spectra(p))


@query(
    "dominant_direction",
    f"""{_DFT}, binned AS (SELECT image_id, CAST(floor((atan2(dy, dx) + pi()) / (2 * pi() / 35)) AS INT) AS bin, round(sum(m * m), 3) AS e FROM placed GROUP BY 1, 2)
    SELECT image_id, round(-180.0::DOUBLE + bin * (360.0::DOUBLE / 35), 6) AS dominant_direction FROM binned WHERE bin < 35 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY e DESC, bin) = 1""",
)
def dominant_direction(p):
    return spectrum.dominant_direction(spectrum.directional_energy(_spectra(p)))


@query("spectral_centroid", f"{_DFT} SELECT image_id, round(sum(m * d) / sum(m), 6) AS centroid FROM placed GROUP BY 1")
def spectral_centroid(p):
    return spectrum.spectral_centroid(_spectra(p))


def _sized(p):
    return p.select("image_id", "row", "col", F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), F.col("r").cast("double").alias("c0"), F.col("g").cast("double").alias("c1"), F.col("b").cast("double").alias("c2"))


def _mirror(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -{x} - 1 WHEN {x} >= {SIDE} THEN {2 * SIDE - 1} - {x} ELSE {x} END"


def _box(name: str, source: str, values: list[str], r: int) -> str:
    means = ", ".join(f"avg(q.{v}) AS {v}" for v in values)
    return f"""{name} AS (SELECT p.image_id, p."row", p.col, {means} FROM {source} p CROSS JOIN range(-{r}, {r + 1}) dy CROSS JOIN range(-{r}, {r + 1}) dx
    JOIN {source} q ON q.image_id = p.image_id AND q."row" = {_mirror('(p."row" + dy.range)')} AND q.col = {_mirror("(p.col + dx.range)")} GROUP BY 1, 2, 3)"""


_CHANNELS = '+ chans AS (SELECT image_id, "row", col, r::DOUBLE AS c0, g::DOUBLE AS c1, b::DOUBLE AS c2 FROM pixels)'


@query("box_filter", f'{_CHANNELS}, {_box("boxed", "chans", ["c0", "c1"], 2)} SELECT image_id, "row", col, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM boxed')
def box_filter(p):
    return chroma.box_means(_sized(p), ["c0", "c1"], 2).select("image_id", "row", "col", F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


def _guided(name: str, source: str, guide: str, values: list[str], r: int, eps: float) -> str:
    """The same filter as CTEs: products, their means, lines, the lines' means, the result."""
    products = ", ".join([f"{guide} AS g", f"{guide} * {guide} AS gg", *(f"{v} AS s_{v}, {guide} * {v} AS gs_{v}" for v in values)])
    lines = ", ".join(f"(gs_{v} - g * s_{v}) / (gg - g * g + {eps}) AS a_{v}, s_{v} - (gs_{v} - g * s_{v}) / (gg - g * g + {eps}) * g AS b_{v}" for v in values)
    out = ", ".join(f"l.a_{v} * o.{guide} + l.b_{v} AS {v}" for v in values)
    kept = ["g", "gg", *(x for v in values for x in (f"s_{v}", f"gs_{v}"))]
    return f"""{name}_p AS (SELECT image_id, "row", col, {products} FROM {source}), {_box(name + "_m", name + "_p", kept, r)},
    {name}_l AS (SELECT image_id, "row", col, {lines} FROM {name}_m), {_box(name + "_n", name + "_l", [x for v in values for x in (f"a_{v}", f"b_{v}")], r)},
    {name} AS (SELECT o.* EXCLUDE ({", ".join(values)}), {out} FROM {source} o JOIN {name}_n l USING (image_id, "row", col))"""


@query(
    "guided_filter",
    f"""{_CHANNELS}, {_guided("guided", "chans", "c0", ["c1"], 2, 0.0001)} SELECT image_id, "row", col, round(c1, 5) AS value FROM guided""",
)
def guided_filter(p):
    return chroma.guided(_sized(p), "c0", ["c1"], 2, 1e-4).select("image_id", "row", "col", F.round("c1", 5).alias("value"))


def _corrected(c: str, n: str, source: str) -> str:
    share = "(c0 - lo) / (hi - lo + 1e-6)"
    return f"""{n}_a AS (SELECT *, min(c0) OVER i AS lo, max(c0) OVER i AS hi, max({c}) OVER i AS mx, log2(greatest({c}, 1e-6)) - log2(greatest(c0, 1e-6)) AS lr FROM {source} WINDOW i AS (PARTITION BY image_id)),
    {n}_b AS (SELECT * EXCLUDE (lr), least(greatest(lr, -2), 2) AS r, CASE WHEN abs(lr) > 2 THEN 2 / abs(lr) ELSE 1.0 END AS w FROM {n}_a),
    {n}_c AS (SELECT * EXCLUDE (r, w), r * w * ((1 - {share}) * w) AS ln, (1 - {share}) * w AS ld, r * w * ({share} * w) AS un, {share} * w AS ud FROM {n}_b),
    {_guided(n + "_d", n + "_c", "c0", ["ln", "ld", "un", "ud"], 2, 0.0001)},
    {n}_e AS (SELECT * EXCLUDE (ln, ld, un, ud), ln / (ld + 1e-6) AS l, un / (ud + 1e-6) AS u FROM {n}_d), {_guided(n + "_f", n + "_e", "c0", ["l", "u"], 2, 0.0001)},
    {n}_g AS (SELECT *, c0 * pow(2.0, (1 - least(greatest({share}, 0), 1)) * l + least(greatest({share}, 0), 1) * u) AS x FROM {n}_f),
    {n}_h AS (SELECT *, least(greatest((abs(x / (c0 + 1e-8) - {c} / (c0 + 1e-8)) - 0.5) / (0.5 + 1e-8), 0), 1) * 0.5 AS bl FROM {n}_g),
    {n} AS (SELECT * EXCLUDE ({c}, lo, hi, mx, l, u, x, bl), least(greatest(x * (1 - bl) + {c} * bl, 0), mx * 2) AS {c} FROM {n}_h)"""


@query(
    "ca_corrected",
    f"""+ raw AS (SELECT image_id, "row", col, r::DOUBLE AS c0, g::DOUBLE AS c1, b::DOUBLE AS c2 FROM pixels),
    chans AS (SELECT image_id, "row", col, scale, c0 / scale AS c0, c1 / scale AS c1, c2 / scale AS c2 FROM (SELECT *, greatest(1.0, max(greatest(c0, c1, c2)) OVER (PARTITION BY image_id)) AS scale FROM raw)),
    {_corrected("c1", "one", "chans")}, {_corrected("c2", "two", "one")}
    SELECT image_id, "row", col, round(c0 * scale, 3) AS c0, round(c1 * scale, 3) AS c1, round(c2 * scale, 3) AS c2 FROM two""",
)
def ca_corrected(p):
    done = chroma.corrected(_sized(p), chroma.ChromaSettings(radius=2))
    return done.select("image_id", "row", "col", *(F.round(c, 3).alias(c) for c in ("c0", "c1", "c2")))
