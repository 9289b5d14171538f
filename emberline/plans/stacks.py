"""Queries over stacks of rasters, a raster a window: feature sets of pixel windows."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import BANDS, REFLECTANCES, SIDES, SPECTRA, window_features
from .registry import query, r6, read

#: Multipliers that spread a cell's number over the bands of the stand-in stack.
_SPREAD = dict(zip((*BANDS, *SPECTRA, *REFLECTANCES), (37, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 103, 107, 109, 113)))


def _value(name: str, side: str) -> str:
    """A band of the stand-in as SQL that both engines read alike."""
    k = f"(k * {_SPREAD[name]} % 1009 * {SIDES.index(side) + 2} % 193)"
    return f"({k} - 95) / 190e0" if name in SPECTRA else f"({k} + 1) / 200e0"


_VALUES = {f"{c}_{s}": _value(c, s) for c in _SPREAD for s in SIDES} | {"cloud_before": "k * 3 % 11 / 10e0", "cloud_after": "k * 5 % 11 / 10e0"}


def stack(spark, d) -> DataFrame:
    """Four windows over a square raster with about two rows of ``lineitem`` for a cell and window; some cells are missing."""
    li = read(spark, d, "lineitem")
    n = isqrt(li.count() // 8)
    place = [(F.col("l_linenumber") % 4).alias("w"), ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % n).alias("row"), ((F.col("l_partkey") * 17 + F.col("l_suppkey")) % n).alias("col")]
    cells = li.groupBy(*place).agg(F.min(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"))
    cells = cells.select("w", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "k", *(F.expr(v).alias(c) for c, v in _VALUES.items()))
    begun = F.expr("date_add(date'2023-01-20', cast(w as int) * 75)")
    deltas = (F.col(f"{b}_after") - F.col(f"{b}_before") for b in BANDS)
    return cells.select("*", *(x.alias(f"delta_{b}") for b, x in zip(BANDS, deltas)), begun.alias("date_before"), F.date_add(begun, 30 + F.col("w").cast("int")).alias("date_after"))


STACK = f"""side AS (SELECT floor(sqrt(count(*) // 8))::BIGINT AS s FROM lineitem), cells AS (SELECT l_linenumber % 4 AS w, ((l_orderkey * 31 + l_linenumber) % (SELECT s FROM side))::INT AS row,
 ((l_partkey * 17 + l_suppkey) % (SELECT s FROM side))::INT AS col, min(l_orderkey * 7 + l_linenumber) AS k FROM lineitem GROUP BY ALL),
stack AS (SELECT *, {", ".join(f"{b}_after - {b}_before AS delta_{b}" for b in BANDS)} FROM (SELECT w, row, col, DATE '2023-01-20' + w::INT * 75 AS date_before, 30 + w AS length, {", ".join(f"{v} AS {c}" for c, v in _VALUES.items())} FROM cells))"""


def _features_sql(kind: str) -> str:
    """One row a pixel window: neighbours from cells that tell those around them, the past from windows of a pixel."""
    single, enriched = kind == "single", kind == "enriched"
    far, t = (1, "abs(delta_trees) >= 0.1") if single else (3, "delta_trees <= -0.1")
    square = lambda r: f"FILTER (abs(i) <= {r} AND abs(j) <= {r})"
    gains = [b for b in BANDS if b != "trees"]
    argmax = lambda names, best: "CASE " + " ".join(f"WHEN {n} = {best} THEN {i}" for i, n in names) + " END"
    top = f"greatest({', '.join('delta_' + b for b in gains)})"
    before_top = f"greatest({', '.join(b + '_before' for b in BANDS)})"
    past = "OVER (PARTITION BY row, col ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    state = "" if single else f""", coalesce(sum(alert::INT) {past}, 0)::DOUBLE AS cum_alert_count, coalesce(sum(delta_trees) {past}, 0) AS cum_delta_trees, least(0, coalesce(min(delta_trees) {past}, 0)) AS max_loss_so_far,
 coalesce(nth - min(CASE WHEN alert THEN nth END) {past}, -1)::DOUBLE AS windows_since_first_alert"""
    if enriched:
        state += f""", coalesce(sum(ndvi_after - ndvi_before) {past}, 0) AS cum_delta_ndvi, least(0, coalesce(min(run) {past}, 0)) AS max_ndvi_loss_so_far, coalesce(sum(nbr_after - nbr_before) {past}, 0) AS cum_delta_nbr,
 coalesce(first_value(CASE WHEN alert THEN ndvi_before END IGNORE NULLS) {past}, 0) AS ndvi_at_first_alert"""
    run = ", sum(ndvi_after - ndvi_before) OVER (PARTITION BY row, col ORDER BY w ROWS UNBOUNDED PRECEDING) AS run" if enriched else ""
    x = {f"delta_{b}": f"delta_{b}" for b in BANDS}
    if enriched:
        x |= {c: c for c in _VALUES if not c.startswith("cloud")} | {f"delta_{c}": f"{c}_after - {c}_before" for c in SPECTRA}
    x |= {"cloud_before": "cloud_before", "cloud_after": "cloud_after", "cloud_worst": "greatest(cloud_before, cloud_after)", "n_neighbors_alert": "least(8, near - alert::INT)", "mean_neighbor_trees": "s1 / 9", "std_neighbor_trees": "sqrt(greatest(q1 / 9 - pow(s1 / 9, 2), 0))"}
    if not single:
        x |= {"delta_trees_5x5_mean": "s2 / 25", "delta_trees_7x7_mean": "s3 / 49", "tree_loss_ratio": "abs(delta_trees) / (abs(delta_trees) + abs(delta_crops) + abs(delta_bare) + 1e-6)"}
        x |= {c: c for c in ("cum_alert_count", "cum_delta_trees", "max_loss_so_far", "windows_since_first_alert")}
    x |= {"trees_crops_anti": "(delta_trees < 0 AND delta_crops > 0)", "trees_bare_anti": "(delta_trees < 0 AND delta_bare > 0)", "dominant_gain_band": "gain", "band_diversity": " + ".join(f"(abs(delta_{b}) > 0.1)::INT" for b in BANDS)}
    x |= {"abs_delta_trees": "abs(delta_trees)", "abs_max_band": f"greatest({', '.join(f'abs(delta_{b})' for b in BANDS)})", "month": "month(date_before)", "is_monsoon": "month(date_before) IN (6, 7, 8, 9)", "is_winter": "month(date_before) IN (12, 1, 2)"}
    if enriched:
        entropy = lambda s: "-(" + " + ".join(f"({b}_{s} + 1e-8) * ln({b}_{s} + 1e-8)" for b in BANDS) + ")"
        ndbi = lambda s: f"(swir1_{s} - nir_{s}) / (swir1_{s} + nir_{s} + 2e-6)"
        second = f"list_sort([{', '.join('delta_' + b for b in gains)}], 'DESC')[2]"
        x |= {
            "dominant_gain_class": "class", "relative_tree_loss": "delta_trees / (trees_before + 1e-6)", "dw_entropy_before": entropy("before"), "dw_entropy_after": entropy("after"), "dw_before_class": "cover", "dominant_gain_value": "top",
            "gain_gap": f"top - {second}", "transition_type": "cover * 10 + class", "monsoon_x_grass": "(month(date_before) IN (6, 7, 8, 9) AND class = 3)", "monsoon_x_shrub": "(month(date_before) IN (6, 7, 8, 9) AND class = 4)",
            "winter_x_crops": "(month(date_before) IN (12, 1, 2) AND class = 1)", "ndbi_before": ndbi("before"), "ndbi_after": ndbi("after"), "delta_ndbi": f"{ndbi('after')} - {ndbi('before')}", "window_duration_days": "length",
            "alert_rate": "(cum_alert_count > 0)", "ndvi_recovery_flag": "(cum_delta_ndvi - max_ndvi_loss_so_far > 0.05)", **{c: c for c in ("cum_delta_ndvi", "max_ndvi_loss_so_far", "ndvi_at_first_alert", "cum_delta_nbr")},
        }
    classes = "CASE WHEN delta_trees <= -0.3 AND top < 0.05 THEN 5 ELSE ([6, NULL, 3, 6, 1, 4, 2, 6])[gain + 1] END"
    return f"""WITH {STACK}, a AS (SELECT *, {t} AS alert, {top} AS top, {argmax([(i, 'delta_' + b) for i, b in enumerate(BANDS) if b != 'trees'], top)} AS gain, {argmax([(i, b + '_before') for i, b in enumerate(BANDS)], before_top)} AS cover, row_number() OVER (PARTITION BY row, col ORDER BY w) AS nth{run} FROM stack),
told AS (SELECT w, row + i AS row, col + j AS col, i, j, delta_trees AS v, alert FROM a, (SELECT unnest(range(-{far}, {far + 1})) AS i), (SELECT unnest(range(-{far}, {far + 1})) AS j)),
heard AS (SELECT w, row, col, {", ".join(f"sum(v) {square(r)} AS s{r}, sum(v * v) {square(r)} AS q{r}" for r in range(1, far + 1))}, count(*) FILTER (alert AND abs(i) <= 1 AND abs(j) <= 1) AS near FROM told GROUP BY w, row, col),
f AS (SELECT a.*, {classes} AS class{state} FROM a) SELECT w, row, col, {", ".join(f"round(({v})::DOUBLE, 6) AS {c}" for c, v in x.items())} FROM f JOIN heard USING (w, row, col)"""


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("w", "row", "col", *(r6(F.col(c), c) for c in x.columns[3:]))


@query(_features_sql("single"))
def l1_single_window_features(spark, d):
    """The 23 features of a window by itself."""
    return _rounded(window_features(stack(spark, d), "w", "date_before", "single"))


@query(_features_sql("history"))
def l1_history_features(spark, d):
    """The 30 features with wider surroundings and the windows before."""
    return _rounded(window_features(stack(spark, d), "w", "date_before", "history"))


@query(_features_sql("enriched"))
def l1_enriched_features(spark, d):
    """The 84 features with shares, spectra, transitions and trajectories."""
    return _rounded(window_features(stack(spark, d), "w", "date_before", "enriched", date_after="date_after"))
