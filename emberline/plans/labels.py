"""Queries on labels made of pixels, thresholds of scores, ensembles and inference over windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import learning, spatial
from ..operators import reports as R
from ..operators.features import window_features
from ..operators.temporal import latest_before
from .pixels import BANDS, _c, pixels
from .registry import HISTORY, RASTER, history, query, r6, raster, read, side, windows
from .stacks import stack

#: Observations of pixels (ten points each), one a pixel and day, with a burn ratio; every tenth row stands for a fire.
_OBS = f"""{HISTORY}, obs AS (SELECT point_id // 10 AS pixel, date AS seen, arg_min((trees - built) / (trees + built + 1e-6::DOUBLE), id) AS nbr FROM hist GROUP BY ALL),
fire AS (SELECT id AS fire, point_id // 10 AS pixel, date AS day FROM hist WHERE id % 10 = 0)"""


def _observations(spark, d):
    h = history(spark, d).withColumn("pixel", F.expr("point_id div 10"))
    nbr = F.min(F.struct("id", ((F.col("trees") - F.col("built")) / (F.col("trees") + F.col("built") + 1e-6)).alias("nbr")))["nbr"]
    obs = h.groupBy("pixel", F.col("date").alias("seen")).agg(nbr.alias("nbr"))
    return obs, h.filter("id % 10 = 0").select(F.col("id").alias("fire"), "pixel", F.col("date").alias("day")), h


@query(f"""WITH {_OBS}, a AS (SELECT fire, any_value(fire.pixel) AS pixel, max(seen) FILTER (seen <= day - 30) AS pre_date, arg_max(nbr, seen) FILTER (seen <= day - 30) AS pre, min(seen) FILTER (seen > day) AS post_date, arg_min(nbr, seen) FILTER (seen > day) AS post
 FROM fire LEFT JOIN obs ON obs.pixel = fire.pixel AND seen BETWEEN day - 90 AND day + 60 GROUP BY fire)
SELECT fire, pixel, pre_date, post_date, CASE WHEN pre IS NULL OR post IS NULL THEN NULL WHEN pixel % 4 = 0 THEN 0.0 ELSE round(greatest(0.0, least(2.0, pre - post)), 6) END AS dnbr FROM a""")
def k14_dnbr_pixels(spark, d):
    """Each burned pixel's change from its last scene 30 to 90 days before the fire to the first within 60 days after; 0 off the burn, null without both."""
    obs, fires, _ = _observations(spark, d)
    c = spatial.range_hits(fires, obs, ["pixel"], "day", "seen", 90, 60)
    c = c.groupBy("fire").agg(
        F.max(F.when(F.col("seen") <= F.date_sub("day", 30), F.struct("seen", "nbr"))).alias("pre"), F.min(F.when(F.col("seen") > F.col("day"), F.struct("seen", "nbr"))).alias("post"))
    x, both = fires.select("fire", "pixel").join(c, "fire", "left"), F.col("pre").isNotNull() & F.col("post").isNotNull()
    value = F.when(~both, None).when(F.col("pixel") % 4 == 0, 0.0).otherwise(F.round(S.clip(F.col("pre.nbr") - F.col("post.nbr"), 0.0, 2.0), 6))
    return x.select("fire", "pixel", F.col("pre.seen").alias("pre_date"), F.col("post.seen").alias("post_date"), value.alias("dnbr"))


@query(f"""WITH {_OBS}, q AS (SELECT hist.id, hist.point_id // 10 AS pixel, hist.date, max(fire.day) AS scar FROM hist LEFT JOIN fire ON fire.pixel = hist.point_id // 10 AND fire.day < hist.date GROUP BY ALL),
a AS (SELECT *, CASE WHEN date - scar < 4380 THEN date - scar ELSE 9999 END AS age FROM q) SELECT id, pixel, scar, age::BIGINT AS age, round(exp(-age / 180.0::DOUBLE), 6) AS recent FROM a""")
def j14_burn_age(spark, d):
    """Days since the latest scar of the pixel before the query date, 9999 if there is none within twelve years."""
    _, fires, h = _observations(spark, d)
    x = latest_before(h.select("id", "pixel", "date"), fires, "pixel", "date", "day", "scar")
    gap = F.datediff("date", "scar")
    x = x.withColumn("age", F.when(gap < 4380, gap).otherwise(9999).cast("long"))
    return x.select("id", "pixel", "scar", "age", F.round(F.exp(-F.col("age") / 180.0), 6).alias("recent"))


@query(f"""WITH {RASTER}, f AS (SELECT o_orderkey AS fire, o_orderkey * 131 % s AS r, o_custkey * 17 % s AS c, 4 - o_orderkey // 20 % 4 AS rank FROM orders, side WHERE o_orderkey % 20 = 0),
fresh AS (SELECT row, col FROM rast WHERE v >= 0.08 AND (row, col) NOT IN (SELECT (row, col) FROM rast WHERE q >= 35)),
seen AS (SELECT fire, rank, row, col FROM f JOIN fresh ON row BETWEEN r - 2 AND r + 2 AND col BETWEEN c - 2 AND c + 2),
disc AS (SELECT fire, rank, r + i AS row, c + j AS col FROM f, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), side WHERE i * i + j * j <= 4 AND r + i BETWEEN 0 AND s - 1 AND c + j BETWEEN 0 AND s - 1 AND fire NOT IN (SELECT fire FROM seen)),
u AS (SELECT * FROM seen UNION ALL SELECT * FROM disc), b AS (SELECT row, col, max(rank) AS rank, count(*) AS fires, arg_max(fire, (rank, fire)) AS fire FROM u GROUP BY row, col)
SELECT row::INT AS row, col::INT AS col, ['VIIRS_ONLY', 'BRONZE', 'SILVER', 'GOLD'][rank] AS tier, ([0.3, 0.5, 0.8, 1.0]::DOUBLE[])[rank] AS weight, fire, fires FROM b""")
def k13_label_cells(spark, d):
    """Cells of a label raster: new burn near each fire, a disc where none was seen; the best tier wins a cell, then the latest fire."""
    g, s = raster(spark, d), side(spark, d)
    k = F.col("o_orderkey")
    f = read(spark, d, "orders").filter(k % 20 == 0).select(k.alias("fire"), (k * 131 % s).alias("r"), (F.col("o_custkey") * 17 % s).alias("c"), (4 - F.expr("o_orderkey div 20") % 4).alias("rank"))
    fresh = g.filter("v >= 0.08").select("row", "col").join(g.filter("q >= 35").select("row", "col"), ["row", "col"], "left_anti").withColumn("fresh", F.lit(True))
    step = F.sequence(F.lit(-2), F.lit(2))
    near = f.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).select("fire", "rank", (F.col("r") + F.col("i")).alias("row"), (F.col("c") + F.col("j")).alias("col"), (F.col("i") * F.col("i") + F.col("j") * F.col("j") <= 4).alias("disc"))
    near = near.filter(F.col("row").between(0, s - 1) & F.col("col").between(0, s - 1)).join(fresh, ["row", "col"], "left")
    seen = near.filter("fresh").select("fire").distinct()
    cells = near.filter("fresh").unionByName(near.filter("disc").join(seen, "fire", "left_anti"))
    best = cells.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.max(F.struct("rank", "fire")).alias("b"), F.count("*").alias("fires"))
    rank = F.col("b.rank").cast("int")
    tier, weight = F.array(*map(F.lit, ("VIIRS_ONLY", "BRONZE", "SILVER", "GOLD"))), F.array(*map(F.lit, (0.3, 0.5, 0.8, 1.0)))
    return best.select("row", "col", F.element_at(tier, rank).alias("tier"), F.element_at(weight, rank).alias("weight"), "b.fire", "fires")


@query("""WITH w AS (SELECT (label = 0)::INT AS y, ((vec_id * 7919) % 1000 + 700 * (label = 0)::INT) / 1700.0::DOUBLE AS s FROM embeddings), n AS (SELECT s, count(*) AS n, sum(y) AS pos FROM w GROUP BY s),
c AS (SELECT s, pos, sum(pos) OVER o AS tp, sum(n) OVER o AS k, sum(pos) OVER () AS ap, sum(n) OVER () AS rows FROM n WINDOW o AS (ORDER BY s DESC)),
f AS (SELECT *, 2 * tp / (k + ap) AS f1, tp / k AS p, tp / ap AS r FROM c), b AS (SELECT * FROM f ORDER BY f1 DESC, s DESC LIMIT 1), q AS (SELECT * FROM f WHERE p >= 0.8 ORDER BY s LIMIT 1)
SELECT b.rows::BIGINT AS rows, (SELECT round(sum(pos * tp / k) / sum(pos), 6) FROM f) AS average_precision, round(b.s, 6) AS threshold, round(b.f1, 6) AS f1, round(b.p, 6) AS precision, round(b.r, 6) AS recall, b.tp::BIGINT AS tp, (b.k - b.tp)::BIGINT AS fp, (b.ap - b.tp)::BIGINT AS fn,
 (b.rows - b.ap - b.k + b.tp)::BIGINT AS tn, round((b.r + (b.rows - b.ap - b.k + b.tp) / (b.rows - b.ap)) / 2, 6) AS balanced_accuracy, round(q.s, 6) AS safe_threshold, round(q.r, 6) AS safe_recall FROM b LEFT JOIN q ON true""")
def l11_thresholds(spark, d):
    w = read(spark, d, "embeddings").select((F.col("label") == 0).cast("int").alias("y"), ((F.col("vec_id") * 7919 % 1000 + F.when(F.col("label") == 0, 700).otherwise(0)) / 1700).alias("s"))
    t = R.thresholds(w, "s", "y")
    return t.select("rows", "tp", "fp", "fn", "tn", *(r6(F.col(c), c) for c in t.columns if c not in ("rows", "tp", "fp", "fn", "tn")))


@query("""WITH w AS (SELECT (label = 0)::INT AS y, ((vec_id * 7919) % 1000 + 700 * (label = 0)::INT) / 1700.0::DOUBLE AS s FROM embeddings), n AS (SELECT s, count(*) AS n, sum(y) AS pos FROM w GROUP BY s),
c AS (SELECT s, sum(pos) OVER o AS tp, sum(n) OVER o AS k, sum(pos) OVER () AS ap FROM n WINDOW o AS (ORDER BY s DESC)) SELECT round(s, 6) AS threshold, round(tp / k, 6) AS precision, round(tp / ap, 6) AS recall, round(2 * tp / (k + ap), 6) AS f1 FROM c""")
def l11_precision_recall_curve(spark, d):
    """A point of the curve for every score."""
    w = read(spark, d, "embeddings").select((F.col("label") == 0).cast("int").alias("y"), ((F.col("vec_id") * 7919 % 1000 + F.when(F.col("label") == 0, 700).otherwise(0)) / 1700).alias("s"))
    r = R.precision_recall(w, "s", "y")
    r = r.crossJoin(F.broadcast(r.agg(F.sum("pos").alias("ap"))))
    return r.select(r6(F.col("s"), "threshold"), r6(F.col("tp") / F.col("k"), "precision"), r6(F.col("tp") / F.col("ap"), "recall"), r6(2 * F.col("tp") / (F.col("k") + F.col("ap")), "f1"))


def best_windows(x, feature_list):
    """Alerting pixel windows with ``y``: 1 for the steepest of a pixel's windows where the pixel lost by half in sum, else 0."""
    steepest = F.row_number().over(Window.partitionBy("row", "col").orderBy("delta_trees", "w")) == 1
    lost = F.sum("delta_trees").over(Window.partitionBy("row", "col")) <= -0.5
    y = (steepest & lost).cast("double")
    return x.withColumn("y", y).filter("delta_trees <= -0.1").select(F.concat_ws("-", "w", "row", "col").alias("key"), *feature_list, "y")


@query()
def l11_feature_importances(spark, d):
    """What the filter of alerts gains by each of the 84 features; tested on a planted rule."""
    x = window_features(stack(spark, d), "w", "date_before", "enriched", date_after="date_after")
    names = x.columns[3:]
    return learning.importances(best_windows(x, names), "key", names, "y")


def _windows(spark, d):
    """Windows with a pixel, measures, and whether they were right: a rule of two measures, with every thirteenth row wrong."""
    w = windows(spark, d)
    right = ((F.col("value") > 60) & (F.col("cloud") < 0.7)).cast("int")
    return w.select("event_id", "pixel", "value", "cloud", F.hour("ts").cast("double").alias("hour"), F.when(F.col("event_id") % 13 == 5, 1 - right).otherwise(right).cast("double").alias("y"))


@query()
def l14_stacked_ensemble(spark, d):
    """Three members, their weighted mean, votes and a stacked regression, all out of fold; tested on a planted rule."""
    x = learning.stacked_ensemble(_windows(spark, d), "event_id", ["value", "cloud", "hour"], "y")
    return x.select("event_id", "y", "fold", *(r6(F.col(c), c) for c in ("logistic", "forest", "boosted", "weighted", "votes", "stacked")))


@query()
def l9_boosted_classes(spark, d):
    """Boosted trees over several classes of pixel changes, scored over all rows; tested on a planted rule."""
    t = _c("d_trees")
    y = F.when(t < -0.15, F.when(_c("d_crops") > 0.1, 1.0).otherwise(2.0)).otherwise(0.0)
    p = pixels(spark, d).withColumn("key", F.concat_ws("-", "pixel", "n", "k")).withColumn("y", y)
    return learning.boosted_classes(p, "key", [f"d_{b}" for b in BANDS], "y")


@query()
def l13_stacked_windows(spark, d):
    """Each window scored by the boosted filter, then a pixel's windows stacked; tested against a loop."""
    x = learning.stacked_windows(_windows(spark, d), "event_id", "pixel", ["value", "cloud", "hour"], "y")
    return x.select("pixel", "n_fires", *(r6(F.col(c), c) for c in ("mean_p", "consistency", "stacked_score")))
