"""Queries that build training tables, splits, weights and label sets, and those that fit and compare models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import scalars as S
from ..operators import learning
from ..operators import reports as R
from ..operators import spatial
from .passes import SCENES, fires, scenes
from .pixels import BANDS, PIXELS, _c, pixels
from .registry import ALERTS, HISTORY, alerts, half_up, history, query, r6, read
from .series import harmonic_fit

_TIER = "CASE k % 5 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'SILVER' WHEN 2 THEN 'BRONZE' WHEN 3 THEN 'VIIRS_ONLY' ELSE 'NEGATIVE' END"
_SPLIT = "CASE WHEN year(date) <= 1997 THEN 'train' WHEN year(date) <= 1999 THEN 'val' ELSE 'test' END"


def patches(spark, d) -> DataFrame:
    """A patch per tile and day: tier, split by year, burned pixels."""
    p, k = pixels(spark, d), F.col("k")
    g = p.groupBy("tile", "date").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.count(F.when(M.loss_fires(_c("d_trees")), 1)).alias("burned"))
    tier = F.when(k % 5 == 0, "GOLD").when(k % 5 == 1, "SILVER").when(k % 5 == 2, "BRONZE").when(k % 5 == 3, "VIIRS_ONLY").otherwise("NEGATIVE")
    split = F.when(F.year("date") <= 1997, "train").when(F.year("date") <= 1999, "val").otherwise("test")
    return g.withColumn("tier", tier).withColumn("split", split)


PATCHES = f"{PIXELS}, g AS (SELECT tile, date, min(k) AS k, count(*) AS n, count(*) FILTER (d_trees <= -0.1) AS burned FROM px GROUP BY ALL), pa AS (SELECT *, {_TIER} AS tier, {_SPLIT} AS split FROM g)"


@query(f"WITH {PATCHES} SELECT split, tier, count(*) AS n, sum(burned)::BIGINT AS burned FROM pa WHERE split = 'train' AND tier <> 'VIIRS_ONLY' AND (tier = 'NEGATIVE' OR burned >= 1) GROUP BY ALL")
def b22_training_rows(spark, d):
    """Rows of a split without excluded tiers; positives need burned pixels."""
    p = patches(spark, d).filter((F.col("split") == "train") & (F.col("tier") != "VIIRS_ONLY") & ((F.col("tier") == "NEGATIVE") | (F.col("burned") >= 1)))
    return p.groupBy("split", "tier").agg(F.count("*").alias("n"), F.sum("burned").alias("burned"))


@query(f"WITH {ALERTS} SELECT count(*) AS n, count(*) FILTER (stacked_score IS NOT NULL AND sar_boost_applied IS NOT NULL) AS complete, sum(CASE WHEN stacked_score IS NULL THEN 1 ELSE 0 END)::BIGINT AS filled, count(*) FILTER (coalesce(sar_boost_applied, false)) AS target FROM alerts")
def b23_l16_required_and_filled(spark, d):
    """Rows fit to score as they are, and those whose nulls count as 0 in the training table."""
    a = alerts(spark, d)
    done = a.na.drop(subset=["stacked_score", "sar_boost_applied"]).agg(F.count("*").alias("complete"))
    t = a.withColumn("was", F.col("stacked_score").isNull()).na.fill(0.0, ["stacked_score"]).na.fill(False, ["sar_boost_applied"])
    t = t.agg(F.count("*").alias("n"), F.sum((F.col("was") & (F.col("stacked_score") == 0)).cast("long")).alias("filled"), F.count(F.when(F.col("sar_boost_applied"), 1)).alias("target"))
    return t.crossJoin(F.broadcast(done))


_W = "CASE tier WHEN 'GOLD' THEN 4 WHEN 'SILVER' THEN 3 WHEN 'BRONZE' THEN 2 ELSE 1 END * CASE WHEN burned > 0 THEN 5 ELSE 1 END"


@query(f"WITH {PATCHES}, w AS (SELECT *, {_W} AS w, (tile * 7 + k) % 100 AS u FROM pa), r AS (SELECT *, w * 30 // 100 + CASE WHEN u < w * 30 % 100 THEN 1 ELSE 0 END AS copies FROM w) SELECT tier, count(*) AS n, sum(w)::BIGINT AS weight, sum(copies)::BIGINT AS drawn FROM r GROUP BY tier")
def l7_sampling_weights(spark, d):
    """Weights by tier and fire; a row is drawn 0.3 times its weight on average, the fraction by a fixed number of its own."""
    tier = F.when(F.col("tier") == "GOLD", 4).when(F.col("tier") == "SILVER", 3).when(F.col("tier") == "BRONZE", 2).otherwise(1)
    p = patches(spark, d).withColumn("w", tier * F.when(F.col("burned") > 0, 5).otherwise(1)).withColumn("u", (F.col("tile") * 7 + F.col("k")) % 100)
    share = F.col("w") * 30
    p = p.withColumn("copies", F.floor(share / 100) + F.when(F.col("u") < share % 100, 1).otherwise(0))
    drawn = p.filter("copies > 0").select("tier", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).groupBy("tier").agg(F.count("*").alias("drawn"))
    return p.groupBy("tier").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("weight")).join(drawn, "tier")


@query(f"""WITH {PATCHES}, q AS (SELECT *, CASE WHEN tier IN ('GOLD', 'SILVER') THEN 'loss' WHEN tier = 'NEGATIVE' THEN 'hard' ELSE 'random' END AS kind FROM pa), m AS (SELECT min(n) AS least FROM (SELECT kind, count(*) * CASE kind WHEN 'loss' THEN 1 ELSE 2 END AS n FROM q GROUP BY kind)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY (tile * 48271 + k) % 10007, tile, date) AS r FROM q) SELECT kind, count(*) AS n, min(date) AS first, count(*) FILTER (month(date) BETWEEN 2 AND 5) AS dry_anchors FROM r, m WHERE r.r * CASE kind WHEN 'loss' THEN 1 ELSE 2 END <= least GROUP BY kind""")
def l19_sampling_quotas(spark, d):
    """Half loss, a quarter each of hard and random negatives, in a fixed pseudorandom order."""
    kind = F.when(F.col("tier").isin("GOLD", "SILVER"), "loss").when(F.col("tier") == "NEGATIVE", "hard").otherwise("random")
    q = patches(spark, d).withColumn("kind", kind).withColumn("part", F.when(F.col("kind") == "loss", 1).otherwise(2)).withColumn("h", (F.col("tile") * 48271 + F.col("k")) % 10007)
    least = q.groupBy("kind", "part").agg((F.count("*") * F.col("part")).alias("n")).agg(F.min("n").alias("least"))
    r = R.numbered(q, "kind", "h", "tile", "date").crossJoin(F.broadcast(least)).filter(F.col("nth") * F.col("part") <= F.col("least"))
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.count(F.when(F.month("date").between(2, 5), 1)).alias("dry_anchors"))


@query(f"""WITH {SCENES}, n AS (SELECT tile, seen, row_number() OVER (PARTITION BY tile ORDER BY seen) AS i, cloud, lag(seen) OVER (PARTITION BY tile ORDER BY seen) AS before, count(*) OVER (PARTITION BY tile ORDER BY seen) AS c FROM sc),
f AS (SELECT tile, day, count(*) AS fires FROM fi GROUP BY ALL) SELECT n.tile, seen, cloud, fires, seen - before AS gap, CASE WHEN seen - before <= 60 THEN floor(exp(-(seen - before) / 180) * 1e6 + 0.5) / 1e6 ELSE 0.0 END AS recent FROM n JOIN f ON n.tile = f.tile AND n.seen = f.day""")
def l18_patch_assembly(spark, d):
    """Scene, clouds, burn age and fires of the day joined to one row per tile and fire day."""
    w = Window.partitionBy("tile").orderBy("seen")
    n = scenes(spark, d).withColumn("gap", F.datediff("seen", F.lag("seen").over(w)).cast("long"))
    f = fires(spark, d).groupBy("tile", F.col("day").alias("seen")).agg(F.count("*").alias("fires"))
    age = F.when(F.col("gap") <= 60, F.floor(S.burn_age(F.col("gap"))["recent"] * 1e6 + 0.5) / 1e6).otherwise(0.0)
    return n.join(f, ["tile", "seen"]).select("tile", "seen", "cloud", "fires", "gap", age.alias("recent"))


@query(f"""WITH {SCENES}, c AS (SELECT fire, min(seen) FILTER (seen > day) AS post, max(seen) FILTER (seen <= day - 30) AS pre FROM fi JOIN sc ON fi.tile = sc.tile AND seen BETWEEN day - 90 AND day + 60 GROUP BY fire)
SELECT CASE WHEN pre IS NULL OR post IS NULL THEN 'missing' WHEN fire % 4 = 0 THEN 'background' ELSE 'burned' END AS label, count(*) AS n, round(avg(CASE WHEN pre IS NULL OR post IS NULL THEN NULL WHEN fire % 4 = 0 THEN 0.0 ELSE greatest(0.0, least(2.0, (fire % 300) / 100 - 0.5)) END), 6) AS mean_dnbr FROM c GROUP BY 1""")
def k14_dnbr_labels(spark, d):
    """Severity between a scene 30 to 90 days before and the next within 60 days; null without both, 0 off the burn."""
    c = spatial.range_hits(fires(spark, d), scenes(spark, d), ["tile"], "day", "seen", 90, 60)
    c = c.groupBy("fire").agg(F.min(F.when(F.col("seen") > F.col("day"), F.col("seen"))).alias("post"), F.max(F.when(F.col("seen") <= F.date_sub("day", 30), F.col("seen"))).alias("pre"))
    missing, off = F.col("pre").isNull() | F.col("post").isNull(), F.col("fire") % 4 == 0
    value = F.when(missing, None).when(off, 0.0).otherwise(S.clip(F.col("fire") % 300 / 100 - 0.5, 0.0, 2.0))
    return c.groupBy(F.when(missing, "missing").when(off, "background").otherwise("burned").alias("label")).agg(F.count("*").alias("n"), r6(F.avg(value), "mean_dnbr"))


@query(f"""WITH {PATCHES}, p AS (SELECT tile, date, tier, burned, k % 64 AS r, k * 7 % 64 AS c FROM pa WHERE tier <> 'NEGATIVE'), t AS (SELECT tile, tier, greatest(burned, CASE WHEN burned = 0 THEN 13 ELSE 0 END) AS pixels, burned = 0 AS fallback FROM p)
SELECT tile, tier, count(*) AS n, sum(pixels)::BIGINT AS pixels, count(*) FILTER (fallback) AS discs, max(CASE tier WHEN 'GOLD' THEN 1.0::DOUBLE WHEN 'SILVER' THEN 0.8::DOUBLE WHEN 'BRONZE' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS weight FROM t GROUP BY ALL HAVING sum(pixels) >= 10""")
def k13_label_rasters(spark, d):
    """Pixels of each label: the new burn, or a disc of radius 2 around the fire where none was seen; under 10 pixels none."""
    p = patches(spark, d).filter("tier <> 'NEGATIVE'")
    step = F.sequence(F.lit(-2), F.lit(2))
    disc = F.size(F.filter(F.flatten(F.transform(step, lambda i: F.transform(step, lambda j: i * i + j * j))), lambda x: x <= 4))
    weight = F.when(F.col("tier") == "GOLD", 1.0).when(F.col("tier") == "SILVER", 0.8).when(F.col("tier") == "BRONZE", 0.5).otherwise(0.3)
    px = F.when(F.col("burned") > 0, F.col("burned")).otherwise(disc)
    return p.groupBy("tile", "tier").agg(F.count("*").alias("n"), F.sum(px).alias("pixels"), F.count(F.when(F.col("burned") == 0, 1)).alias("discs"), F.max(weight).alias("weight")).filter("pixels >= 10")


@query(f"""WITH {PIXELS}, m AS (SELECT k % 3 AS t, unnest(['a', 'b', 'c']) AS model, unnest([k * 7 % 3, k * 11 % 5 % 3, (k + n) % 3]) AS p FROM px), x AS (SELECT model, t, p, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT model, t, sum(n) AS sup FROM x GROUP BY ALL), q AS (SELECT model, p, sum(n) AS said FROM x GROUP BY ALL), h AS (SELECT model, t, n AS tp FROM x WHERE t = p)
SELECT s.model, {", ".join(f"floor(coalesce(max(tp) FILTER (s.t = {c}), 0)::DOUBLE / max(sup) FILTER (s.t = {c}) * 1e6 + 0.5) / 1e6 AS recall_{c}" for c in range(3))}, {", ".join(f"floor(coalesce(max(tp) FILTER (s.t = {c}), 0)::DOUBLE / max(said) FILTER (s.t = {c}) * 1e6 + 0.5) / 1e6 AS precision_{c}" for c in range(3))} FROM s JOIN q ON s.model = q.model AND s.t = q.p LEFT JOIN h ON s.model = h.model AND s.t = h.t GROUP BY s.model""")
def d53_models_side_by_side(spark, d):
    """Recall and precision of several models on the same rows, a column a class."""
    k = _c("k")
    said = F.array(*(F.struct(F.lit(n).alias("model"), v.alias("p")) for n, v in (("a", k * 7 % 3), ("b", k * 11 % 5 % 3), ("c", (k + _c("n")) % 3))))
    m = pixels(spark, d).select((k % 3).alias("t"), F.explode(said).alias("s")).select("t", "s.*")
    n = lambda c: F.count(F.when(c, 1))
    hit = lambda c: n((F.col("t") == c) & (F.col("p") == c))
    return m.groupBy("model").agg(*(half_up(hit(c) / n(F.col("t") == c), f"recall_{c}") for c in range(3)), *(half_up(hit(c) / n(F.col("p") == c), f"precision_{c}") for c in range(3)))


@query()
def l10_cross_validation(spark, d):
    """Balanced accuracy in five folds by a hash of the key; tested on a planted rule."""
    e = read(spark, d, "events").select("event_id", "value", (F.col("event_id") % 10).cast("double").alias("cloud"), F.hour("ts").cast("double").alias("hour"), (F.col("value") > 80).cast("double").alias("y"))
    return learning.cross_validated(e, "event_id", ["value", "cloud", "hour"], "y")


@query()
def l9_multi_class_trees(spark, d):
    """A forest over several classes of pixel changes, scored over all rows; tested on a planted rule."""
    t = _c("d_trees")
    y = F.when(t < -0.15, F.when(_c("d_crops") > 0.1, 1.0).otherwise(2.0)).otherwise(0.0)
    p = pixels(spark, d).withColumn("key", F.concat_ws("-", "pixel", "n", "k")).withColumn("y", y)
    return learning.forest_classes(p, "key", [f"d_{b}" for b in BANDS], "y")


@query(f"""WITH {HISTORY}, c AS (SELECT point_id, count(*) AS n FROM hist GROUP BY 1), u AS (SELECT point_id, unnest(['trees', 'crops']) AS variable, n FROM c) SELECT point_id, variable, n, CASE WHEN n < 12 THEN 'too few' ELSE 'fitted' END AS status FROM u""")
def j3_fit_status(spark, d):
    """Each point and variable: fitted, or skipped for too few observations. The models themselves are held against numpy."""
    h = history(spark, d).withColumn("doy", F.dayofyear("date"))
    long = h.select("point_id", "doy", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("y")) for v in ("trees", "crops")))).alias("s")).select("point_id", "doy", "s.*")
    keyed = long.withColumn("key", F.concat_ws("|", "point_id", "variable"))
    counts = keyed.groupBy("key", "point_id", "variable").agg(F.count("*").alias("n"))
    models = harmonic_fit(keyed, "key", "doy", "y").select("key", "r2")
    return counts.join(models, "key", "left").select("point_id", "variable", "n", F.when(F.col("r2").isNull(), "too few").otherwise("fitted").alias("status"))


@query(f"""WITH {HISTORY} SELECT id, floor(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (trees - (0.5 + 0.1 * cos(dayofyear(date) * 2 * pi() / 365.25))) / 0.14)) * 1e4 + 0.5) / 1e4 AS z FROM hist""")
def j4_raster_z_scores(spark, d):
    """All pixels against one harmonic model, held within 10 spreads."""
    model = F.array(*map(F.lit, (0.5, 0.1, 0.0, 0.0, 0.0)))
    z = (F.col("trees") - S.harmonic(model, F.dayofyear("date"))) / 0.14
    return history(spark, d).select("id", (F.floor(S.clip(z, -10.0, 10.0) * 1e4 + 0.5) / 1e4).alias("z"))


def _solved(by: str) -> str:
    """CTEs from ``obs(<by>, doy, y)`` to ``fit(<by>, n, r2, residual_std, c0 .. c4)``: normal equations by elimination."""
    basis = ("1e0", "cos(w)", "sin(w)", "cos(2 * w)", "sin(2 * w)")
    sums = ", ".join([f"sum({a} * {b}) AS a{i}{j}" for i, a in enumerate(basis) for j, b in enumerate(basis)] + [f"sum({a} * y) AS a{i}5" for i, a in enumerate(basis)] + [f"sum({a} * y) AS b{i}" for i, a in enumerate(basis)])
    steps = [f"e0 AS (SELECT {by}, count(*) AS n, sum(y * y) AS yy, {sums} FROM (SELECT *, doy * 2 * pi() / 365.25e0 AS w FROM obs) GROUP BY {by} HAVING count(*) >= 12)"]
    for k in range(5):
        steps.append(f"e{k + 1} AS (SELECT * REPLACE ({', '.join(f'a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}' for i in range(5) if i != k for j in range(k, 6))}) FROM e{k})")
    c = [f"a{i}5 / a{i}{i}" for i in range(5)]
    rss = f"greatest(yy - ({' + '.join(f'{x} * b{i}' for i, x in enumerate(c))}), 0)"
    return ", ".join(steps) + f", fit AS (SELECT {by}, n, 1 - {rss} / (yy - b0 * b0 / n) AS r2, sqrt({rss} / (n - 5)) AS residual_std, {', '.join(f'{x} AS c{i}' for i, x in enumerate(c))} FROM e5)"


_LONG = "obs AS (SELECT beat || '|' || range_name AS label, variable, beat || '|' || range_name || '|' || variable AS key, dayofyear(date) AS doy, CASE variable WHEN 'trees' THEN trees ELSE crops END AS y FROM hist, (SELECT unnest(['trees', 'crops']) AS variable))"


def _models(spark, d) -> DataFrame:
    """A model for each label (beat and range) and each of two variables."""
    h = history(spark, d).withColumn("label", F.concat_ws("|", "beat", "range_name")).withColumn("doy", F.dayofyear("date"))
    long = h.select("label", "doy", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("y")) for v in ("trees", "crops")))).alias("s")).select("label", "doy", "s.*")
    return harmonic_fit(long.withColumn("key", F.concat_ws("|", "label", "variable")), "key", "doy", "y")


@query(f"WITH {HISTORY}, {_LONG}, {_solved('key')} SELECT key, n, round(r2, 5) AS r2, round(residual_std, 5) AS residual_std, {', '.join(f'round(c{i}, 5) AS c{i}' for i in range(5))} FROM fit")
def j3_harmonic_models(spark, d):
    """The models of all labels and variables with their quality and coefficients; labels with too few observations have none."""
    return _models(spark, d).select("key", "n", F.round("r2", 5).alias("r2"), F.round("residual_std", 5).alias("residual_std"), *(F.round(F.col("coeffs")[i], 5).alias(f"c{i}") for i in range(5)))


@query(f"""WITH {HISTORY}, {_LONG}, {_solved('key')} SELECT id, round(CASE WHEN residual_std > 1e-6 THEN greatest(-10, least(10, (trees - (c0 + c1 * cos(w) + c2 * sin(w) + c3 * cos(2 * w) + c4 * sin(2 * w))) / residual_std)) WHEN residual_std IS NOT NULL THEN 0 END, 5) AS z
 FROM (SELECT *, dayofyear(date) * 2 * pi() / 365.25e0 AS w FROM hist) LEFT JOIN fit ON key = beat || '|' || range_name || '|trees'""")
def j4_model_z_scores(spark, d):
    """Every pixel against the fitted model of its label, held within 10 spreads; null where the label has no model."""
    h = history(spark, d).withColumn("key", F.concat_ws("|", "beat", "range_name", F.lit("trees")))
    x = h.join(_models(spark, d).withColumnRenamed("n", "n_fit"), "key", "left")
    z = F.when(F.col("residual_std") > 1e-6, S.clip((F.col("trees") - S.harmonic(F.col("coeffs"), F.dayofyear("date"))) / F.col("residual_std"), -10.0, 10.0)).when(F.col("residual_std").isNotNull(), 0.0)
    return x.select("id", F.round(z, 5).alias("z"))


@query(f"WITH {HISTORY}, p AS (SELECT id, date - lag(date) OVER w AS gap FROM hist WINDOW w AS (PARTITION BY point_id ORDER BY date, id)) SELECT count(*) AS n, count(gap) AS with_before, count(*) FILTER (gap > 90) AS too_far FROM p")
def e1_shifted_measures(spark, d):
    """Rows with a row before them at their point, and those too far apart to compare."""
    h = history(spark, d)
    p = h.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("point_id").orderBy("date", "id"))))
    return p.agg(F.count("*").alias("n"), F.count("gap").alias("with_before"), F.count(F.when(F.col("gap") > 90, 1)).alias("too_far"))
