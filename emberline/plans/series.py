"""Queries over ordered observations: pairs and scores, running states, streaks, sums, as-of joins, models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scorers as K
from ..operators import spatial, temporal
from ..operators.grid import persist_table
from ..operators.quantiles import exact_quantiles
from .registry import HISTORY, WINDOWS, half_up, history, query, r6, read, windows

#: Monthly means and deviation of the stand-in series (flat in winter, high in the monsoon).
MEANS = [0.45, 0.42, 0.38, 0.34, 0.33, 0.40, 0.52, 0.58, 0.60, 0.57, 0.52, 0.48]
STD = 0.12


def _doy_sql(doy: str) -> str:
    pts = [*zip(S.MONTH_CENTRES, MEANS), (380, MEANS[0])]
    d = f"(CASE WHEN {doy} < 15 THEN {doy} + 365 ELSE {doy} END)"
    cases = " ".join(f"WHEN {d} BETWEEN {a} AND {b} THEN {v}::DOUBLE + {w - v}::DOUBLE * ({d} - {a}) / {b - a}.0::DOUBLE" for (a, v), (b, w) in zip(pts, pts[1:]))
    return f"(CASE {cases} END)"


def _l(x: str, m: str, k: str) -> str:
    return f"(1 / (1 + exp(-greatest(-60.0, least(60.0, ({k}) * (({x}) - ({m})))))))"


PAIRS_SQL = f"""{HISTORY},
lagged AS (SELECT *, lag(trees) OVER w AS trees_before, lag(crops) OVER w AS crops_before, lag(built) OVER w AS built_before, lag(date) OVER w AS date_before FROM hist WINDOW w AS (PARTITION BY point_id ORDER BY date, id)),
once AS (SELECT * FROM lagged WHERE date_before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id, date ORDER BY date, id) = 1),
pairs AS (SELECT *, date - date_before AS gap FROM once WHERE date - date_before BETWEEN 1 AND 90)"""

SCORE_SQL = f"""{PAIRS_SQL},
s0 AS (SELECT *, {_doy_sql("dayofyear(date_before)")} AS m0, {_doy_sql("dayofyear(date)")} AS m1 FROM pairs),
s1 AS (SELECT *, greatest(0.0, -(trees - trees_before - least(0.0, m1 - m0))) AS loss, (trees - greatest(trees_before, m1)) / {STD} AS z, (trees - m1) / {STD} AS pz FROM s0),
s2 AS (SELECT *, least((0.7 * {_l("loss", "0.05 + 0.10 * trees_before", "25 + 20 * greatest(0.0, (0.30 - trees_before) / 0.30)")} + 0.3 * {_l("loss / greatest(trees_before, 0.05)", "0.30", "8")})
  * (1 + greatest(0.0, -z) / 4 * {_l("loss", "0.08", "40")}), 1.0) AS ev FROM s1),
s3 AS (SELECT *, least(round(ev, 3) + least(CASE WHEN pz < -1.96 THEN 0.30 * {_l("-pz", "1.96", "5")} ELSE 0.0 END + CASE WHEN id % 11 > 0 THEN 0.20 * {_l("id % 11 / 25.0::DOUBLE", "0.22", "25")} ELSE 0.0 END, 0.35), 1.0) AS tree,
  {_l("greatest(0.0, crops - crops_before)", "0.08 + 0.10 * crops_before", "25")} * (1 - {_l("crops_before", "0.30", "20")}) * {_l("crops", "0.35", "20")} AS crop,
  {_l("greatest(0.0, built - built_before)", "0.06 + 0.10 * built_before", "30")} * (1 - {_l("built_before", "0.20", "20")}) * {_l("built", "0.30", "25")} AS bt FROM s2),
s4 AS (SELECT *, greatest(tree, crop, bt) AS best FROM s3),
s5 AS (SELECT *, best * pow(1 - {_l("cloud", "0.60", "15")}, 1 - best) AS score, CASE WHEN tree = best THEN 'CANOPY_LOSS' WHEN crop = best THEN 'CROP_ENCROACHMENT' ELSE 'BUILT_ENCROACHMENT' END AS threat FROM s4),
scored AS (SELECT *, CASE WHEN score >= 0.70 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' WHEN score >= 0.25 THEN 'LOW' ELSE 'NO ALERT' END AS label FROM s5)"""


def scored_pairs(spark, d) -> DataFrame:
    p = temporal.consecutive_pairs(history(spark, d), "point_id", ["date", "id"], "date", ["trees", "crops", "built"])
    m0, m1 = (K.baseline(F.dayofyear(c), MEANS) for c in ("date_before", "date"))
    p = p.withColumn("m0", m0).withColumn("m1", m1)
    kinds = ("trees", "crops", "built")
    out = K.threat_scores({k: F.col(f"{k}_before") for k in kinds}, {k: F.col(k) for k in kinds}, F.col("m0"), F.col("m1"), F.lit(STD), F.col("cloud"), F.col("id") % 11 / 25)
    return p.withColumns({k: out[k] for k in ("score", "threat", "label")})


@query(f"WITH {SCORE_SQL} SELECT label, threat, count(*) AS n_pairs, round(avg(score), 6) AS mean_score, max(gap)::BIGINT AS max_gap FROM scored GROUP BY ALL")
def k17_pair_backtest(spark, d):
    return scored_pairs(spark, d).groupBy("label", "threat").agg(F.count("*").alias("n_pairs"), r6(F.avg("score"), "mean_score"), F.max("gap").cast("long").alias("max_gap"))


@query(f"WITH {SCORE_SQL} SELECT beat, count(*) AS n, count(*) FILTER (label = 'HIGH') AS n_high, round(count(*) FILTER (label = 'HIGH') / count(*), 6) AS rate FROM scored GROUP BY beat ORDER BY rate DESC, beat LIMIT 15")
def f10_high_rate_by_beat(spark, d):
    x = scored_pairs(spark, d).groupBy("beat").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == "HIGH", 1)).alias("n_high"))
    return x.withColumn("rate", F.round(F.col("n_high") / F.col("n"), 6)).orderBy(F.desc("rate"), "beat").limit(15)


@query(f"WITH {SCORE_SQL} SELECT year(date)::INT AS year, {', '.join(f'coalesce(round(avg(score) FILTER (month(date) = {m}), 6), 0) AS m{m}' for m in range(1, 13))} FROM scored GROUP BY ALL")
def d8_score_by_year_and_month(spark, d):
    x = scored_pairs(spark, d).withColumn("m", F.month("date")).groupBy(F.year("date").alias("year")).pivot("m", list(range(1, 13)))
    x = x.agg(F.round(F.avg("score"), 6)).na.fill(0)
    return x.toDF("year", *(f"m{m}" for m in range(1, 13)))


@query(f"WITH {PAIRS_SQL} SELECT id, gap::BIGINT AS gap, floor((trees - trees_before) * 1e6 + 0.5) / 1e6 AS d_trees, floor(least({_l('-(trees - trees_before)', '0.12', '18')} * (1 + greatest(0.0, -((trees - trees_before) / {STD})) / 4), 1.0) * greatest(0.0, 1 - cloud) * 1e6 + 0.5) / 1e6 AS score FROM pairs")
def k1_plain_scores(spark, d):
    p = temporal.consecutive_pairs(history(spark, d), "point_id", ["date", "id"], "date", ["trees", "crops", "built"])
    delta = F.col("trees") - F.col("trees_before")
    return p.select("id", F.col("gap").cast("long").alias("gap"), half_up(delta, "d_trees"), half_up(K.plain_score(delta, delta / STD, F.col("cloud")), "score"))


@query(f"""WITH {WINDOWS}, n AS (SELECT *, row_number() OVER w AS k FROM win WINDOW w AS (PARTITION BY pixel ORDER BY ts, event_id)),
s AS (SELECT event_id, coalesce(sum(fired::INT) OVER p, 0)::BIGINT AS cum_alert_count, coalesce(sum(delta) OVER p, 0) AS cd, least(0, coalesce(min(delta) OVER p, 0)) AS ml,
 coalesce(k - min(CASE WHEN fired THEN k END) OVER p, -1)::BIGINT AS windows_since_first_alert, coalesce(max(fired::INT) OVER p, 0) = 1 AS already_detected FROM n WINDOW p AS (PARTITION BY pixel ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, cum_alert_count, round(cd, 6) AS cum_delta, round(ml, 6) AS max_loss_so_far, windows_since_first_alert, already_detected FROM s""")
def e3_e5_running_state(spark, d):
    x = temporal.running_state(windows(spark, d), "pixel", ["ts", "event_id"], F.col("fired"), F.col("delta"))
    return x.select("event_id", F.col("cum_alert_count").cast("long").alias("cum_alert_count"), r6(F.col("cum_delta"), "cum_delta"), r6(F.col("max_loss_so_far"), "max_loss_so_far"), F.col("windows_since_first_alert").cast("long").alias("windows_since_first_alert"), "already_detected")


@query(f"""WITH {WINDOWS}, c AS (SELECT *, sum(delta) OVER w AS run FROM win WINDOW w AS (PARTITION BY pixel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(0, min(run) OVER w) AS low, first_value(CASE WHEN fired THEN value END IGNORE NULLS) OVER w AS at_first FROM c WINDOW w AS (PARTITION BY pixel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(run, 6) AS cum_delta, round(low, 6) AS min_cum, round(at_first, 6) AS value_at_first_alert, run - low > 0.05 AS recovering FROM m""")
def e4_trajectory_state(spark, d):
    w = Window.partitionBy("pixel").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = windows(spark, d).withColumn("run", F.sum("delta").over(w)).withColumn("low", F.least(F.lit(0.0), F.min("run").over(w)))
    x = x.withColumn("first", F.first(F.when(F.col("fired"), F.col("value")), ignorenulls=True).over(w))
    return x.select("event_id", r6(F.col("run"), "cum_delta"), r6(F.col("low"), "min_cum"), r6(F.col("first"), "value_at_first_alert"), (F.col("run") - F.col("low") > 0.05).alias("recovering"))


@query(f"""WITH {WINDOWS}, l AS (SELECT event_id, delta, lead(delta) OVER (PARTITION BY pixel ORDER BY ts, event_id) AS nx FROM win)
SELECT event_id, coalesce(sign(nx) = -sign(delta) AND abs(nx) >= 0.15, false) AS reversal FROM l""")
def e6_reversals(spark, d):
    return temporal.reversals(windows(spark, d), "pixel", ["ts", "event_id"], "delta", 0.15).select("event_id", "reversal")


@query(f"""WITH {WINDOWS}, n AS (SELECT pixel, fired, row_number() OVER (PARTITION BY pixel ORDER BY ts, event_id) AS k FROM win), i AS (SELECT *, k - row_number() OVER (PARTITION BY pixel, fired ORDER BY k) AS g FROM n),
r AS (SELECT pixel, fired, g, count(*) AS run, max(k) AS e FROM i GROUP BY ALL)
SELECT pixel, coalesce(max(run) FILTER (fired), 0)::BIGINT AS max_streak, (CASE WHEN arg_max(fired, e) THEN arg_max(run, e) ELSE 0 END)::BIGINT AS cur_streak FROM r GROUP BY pixel""")
def e7_streaks(spark, d):
    x = temporal.streaks(windows(spark, d), "pixel", ["ts", "event_id"], F.col("fired"))
    return x.select("pixel", F.col("max_streak").cast("long").alias("max_streak"), F.col("cur_streak").cast("long").alias("cur_streak"))


@query(f"""WITH {WINDOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY ts, event_id) AS k FROM win)
SELECT pixel, min(k) FILTER (fired) AS first_fire, max(k) FILTER (fired) AS last_fire, round(arg_max(delta, k) FILTER (fired), 6) AS last_fired_delta, arg_max(event_type, p - k / 1e6) AS best_type, arg_min(k, (delta, k)) AS worst_window FROM n GROUP BY pixel""")
def e9_e12_first_last_best(spark, d):
    n = windows(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("pixel").orderBy("ts", "event_id")))
    at = F.when(F.col("fired"), F.col("k"))
    return n.groupBy("pixel").agg(
        F.min(at).cast("long").alias("first_fire"), F.max(at).cast("long").alias("last_fire"), F.round(F.max_by("delta", at), 6).alias("last_fired_delta"),
        F.max_by("event_type", F.col("p") - F.col("k") / 1e6).alias("best_type"), F.min_by("k", F.struct("delta", "k")).cast("long").alias("worst_window"),
    )


@query(f"""WITH {WINDOWS}, f AS (SELECT pixel, min(date) FILTER (fired) AS day FROM win GROUP BY pixel), c AS (SELECT day, count(*) AS n FROM f WHERE day IS NOT NULL GROUP BY day)
SELECT day, n, round(sum(n) OVER (ORDER BY day) / sum(n) OVER (), 6) AS cumulative FROM c""")
def e13_cumulative_detection(spark, d):
    c = windows(spark, d).groupBy("pixel").agg(F.min(F.when(F.col("fired"), F.col("date"))).alias("day")).filter("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    return c.withColumn("cumulative", F.round(F.sum("n").over(Window.orderBy("day")) / F.sum("n").over(Window.partitionBy()), 6))


@query(f"""WITH {WINDOWS}, w AS (SELECT pixel, unnest(range(greatest(0, ((date - DATE '2024-01-01') - 6 + 3) // 3), (date - DATE '2024-01-01') // 3 + 1)) AS s, date - DATE '2024-01-01' AS t, value FROM win),
x AS (SELECT pixel, s, avg(value) FILTER (t < s * 3 + 2) AS a, avg(value) FILTER (t >= s * 3 + 4) AS b FROM w WHERE t - s * 3 BETWEEN 0 AND 5 GROUP BY ALL)
SELECT pixel, s::BIGINT AS start, round(b - a, 6) AS delta FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def e14_m7_hopping_deltas(spark, d):
    t = F.datediff("date", F.lit("2024-01-01").cast("date"))
    w = windows(spark, d).withColumn("t", t).withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - 3) / 3)).cast("long"), F.floor(F.col("t") / 3).cast("long"))))
    w = w.filter((F.col("t") - F.col("s") * 3).between(0, 5))
    x = w.groupBy("pixel", "s").agg(F.avg(F.when(F.col("t") < F.col("s") * 3 + 2, F.col("value"))).alias("a"), F.avg(F.when(F.col("t") >= F.col("s") * 3 + 4, F.col("value"))).alias("b"))
    return x.filter("a is not null and b is not null").select("pixel", F.col("s").alias("start"), r6(F.col("b") - F.col("a"), "delta"))


@query(f"""WITH {WINDOWS}, g AS (SELECT pixel, event_id, ts, CASE WHEN event_type <> 'view' THEN value END AS v FROM win)
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER b, first_value(v IGNORE NULLS) OVER a), 6) AS filled FROM g
WINDOW b AS (PARTITION BY pixel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY pixel ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def e16_fill(spark, d):
    g = windows(spark, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return temporal.fill_both_ways(g, "pixel", ["ts", "event_id"], ["v"]).select("event_id", r6(F.col("v"), "filled"))


@query(f"""WITH {WINDOWS}, g AS (SELECT pixel, event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM win),
h AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS ni, first_value(v IGNORE NULLS) OVER a AS nv FROM g
WINDOW b AS (PARTITION BY pixel ORDER BY event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY pixel ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, pv + (nv - pv) * (event_id - pi) / (ni - pi), pv, nv), 6) AS filled FROM h""")
def e17_interpolate(spark, d):
    g = windows(spark, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return temporal.interpolate(g.select("pixel", "event_id", "v"), "pixel", "event_id", "v").select("event_id", r6(F.col("v"), "filled"))


@query(f"""WITH {WINDOWS}, m AS (SELECT pixel, date, avg(value) AS v FROM win GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY pixel ORDER BY date) - v AS fall FROM m)
SELECT pixel, arg_max(date, fall) AS day, round(max(fall), 6) AS fall FROM l GROUP BY pixel HAVING max(fall) >= 2""")
def e18_largest_drop(spark, d):
    m = windows(spark, d).groupBy("pixel", "date").agg(F.avg("value").alias("v"))
    x = m.withColumn("fall", F.lag("v").over(Window.partitionBy("pixel").orderBy("date")) - F.col("v")).filter("fall is not null")
    first = F.struct("fall", -F.unix_date("date"))  # of equal falls the first day, as arg_max keeps it
    x = x.groupBy("pixel").agg(F.max_by("date", first).alias("day"), F.max("fall").alias("fall"))
    return x.filter("fall >= 2").withColumn("fall", F.round("fall", 6))


@query(f"""WITH {HISTORY}, o AS (SELECT DISTINCT point_id, date FROM hist), g AS (SELECT *, lag(date) OVER (PARTITION BY point_id ORDER BY date) AS prev FROM o)
SELECT point_id, prev AS gap_start, date AS gap_end, (date - prev)::BIGINT AS days FROM g WHERE date - prev > 365""")
def e19_coverage_gaps(spark, d):
    g = history(spark, d).select("point_id", "date").distinct().withColumn("prev", F.lag("date").over(Window.partitionBy("point_id").orderBy("date")))
    return g.withColumn("days", F.datediff("date", "prev").cast("long")).filter("days > 365").select("point_id", F.col("prev").alias("gap_start"), F.col("date").alias("gap_end"), "days")


@query("""WITH y AS (SELECT o_custkey AS point_id, year(o_orderdate) AS y, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 50000000 AS v FROM orders GROUP BY ALL), s AS (SELECT *, array_agg(v) OVER w AS seq, count(*) OVER w AS n, lead(v) OVER (PARTITION BY point_id ORDER BY y) AS target FROM y
 WINDOW w AS (PARTITION BY point_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT point_id, y::INT AS year, floor(seq[1] * 1e6 + 0.5) / 1e6 AS s0, floor(seq[2] * 1e6 + 0.5) / 1e6 AS s1, floor(seq[3] * 1e6 + 0.5) / 1e6 AS s2, floor(target * 1e6 + 0.5) / 1e6 AS target FROM s WHERE n = 3 AND target IS NOT NULL""")
def e23_sequences(spark, d):
    y = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("point_id"), F.year("o_orderdate").alias("year")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / 50000000).alias("v"))
    w = Window.partitionBy("point_id").orderBy("year")
    s = y.withColumn("seq", F.collect_list("v").over(w.rowsBetween(-2, 0))).withColumn("target", F.lead("v").over(w)).filter((F.size("seq") == 3) & F.col("target").isNotNull())
    return s.select("point_id", "year", *(half_up(F.col("seq")[i], f"s{i}") for i in range(3)), half_up(F.col("target"), "target"))


@query(f"""WITH {HISTORY}, r AS (SELECT point_id, date - 30 AS s, date + 30 AS e FROM hist), m AS (SELECT *, max(e) OVER (PARTITION BY point_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY point_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT point_id, min(s) AS start, max(e) AS stop FROM i GROUP BY point_id, g""")
def e24_merged_ranges(spark, d):
    r = history(spark, d).select("point_id", F.date_sub("date", 30).alias("start"), F.date_add("date", 30).alias("stop"))
    return temporal.merge_ranges(r, "point_id", "start", "stop")


@query(f"""WITH {WINDOWS}, x AS (SELECT pixel, event_id, ts, -delta - 0.05 AS step FROM win), c AS (SELECT *, sum(step) OVER w AS t FROM x WINDOW w AS (PARTITION BY pixel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY pixel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS s FROM c), m AS (SELECT pixel, max(s) AS top FROM s GROUP BY pixel)
SELECT pixel, round(top, 6) AS max_cusum, round(top / max(top) OVER (), 6) AS score FROM m""")
def j5_cusum(spark, d):
    m = persist_table(temporal.cusum(windows(spark, d), "pixel", ["ts", "event_id"], -F.col("delta") - 0.05).groupBy("pixel").agg(F.max("cusum").alias("top")), "cusum")
    most = m.agg(F.max("top").alias("most"))  # one row
    return m.crossJoin(F.broadcast(most)).select("pixel", r6(F.col("top"), "max_cusum"), r6(F.col("top") / F.col("most"), "score"))


@query(f"""WITH {WINDOWS}, b AS (SELECT pixel, (date - DATE '2024-01-01') // 2 AS f, median(value) AS v FROM win GROUP BY ALL), m AS (SELECT pixel, avg(v) FILTER (f < 10) AS base FROM b GROUP BY pixel)
SELECT pixel, round(greatest(0, least(1, sum(greatest(0, (base - v) * 1.5) ) FILTER (f >= 10) / (5 * 1.5 * 50))), 6) AS score FROM b JOIN m USING (pixel) GROUP BY pixel HAVING max(base) IS NOT NULL AND count(*) FILTER (f >= 10) > 0""")
def j6_fortnight_deficit(spark, d):
    f = F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 2)
    b = windows(spark, d).groupBy("pixel", f.alias("f")).agg(F.median("value").alias("v"))
    base = F.avg(F.when(F.col("f") < 10, F.col("v"))).over(Window.partitionBy("pixel"))
    late = F.when(F.col("f") >= 10, F.greatest(F.lit(0.0), (F.col("base") - F.col("v")) * 1.5))
    return b.withColumn("base", base).filter("base is not null").groupBy("pixel").agg(F.sum(late).alias("s")).filter("s is not null").select("pixel", r6(S.clip(F.col("s") / (5 * 1.5 * 50), 0.0, 1.0), "score"))


@query(f"""WITH {WINDOWS}, n AS (SELECT *, row_number() OVER w AS k, delta - lag(delta) OVER w < -0.01 AS down FROM win WINDOW w AS (PARTITION BY pixel ORDER BY ts, event_id)), f AS (SELECT pixel, k, coalesce(down, false) AS down, value FROM n),
i AS (SELECT *, k - row_number() OVER (PARTITION BY pixel, down ORDER BY k) AS g FROM f), r AS (SELECT pixel, max(c) AS streak FROM (SELECT pixel, g, count(*) AS c FROM i WHERE down GROUP BY ALL) GROUP BY pixel),
e AS (SELECT pixel, count(*) AS t, arg_min(value, k) AS a, arg_max(value, k) AS b FROM f GROUP BY pixel)
SELECT pixel, round(coalesce(streak, 0) / t * greatest(0, least(1, (a - b) / 100)), 6) AS score FROM e LEFT JOIN r USING (pixel)""")
def e8_j7_gradual_loss(spark, d):
    w = Window.partitionBy("pixel").orderBy("ts", "event_id")
    n = windows(spark, d).withColumn("down", F.coalesce(F.col("delta") - F.lag("delta").over(w) < -0.01, F.lit(False)))
    run = temporal.streaks(n, "pixel", ["ts", "event_id"], F.col("down"))
    at = F.struct("ts", "event_id")
    ends = n.groupBy("pixel").agg(F.count("*").alias("t"), F.min_by("value", at).alias("a"), F.max_by("value", at).alias("b"))
    return ends.join(run, "pixel").select("pixel", r6(F.col("max_streak") / F.col("t") * S.clip((F.col("a") - F.col("b")) / 100, 0.0, 1.0), "score"))


@query(f"""WITH {HISTORY}, m AS (SELECT point_id, avg(trees) AS a, avg(trees) FILTER (month(date) BETWEEN 7 AND 9) AS w FROM hist GROUP BY point_id) SELECT point_id, round(w, 6) AS monsoon_mean, w < 0.65 AND w < 0.85 * a AS not_recovered FROM m WHERE w IS NOT NULL""")
def j8_monsoon_recovery(spark, d):
    m = history(spark, d).groupBy("point_id").agg(F.avg("trees").alias("a"), F.avg(F.when(F.month("date").between(7, 9), F.col("trees"))).alias("w")).filter("w is not null")
    return m.select("point_id", r6(F.col("w"), "monsoon_mean"), ((F.col("w") < 0.65) & (F.col("w") < 0.85 * F.col("a"))).alias("not_recovered"))


STACK_SQL = f"""{WINDOWS}, a AS (SELECT pixel, count(*) FILTER (fired) AS n_fires, sum(p) FILTER (fired) AS s1, sum(p * p) FILTER (fired) AS s2 FROM win GROUP BY pixel),
b AS (SELECT *, coalesce(s1 / n_fires, 0) AS mean_p, greatest(s2 / n_fires - (s1 / n_fires) * (s1 / n_fires), 0) AS v FROM a), c AS (SELECT *, CASE WHEN mean_p > 0.01 THEN 1 - greatest(0, least(1, sqrt(v) / mean_p)) ELSE 1.0 END AS consistency FROM b),
stack AS (SELECT pixel, n_fires, mean_p, consistency, CASE WHEN n_fires >= 2 THEN s1 * sqrt(consistency) ELSE 0.0 END AS stacked_score FROM c)"""


@query(f"WITH {STACK_SQL} SELECT pixel, n_fires, round(mean_p, 6) AS mean_p, round(consistency, 6) AS consistency, round(stacked_score, 6) AS stacked_score FROM stack")
def j11_temporal_stack(spark, d):
    s = temporal.temporal_stack(windows(spark, d), "pixel", F.col("fired"), F.col("p"))
    return s.select("pixel", "n_fires", *(r6(F.col(c), c) for c in ("mean_p", "consistency", "stacked_score")))


@query(f"WITH {STACK_SQL} SELECT round(greatest(0.5, quantile_cont(stacked_score, 0.8)), 6) AS threshold, count(*) AS n FROM stack WHERE stacked_score > 0")
def j12_auto_threshold(spark, d):
    s = persist_table(temporal.temporal_stack(windows(spark, d), "pixel", F.col("fired"), F.col("p")).filter("stacked_score > 0"), "scores")
    return exact_quantiles(s, "stacked_score", {"p80": 0.8}).select(r6(F.greatest(F.lit(0.5), "p80"), "threshold"), "n")


#: Right rows are one value a customer and day, so ties do not depend on row order.
ASOF_SQL = f"""{HISTORY}, l AS (SELECT id, point_id, date AS at FROM hist WHERE id % 2 = 0), r AS (SELECT point_id, date, round(avg(trees), 9) AS v FROM hist WHERE id % 2 = 1 GROUP BY ALL),
j AS (SELECT l.id, abs(r.date - l.at) AS gap, r.date < l.at AS earlier, v FROM l JOIN r ON l.point_id = r.point_id AND abs(r.date - l.at) <= 30)"""


@query(f"WITH {ASOF_SQL}, b AS (SELECT id, min(gap) AS gap, arg_min(v, gap * 2 + earlier::INT) AS v FROM j GROUP BY id) SELECT l.id, b.gap::BIGINT AS gap_days, round(b.v, 6) AS v FROM l LEFT JOIN b USING (id)")
def c11_c12_nearest_asof(spark, d):
    h = history(spark, d)
    left = h.filter("id % 2 = 0").select("id", "point_id", F.col("date").alias("at"))
    right = h.filter("id % 2 = 1").groupBy("point_id", "date").agg(F.round(F.avg("trees"), 9).alias("v"))
    x = temporal.nearest_asof(left, right, "id", "point_id", "at", "date", 30, "v")
    return x.select("id", F.col("gap_days").cast("long").alias("gap_days"), r6(F.col("v"), "v"))


@query(f"WITH {HISTORY}, l AS (SELECT id, point_id, date AS at FROM hist WHERE id % 2 = 0), r AS (SELECT point_id, date AS seen, trees FROM hist WHERE id % 2 = 1) SELECT l.id, count(*) AS n, round(max(r.trees), 6) AS top FROM l JOIN r ON l.point_id = r.point_id AND r.seen BETWEEN l.at - 60 AND l.at GROUP BY l.id")
def c8_range_join(spark, d):
    h = history(spark, d)
    left = h.filter("id % 2 = 0").select("id", "point_id", F.col("date").alias("at"))
    right = h.filter("id % 2 = 1").select("point_id", F.col("date").alias("seen"), "trees")
    return spatial.range_hits(left, right, ["point_id"], "at", "seen", 60, 0).groupBy("id").agg(F.count("*").alias("n"), r6(F.max("trees"), "top"))


@query(f"""WITH {HISTORY}, l AS (SELECT id, point_id, date AS at FROM hist WHERE id % 2 = 0), r AS (SELECT point_id, date AS seen FROM hist WHERE id % 2 = 1) SELECT id, l."at" AS "at" FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.point_id = l.point_id AND r.seen BETWEEN l."at" - 30 AND l."at" + 30)""")
def c10_c29_no_event_near(spark, d):
    h = history(spark, d)
    left = h.filter("id % 2 = 0").select("id", "point_id", F.col("date").alias("at"))
    right = h.filter("id % 2 = 1").select("point_id", F.col("date").alias("seen"))
    return left.select("id", "at").join(spatial.range_hits(left, right, ["point_id"], "at", "seen", 30, 30).select("id").distinct(), "id", "left_anti")


@query(f"""WITH {HISTORY}, d AS (SELECT point_id, date, median(trees) AS v FROM hist GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY date DESC) AS n FROM d)
SELECT a.point_id, a.date AS latest, b.date AS before, round(a.v - b.v, 6) AS delta FROM p a JOIN p b ON a.point_id = b.point_id AND a.n = 1 AND b.n = 2""")
def c18_two_latest_passes(spark, d):
    day = history(spark, d).groupBy("point_id", "date").agg(F.median("trees").alias("v"))
    n = day.withColumn("n", F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("date")))).filter("n <= 2")
    pick = lambda c, i: F.max(F.when(F.col("n") == i, F.col(c)))
    x = n.groupBy("point_id").agg(pick("date", 1).alias("latest"), pick("date", 2).alias("before"), pick("v", 1).alias("a"), pick("v", 2).alias("b")).filter("before is not null")
    return x.select("point_id", "latest", "before", r6(F.col("a") - F.col("b"), "delta"))


@query(f"WITH {HISTORY}, m AS (SELECT point_id, year(date) AS y, month(date) AS m, avg(trees) AS v FROM hist GROUP BY ALL) SELECT a.point_id, a.y::INT AS year, a.m::INT AS month, round(a.v - b.v, 6) AS change FROM m a JOIN m b ON a.point_id = b.point_id AND a.m = b.m AND a.y = b.y + 1")
def c19_c33_year_over_year(spark, d):
    m = history(spark, d).groupBy("point_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("trees").alias("v"))
    before = m.select("point_id", (F.col("year") + 1).alias("year"), "month", F.col("v").alias("u"))
    return m.join(before, ["point_id", "year", "month"]).select("point_id", "year", "month", r6(F.col("v") - F.col("u"), "change"))


@query(f"WITH {WINDOWS} SELECT h.pixel, n.event_id IS NOT NULL AS fresh, h.event_id FROM win h LEFT JOIN (SELECT pixel, date, min(event_id) AS event_id FROM win WHERE event_type = 'signup' GROUP BY ALL) n ON h.pixel = n.pixel AND h.date = n.date WHERE h.event_type <> 'signup' AND n.event_id IS NULL UNION ALL SELECT pixel, true, event_id FROM win WHERE event_type = 'signup'")
def c27_g2_newer_rows_win(spark, d):
    w = windows(spark, d)
    new = w.filter("event_type = 'signup'")
    old = w.filter("event_type <> 'signup'").join(new.select("pixel", "date").distinct(), ["pixel", "date"], "left_anti")
    return old.select("pixel", F.lit(False).alias("fresh"), "event_id").unionByName(new.select("pixel", F.lit(True).alias("fresh"), "event_id"))


def harmonic_fit(obs: DataFrame, by: str, doy: str, y: str, least: int = 12) -> DataFrame:
    """Least squares on 1, cos, sin, cos 2, sin 2 of the year's angle, per group: coefficients, n, R squared, residual std.

    Moments are summed natively; a task solves the 5 x 5 systems of a batch of groups at once.
    """
    w = F.col(doy) * (2 * np.pi / 365.25)
    xs = [F.lit(1.0), F.cos(w), F.sin(w), F.cos(2 * w), F.sin(2 * w)]
    sums = [F.sum(a * b).alias(f"a{i}{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i] + [F.sum(x * F.col(y)).alias(f"b{i}") for i, x in enumerate(xs)]
    m = obs.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums).filter(F.col("n") >= least)

    def solve(batches):
        for p in batches:
            a = np.zeros((len(p), 5, 5))
            for i in range(5):
                for j in range(i, 5):
                    a[:, i, j] = a[:, j, i] = p[f"a{i}{j}"]
            b = np.stack([p[f"b{i}"] for i in range(5)], 1)
            c = (np.linalg.pinv(a, rcond=5 * np.finfo(float).eps) @ b[..., None])[..., 0]  # least norm where days are too few
            rss = np.maximum(p["yy"] - (c * b).sum(1), 0)
            tss = p["yy"] - b[:, 0] ** 2 / p["n"]
            ddof = np.minimum(5, p["n"] - 1)
            yield pd.DataFrame({by: p[by], "coeffs": list(c), "n": p["n"], "r2": np.where(tss > 1e-12, 1 - rss / tss.where(tss > 1e-12, 1), 0.0), "residual_std": np.sqrt(rss / np.maximum(p["n"] - ddof, 1))})

    return m.mapInPandas(solve, f"{by} {dict(obs.dtypes)[by]}, coeffs array<double>, n long, r2 double, residual_std double")


@query()
def j1_j2_harmonic_models(spark, d):
    """Fit per point, then z-scores of each observation; tested against numpy."""
    h = history(spark, d).withColumn("doy", F.dayofyear("date"))
    model = harmonic_fit(h, "point_id", "doy", "trees")
    x = h.join(model, "point_id")
    z = F.when(F.col("residual_std") > 1e-6, (F.col("trees") - S.harmonic(F.col("coeffs"), F.col("doy"))) / F.col("residual_std")).otherwise(0.0)
    return x.select("point_id", "id", r6(z, "z"), (z <= -2).alias("anomaly"), r6(F.col("r2"), "r2"))
