"""Queries around fires: weather index, links to scars, confidence ladders, bulletins, rolling states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.messages import alert_message, alert_severity
from ..operators import fire, reports
from .registry import query, r6, read


def weather(spark, d):
    """A daily series per station, from ``orders``: one row a priority and day."""
    o = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("station"), F.to_date("o_orderdate").alias("date")).agg(F.min("o_orderkey").alias("k"))
    k = F.col("k")
    return o.select("station", "date", (k % 350 / 10 - 2).alias("temp_c"), (k % 107).cast("double").alias("rh_pct"), (k % 40).cast("double").alias("wind_kmh"), F.when(k % 4 == 0, k % 90 / 10).otherwise(0.0).alias("precip_mm"))


#: The recurrence as SQL: one step a row number, the codes before it joined with the day's weather.
INDEX_SQL = """WITH RECURSIVE o AS (SELECT o_orderpriority AS station, o_orderdate::DATE AS date, min(o_orderkey) AS k FROM orders GROUP BY ALL),
w AS (SELECT station, date, row_number() OVER (PARTITION BY station ORDER BY date) AS i, year(date) <> coalesce(year(lag(date) OVER (PARTITION BY station ORDER BY date)), year(date)) AS fresh,
 (k % 350) / 10::DOUBLE - 2 AS t, (k % 107)::DOUBLE AS humid, least(100, k % 107)::DOUBLE AS h, (k % 40)::DOUBLE AS v, CASE WHEN k % 4 = 0 THEN (k % 90) / 10::DOUBLE ELSE 0::DOUBLE END AS p,
 ([6.4, 7.5, 9.0, 10.4, 11.4, 11.4, 11.4, 10.2, 9.0, 7.7, 6.8, 6.2]::DOUBLE[])[month(date)] AS day_length, ([-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]::DOUBLE[])[month(date)] AS factor FROM o),
codes AS (
 SELECT station, 0::BIGINT AS i, 85::DOUBLE AS ffmc, 6::DOUBLE AS dmc, 15::DOUBLE AS dc FROM (SELECT DISTINCT station FROM w)
 UNION ALL
 SELECT station, i, 59.5::DOUBLE * (250 - m3) / (147.2::DOUBLE + m3), b2 + CASE WHEN t > -1.1 THEN 1.894::DOUBLE * (t + 1.1::DOUBLE) * (100 - h) * day_length * 1e-4 ELSE 0 END,
  greatest(0, c2 + CASE WHEN t >= -2.8 THEN 0.36::DOUBLE * (t + 2.8::DOUBLE) + factor ELSE 0 END / 2)
 FROM (SELECT *, greatest(0, least(250, CASE
   WHEN m2 > dry THEN dry + (m2 - dry) * pow(10, -(0.424::DOUBLE * (1 - pow(h / 100, 1.7)) + 0.0694::DOUBLE * sqrt(v) * (1 - pow(h / 100, 8))) * speed)
   WHEN m2 < wet THEN wet - (wet - m2) * pow(10, -(0.424::DOUBLE * (1 - pow((100 - h) / 100, 1.7)) + 0.0694::DOUBLE * sqrt(v) * (1 - pow((100 - h) / 100, 8))) * speed) ELSE m2 END)) AS m3
  FROM (SELECT *, CASE WHEN p > 0.5 THEN least(250, m + 42.5::DOUBLE * (p - 0.5::DOUBLE) * exp(-100 / (251 - m)) * (1 - exp(-6.93::DOUBLE / (p - 0.5::DOUBLE))) + CASE WHEN m > 150 THEN 0.0015::DOUBLE * (m - 150) * (m - 150) * sqrt(p - 0.5::DOUBLE) ELSE 0 END) ELSE m END AS m2,
    0.942::DOUBLE * pow(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18::DOUBLE * (21.1::DOUBLE - t) * (1 - exp(-0.115::DOUBLE * h)) AS dry,
    0.618::DOUBLE * pow(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18::DOUBLE * (21.1::DOUBLE - t) * (1 - exp(-0.115::DOUBLE * h)) AS wet, 0.581::DOUBLE * exp(0.0365::DOUBLE * t) AS speed,
    CASE WHEN p > 1.5 THEN greatest(0, 244.72::DOUBLE - 43.43::DOUBLE * ln(20 + exp(5.6348::DOUBLE - b / 43.43::DOUBLE) + 1000 * (0.92::DOUBLE * p - 1.27::DOUBLE) / (48.77::DOUBLE + (0.92::DOUBLE * p - 1.27::DOUBLE) * (
     CASE WHEN b <= 33 THEN 100 / (0.5::DOUBLE + 0.3::DOUBLE * b) WHEN b <= 65 THEN 14 - 1.3::DOUBLE * ln(b) ELSE 6.2::DOUBLE * ln(b) - 17.2::DOUBLE END)) - 20)) ELSE b END AS b2,
    CASE WHEN p > 2.8 THEN greatest(0, 400 * ln(800 / (800 * exp(-c / 400) + 3.937::DOUBLE * (0.83::DOUBLE * p - 1.27::DOUBLE)))) ELSE c END AS c2
   FROM (SELECT *, 147.2::DOUBLE * (101 - a) / (59.5::DOUBLE + a) AS m FROM (SELECT w.*, CASE WHEN fresh THEN round(ffmc, 1) ELSE ffmc END AS a, CASE WHEN fresh THEN round(dmc, 1) ELSE dmc END AS b, CASE WHEN fresh THEN round(dc, 1) ELSE dc END AS c
    FROM codes JOIN w ON w.station = codes.station AND w.i = codes.i + 1))))),
steps AS (SELECT w.station, w.date, t, humid, v, p, ffmc, dmc, dc, 147.2::DOUBLE * (101 - ffmc) / (59.5::DOUBLE + ffmc) AS m, dmc + 0.4::DOUBLE * dc AS base FROM codes JOIN w USING (station, i)),
spread AS (SELECT *, 0.208::DOUBLE * exp(0.05039::DOUBLE * v) * 91.9::DOUBLE * exp(-0.1386::DOUBLE * m) * (1 + pow(m, 5.31) / 4.93e7) AS isi,
 greatest(0, CASE WHEN base <= 0 THEN 0 WHEN dmc <= 0.4::DOUBLE * dc THEN 0.8::DOUBLE * dmc * dc / base ELSE dmc - (1 - 0.8::DOUBLE * dc / base) * (0.92::DOUBLE + pow(0.0114::DOUBLE * dmc, 1.7)) END) AS bui FROM steps),
rated AS (SELECT *, 0.1::DOUBLE * isi * CASE WHEN bui <= 80 THEN 0.626::DOUBLE * pow(bui, 0.809) + 2 ELSE 1000 / (25 + 108.64::DOUBLE * exp(-0.023::DOUBLE * bui)) END AS b FROM spread),
exact AS (SELECT *, CASE WHEN b > 1 THEN exp(2.72::DOUBLE * pow(0.434::DOUBLE * ln(b), 0.647)) ELSE b END AS f FROM rated),
idx AS (SELECT station, date, t, humid, v, p, f, round(ffmc, 3) AS ffmc, round(dmc, 3) AS dmc, round(dc, 3) AS dc, round(isi, 3) AS isi, round(bui, 3) AS bui, round(f, 3) AS fwi, CASE WHEN f < 5 THEN 'Low' WHEN f < 11.2 THEN 'Moderate' WHEN f < 21.3 THEN 'High' WHEN f < 38 THEN 'Very High' ELSE 'Extreme' END AS danger_class FROM exact)"""
INDEX_COLUMNS = "station, date, ffmc, dmc, dc, isi, bui, fwi, danger_class"


@query(INDEX_SQL + f" SELECT {INDEX_COLUMNS} FROM idx")
def j10_fire_weather(spark, d):
    """The daily recurrence per station; also tested against published worked values and a loop."""
    x = fire.fire_weather(weather(spark, d))
    return x.select("station", "date", *(F.round(c, 3).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")), "danger_class")


@query(INDEX_SQL + """ SELECT station, year(date) AS year, (array_agg(date ORDER BY fwi DESC, date DESC))[1] AS peak_day, max(fwi) AS peak, count(*) AS days, round(avg((f >= 21.3)::INT), 6) AS danger_share,
 count(*) FILTER (danger_class = 'Extreme') AS n_extreme, round(100 * avg((danger_class = 'Low')::INT), 6) AS low_pct FROM idx GROUP BY station, year(date)""")
def d37_f4_danger_days(spark, d):
    """A year's peak with its day, and how its days share out over the danger classes."""
    x = fire.fire_weather(weather(spark, d))
    order = F.struct(F.round("fwi", 3), "date")
    return x.groupBy("station", F.year("date").cast("long").alias("year")).agg(
        F.max_by("date", order).alias("peak_day"), F.max(F.round("fwi", 3)).alias("peak"), F.count("*").alias("days"), r6(F.avg((F.col("fwi") >= 21.3).cast("int")), "danger_share"),
        F.count_if(F.col("danger_class") == "Extreme").alias("n_extreme"), r6(100 * F.avg((F.col("danger_class") == "Low").cast("int")), "low_pct"),
    )


@query(INDEX_SQL + " SELECT station, date, fwi, danger_class FROM idx ORDER BY fwi DESC, date DESC, station LIMIT 20")
def f4_top_index_days(spark, d):
    """The report of the 20 days with the highest index, of all stations; of equal ones the latest."""
    x = fire.fire_weather(weather(spark, d)).select("station", "date", F.round("fwi", 3).alias("fwi"), "danger_class")
    return x.orderBy(F.desc("fwi"), F.desc("date"), "station").limit(20)


@query(INDEX_SQL + """ SELECT station, month(date) AS month, count(*) AS days, round(avg(t), 6) AS temp_c, round(avg(humid), 6) AS rh_pct, round(avg(v), 6) AS wind_kmh, round(sum(p) / count(DISTINCT year(date)), 6) AS precip_mm, round(avg(f), 5) AS fwi FROM idx GROUP BY station, month(date)""")
def d37_monthly_weather(spark, d):
    """A station's climatology: means by month, rain as the mean monthly sum."""
    x = fire.fire_weather(weather(spark, d))
    return x.groupBy("station", F.month("date").cast("long").alias("month")).agg(
        F.count("*").alias("days"), *(r6(F.avg(c), c) for c in ("temp_c", "rh_pct", "wind_kmh")), r6(F.sum("precip_mm") / F.countDistinct(F.year("date")), "precip_mm"), F.round(F.avg("fwi"), 5).alias("fwi"))


@query(INDEX_SQL + " SELECT station, date, fwi, danger_class, row_number() OVER (PARTITION BY station ORDER BY fwi DESC, date) AS place FROM idx QUALIFY place <= 20")
def f4_worst_days(spark, d):
    """The twenty days of the highest index a station; equal days by date."""
    x = fire.fire_weather(weather(spark, d)).select("station", "date", F.round("fwi", 3).alias("fwi"), "danger_class")
    place = F.row_number().over(Window.partitionBy("station").orderBy(F.desc("fwi"), "date")).cast("long")
    return x.withColumn("place", place).filter("place <= 20")


@query("WITH w AS (SELECT min(o_orderkey) AS k, o_orderpriority AS station, o_orderdate::DATE AS date FROM orders GROUP BY 2, 3) SELECT station, date, round(greatest(0, least(100, 100 - (k % 107) / 2 + ((k % 350) / 10 - 2 - 20) / 5 - 2 * CASE WHEN k % 4 = 0 THEN (k % 90) / 10 ELSE 0 END)), 6) AS proxy FROM w")
def h33_weather_proxy(spark, d):
    w = weather(spark, d)
    return w.select("station", "date", r6(S.fire_weather_proxy(F.col("temp_c"), F.col("rh_pct"), F.col("precip_mm")), "proxy"))


LINKS_SQL = """s AS (SELECT DISTINCT l_suppkey AS tile, l_shipdate::DATE AS scene FROM lineitem), f AS (SELECT o_orderkey AS fire_id, o_custkey % 1000 AS tile, o_orderdate::DATE AS day, o_totalprice / 1000 AS frp, o_orderkey % 900 AS dist FROM orders),
c AS (SELECT s.tile, scene, fire_id, day, frp, dist, scene - day AS gap, dist < 150 AS hit FROM s JOIN f ON s.tile = f.tile AND f.day BETWEEN scene - 60 AND scene)"""


def _links(spark, d, leading=lambda fires: fires):
    """Scenes with the fires of their tile in the 60 days before; ``leading`` may leave out fires that none of them needs."""
    from ..operators.spatial import range_hits

    s = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), F.to_date("l_shipdate").alias("scene")).distinct()
    f = read(spark, d, "orders").select(F.col("o_orderkey").alias("fire_id"), (F.col("o_custkey") % 1000).alias("tile"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("frp"), (F.col("o_orderkey") % 900).alias("dist"))
    c = range_hits(s, leading(f.withColumn("hit", F.col("dist") < 150)), ["tile"], "scene", "day", 60, 0)
    return c.withColumn("gap", F.datediff("scene", "day"))


@query(f"""WITH {LINKS_SQL}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY tile, scene ORDER BY hit DESC, CASE WHEN hit THEN day END ASC NULLS LAST, CASE WHEN hit THEN frp END DESC NULLS LAST, dist, day, fire_id) = 1),
k AS (SELECT *, CASE WHEN hit AND gap <= 10 THEN 'HIGH' WHEN hit AND gap <= 30 THEN 'MEDIUM-HIGH' WHEN hit AND gap <= 60 THEN 'MEDIUM' WHEN dist < 500 AND gap <= 10 THEN 'MEDIUM' WHEN dist < 500 AND gap <= 30 THEN 'LOW-MEDIUM' WHEN gap <= 60 THEN 'LOW' ELSE 'NONE' END AS confidence FROM b)
SELECT tile, scene, fire_id, gap::BIGINT AS days_gap, hit AS spatial_hit, confidence, CASE WHEN confidence = 'HIGH' AND hit THEN 'GOLD' WHEN confidence = 'MEDIUM-HIGH' AND hit THEN 'SILVER' WHEN confidence = 'MEDIUM' THEN 'BRONZE' WHEN confidence IN ('LOW-MEDIUM', 'LOW') THEN 'VIIRS_ONLY' ELSE 'EXCLUDE' END AS tier FROM k""")
def k15_f6_h22_h23_fire_links(spark, d):
    best = lambda x, by: fire.best_causal_fire(x, by, "hit", "day", "frp", "dist")
    # fires of one tile and day stand in one order for all its scenes, so only the first hit and the first other one can win
    b = best(_links(spark, d, lambda f: best(f, ["tile", "day", "hit"])), ["tile", "scene"])
    c = b.withColumn("confidence", S.link_confidence(F.col("hit"), F.col("dist") < 500, F.col("gap")))
    return c.select("tile", "scene", "fire_id", F.col("gap").cast("long").alias("days_gap"), F.col("hit").alias("spatial_hit"), "confidence", S.tier(F.col("confidence"), F.col("hit")).alias("tier"))


@query(f"WITH {LINKS_SQL}, n AS (SELECT tile, scene, count(*) AS n_fires, count(*) FILTER (hit) AS n_hits, min(gap)::BIGINT AS nearest_gap FROM c GROUP BY ALL) SELECT tile, count(*) AS scenes, sum(n_fires)::BIGINT AS fires, sum(n_hits)::BIGINT AS hits, min(nearest_gap) AS nearest_gap FROM n GROUP BY tile")
def d48_link_summary(spark, d):
    n = _links(spark, d).groupBy("tile", "scene").agg(F.count("*").alias("n_fires"), F.count(F.when(F.col("hit"), 1)).alias("n_hits"), F.min("gap").cast("long").alias("nearest_gap"))
    return n.groupBy("tile").agg(F.count("*").alias("scenes"), F.sum("n_fires").alias("fires"), F.sum("n_hits").alias("hits"), F.min("nearest_gap").alias("nearest_gap"))


@query("""WITH e AS (SELECT event_id, ts::DATE AS day, value AS frp, (event_id % 60)::DOUBLE AS fwi, event_id % 3 = 0 AS forest FROM events), s AS (SELECT *, CASE WHEN fwi >= 38 AND frp >= 5 THEN CASE WHEN forest THEN 'CRITICAL' ELSE 'HIGH' END WHEN fwi >= 21.3 OR frp >= 20 THEN 'HIGH' WHEN fwi >= 11.2 OR frp >= 5 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM e)
SELECT day, count(*) AS n_fires, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (forest) AS n_forest, round(max(frp), 2) AS peak_frp, CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'HIGH') > 0 THEN 'HIGH' ELSE 'MODERATE' END AS level FROM s GROUP BY day""")
def k11_k18_d38_bulletins(spark, d):
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("value").alias("frp"), (F.col("event_id") % 60).cast("double").alias("fwi"), (F.col("event_id") % 3 == 0).alias("forest"))
    severity = S.combined_severity(F.col("fwi"), F.col("frp"))
    e = e.withColumn("severity", F.when((severity == "CRITICAL") & ~F.col("forest"), "HIGH").otherwise(severity))
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return e.groupBy("day").agg(F.count("*").alias("n_fires"), n("CRITICAL").alias("n_critical"), F.count(F.when(F.col("forest"), 1)).alias("n_forest"), F.round(F.max("frp"), 2).alias("peak_frp"), F.when(n("CRITICAL") > 0, "CRITICAL").when(n("HIGH") > 0, "HIGH").otherwise("MODERATE").alias("level"))


@query("SELECT event_id, CASE WHEN value >= 100 THEN 3 WHEN value >= 40 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS rank, 'fire ' || event_id || ' at ' || floor(value)::BIGINT || ' MW' AS message FROM events ORDER BY 2 DESC, value DESC, event_id LIMIT 50")
def f5_h36_ranked_messages(spark, d):
    v = F.col("value")
    rank = F.when(v >= 100, 3).when(v >= 40, 2).when(v >= 10, 1).otherwise(0)
    return read(spark, d, "events").select("event_id", rank.alias("rank"), F.concat(F.lit("fire "), F.col("event_id").cast("string"), F.lit(" at "), F.floor(v).cast("string"), F.lit(" MW")).alias("message"), v).orderBy(F.desc("rank"), v.desc(), "event_id").limit(50).drop("value")


_COVERS = ("'water'", "'crops'", "'unknown'", "NULL", "'bare'")
_AT_SQL = "' at ' || printf('%.3f', floor(lat * 1000 + 0.5) / 1000) || 'N ' || printf('%.3f', floor(lon * 1000 + 0.5) / 1000) || 'E — FRP=' || printf('%.1f', floor(frp * 10 + 0.5) / 10) || ' MW'"
_WEATHER_SQL = "', FWI=' || printf('%.1f', floor(fwi * 10 + 0.5) / 10) || ' (' || danger || '). '"


@query(f"""WITH e AS (SELECT event_id, value / 10 AS frp, event_id * 7 % 600 / 10e0 AS fwi, 24 + event_id * 13 % 9973 / 9973e0 AS lat, 77 + event_id * 17 % 9967 / 9967e0 AS lon, CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'daytime' ELSE 'nighttime' END AS time,
 CASE WHEN event_id % 11 <> 0 THEN event_id % 3 = 0 END AS forest, CASE WHEN event_id % 13 <> 0 THEN event_id % 5 = 0 END AS near, event_id % 7 = 0 AS agri, CASE event_id % 5 {" ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_COVERS))} END AS cover FROM events),
k AS (SELECT *, CASE WHEN frp >= 50 THEN 'INFERNO' WHEN frp >= 20 THEN 'INTENSE' WHEN frp >= 5 THEN 'ACTIVE' WHEN frp >= 1 THEN 'MINOR' ELSE 'TRACE' END AS kind, CASE WHEN fwi < 5 THEN 'Low' WHEN fwi < 11.2 THEN 'Moderate' WHEN fwi < 21.3 THEN 'High' WHEN fwi < 38 THEN 'Very High' ELSE 'Extreme' END AS danger,
 CASE WHEN fwi >= 38 AND frp >= 5 AND NOT coalesce(NOT forest AND NOT near, false) THEN 'CRITICAL' WHEN fwi >= 21.3 OR frp >= 20 THEN 'HIGH' WHEN fwi >= 11.2 OR frp >= 5 THEN 'MODERATE' ELSE 'LOW' END AS severity,
 CASE WHEN forest THEN '[FOREST FIRE]' WHEN near THEN '[NEAR FOREST]' WHEN agri THEN '[AGRICULTURAL]' WHEN coalesce(cover, 'unknown') <> 'unknown' THEN '[' || upper(cover) || ']' ELSE '' END AS tag FROM e)
SELECT event_id, severity, severity || ' ' || tag || ': ' || CASE WHEN severity = 'CRITICAL' OR severity = 'HIGH' AND (coalesce(forest, false) OR coalesce(near, false)) THEN kind || ' ' ELSE '' END || time || CASE WHEN severity = 'CRITICAL' THEN ' FOREST fire' ELSE ' fire' END || {_AT_SQL}
 || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN {_WEATHER_SQL} ELSE ' (' || coalesce(cover, 'unknown') || '). ' END || CASE WHEN severity = 'CRITICAL' THEN 'Immediate ground response required.' WHEN severity = 'MODERATE' THEN 'Monitor closely.' WHEN severity = 'LOW' THEN 'Routine monitoring.'
 WHEN coalesce(forest, false) OR coalesce(near, false) THEN 'Deploy rapid response team.' ELSE 'Non-forest — monitor for spread to nearby vegetation.' END AS message FROM k""")
def h36_alert_messages(spark, d):
    """The alert of every detection, in words, with its severity after what burns is known."""
    i = F.col("event_id")
    cover = F.element_at(F.array(*(F.expr(c).cast("string") for c in _COVERS)), (i % 5).cast("int") + 1)
    e = read(spark, d, "events").select(
        "event_id", (F.col("value") / 10).alias("frp"), (i * 7 % 600 / 10).alias("fwi"), (24 + i * 13 % 9973 / 9973).alias("lat"), (77 + i * 17 % 9967 / 9967).alias("lon"), F.when(F.hour("ts").between(6, 17), "D").otherwise("N").alias("daynight"),
        F.when(i % 11 != 0, i % 3 == 0).alias("forest"), F.when(i % 13 != 0, i % 5 == 0).alias("near"), (i % 7 == 0).alias("agri"), cover.alias("cover"),
    )
    c = F.col
    e = e.withColumn("severity", alert_severity(S.combined_severity(c("fwi"), c("frp")), c("forest"), c("near")))
    return e.select("event_id", "severity", alert_message(c("severity"), S.frp_category(c("frp")), c("daynight"), c("lat"), c("lon"), c("frp"), c("fwi"), S.fwi_class(c("fwi")), c("forest"), c("near"), c("agri"), c("cover")).alias("message"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_frp, round(max(value), 2) AS max_frp, round(sum(value), 2) AS total_frp, count(*) FILTER (hour(ts) BETWEEN 6 AND 17) AS n_day, count(*) FILTER (hour(ts) NOT BETWEEN 6 AND 17) AS n_night, round(100.0 * count(*) FILTER (event_type IN ('error', 'click')) / count(*), 4) AS pct_high FROM events WHERE value BETWEEN 1 AND 200")
def d1_b3_b4_detection_summary(spark, d):
    e = read(spark, d, "events").filter(F.col("value").between(1, 200))
    day = F.hour("ts").between(6, 17)
    return e.agg(F.count("*").alias("n"), r6(F.avg("value"), "mean_frp"), F.round(F.max("value"), 2).alias("max_frp"), F.round(F.sum("value"), 2).alias("total_frp"), F.count(F.when(day, 1)).alias("n_day"), F.count(F.when(~day, 1)).alias("n_night"), F.round(100 * F.count(F.when(F.lower(F.trim("event_type")).isin("error", "click"), 1)) / F.count("*"), 4).alias("pct_high"))


@query("WITH w AS (SELECT vec_id, label, ((vec_id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM embeddings), t AS (SELECT unnest(range(1, 10)) / 10.0::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (score >= threshold AND label = 0) AS tp, count(*) FILTER (score >= threshold AND label <> 0) AS fp, count(*) FILTER (score < threshold AND label = 0) AS fn, round(2 * count(*) FILTER (score >= threshold AND label = 0) / (2 * count(*) FILTER (score >= threshold AND label = 0) + count(*) FILTER (score >= threshold AND label <> 0) + count(*) FILTER (score < threshold AND label = 0)), 6) AS f1 FROM w, t GROUP BY threshold")
def j13_d32_threshold_sweep(spark, d):
    w = read(spark, d, "embeddings").select("label", (F.col("vec_id") * 7919 % 1000 / 1000).alias("score"))
    return reports.threshold_sweep(w, "score", F.col("label") == 0, [i / 10 for i in range(1, 10)])


@query("WITH w AS (SELECT label, ((vec_id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM embeddings), c AS (SELECT score, count(*) AS n, count(*) FILTER (label = 0) AS pos FROM w GROUP BY score), r AS (SELECT pos, sum(pos) OVER o AS tp, sum(n) OVER o AS k FROM c WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(pos * tp / k) / sum(pos), 6) AS average_precision, max(k)::BIGINT AS rows FROM r")
def l11_average_precision(spark, d):
    w = read(spark, d, "embeddings").select((F.col("label") == 0).cast("int").alias("y"), (F.col("vec_id") * 7919 % 1000 / 1000).alias("score"))
    return reports.average_precision(w, "score", "y")


@query("WITH b AS (SELECT l_orderkey // 64 AS block, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS pos FROM lineitem GROUP BY ALL), s AS (SELECT *, CASE WHEN (block * 2654435761) % 100 < 15 THEN 'test' WHEN (block * 2654435761) % 100 < 30 THEN 'val' ELSE 'train' END AS split FROM b) SELECT split, count(*) AS blocks, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, round(sum(n) / (2.0 * sum(pos)), 6) AS weight_pos FROM s GROUP BY split")
def l4_l6_l20_block_split(spark, d):
    b = read(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 64).alias("block")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("pos"))
    h = F.col("block") * 2654435761 % 100
    s = b.withColumn("split", F.when(h < 15, "test").when(h < 30, "val").otherwise("train"))
    return s.groupBy("split").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum("pos").alias("pos"), r6(F.sum("n") / (2.0 * F.sum("pos")), "weight_pos"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY (l_orderkey * 48271 + l_partkey) % 100003, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS n FROM lineitem), p AS (SELECT count(*) AS pos FROM lineitem WHERE l_returnflag = 'R') SELECT l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM r, p WHERE l_returnflag = 'R' OR r.n <= p.pos // 4 GROUP BY l_returnflag")
def l5_undersampling(spark, d):
    li = read(spark, d, "lineitem").withColumn("h", (F.col("l_orderkey") * 48271 + F.col("l_partkey")) % 100003)
    pos = li.filter("l_returnflag = 'R'").agg(F.count("*").alias("pos"))
    r = reports.numbered(li, "l_returnflag", "h", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    r = r.crossJoin(F.broadcast(pos)).filter((F.col("l_returnflag") == "R") | (F.col("nth") <= F.floor(F.col("pos") / 4)))
    return r.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("WITH x AS (SELECT doc_id, quality, toxic FROM labels), p AS (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS a, (doc_id * 7 % 100) / 100.0::DOUBLE AS b, (doc_id * 13 % 100) / 100.0::DOUBLE AS c, quality FROM x) SELECT doc_id, round((0.5 * a + 0.3 * b + 0.2 * c), 6) AS weighted, (a >= 0.5)::INT + (b >= 0.5)::INT + (c >= 0.5)::INT >= 2 AS majority, quality FROM p")
def l14_ensemble(spark, d):
    k = F.col("doc_id")
    a, b, c = k % 100 / 100, k * 7 % 100 / 100, k * 13 % 100 / 100
    vote = sum(((x >= 0.5).cast("int") for x in (b, c)), (a >= 0.5).cast("int"))
    return read(spark, d, "labels").select("doc_id", r6(0.5 * a + 0.3 * b + 0.2 * c, "weighted"), (vote >= 2).alias("majority"), "quality")


@query("WITH u AS (SELECT conv_id AS alert_id, role AS label, turn FROM conversations) SELECT alert_id, label, turn FROM u WHERE label IN ('user', 'assistant') AND alert_id IN (SELECT o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY turn DESC, label) = 1")
def l17_c21_label_upsert(spark, d):
    u = read(spark, d, "conversations").select(F.col("conv_id").alias("alert_id"), F.col("role").alias("label"), "turn").filter(F.col("label").isin("user", "assistant"))
    known = u.join(read(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id")), "alert_id", "left_semi")
    return reports.top_per_group(known, "alert_id", 1, F.desc("turn"), "label").drop("rank")


@query("WITH a AS (SELECT user_id AS pixel, event_type, first_value(event_type) OVER w AS best, row_number() OVER w AS r FROM events WHERE value >= 50 WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) SELECT pixel, event_type AS type, CASE WHEN r = 1 THEN 'TP' WHEN event_type = best THEN 'FP' ELSE 'FP_contra' END AS label, count(*) AS n FROM a GROUP BY ALL")
def l2_event_labels(spark, d):
    """Only a pixel's strongest window is right; others of its kind are wrong in time, those of another kind contradict it."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    a = read(spark, d, "events").filter("value >= 50").withColumn("r", F.row_number().over(w)).withColumn("best", F.first("event_type").over(w))
    label = F.when(F.col("r") == 1, "TP").when(F.col("event_type") == F.col("best"), "FP").otherwise("FP_contra")
    return a.groupBy(F.col("user_id").alias("pixel"), F.col("event_type").alias("type"), label.alias("label")).agg(F.count("*").alias("n"))


@query()
def j16_embedding_pca(spark, d):
    """Embeddings on their first eight principal axes; tested against numpy."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = read(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    model = PCA(k=8, inputCol="v", outputCol="p").fit(x)
    return model.transform(x).select("vec_id", vector_to_array("p").alias("axes"))


@query()
def l8_l13_boosted_filter(spark, d):
    """Boosted trees on pixel features with weights and a hash-split, scored over all rows; tested on a planted rule."""
    from ..operators.learning import boosted_filter

    e = read(spark, d, "events").select("event_id", "value", (F.col("event_id") % 10).cast("double").alias("cloud"), F.hour("ts").cast("double").alias("hour"), (F.col("event_type") == "error").cast("double").alias("y"))
    return boosted_filter(e, "event_id", ["value", "cloud", "hour"], "y")
