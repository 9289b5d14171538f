"""Queries over the alerts table and its like: filters, summaries, rankings, set operations, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reports as R
from ..operators.quantiles import exact_quantiles
from .registry import ALERTS, GRID, RASTER, WINDOWS, alerts, grid, half_up, query, r6, raster, read, windows


@query(f"WITH {ALERTS} SELECT id, round(coalesce(stacked_score, confidence), 6) AS score, area_ha FROM alerts WHERE change_type = '1-URGENT' AND coalesce(stacked_score, confidence) >= 0.3 AND area_ha >= 1 AND detection_date BETWEEN '1996-01-01' AND '1999-12-31' AND coalesce(sar_boost_applied, false) = false AND cusum_zone_score >= 0.2 AND centroid_lon BETWEEN -100 AND 100 AND centroid_lat BETWEEN -60 AND 60")
def b1_alert_filter(spark, d):
    cond = R.alert_filter("1-URGENT", min_score=0.3, min_area=1, since="1996-01-01", until="1999-12-31", sar=False, min_cusum=0.2, bbox="-100,-60,100,60")
    return alerts(spark, d).filter(cond).select("id", r6(F.coalesce("stacked_score", "confidence"), "score"), "area_ha")


@query(f"WITH {ALERTS} SELECT beat_name, count(*) AS n_alerts, round(sum(area_ha), 4) AS total_area_ha, round(avg(coalesce(stacked_score, confidence)), 6) AS avg_score, round(avg(coalesce(sar_boost_applied, false)::INT), 6) AS boost_rate, round(avg(cusum_zone_score), 6) AS avg_cusum, max(detection_date) AS last_date FROM alerts GROUP BY beat_name")
def d2_beat_summary(spark, d):
    return R.beat_summary(alerts(spark, d))


@query(f"WITH {ALERTS} SELECT id, beat_name, round(coalesce(stacked_score, confidence), 6) AS score FROM alerts ORDER BY coalesce(stacked_score, confidence) DESC NULLS LAST, id LIMIT 100 OFFSET 50")
def f1_alert_page(spark, d):
    return R.page(alerts(spark, d), 100, 50).select("id", "beat_name", r6(F.coalesce("stacked_score", "confidence"), "score"))


@query(f"WITH {ALERTS} SELECT change_type, model_version, count(*) AS n, count(*) FILTER (sar_boost_applied) AS n_sar, count(*) FILTER (sar_boost_applied IS NULL) AS n_unknown, grouping(change_type)::INT AS g FROM alerts GROUP BY GROUPING SETS ((change_type), (model_version), ())")
def d3_d4_stats(spark, d):
    sets = [[F.col("change_type")], [F.col("model_version")], []]
    counts = [F.count("*").alias("n"), F.count_if("sar_boost_applied").alias("n_sar"), F.count_if(F.col("sar_boost_applied").isNull()).alias("n_unknown"), F.grouping("change_type").cast("int").alias("g")]
    return alerts(spark, d).groupingSets(sets, F.col("change_type"), F.col("model_version")).agg(*counts)


@query(f"WITH {ALERTS} SELECT count(*) AS total, count(DISTINCT beat_name) AS n_beats, count(*) FILTER (confidence >= 0.7) AS n_high, count(*) FILTER (confidence >= 0.45 AND confidence < 0.7) AS n_medium, round(sum(area_ha), 4) AS area, min(detection_date) AS first_day, max(detection_date) AS last_day FROM alerts")
def d5_run_summary(spark, d):
    c = F.col("confidence")
    return alerts(spark, d).agg(F.count("*").alias("total"), F.countDistinct("beat_name").alias("n_beats"), F.count(F.when(c >= 0.7, 1)).alias("n_high"), F.count(F.when((c >= 0.45) & (c < 0.7), 1)).alias("n_medium"), F.round(F.sum("area_ha"), 4).alias("area"), F.min("detection_date").alias("first_day"), F.max("detection_date").alias("last_day"))


@query(f"WITH {ALERTS}, l AS (SELECT beat_name, CASE WHEN confidence >= 0.70 THEN 'HIGH' WHEN confidence >= 0.45 THEN 'MEDIUM' WHEN confidence >= 0.25 THEN 'LOW' ELSE 'NO ALERT' END AS label FROM alerts) SELECT beat_name, count(*) FILTER (label = 'HIGH') AS high, count(*) FILTER (label = 'LOW') AS low, count(*) FILTER (label = 'MEDIUM') AS medium, count(*) FILTER (label = 'NO ALERT') AS none FROM l GROUP BY beat_name")
def d7_d9_label_pivot(spark, d):
    x = alerts(spark, d).select("beat_name", S.score_label(F.col("confidence")).alias("label")).groupBy("beat_name").pivot("label", ["HIGH", "LOW", "MEDIUM", "NO ALERT"]).count().na.fill(0)
    return x.toDF("beat_name", "high", "low", "medium", "none")


@query(f"WITH {WINDOWS}, x AS (SELECT pixel % 5 AS t, event_id % 5 AS p, count(*) AS n FROM win GROUP BY ALL), s AS (SELECT t, sum(n) AS support, sum(n) FILTER (t = p) AS tp FROM x GROUP BY t), q AS (SELECT p, sum(n) AS said FROM x GROUP BY p), m AS (SELECT t AS class, support, said, coalesce(tp, 0) AS tp FROM s JOIN q ON t = p) SELECT class, support::BIGINT AS support, round(tp / (said + 1e-8), 6) AS precision, round(tp / (support + 1e-8), 6) AS recall, round(2 * (tp / (said + 1e-8)) * (tp / (support + 1e-8)) / (tp / (said + 1e-8) + tp / (support + 1e-8) + 1e-8), 6) AS f1, round(tp / (support + said - tp + 1e-8), 6) AS iou FROM m")
def d11_l12_class_metrics(spark, d):
    return R.confusion_metrics(windows(spark, d).select((F.col("pixel") % 5).alias("t"), (F.col("event_id") % 5).alias("p")), "t", "p")


@query(f"WITH {WINDOWS} SELECT count(*) AS n, round(avg(abs(delta - cloud)), 6) AS mae, round(sqrt(avg((delta - cloud) * (delta - cloud))), 6) AS rmse, round(1 - sum((delta - cloud) * (delta - cloud)) / (sum(cloud * cloud) - sum(cloud) * sum(cloud) / count(*)), 6) AS r2 FROM win")
def d12_regression_metrics(spark, d):
    e = F.col("delta") - F.col("cloud")
    tss = F.sum(F.col("cloud") * F.col("cloud")) - F.sum("cloud") * F.sum("cloud") / F.count("*")
    return windows(spark, d).agg(F.count("*").alias("n"), r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(1 - F.sum(e * e) / tss, "r2"))


def _h(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


#: Changes in whole ten-thousandths and cloud in tenths, so that sums are exact.
BANDS_SQL = f"{WINDOWS}, b AS (SELECT pixel, CASE WHEN event_type <> 'view' THEN round(value * 100)::BIGINT - 5000 END AS v, event_id % 10 AS c FROM win)"


@query(f"""WITH {BANDS_SQL} SELECT pixel, {_h("sum(v)::DOUBLE / count(v) / 10000")} AS mean, {_h("sqrt((count(v) * sum(v * v) - sum(v) * sum(v))::DOUBLE) / count(v) / 10000")} AS std, min(v) / 10000 AS low, max(v) / 10000 AS high,
sum(v)::BIGINT / 10000 AS total, count(v) AS n, (max(v) - min(v)) / 10000 AS range, count(*) FILTER (v < 0) AS n_neg, {_h("sum(CASE WHEN v < 0 THEN v END)::DOUBLE / count(*) FILTER (v < 0) / 10000")} AS mean_neg, {_h("sum(c)::DOUBLE / count(*) / 10")} AS cloud,
count(*) FILTER (c < 3) AS n_clear, {_h("sum(v * (10 - c))::DOUBLE / sum(10 - c)::DOUBLE / 10000")} AS clear_mean FROM b GROUP BY pixel""")
def d16_d18_pixel_features(spark, d):
    b = windows(spark, d).select("pixel", (F.col("event_id") % 10).alias("c"), F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("long") - 5000).alias("v"))
    v, c, n, down = F.col("v"), F.col("c"), F.count("v"), F.col("v") < 0
    return b.groupBy("pixel").agg(
        half_up(F.sum(v) / n / 10000, "mean"), half_up(F.sqrt(n * F.sum(v * v) - F.sum(v) * F.sum(v)) / n / 10000, "std"), (F.min(v) / 10000).alias("low"), (F.max(v) / 10000).alias("high"), (F.sum(v) / 10000).alias("total"), n.alias("n"),
        ((F.max(v) - F.min(v)) / 10000).alias("range"), F.count(F.when(down, 1)).alias("n_neg"), half_up(F.sum(F.when(down, v)) / F.nullif(F.count(F.when(down, 1)), F.lit(0)) / 10000, "mean_neg"), half_up(F.sum(c) / F.count("*") / 10, "cloud"),
        F.count(F.when(c < 3, 1)).alias("n_clear"), half_up(F.sum(v * (10 - c)) / F.sum(10 - c) / 10000, "clear_mean"),
    )


@query(f"WITH {WINDOWS} SELECT pixel, round(avg(fired::INT), 6) AS frequency, count(DISTINCT event_type) AS diversity, round(regr_slope(delta, event_id / 1000.0), 5) AS trend, round(max(abs(delta)), 6) AS strongest FROM win GROUP BY pixel")
def d17_d19_d21_frequency_and_trend(spark, d):
    return windows(spark, d).groupBy("pixel").agg(r6(F.avg(F.col("fired").cast("int")), "frequency"), F.countDistinct("event_type").alias("diversity"), F.round(F.regr_slope("delta", F.col("event_id") / 1000), 5).alias("trend"), r6(F.max(F.abs("delta")), "strongest"))


@query(f"WITH {WINDOWS} SELECT event_type, CASE WHEN cloud < 0.1 THEN 'clear' WHEN cloud < 0.3 THEN 'light' WHEN cloud < 0.6 THEN 'broken' ELSE 'overcast' END AS cloud_bin, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS std, round(median(delta), 6) AS median, round(quantile_cont(delta, 0.1), 6) AS p10, round(quantile_cont(delta, 0.9), 6) AS p90 FROM win GROUP BY ALL")
def d15_d25_d27_profiles(spark, d):
    c = F.col("cloud")
    b = F.when(c < 0.1, "clear").when(c < 0.3, "light").when(c < 0.6, "broken").otherwise("overcast").alias("cloud_bin")
    w = windows(spark, d).withColumn("cloud_bin", b)
    q = exact_quantiles(w, "delta", {"median": 0.5, "p10": 0.1, "p90": 0.9}, ["event_type", "cloud_bin"]).drop("n")
    means = w.groupBy("event_type", "cloud_bin").agg(F.count("*").alias("n"), r6(F.avg("delta"), "mean"), r6(F.stddev_pop("delta"), "std"))
    return means.join(q, ["event_type", "cloud_bin"]).withColumns({c: F.round(c, 6) for c in ("median", "p10", "p90")})


@query(f"WITH {WINDOWS}, t AS (SELECT unnest([0.05, 0.15, 0.3]::DOUBLE[]) AS threshold) SELECT threshold, date, count(*) FILTER (delta <= -threshold) AS n_loss, count(*) FILTER (abs(delta) >= threshold) AS n_change FROM win, t GROUP BY ROLLUP (threshold, date)")
def d26_d32_d54_counts_by_threshold(spark, d):
    at = windows(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.05, 0.15, 0.3)))))
    t = F.col("threshold")
    return at.rollup("threshold", "date").agg(F.count(F.when(F.col("delta") <= -t, 1)).alias("n_loss"), F.count(F.when(F.abs("delta") >= t, 1)).alias("n_change"))


@query(f"WITH {ALERTS}, c AS (SELECT change_type, count(*) AS n, round(sum(area_ha), 4) AS area, round(avg(confidence), 6) AS confidence FROM alerts GROUP BY change_type) SELECT *, round(100 * area / sum(area) OVER (), 4) AS pct_area FROM c")
def d29_change_breakdown(spark, d):
    c = alerts(spark, d).groupBy("change_type").agg(F.count("*").alias("n"), F.round(F.sum("area_ha"), 4).alias("area"), r6(F.avg("confidence"), "confidence"))
    return c.withColumn("pct_area", F.round(100 * F.col("area") / F.sum("area").over(Window.partitionBy()), 4))


@query("WITH s AS (SELECT l_suppkey AS tile, l_shipdate::DATE AS day, list_sort(list_distinct(array_agg(l_linenumber))) AS bands, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY ALL) SELECT tile, year(day)::INT AS year, count(*) AS scenes, count(*) FILTER (len(bands) >= 3) AS complete, sum(bytes)::BIGINT AS bytes FROM s GROUP BY ALL")
def a11_d36_scene_completeness(spark, d):
    li = read(spark, d, "lineitem")
    s = li.groupBy(F.col("l_suppkey").alias("tile"), F.to_date("l_shipdate").alias("day")).agg(F.size(F.collect_set("l_linenumber")).alias("bands"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return s.groupBy("tile", F.year("day").alias("year")).agg(F.count("*").alias("scenes"), F.count(F.when(F.col("bands") >= 3, 1)).alias("complete"), F.sum("bytes").alias("bytes"))


@query("WITH m AS (SELECT o_orderpriority AS region, year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS v, stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 5) SELECT region, m::INT AS month, count(*) AS years, round(avg(v), 2) AS mean, round(avg(s), 2) AS std, max(n) AS most FROM m GROUP BY ALL")
def d39_d40_monthly_baseline(spark, d):
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("region"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("v"), F.stddev_pop("o_totalprice").alias("s"), F.count("*").alias("n")).filter("n >= 5")
    return m.groupBy("region", "month").agg(F.count("*").alias("years"), F.round(F.avg("v"), 2).alias("mean"), F.round(F.avg("s"), 2).alias("std"), F.max("n").alias("most"))


@query(f"WITH {WINDOWS}, n AS (SELECT count(DISTINCT date) AS n FROM win) SELECT pixel, round(median(value), 6) AS composite, round(1 - count(DISTINCT date) FILTER (cloud < 0.5) / any_value(n.n), 6) AS cloud_fraction FROM win, n GROUP BY pixel")
def d41_d42_composites(spark, d):
    w = windows(spark, d)
    total = w.agg(F.countDistinct("date").alias("n"))
    x = w.groupBy("pixel").agg(F.median("value").alias("c"), F.countDistinct(F.when(F.col("cloud") < 0.5, F.col("date"))).alias("k"))
    return x.crossJoin(F.broadcast(total)).select("pixel", r6(F.col("c"), "composite"), r6(1 - F.col("k") / F.col("n"), "cloud_fraction"))


@query(f"WITH {ALERTS}, z AS (SELECT beat_name, avg((change_type = '1-URGENT')::INT) AS loss, avg((detection_date >= '2000-01-01')::INT) AS recent, max(cusum_zone_score) AS cusum FROM alerts GROUP BY beat_name), s AS (SELECT *, 0.4 * loss + 0.3 * recent + CASE WHEN cusum >= 0.5 THEN 0.15 ELSE 0 END AS risk FROM z) SELECT beat_name, round(risk, 6) AS risk, CASE WHEN risk >= 0.40 THEN 'critical' WHEN risk >= 0.20 THEN 'high' WHEN risk >= 0.08 THEN 'medium' ELSE 'low' END AS tier FROM s")
def d43_zone_risk(spark, d):
    z = alerts(spark, d).groupBy("beat_name").agg(F.avg((F.col("change_type") == "1-URGENT").cast("int")).alias("loss"), F.avg((F.col("detection_date") >= "2000-01-01").cast("int")).alias("recent"), F.max("cusum_zone_score").alias("cusum"))
    r = z.withColumn("r", 0.4 * F.col("loss") + 0.3 * F.col("recent") + F.when(F.col("cusum") >= 0.5, 0.15).otherwise(0.0))
    return r.select("beat_name", r6(F.col("r"), "risk"), F.when(F.col("r") >= 0.4, "critical").when(F.col("r") >= 0.2, "high").when(F.col("r") >= 0.08, "medium").otherwise("low").alias("tier"))


@query(f"WITH {ALERTS} SELECT source, count(*) AS n, count(*) FILTER (confidence >= 0.5) AS matched, round(100.0 * count(*) FILTER (confidence >= 0.5) / count(*), 4) AS pct, round(avg(area_ha), 6) AS mean_area, round(stddev_pop(area_ha), 6) AS std_area FROM alerts GROUP BY source")
def d44_d56_by_source(spark, d):
    hit = F.count(F.when(F.col("confidence") >= 0.5, 1))
    return alerts(spark, d).groupBy("source").agg(F.count("*").alias("n"), hit.alias("matched"), F.round(100 * hit / F.count("*"), 4).alias("pct"), r6(F.avg("area_ha"), "mean_area"), r6(F.stddev_pop("area_ha"), "std_area"))


@query(f"""WITH {ALERTS} SELECT * FROM (SELECT 'rows' AS expectation, count(*) > 0 AS passed FROM alerts UNION ALL SELECT 'confidence_in_range', count(*) FILTER (confidence NOT BETWEEN 0 AND 1) = 0 FROM alerts UNION ALL SELECT 'unique_id', count(*) = count(DISTINCT id) FROM alerts UNION ALL SELECT 'score_present', count(*) FILTER (stacked_score IS NULL) = 0 FROM alerts)""")
def d45_expectations(spark, d):
    a = alerts(spark, d).agg((F.count("*") > 0).alias("rows"), (F.count(F.when(~F.col("confidence").between(0, 1), 1)) == 0).alias("confidence_in_range"), (F.count("*") == F.countDistinct("id")).alias("unique_id"), (F.count(F.when(F.col("stacked_score").isNull(), 1)) == 0).alias("score_present"))
    return a.unpivot([], a.columns, "expectation", "passed")


@query("SELECT conv_id, count(*) AS steps, count(*) FILTER (length(text) > 40) AS ok, count(*) FILTER (length(text) <= 40) AS failed, max(turn) + 1 AS last FROM conversations GROUP BY conv_id")
def d46_d47_run_summary(spark, d):
    n = F.length("text")
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.count(F.when(n > 40, 1)).alias("ok"), F.count(F.when(n <= 40, 1)).alias("failed"), (F.max("turn") + 1).alias("last"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def d50_region_rollup(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high"))


@query(f"WITH {WINDOWS}, s AS (SELECT pixel, date, min(cloud) AS c FROM win GROUP BY ALL) SELECT pixel, date, CASE WHEN c <= 0.1 THEN 'good' WHEN c <= 0.3 THEN 'usable' WHEN c <= 0.6 THEN 'poor' ELSE 'skip' END AS usability FROM s")
def d52_f11_usability(spark, d):
    c = F.col("c")
    return windows(spark, d).groupBy("pixel", "date").agg(F.min("cloud").alias("c")).select("pixel", "date", F.when(c <= 0.1, "good").when(c <= 0.3, "usable").when(c <= 0.6, "poor").otherwise("skip").alias("usability"))


@query(f"WITH {ALERTS} SELECT beat_name, id, round(confidence, 6) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY beat_name ORDER BY confidence DESC, id) AS rank FROM alerts) WHERE rank <= 10")
def f2_top_per_beat(spark, d):
    x = R.top_per_group(alerts(spark, d), "beat_name", 10, F.desc("confidence"), "id")
    return x.select("beat_name", "id", r6(F.col("confidence"), "confidence"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ALERTS} SELECT id, round(coalesce(stacked_score, confidence), 6) AS score, area_ha FROM alerts WHERE coalesce(stacked_score, confidence) >= 0.7 ORDER BY coalesce(stacked_score, confidence) DESC, area_ha DESC, id LIMIT 25")
def f3_f4_top_spots(spark, d):
    s = F.coalesce("stacked_score", "confidence")
    return alerts(spark, d).filter(s >= 0.7).orderBy(s.desc(), F.desc("area_ha"), "id").limit(25).select("id", r6(s, "score"), "area_ha")


@query(f"WITH {ALERTS} SELECT beat_name, detection_date, id, model_version FROM alerts QUALIFY row_number() OVER (PARTITION BY beat_name, detection_date ORDER BY CASE model_version WHEN 'v2' THEN 0 WHEN 'v1' THEN 1 ELSE 2 END, id) = 1")
def f7_f8_best_tier_per_day(spark, d):
    rank = F.when(F.col("model_version") == "v2", 0).when(F.col("model_version") == "v1", 1).otherwise(2)
    w = Window.partitionBy("beat_name", "detection_date").orderBy(rank, "id")
    return alerts(spark, d).withColumn("n", F.row_number().over(w)).filter("n = 1").select("beat_name", "detection_date", "id", "model_version")


@query(f"WITH {ALERTS} SELECT DISTINCT change_type, source FROM alerts ORDER BY 1, 2")
def f9_distinct_filters(spark, d):
    return alerts(spark, d).select("change_type", "source").distinct().orderBy("change_type", "source")


@query("SELECT DISTINCT l_orderkey % 64 AS row, l_partkey % 64 AS col FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey % 64, l_partkey % 64 FROM lineitem WHERE l_returnflag = 'R'")
def g3_new_burns(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"), "l_returnflag")
    return li.filter("l_returnflag = 'A'").drop("l_returnflag").distinct().join(li.filter("l_returnflag = 'R'").drop("l_returnflag"), ["row", "col"], "left_anti")


@query("SELECT user_id, ts::DATE AS date FROM events WHERE event_type = 'click' INTERSECT SELECT user_id, ts::DATE FROM events WHERE event_type = 'view'")
def g4_g7_clean_and_observed(spark, d):
    e = read(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "event_type")
    return e.filter("event_type = 'click'").drop("event_type").intersect(e.filter("event_type = 'view'").drop("event_type"))


@query(f"WITH {ALERTS}, x AS (SELECT * FROM alerts WHERE id % 2 = 0), y AS (SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY beat_name, detection_date, model_version ORDER BY id) = 1) SELECT id, beat_name, detection_date FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.beat_name = y.beat_name AND x.detection_date = y.detection_date AND x.model_version = y.model_version)")
def a19_a20_idempotent_append(spark, d):
    a = alerts(spark, d)
    return R.idempotent_append(a.filter("id % 2 = 0"), a, ["beat_name", "detection_date", "model_version"], ["id"]).select("id", "beat_name", "detection_date")


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, event_type || '-' || date_part('year', ts) AS tag FROM events WHERE (props::JSON->>'$.k')::INT > 50")
def h41_json_properties(spark, d):
    e = read(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.filter("k > 50").select("event_id", "k", F.concat_ws("-", "event_type", F.year("ts").cast("string")).alias("tag"))


@query("SELECT event_id, CASE WHEN value <= 0 THEN NULL WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'moderate' WHEN value <= 200 THEN 'high' ELSE 'extreme' END AS frp_bin, CASE WHEN value < 5 THEN 'minor' WHEN value < 15 THEN 'moderate' WHEN value < 40 THEN 'major' ELSE 'extreme' END AS severity, CASE WHEN event_id % 60 >= 38 AND value >= 5 THEN 'CRITICAL' WHEN event_id % 60 >= 21.3 OR value >= 20 THEN 'HIGH' WHEN event_id % 60 >= 11.2 OR value >= 5 THEN 'MODERATE' ELSE 'LOW' END AS combined, printf('%02d:%02d', (((hour(ts) * 60 + minute(ts)) + 330) % 1440) // 60, ((hour(ts) * 60 + minute(ts)) + 330) % 60) AS ist, CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' ELSE 'other' END AS season FROM events")
def h17_h19_h31_fire_classes(spark, d):
    e, v = read(spark, d, "events"), F.col("value")
    season = F.when(S.season(F.month("ts")) == "Winter", "Winter").otherwise("other")
    return e.select("event_id", S.frp_bin(v).alias("frp_bin"), S.frp_severity(v).alias("severity"), S.combined_severity(F.col("event_id") % 60, v).alias("combined"), S.utc_to_ist(F.hour("ts") * 100 + F.minute("ts")).alias("ist"), season.alias("season"))


@query("WITH v AS (SELECT id, sin(id)::DOUBLE AS a, cos(id)::DOUBLE AS b FROM (SELECT l_orderkey AS id FROM lineitem GROUP BY 1)) SELECT id, round(greatest(-1, least(1, (abs(a) - abs(b)) / (abs(a) + abs(b) + 1e-6))), 6) AS nd, round(-(a*a * ln(a*a + 1e-8) + b*b * ln(b*b + 1e-8)), 6) + 0.0 AS entropy, round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(a - b) / 2), 2) + cos(radians(b)) * cos(radians(a)) * pow(sin(radians(b - a) / 2), 2)))), 3) AS metres FROM v")
def h1_h3_h9_indices(spark, d):
    v = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("a", F.sin("id")).withColumn("b", F.cos("id"))
    a, b = F.col("a"), F.col("b")
    return v.select("id", r6(S.normalised_difference(F.abs(a), F.abs(b)), "nd"), r6(S.entropy(a * a, b * b), "entropy"), F.round(S.haversine_m(b, a, a, b), 3).alias("metres"))


@query("SELECT o_orderkey AS id, round(coalesce(exp(-(o_orderkey % 4000) / 180.0), 0), 6) AS recent, round(exp(-pow(((o_orderkey % 4000) - 730) / 365.0, 2)), 6) AS regrowth, round(1 / (1 + exp(-greatest(-60.0, least(60.0, ((o_orderkey % 4000) - 1825) / 180.0)))), 6) AS old FROM orders")
def h30_j14_burn_age(spark, d):
    enc = S.burn_age(F.col("o_orderkey") % 4000)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *(r6(v, k) for k, v in enc.items()))


@query("WITH t AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey % 60)::DOUBLE AS y FROM supplier) SELECT id, tx::BIGINT AS tx, ty::BIGINT AS ty FROM (SELECT id, unnest(range(floor(x / 3)::BIGINT, floor((x + 4) / 3)::BIGINT + 1)) AS tx, y FROM t), LATERAL (SELECT unnest(range(floor(y / 3)::BIGINT, floor((y + 4) / 3)::BIGINT + 1)) AS ty)")
def h42_tiles_of_boxes(spark, d):
    t = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 60).cast("double").alias("y"))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / 3), F.floor((F.col(c) + 4) / 3)))
    return t.withColumn("tx", span("x")).withColumn("ty", span("y")).select("id", "tx", "ty")


@query(f"""WITH {RASTER}, t AS (SELECT *, n % 8 * 45 + 10 AS aspect, q AS slope FROM rast) SELECT count(*) AS cells, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90,
 round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, count(*) FILTER (v >= 0.06) AS n_above, round(corr(v, q), 5) AS corr,
 {", ".join(f"round(100 * avg((slope >= {t})::INT), 6) AS slope_{t}_pct" for t in (15, 30, 45))}, {", ".join(f"count(*) FILTER (floor((aspect + 22.5) / 45) % 8 = {i}) AS facing_{i}" for i in range(8))} FROM t""")
def d23_d35_d51_grid_stats(spark, d):
    """A raster's distribution in one row: moments, exact percentiles, shares of steep slopes, aspects by octant (0: north)."""
    g = raster(spark, d).withColumns({"slope": F.col("q"), "aspect": F.col("n") % 8 * 45 + 10})
    facing = F.floor((F.col("aspect") + 22.5) / 45) % 8
    one = g.agg(
        F.count("*").alias("cells"), r6(F.min("v"), "low"), r6(F.max("v"), "high"), r6(F.avg("v"), "mean"), r6(F.stddev_pop("v"), "std"), F.count(F.when(F.col("v") >= 0.06, 1)).alias("n_above"), F.round(F.corr("v", "q"), 5).alias("corr"),
        *(r6(100 * F.avg((F.col("slope") >= t).cast("int")), f"slope_{t}_pct") for t in (15, 30, 45)), *(F.count_if(facing == i).alias(f"facing_{i}") for i in range(8)),
    )
    q = exact_quantiles(g, "v", {"p10": 0.1, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")
    return one.crossJoin(F.broadcast(q.select(*(F.round(c, 6).alias(c) for c in q.columns))))
