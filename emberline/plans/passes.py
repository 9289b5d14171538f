"""Queries over passes of a scene catalog and observations in time: as-of choices, gates, gaps, windows, confirmations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reports as R
from ..operators import spatial, temporal
from .registry import ALERTS, HISTORY, WINDOWS, alerts, half_up, history, query, r6, read, windows
from .series import MEANS, PAIRS_SQL, SCORE_SQL, STD, _doy_sql, _l, scored_pairs


def scenes(spark, d) -> DataFrame:
    """Scenes of tiles with their cloud share, from ``lineitem``."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tile"), F.to_date("l_shipdate").alias("seen")).agg(F.min("l_orderkey").alias("k"))
    return s.select("tile", "seen", (F.col("k") % 11 / 10).alias("cloud"))


def fires(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("fire"), (F.col("o_custkey") % 1000).alias("tile"), F.to_date("o_orderdate").alias("day"))


SCENES = "sc AS (SELECT l_suppkey AS tile, l_shipdate::DATE AS seen, min(l_orderkey) % 11 / 10 AS cloud FROM lineitem GROUP BY ALL), fi AS (SELECT o_orderkey AS fire, o_custkey % 1000 AS tile, o_orderdate::DATE AS day FROM orders)"


@query(f"WITH {SCENES}, l AS (SELECT tile, seen, lag(seen) OVER (PARTITION BY tile ORDER BY seen) AS before FROM sc) SELECT tile, seen, CASE WHEN seen - before <= 60 THEN before END AS scar FROM l")
def c13_previous_scar(spark, d):
    """The scene strictly before, if it is at most 60 days back."""
    before = F.lag("seen").over(Window.partitionBy("tile").orderBy("seen"))
    return scenes(spark, d).select("tile", "seen", F.when(F.datediff("seen", before) <= 60, before).alias("scar"))


_STEP = "CASE WHEN gap <= 38 THEN 0 WHEN gap <= 54 THEN 1 WHEN gap <= 70 THEN 2 WHEN gap <= 86 THEN 3 ELSE 4 END"


@query(f"WITH {SCENES}, c AS (SELECT fire, seen, day - seen AS gap FROM fi JOIN sc ON fi.tile = sc.tile AND seen BETWEEN day - 90 AND day - 30), s AS (SELECT *, {_STEP} AS step FROM c) SELECT fire, seen, gap::BIGINT AS gap FROM s QUALIFY row_number() OVER (PARTITION BY fire ORDER BY step, CASE WHEN step < 4 THEN abs(gap - 30 - 16 * step) END, gap) = 1")
def c14_pre_fire_scene(spark, d):
    """A scene 30 to 90 days before a fire: the first 16-day step that has one within 8 days, the nearest of it; else the latest."""
    c = spatial.range_hits(fires(spark, d), scenes(spark, d), ["tile"], "day", "seen", 90, -30).withColumn("gap", F.datediff("day", "seen"))
    gap = F.col("gap")
    step = F.when(gap <= 38, 0).when(gap <= 54, 1).when(gap <= 70, 2).when(gap <= 86, 3).otherwise(4)
    c = c.withColumn("step", step)
    off = F.when(F.col("step") < 4, F.abs(gap - 30 - 16 * F.col("step")))
    return R.top_per_group(c, "fire", 1, "step", off, "gap").select("fire", "seen", gap.cast("long").alias("gap"))


_FRAMES = "fr AS (SELECT fire, tile, day, back, day - back AS want FROM fi, (SELECT unnest([0, 16, 32]) AS back))"


@query(f"""WITH {SCENES}, {_FRAMES}, c AS (SELECT fire, back, seen, abs(seen - want) AS off FROM fr JOIN sc ON fr.tile = sc.tile AND seen BETWEEN want - 12 AND want + 12 WHERE back > 0),
b AS (SELECT fire, back, seen FROM c QUALIFY row_number() OVER (PARTITION BY fire, back ORDER BY off, seen) = 1) SELECT fire, max(seen) FILTER (back = 16) AS frame_16, max(seen) FILTER (back = 32) AS frame_32 FROM b GROUP BY fire""")
def c15_j15_two_frames(spark, d):
    """Nearest scenes to 16 and 32 days before, within 12 days."""
    f = fires(spark, d).withColumn("back", F.explode(F.array(F.lit(16), F.lit(32)))).withColumn("want", F.expr("date_sub(day, back)"))
    c = spatial.range_hits(f, scenes(spark, d), ["tile"], "want", "seen", 12, 12).withColumn("off", F.abs(F.datediff("seen", "want")))
    best = c.withColumn("nth", F.row_number().over(Window.partitionBy("fire", "back").orderBy("off", "seen"))).filter("nth = 1")
    at = lambda n: F.max(F.when(F.col("back") == n, F.col("seen"))).alias(f"frame_{n}")
    return best.groupBy("fire").agg(at(16), at(32))


@query(f"WITH {SCENES}, {_FRAMES}, m AS (SELECT fire, back FROM fr WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.tile = fr.tile AND seen BETWEEN want - 12 AND want + 12)) SELECT fire, count(*) AS n_missing, count(*) = 3 AS all_missing FROM m GROUP BY fire")
def c32_missing_frames(spark, d):
    """Fires with expected frames that no scene within 12 days can give."""
    f = fires(spark, d).withColumn("back", F.explode(F.array(F.lit(0), F.lit(16), F.lit(32)))).withColumn("want", F.expr("date_sub(day, back)"))
    have = spatial.range_hits(f, scenes(spark, d), ["tile"], "want", "seen", 12, 12).select("fire", "back").distinct()
    return f.join(have, ["fire", "back"], "left_anti").groupBy("fire").agg(F.count("*").alias("n_missing")).withColumn("all_missing", F.col("n_missing") == 3)


@query("WITH a AS (SELECT l_suppkey AS tile, l_shipdate::DATE AS seen, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS tile, l_shipdate::DATE AS seen, min(l_orderkey) % 11 / 10 AS cloud FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) SELECT tile, seen, n, cloud FROM a JOIN b USING (tile, seen)")
def c16_join_collections(spark, d):
    """Images of one collection with the clouds of the other's image of the same scene."""
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), F.to_date("l_shipdate").alias("seen"), "l_orderkey", "l_returnflag")
    a = li.filter("l_returnflag = 'A'").groupBy("tile", "seen").agg(F.count("*").alias("n"))
    b = li.filter("l_returnflag <> 'A'").groupBy("tile", "seen").agg((F.min("l_orderkey") % 11 / 10).alias("cloud"))
    return a.join(b, ["tile", "seen"])


@query(f"WITH {SCENES}, c AS (SELECT fire, min(cloud) AS cloud FROM fi JOIN sc ON fi.tile = sc.tile AND seen BETWEEN day - 1 AND day + 1 GROUP BY fire) SELECT fire, coalesce(cloud, 1.0) AS cloud, coalesce(cloud, 1.0) < 0.3 AS clear FROM fi LEFT JOIN c USING (fire)")
def c17_cloud_gate(spark, d):
    """Least cloud of the scenes within a day; without a scene the day counts as cloudy."""
    f = fires(spark, d)
    c = spatial.range_hits(f, scenes(spark, d), ["tile"], "day", "seen", 1, 1).groupBy("fire").agg(F.min("cloud").alias("c"))
    out = f.select("fire").join(c, "fire", "left").select("fire", F.coalesce("c", F.lit(1.0)).alias("cloud"))
    return out.withColumn("clear", F.col("cloud") < 0.3)


@query(f"""WITH {HISTORY}, p AS (SELECT DISTINCT point_id, date FROM hist), l AS (SELECT point_id, max(date) AS latest FROM p GROUP BY 1), c AS (SELECT l.point_id, latest, p.date AS before, latest - p.date AS gap FROM l JOIN p ON l.point_id = p.point_id AND p.date < latest),
r AS (SELECT *, CASE WHEN gap <= 45 THEN 0 WHEN abs(gap - 365) <= 20 THEN 1 END AS mode FROM c) SELECT point_id, latest, before, CASE mode WHEN 0 THEN 'instant' ELSE 'year' END AS mode FROM r WHERE mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY r.mode, CASE r.mode WHEN 0 THEN gap ELSE abs(gap - 365) END, before DESC) = 1""")
def c20_instant_or_yearly_pair(spark, d):
    """The latest pass with the one before if that is at most 45 days back, else with the nearest to the same day a year ago."""
    p = history(spark, d).select("point_id", "date").distinct()
    latest = p.groupBy("point_id").agg(F.max("date").alias("latest"))
    c = latest.join(p.withColumnRenamed("date", "before"), "point_id").filter("before < latest").withColumn("gap", F.datediff("latest", "before"))
    off = F.abs(F.col("gap") - 365)
    c = c.withColumn("mode", F.when(F.col("gap") <= 45, "instant").when(off <= 20, "year")).filter("mode is not null")
    return R.top_per_group(c, "point_id", 1, "mode", F.when(F.col("mode") == "instant", F.col("gap")).otherwise(off), F.desc("before")).select("point_id", "latest", "before", "mode")


@query(f"WITH {HISTORY}, done AS (SELECT DISTINCT point_id, year(date) AS y FROM hist WHERE range_name = 'F') SELECT point_id, year(date)::INT AS year, count(*) AS n FROM hist WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.point_id = hist.point_id AND done.y = year(hist.date)) GROUP BY ALL")
def c28_resume(spark, d):
    """Work left: chunks whose key is not among those completed."""
    h = history(spark, d).withColumn("year", F.year("date"))
    done = h.filter("range_name = 'F'").select("point_id", "year").distinct()
    return h.join(done, ["point_id", "year"], "left_anti").groupBy("point_id", "year").agg(F.count("*").alias("n"))


_PLAIN = f"least({_l('-(trees - trees_before)', '0.12', '18')} * (1 + greatest(0.0, -((trees - trees_before) / {STD})) / 4), 1.0) * greatest(0.0, 1 - cloud)"
_LABEL = "CASE WHEN {0} >= 0.70 THEN 'HIGH' WHEN {0} >= 0.45 THEN 'MEDIUM' WHEN {0} >= 0.25 THEN 'LOW' ELSE 'NO ALERT' END"


@query(f"WITH {SCORE_SQL}, o AS (SELECT label AS new, {_PLAIN} AS s FROM scored), q AS (SELECT new, {_LABEL.format('s')} AS old FROM o) SELECT old, new, count(*) AS n FROM q GROUP BY ALL")
def c31_rescored_labels(spark, d):
    """Labels of the plain scorer against those of the threat scorer, on the same rows."""
    from ..functions.scorers import plain_score

    delta = F.col("trees") - F.col("trees_before")
    old = S.score_label(plain_score(delta, delta / STD, F.col("cloud")))
    return scored_pairs(spark, d).groupBy(old.alias("old"), F.col("label").alias("new")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORE_SQL} SELECT threat, beat, label, date_trunc('month', date)::DATE AS month, count(*) AS n FROM scored GROUP BY GROUPING SETS ((threat), (threat, beat, label, date_trunc('month', date)))")
def d6_threat_counts(spark, d):
    """By threat, and by threat, beat, label and month."""
    x = scored_pairs(spark, d).select("threat", "beat", "label", F.trunc("date", "month").alias("month"))
    return x.groupingSets([["threat"], ["threat", "beat", "label", "month"]], "threat", "beat", "label", "month").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS_SQL}, a AS (SELECT beat, month(date_before) AS m0, month(date) AS m1, count(*) AS n, avg(trees - trees_before) AS dt, avg({_doy_sql("dayofyear(date)")} - {_doy_sql("dayofyear(date_before)")}) AS expected FROM pairs GROUP BY ALL)
SELECT beat, m0::INT AS m0, m1::INT AS m1, n, round(dt - expected, 5) AS residual, CASE WHEN expected - dt > 0.08 THEN 'REAL' WHEN expected - dt > 0.03 THEN 'MARGINAL' ELSE 'PHENO' END AS verdict FROM a""")
def d49_h7_seasonal_false_positives(spark, d):
    """Mean change against what the season explains."""
    p = temporal.consecutive_pairs(history(spark, d), "point_id", ["date", "id"], "date", ["trees", "crops", "built"])
    expected = S.doy_value(F.dayofyear("date"), MEANS) - S.doy_value(F.dayofyear("date_before"), MEANS)
    a = p.groupBy("beat", F.month("date_before").alias("m0"), F.month("date").alias("m1")).agg(F.count("*").alias("n"), F.avg(F.col("trees") - F.col("trees_before")).alias("dt"), F.avg(expected).alias("e"))
    r = F.col("dt") - F.col("e")
    return a.select("beat", "m0", "m1", "n", F.round(r, 5).alias("residual"), F.when(-r > 0.08, "REAL").when(-r > 0.03, "MARGINAL").otherwise("PHENO").alias("verdict"))


@query(f"WITH {HISTORY} SELECT id, row_number() OVER (PARTITION BY beat, date ORDER BY id) - 1 AS nth, lead(date) OVER (PARTITION BY point_id ORDER BY date, id) AS next_date FROM hist")
def e2_e21_order_and_next(spark, d):
    """Number of a row within its beat and date, and the date that follows it at its point."""
    nth = F.row_number().over(Window.partitionBy("beat", "date").orderBy("id")) - 1
    return history(spark, d).select("id", nth.cast("long").alias("nth"), F.lead("date").over(Window.partitionBy("point_id").orderBy("date", "id")).alias("next_date"))


@query("""WITH w AS (SELECT o_orderpriority AS station, o_orderdate::DATE AS date, min(o_orderkey) % 350 AS t FROM orders GROUP BY ALL) SELECT a.station, a.date, array_to_string(list_transform(range(0, 7), i -> coalesce((max(b.t) FILTER (a.date - b.date = i))::VARCHAR, '-')), ',') AS week FROM w a JOIN w b ON a.station = b.station AND b.date BETWEEN a.date - 6 AND a.date GROUP BY ALL""".replace("array_to_string(list_transform(range(0, 7), i -> coalesce((max(b.t) FILTER (a.date - b.date = i))::VARCHAR, '-')), ',')", " || ',' || ".join(f"coalesce((max(b.t) FILTER (a.date - b.date = {i}))::VARCHAR, '-')" for i in range(7))))
def e20_week_of_weather(spark, d):
    """The day and the six before it, newest first; '-' where nothing was measured."""
    o = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("station"), F.to_date("o_orderdate").alias("date")).agg((F.min("o_orderkey") % 350).alias("t"))
    spread = o.select("station", F.posexplode(F.sequence(F.col("date"), F.date_add("date", 6))).alias("back", "day"), "t")
    week = spread.groupBy("station", F.col("day").alias("date")).agg(F.map_from_entries(F.collect_list(F.struct("back", "t"))).alias("m"))
    days = F.concat_ws(",", *(F.coalesce(F.col("m")[i].cast("string"), F.lit("-")) for i in range(7)))
    return week.join(o.select("station", "date"), ["station", "date"], "left_semi").select("station", "date", days.alias("week"))


@query(f"WITH {HISTORY}, p AS (SELECT DISTINCT point_id, date FROM hist), a AS (SELECT point_id, max(date) AS stop FROM p GROUP BY 1), b AS (SELECT point_id, max(p.date) AS before FROM p JOIN a USING (point_id) WHERE p.date < a.stop - 15 GROUP BY 1) SELECT point_id, stop, stop - 15 AS start, before, before - 15 AS before_start FROM a LEFT JOIN b USING (point_id)")
def e22_latest_windows(spark, d):
    """The latest window of 15 days and the latest one before that does not overlap it."""
    p = history(spark, d).select("point_id", "date").distinct()
    stop = F.max("date").over(Window.partitionBy("point_id"))
    x = p.withColumn("stop", stop).groupBy("point_id", "stop").agg(F.max(F.when(F.col("date") < F.date_sub("stop", 15), F.col("date"))).alias("before"))
    return x.select("point_id", "stop", F.date_sub("stop", 15).alias("start"), "before", F.date_sub("before", 15).alias("before_start"))


@query(f"WITH {ALERTS} SELECT id, stacked_score IS NULL AS unscored, row_number() OVER (ORDER BY stacked_score DESC NULLS LAST, id) AS rank FROM alerts WHERE change_type = '2-HIGH' QUALIFY rank <= 500")
def f12_drilldown(spark, d):
    """The 500 best rows of one type by score, nulls last."""
    a = alerts(spark, d).filter("change_type = '2-HIGH'").orderBy(F.col("stacked_score").desc_nulls_last(), "id").limit(500)
    rank = F.row_number().over(Window.orderBy(F.col("stacked_score").desc_nulls_last(), "id"))  # of 500 rows
    return a.select("id", F.col("stacked_score").isNull().alias("unscored"), rank.cast("long").alias("rank"))


@query(f"WITH {ALERTS} SELECT 'alert' AS layer, beat_name AS name, count(*) AS n, round(sum(area_ha), 4) AS area_ha, NULL::BIGINT AS customers FROM alerts GROUP BY ALL UNION ALL SELECT 'nation', n_name, count(*), NULL, count(DISTINCT c_custkey) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def g1_layers(spark, d):
    """Layers of different columns in one table."""
    a = alerts(spark, d).groupBy(F.lit("alert").alias("layer"), F.col("beat_name").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("area_ha"), 4).alias("area_ha"))
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.groupBy(F.lit("nation").alias("layer"), F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers"))
    return a.unionByName(c, allowMissingColumns=True)


@query(f"WITH {ALERTS} SELECT beat_name, detection_date, min(id) AS id FROM alerts GROUP BY ALL")
def g6_keyed_dedup(spark, d):
    return R.top_per_group(alerts(spark, d).withColumn("key", F.struct("beat_name", "detection_date")), "key", 1, "id").select("beat_name", "detection_date", "id")


_DATES = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'unknown' END"


@query(f"WITH t AS (SELECT o_orderkey AS id, {_DATES} AS s FROM orders), p AS (SELECT id, coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y%m%d'), try_strptime(s, '%d/%m/%Y'))::DATE AS day FROM t) SELECT id, day, (day + 14)::DATE AS period_end, dayofyear(day)::INT AS doy FROM p")
def h20_date_parsing(spark, d):
    """Dates in any of three spellings; others are null."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    s = F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(at, "yyyyMMdd")).when(k % 4 == 2, F.date_format(at, "dd/MM/yyyy")).otherwise("unknown")
    day = S.tolerant_date(F.col("s"))
    return read(spark, d, "orders").select(k.alias("id"), s.alias("s")).select("id", day.alias("day"), F.date_add(day, 14).alias("period_end"), F.dayofyear(day).alias("doy"))


@query(f"""WITH {HISTORY}, d AS (SELECT DISTINCT dayofyear(date) AS doy FROM hist) SELECT doy::INT AS doy, round({_doy_sql("doy")}, 6) AS baseline, round(0.5 + 0.2 * cos(doy * 2 * pi() / 365.25) - 0.1 * sin(doy * 2 * pi() / 365.25) + 0.05 * cos(2 * (doy * 2 * pi() / 365.25)) + 0.02 * sin(2 * (doy * 2 * pi() / 365.25)), 6) AS predicted,
round(1 / (1 + exp(-greatest(-60.0, least(60.0, (doy - 180) / 10)))), 6) AS logistic FROM d""")
def h6_h7_h8_seasonal_curves(spark, d):
    doy = F.col("doy")
    coefficients = F.array(*map(F.lit, (0.5, 0.2, -0.1, 0.05, 0.02)))
    x = history(spark, d).select(F.dayofyear("date").alias("doy")).distinct()
    return x.select("doy", r6(S.doy_value(doy, MEANS), "baseline"), r6(S.harmonic(coefficients, doy), "predicted"), r6(S.logistic(doy, 180, 0.1), "logistic"))


@query(f"WITH {ALERTS}, l AS (SELECT {_LABEL.format('confidence')} AS label, CASE WHEN confidence >= 0.65 THEN 'HIGH' WHEN confidence >= 0.45 THEN 'MEDIUM' WHEN confidence >= 0.25 THEN 'LOW' ELSE 'NO ALERT' END AS legacy, CASE WHEN confidence >= 0.4 THEN 'A' WHEN confidence >= 0.2 THEN 'B' WHEN confidence >= 0.1 THEN 'C' ELSE 'D' END AS tier, split_part(beat_name, '_', 1) AS prefix FROM alerts) SELECT label, legacy, tier, prefix, count(*) AS n FROM l GROUP BY ALL")
def h28_h35_labels_and_prefixes(spark, d):
    c = F.col("confidence")
    tier = F.when(c >= 0.4, "A").when(c >= 0.2, "B").when(c >= 0.1, "C").otherwise("D")
    return alerts(spark, d).groupBy(S.score_label(c).alias("label"), S.score_label(c, high=0.65).alias("legacy"), tier.alias("tier"), F.split_part("beat_name", F.lit("_"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


@query(f"""WITH {HISTORY}, o AS (SELECT id, point_id, date AS at FROM hist), c AS (SELECT o.id, h.date - o.at AS off, round(h.trees * 500000 * 100)::BIGINT AS v FROM o JOIN hist h ON h.point_id = o.point_id AND h.date BETWEEN o.at - 75 AND o.at + 45),
m AS (SELECT id, sum(CASE WHEN off <= -15 THEN v END)::DOUBLE / count(CASE WHEN off <= -15 THEN v END) AS b, sum(CASE WHEN off >= 0 THEN v END)::DOUBLE / count(CASE WHEN off >= 0 THEN v END) AS a FROM c GROUP BY id) SELECT id, b IS NULL AS no_before, coalesce(b - a >= 2000000, true) AS confirmed FROM m""")
def k9_drop_confirmation(spark, d):
    """Whether the mean 75 to 15 days before exceeds that of 45 days after by enough; without data an alert is accepted."""
    h = history(spark, d)
    cents = F.round(F.col("trees") * 500000 * 100).cast("long")
    c = spatial.range_hits(h.select("id", "point_id", F.col("date").alias("at")), h.select("point_id", F.col("date").alias("seen"), cents.alias("v")), ["point_id"], "at", "seen", 75, 45).withColumn("off", F.datediff("seen", "at"))
    m = c.groupBy("id").agg(F.avg(F.when(F.col("off") <= -15, F.col("v"))).alias("b"), F.avg(F.when(F.col("off") >= 0, F.col("v"))).alias("a"))
    return m.select("id", F.col("b").isNull().alias("no_before"), F.coalesce(F.col("b") - F.col("a") >= 2000000, F.lit(True)).alias("confirmed"))


@query(f"""WITH {WINDOWS}, a AS (SELECT pixel // 8 AS chip, date, count(*) AS n, count(*) FILTER (fired) AS changed, sum(CASE WHEN fired THEN event_id % 100 END) AS conf, max(value) AS top FROM win GROUP BY ALL)
SELECT chip, date, changed, floor(conf::DOUBLE / changed / 100 * 1e6 + 0.5) / 1e6 AS confidence, changed / 100 AS area_ha, changed * 4 >= n AS dense, top FROM a WHERE changed > 0""")
def k10_alert_records(spark, d):
    """An alert per chip and day with changed pixels: mean confidence over them, area, flags."""
    w, fired = windows(spark, d), F.col("fired")
    a = w.groupBy(F.floor(F.col("pixel") / 8).alias("chip"), "date").agg(F.count("*").alias("n"), F.count(F.when(fired, 1)).alias("changed"), F.sum(F.when(fired, F.col("event_id") % 100)).alias("conf"), F.max("value").alias("top")).filter("changed > 0")
    n = F.col("changed")
    return a.select("chip", "date", "changed", half_up(F.col("conf") / n / 100, "confidence"), (n / 100).alias("area_ha"), (n * 4 >= F.col("n")).alias("dense"), "top")


SCENARIOS = (("stable", 0.6, 0.6), ("leaf_fall", 0.6, 0.45), ("thinning", 0.6, 0.35), ("clearing", 0.6, 0.05), ("sparse_loss", 0.2, 0.05), ("regrowth", 0.3, 0.5), ("degraded", 0.4, 0.3), ("bare", 0.05, 0.02))


@query(f"""WITH {HISTORY}, r AS (SELECT beat, min(date) AS lo, max(date) AS hi FROM hist GROUP BY beat), g AS (SELECT beat, unnest(generate_series(lo, hi, INTERVAL 10 DAY))::DATE AS day FROM r), s(scenario, b, a) AS (VALUES {", ".join(f"('{n}', {b}::DOUBLE, {a}::DOUBLE)" for n, b, a in SCENARIOS)}),
x AS (SELECT beat, day, scenario, b, greatest(0.0, b - a) AS loss FROM g, s) SELECT beat, day, scenario, floor((0.7 * {_l("loss", "0.05 + 0.10 * b", "25 + 20 * greatest(0.0, (0.30 - b) / 0.30)")} + 0.3 * {_l("loss / greatest(b, 0.05)", "0.30", "8")}) * 1e6 + 0.5) / 1e6 AS raw FROM x""")
def k16_scenario_grid(spark, d):
    """Every tenth day of each beat's span under fixed scenarios of change."""
    from ..functions.scorers import drop_parts

    span = history(spark, d).groupBy("beat").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select("beat", F.explode(F.expr("sequence(lo, hi, interval 10 days)")).alias("day"))
    kinds = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(b).alias("b"), F.lit(a).alias("a")) for n, b, a in SCENARIOS))
    x = days.withColumn("s", F.explode(kinds)).select("beat", "day", "s.*")
    absolute, relative = drop_parts(F.greatest(F.lit(0.0), F.col("b") - F.col("a")), F.col("b"))
    return x.select("beat", "day", "scenario", half_up(0.7 * absolute + 0.3 * relative, "raw"))
