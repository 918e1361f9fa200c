"""Queries over frames, intervals and tamper signals."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.catalog.base import *  # noqa: F403
from parleo.functions.columns import half_up
from parleo.operators import series as ser
from parleo.plans.stage import settle
from parleo.sources import tables
from parleo.sources.tables import frames

STATS = FR + """, st AS (SELECT call_id, count(*) AS n, sqrt(greatest(sum(v100 * v100) / count(*) - (sum(v100) / count(*)) * (sum(v100) / count(*)), 0)) AS sd, max(t_ms) AS end_ms, quantile_cont(v100, 0.5) AS median FROM fr GROUP BY 1)"""
RUNS = STATS + """, ac AS (SELECT fr.*, median, end_ms, v100 > median * 1.5e0 AS active FROM fr JOIN st USING (call_id)),
lg AS (SELECT *, CASE WHEN lag(active) OVER w IS DISTINCT FROM active THEN 1 ELSE 0 END AS chg FROM ac WINDOW w AS (PARTITION BY call_id ORDER BY t_ms, event_id)),
il AS (SELECT *, sum(chg) OVER (PARTITION BY call_id ORDER BY t_ms, event_id) - 1 AS run FROM lg),
rn0 AS (SELECT call_id, CAST(run AS BIGINT) AS run, min(t_ms) AS start, bool_and(active) AS active, max(end_ms) AS call_end, bool_and(v100 < 50) AS all_zero, count(*) AS n_frames FROM il GROUP BY 1, 2),
rn AS (SELECT *, coalesce(lead(start) OVER w, call_end) AS "end", lead(start) OVER w IS NULL AS is_last FROM rn0 WINDOW w AS (PARTITION BY call_id ORDER BY run)),
iv AS (SELECT call_id, start, "end", call_end FROM rn WHERE active)"""


def merge_sql(gap: int) -> str:
    return f"""mp AS (SELECT *, max("end") OVER (PARTITION BY call_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
mg0 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY start, "end") AS grp FROM mp),
mg AS (SELECT call_id, grp, min(start) AS start, max("end") AS "end", max(call_end) AS call_end FROM mg0 GROUP BY 1, 2)"""


GAPS = """gq AS (SELECT call_id, coalesce(lag("end") OVER (PARTITION BY call_id ORDER BY start), 0) AS g_start, start AS g_end FROM iv UNION ALL SELECT call_id, max("end"), max(call_end) FROM iv GROUP BY 1),
gp AS (SELECT * FROM gq WHERE g_end - g_start >= 3000)"""
HOLD = """hj AS (SELECT g.call_id, g_start, g_end, avg(v100) AS c, var_pop((event_id % 100) / 1000e0) AS zv, avg(v100 / 10000e0) AS m, stddev_pop(v100 / 10000e0) AS sdv, count(*) AS n_frames FROM gp g JOIN fr ON fr.call_id = g.call_id AND t_ms >= g_start AND t_ms < g_end GROUP BY 1, 2, 3),
hold AS (SELECT call_id, g_start, g_end, n_frames, CAST(c > 2000 AS INTEGER) + CAST(zv < 0.005e0 AS INTEGER) + CAST(m > 0.01e0 AND sdv / greatest(m, 1e-10) < 0.5e0 AS INTEGER) AS votes FROM hj)"""
SUBTR = """bl AS (SELECT call_id, g_start AS bs, g_end AS be FROM hold WHERE votes >= 2),
ov AS (SELECT m.call_id, m.start, m."end", bs, be, lag(be) OVER (PARTITION BY m.call_id, m.start ORDER BY bs) AS pe FROM mg m JOIN bl b ON b.call_id = m.call_id AND bs < m."end" AND be > m.start),
pcs AS (SELECT call_id, greatest(start, coalesce(pe, start)) AS start, bs AS "end" FROM ov UNION ALL SELECT call_id, max(be), "end" FROM ov GROUP BY call_id, start, "end"
 UNION ALL SELECT call_id, start, "end" FROM mg m WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE b.call_id = m.call_id AND bs < m."end" AND be > m.start)),
pieces AS (SELECT * FROM pcs WHERE "end" - start > 100)"""


def _base(spark, sf):
    fr = frames(spark, sf)
    return fr, settle(ser.call_stats(fr))


def _runs(spark, sf):
    fr, st = _base(spark, sf)
    return fr, st, ser.runs(fr, st)


@query("W11_activity", f'WITH {RUNS} SELECT call_id, start, "end" FROM iv')
def w11(spark, sf):
    return ser.activity(_runs(spark, sf)[2]).drop("call_end")


@query("W12_merge_intervals", f'WITH {RUNS}, {merge_sql(2000)} SELECT call_id, start, "end" FROM mg')
def w12(spark, sf):
    return ser.merge_close(ser.activity(_runs(spark, sf)[2])).drop("call_end")


@query("W13_gaps", f"WITH {RUNS}, {GAPS} SELECT * FROM gp")
def w13(spark, sf):
    return ser.gaps(settle(ser.activity(_runs(spark, sf)[2])))


@query("W14_irregular_silence", f"""WITH {RUNS}, d AS (SELECT *, "end" - start AS d FROM rn WHERE NOT active AND run > 0 AND NOT is_last), g AS (SELECT call_id, count(*) AS n_gaps, count(*) FILTER (WHERE all_zero) AS n_zero, count(*) FILTER (WHERE d > 100 AND d < 5000) AS k, sum(d) FILTER (WHERE d > 100 AND d < 5000) AS s, sum(d * d) FILTER (WHERE d > 100 AND d < 5000) AS ss FROM d GROUP BY 1),
c AS (SELECT *, sqrt(greatest(ss / k - (s / k) * (s / k), 0)) / (s / k) AS cv FROM g) SELECT call_id, n_gaps, n_zero, {hu('cv', 4)} AS cv, n_gaps >= 5 AND k >= 3 AND coalesce(cv > 2, false) AS irregular FROM c""")
def w14(spark, sf):
    return ser.gap_variation(_runs(spark, sf)[2])


FLUX = """ou AS (SELECT fr.*, median, end_ms, lag(t_ms) OVER (PARTITION BY call_id ORDER BY t_ms, event_id) AS prev FROM fr JOIN st USING (call_id) WHERE n >= 10 AND v100 > median + 5 * sd),
og AS (SELECT *, sum(CASE WHEN prev IS NULL OR t_ms - prev >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY t_ms, event_id) AS grp FROM ou),
oc AS (SELECT *, row_number() OVER (PARTITION BY call_id, grp ORDER BY t_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY call_id, grp) AS c, max(v100) OVER (PARTITION BY call_id, grp) / greatest(median, 0.01e0) AS dev FROM og),
fx AS (SELECT call_id, 'spectral_discontinuity' AS signal_type, t_ms, floor(CASE WHEN dev > 10 THEN least(0.9e0, dev / 15) ELSE least(0.7e0, dev / 15) END * 1000 + 0.5) / 1000e0 AS confidence, CASE WHEN dev > 10 THEN 'high' ELSE 'medium' END AS severity FROM oc WHERE i = c // 2 AND t_ms >= 2000 AND t_ms <= end_ms - 2000 AND dev > 7)"""


@query("W10_flux_outliers", f"WITH {STATS}, {FLUX} SELECT * FROM fx")
def w10(spark, sf):
    return ser.flux_outliers(*_base(spark, sf))


SLIDE = """wn AS (SELECT *, unnest(range(CAST(floor((t_ms - 5000) / 2000) AS BIGINT) * 2000, t_ms + 1, 2000)) AS w_ms FROM fr),
wd AS (SELECT call_id, w_ms, quantile_cont(v100, 0.05) AS noise_floor, count(*) AS n_frames FROM wn WHERE w_ms >= 0 AND w_ms > t_ms - 5000 AND w_ms <= t_ms GROUP BY 1, 2),
wk AS (SELECT wd.*, end_ms FROM wd JOIN st USING (call_id) WHERE end_ms >= 10000 AND w_ms < end_ms - 5000)"""


@query("W15_sliding_windows", f"WITH {STATS}, {SLIDE} SELECT call_id, w_ms, {hu('noise_floor', 2)} AS noise_floor, n_frames FROM wk")
def w15(spark, sf):
    return ser.sliding(*_base(spark, sf)).select("call_id", "w_ms", half_up(F.col("noise_floor"), 2).alias("noise_floor"), "n_frames")


def nf_sql(limit: str) -> str:
    return f"""nm AS (SELECT call_id, median(noise_floor) AS med, stddev_pop(noise_floor) AS sdv FROM wk GROUP BY 1 HAVING count(*) >= 3),
nd AS (SELECT wk.call_id, w_ms, abs(noise_floor - med) / greatest(sdv, med * 0.1e0) AS dev FROM wk JOIN nm USING (call_id) WHERE med > 0),
nf AS (SELECT call_id, 'noise_floor_inconsistency' AS signal_type, w_ms AS t_ms, {hu('least(0.8e0, dev / 5)', 3)} AS confidence, CASE WHEN dev < 5 THEN 'medium' ELSE 'high' END AS severity FROM nd WHERE dev > {limit})"""


@query("A43_noise_floor", f"WITH {STATS}, {SLIDE}, {nf_sql('3')} SELECT * FROM nf")
def a43(spark, sf):
    return ser.noise_floor_outliers(ser.sliding(*_base(spark, sf)))


SIL = """sd0 AS (SELECT *, "end" - start AS d FROM rn WHERE NOT active AND run > 0 AND NOT is_last),
sg0 AS (SELECT call_id, count(*) AS n, count(*) FILTER (WHERE d > 100 AND d < 5000) AS k, sum(d) FILTER (WHERE d > 100 AND d < 5000) AS s, sum(d * d) FILTER (WHERE d > 100 AND d < 5000) AS ss FROM sd0 GROUP BY 1),
si AS (SELECT call_id, 'silence_anomaly' AS signal_type, start AS t_ms, 0.85e0 AS confidence, 'high' AS severity FROM sd0 WHERE all_zero AND d > 50 UNION ALL
 SELECT call_id, 'silence_anomaly', 0, floor(least(0.7e0, cv / 4) * 1000 + 0.5) / 1000e0, 'medium' FROM (SELECT *, sqrt(greatest(ss / k - (s / k) * (s / k), 0)) / (s / k) AS cv FROM sg0 WHERE n >= 5 AND k >= 3) WHERE cv > 2)"""


@query("U2_tamper_detectors", f"""WITH {RUNS}, {FLUX}, {SIL}, {SLIDE}, {nf_sql("CASE WHEN wk.call_id % 2 = 0 THEN 5 ELSE 3 END").replace('SELECT wk.call_id, w_ms, abs', 'SELECT wk.call_id, w_ms, CASE WHEN wk.call_id % 2 = 0 THEN 5 ELSE 3 END AS lim, abs').replace('dev > CASE WHEN wk.call_id % 2 = 0 THEN 5 ELSE 3 END', 'dev > lim')},
al AS (SELECT * FROM fx UNION ALL SELECT * FROM si UNION ALL SELECT * FROM nf), ty AS (SELECT call_id, count(DISTINCT signal_type) AS n_types FROM al GROUP BY 1)
SELECT call_id, signal_type, t_ms, confidence, CASE WHEN n_types < 2 AND severity = 'high' THEN 'medium' ELSE severity END AS severity, n_types FROM al JOIN ty USING (call_id)""")
def u2(spark, sf):
    fr, st, r = _runs(spark, sf)
    lossy = F.when(F.col("call_id") % 2 == 0, 5.0).otherwise(3.0)
    parts = [ser.flux_outliers(fr, st), ser.silence_anomalies(r), ser.noise_floor_outliers(ser.sliding(fr, st), lossy)]
    return ser.corroborated(settle(reduce(DataFrame.unionByName, parts)))


TAMP = FR + f", tp AS (SELECT call_id, event_id, t_ms, {case('event_type', tables.EVENT_TAMPER)} AS signal_type, CASE WHEN v100 >= 10000 THEN 'high' WHEN v100 >= 5000 THEN 'medium' ELSE 'low' END AS severity FROM fr WHERE v100 >= 9000 AND (event_type = 'view' OR call_id % 3 > 0))"


def _tamper(spark, sf):
    f = frames(spark, sf).where((F.col("v100") >= 9000) & ((F.col("event_type") == "view") | (F.col("call_id") % 3 > 0)))
    sev = F.when(F.col("v100") >= 10000, "high").when(F.col("v100") >= 5000, "medium").otherwise("low")
    return f.select("call_id", "event_id", "t_ms", tables._map("event_type", tables.EVENT_TAMPER).alias("signal_type"), sev.alias("severity"))


@query("A24_corroboration", f"WITH {TAMP}, ty AS (SELECT call_id, count(DISTINCT signal_type) AS n_types FROM tp GROUP BY 1) SELECT call_id, event_id, t_ms, signal_type, CASE WHEN n_types < 2 AND severity = 'high' THEN 'medium' ELSE severity END AS severity, n_types FROM tp JOIN ty USING (call_id)")
def a24(spark, sf):
    return ser.corroborated(_tamper(spark, sf))


@query("A23_tamper_risk", f"WITH {TAMP}, g AS (SELECT call_id, count(DISTINCT signal_type) AS n_types, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) AS n_signals FROM tp GROUP BY 1) SELECT *, CASE WHEN n_types >= 3 AND n_high >= 2 THEN 'high' WHEN n_types >= 2 AND (n_high >= 1 OR n_signals >= 4) THEN 'medium' ELSE 'low' END AS tamper_risk FROM g")
def a23(spark, sf):
    return ser.tamper_risk(_tamper(spark, sf))


@query("A54_hold_music", f"WITH {RUNS}, {GAPS}, {HOLD} SELECT *, votes >= 2 AS is_hold FROM hold")
def a54(spark, sf):
    fr, _, r = _runs(spark, sf)
    return ser.hold_music(fr, ser.gaps(settle(ser.activity(r))))


@query("J16_frames_in_intervals", f'WITH {RUNS}, {merge_sql(2000)} SELECT m.call_id, start, "end", count(*) AS n_frames, CAST(sum(v100) AS BIGINT) AS v_sum, max(v100) AS v_max FROM mg m JOIN fr ON fr.call_id = m.call_id AND t_ms >= start AND t_ms < "end" GROUP BY 1, 2, 3')
def j16(spark, sf):
    fr, _, r = _runs(spark, sf)
    iv = ser.merge_close(ser.activity(r))
    return ser.bucket_join(fr, iv, "start", "end").groupBy("call_id", "start", "end").agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("v100").alias("v_sum"), F.max("v100").alias("v_max"))


def _cleanup(spark, sf):
    fr, st, r = _runs(spark, sf)
    act = settle(ser.activity(r))
    hold = settle(ser.hold_music(fr, ser.gaps(act)))
    return st, hold, ser.subtract(settle(ser.merge_close(act, 6000)), hold.where("is_hold"))


@query("J15_interval_subtraction", f'WITH {RUNS}, {merge_sql(6000)}, {GAPS}, {HOLD}, {SUBTR} SELECT call_id, start, "end" FROM pieces')
def j15(spark, sf):
    return _cleanup(spark, sf)[2]


@query("A53_cleanup_metadata", f"""WITH {RUNS}, {merge_sql(6000)}, {GAPS}, {HOLD}, {SUBTR}, cl AS (SELECT call_id, sum("end" - start) AS cleaned, count(*) AS k FROM pieces GROUP BY 1), hd AS (SELECT call_id, sum(g_end - g_start) AS h FROM hold WHERE votes >= 2 GROUP BY 1),
j AS (SELECT st.call_id, end_ms AS o, coalesce(cleaned, 0) AS c, coalesce(k, 0) AS k, coalesce(h, 0) AS h FROM st LEFT JOIN cl USING (call_id) LEFT JOIN hd USING (call_id)), u AS (SELECT *, c > 0 AND o - c >= 1000 AS used FROM j)
SELECT call_id, o AS original_ms, CAST(CASE WHEN used THEN c ELSE o END AS BIGINT) AS cleaned_ms, CAST(CASE WHEN used THEN greatest(0, o - c - h) ELSE 0 END AS BIGINT) AS dead_air_ms, CAST(CASE WHEN used THEN h ELSE 0 END AS BIGINT) AS hold_ms, CASE WHEN used THEN k ELSE 0 END AS segments_stitched, used AS cleanup_applied FROM u""")
def a53(spark, sf):
    st, hold, clean = _cleanup(spark, sf)
    return ser.cleanup_metadata(st, clean, hold)


@query("A42_quality_score", f"""WITH {RUNS}, g AS (SELECT fr.call_id, avg(v100) FILTER (WHERE v100 > median * 1.5e0) AS se, avg(v100) FILTER (WHERE NOT v100 > median * 1.5e0) AS ne, count(*) FILTER (WHERE v100 >= 20000) * 100 / count(*) AS clip, max(end_ms) AS end_ms FROM fr JOIN st USING (call_id) GROUP BY 1),
sp AS (SELECT call_id, sum("end" - start) AS speech FROM iv GROUP BY 1),
k AS (SELECT g.call_id, greatest(0e0, least(40e0, 10 * log10(coalesce(se, 1e-10) / greatest(coalesce(ne, 1e-10), 1e-10)))) AS snr, CASE WHEN clip < 0.1 THEN 100e0 WHEN clip < 0.5 THEN 80e0 WHEN clip < 2 THEN 50e0 ELSE 20e0 END AS cs, CASE WHEN end_ms > 0 THEN coalesce(speech, 0) * 100e0 / end_ms ELSE 0e0 END AS share,
 CASE WHEN g.call_id % 20 - 2 >= 15 THEN 100e0 WHEN g.call_id % 20 - 2 >= 8 THEN 80e0 WHEN g.call_id % 20 - 2 >= 3 THEN 60e0 WHEN g.call_id % 20 - 2 >= 0 THEN 40e0 ELSE 20e0 END AS hs FROM g LEFT JOIN sp USING (call_id)),
s AS (SELECT *, CAST(greatest(0, least(100, floor({hu('least(100e0, snr * 5) * 0.4e0 + cs * 0.2e0 + CASE WHEN share >= 50 THEN 100e0 WHEN share >= 30 THEN 60e0 WHEN share >= 15 THEN 30e0 ELSE 10e0 END * 0.2e0 + hs * 0.2e0', 6)}))) AS BIGINT) AS q FROM k)
SELECT call_id, q AS quality_score, CASE WHEN q >= 70 THEN 'TRUSTWORTHY' WHEN q >= 40 THEN 'DEGRADED' ELSE 'UNRELIABLE' END AS quality_flag, {hu('snr', 1)} AS snr_db, {hu('share', 1)} AS speech_percentage, cs AS clipping_score FROM s""")
def a42(spark, sf):
    fr, st, r = _runs(spark, sf)
    return ser.quality(fr, st, ser.activity(r), F.col("call_id") % 20 - 2)


@query("A58_downsample", f"WITH {FR}, p AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY t_ms, event_id) - 1 AS pos, count(*) OVER (PARTITION BY call_id) AS n FROM fr), g AS (SELECT call_id, pos * 200 // n AS block, sum(abs(v100)) / count(*) AS m FROM p GROUP BY 1, 2) SELECT call_id, block, {hu('m / greatest(max(m) OVER (PARTITION BY call_id), 0.001e0)', 4)} AS height FROM g")
def a58(spark, sf):
    return ser.downsample(frames(spark, sf))
