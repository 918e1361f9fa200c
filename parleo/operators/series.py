"""Time series of a call: activity, intervals, gaps, outliers, noise floor, quality.

Frames carry ``call_id, event_id, t_ms, v100, chunk``; chunks are slices of call
time.  Thresholds come from exact per-call statistics that are spread to the
frames through the list of chunks.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.functions.columns import half_up
from parleo.plans.skew import attach, exact_quantile, islands, scan
from parleo.plans.stage import settle

KEYS = ["call_id"]
ORDER = ["t_ms", "event_id"]
SLICE_MS = 20_000


def sliced(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(at) / SLICE_MS))


def call_stats(fr: DataFrame) -> DataFrame:
    """Median, spread, size and end of every call."""
    med = exact_quantile(fr, KEYS, "v100", 0.5, "median")
    # spread from exact integer sums, so that the order of addition cannot matter
    n, s, ss = F.count(F.lit(1)), F.sum("v100"), F.sum(F.col("v100").cast("decimal(20,0)") * F.col("v100").cast("decimal(17,0)"))
    agg = fr.groupBy(*KEYS).agg(n.alias("n"), s.alias("s"), ss.cast("double").alias("ss"), F.max("t_ms").alias("end_ms"))
    var = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return agg.select(*KEYS, "n", F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), "end_ms").join(med, KEYS)


def runs(fr: DataFrame, stats: DataFrame, factor: float = 1.5, zero_below: int = 50) -> DataFrame:
    """Maximal runs of active and inactive frames; a run ends where the next one starts."""
    x = attach(fr.select("call_id", "event_id", "t_ms", "v100", "chunk"), stats.select("call_id", "median", "end_ms"), KEYS, "chunk")
    x = x.withColumn("active", F.col("v100") > F.col("median") * factor)
    r = islands(x, KEYS, "chunk", ORDER, F.col("active"), "run").groupBy("call_id", "run").agg(
        F.min("t_ms").alias("start"), F.min("active").alias("active"), F.max("end_ms").alias("call_end"),
        F.bool_and(F.col("v100") < zero_below).alias("all_zero"), F.count(F.lit(1)).alias("n_frames"))
    r = settle(r)
    nxt = r.select("call_id", (F.col("run") - 1).alias("run"), F.col("start").alias("nxt"))
    return r.join(nxt, ["call_id", "run"], "left").select(
        "call_id", "run", "start", F.coalesce("nxt", "call_end").alias("end"), "active", "all_zero", "n_frames", "call_end",
        F.col("nxt").isNull().alias("is_last"))


def activity(r: DataFrame) -> DataFrame:
    return r.where("active").select("call_id", "start", "end", "call_end")


def merge_close(iv: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Join intervals whose gap to everything before is below ``gap_ms``."""
    x = sliced(iv, "start")
    x = settle(scan(x, KEYS, "chunk", ["start", "end"], {"reach": ("max", F.col("end"), False)}))
    new = (F.col("reach").isNull() | (F.col("start") - F.col("reach") >= gap_ms)).cast("bigint")
    x = scan(x, KEYS, "chunk", ["start", "end"], {"grp": ("sum", new, True)})
    return x.groupBy("call_id", "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("call_end").alias("call_end")).drop("grp")


def gaps(iv: DataFrame, min_ms: int = 3000) -> DataFrame:
    """Silence of at least ``min_ms`` before, between and after the intervals of a call."""
    x = scan(sliced(iv, "start"), KEYS, "chunk", ["start", "end"], {"reach": ("max", F.col("end"), False)})
    inner = x.select("call_id", F.coalesce("reach", F.lit(0).cast("bigint")).alias("g_start"), F.col("start").alias("g_end"))
    tail = iv.groupBy("call_id").agg(F.max("end").alias("g_start"), F.max("call_end").alias("g_end"))
    return inner.unionByName(tail).where(F.col("g_end") - F.col("g_start") >= min_ms)


def bucket_join(points: DataFrame, iv: DataFrame, start: str, end: str, width_ms: int = 10_000) -> DataFrame:
    """Points inside [start, end) by an equi-join on call and time bucket."""
    p = points.withColumn("_bk", F.floor(F.col("t_ms") / width_ms))
    i = iv.where(F.col(end) > F.col(start)).withColumn("_bk", F.explode(F.sequence(
        F.floor(F.col(start) / width_ms), F.floor((F.col(end) - 1) / width_ms))))
    return p.join(i, ["call_id", "_bk"]).where((F.col("t_ms") >= F.col(start)) & (F.col("t_ms") < F.col(end))).drop("_bk")


def hold_music(fr: DataFrame, gp: DataFrame) -> DataFrame:
    """Two of three: bright sound, steady zero crossings, steady loudness."""
    x = bucket_join(fr.select("call_id", "event_id", "t_ms", "v100"), gp, "g_start", "g_end")
    rms, z = F.col("v100") / 10000.0, (F.col("event_id") % 100) / 1000.0
    g = x.groupBy("call_id", "g_start", "g_end").agg(
        F.avg("v100").alias("centroid"), F.var_pop(z).alias("zvar"), F.avg(rms).alias("m"), F.stddev_pop(rms).alias("sd"), F.count(F.lit(1)).alias("n_frames"))
    votes = (F.col("centroid") > 2000).cast("int") + (F.col("zvar") < 0.005).cast("int") + (
        (F.col("m") > 0.01) & (F.col("sd") / F.greatest(F.col("m"), F.lit(1e-10)) < 0.5)).cast("int")
    return g.withColumn("votes", votes).select("call_id", "g_start", "g_end", "n_frames", "votes", (F.col("votes") >= 2).alias("is_hold"))


def subtract(iv: DataFrame, blockers: DataFrame, min_ms: int = 100, width_ms: int = 10_000) -> DataFrame:
    """Intervals minus disjoint blockers, keeping pieces longer than ``min_ms``.

    Overlaps are found by time bucket.  The piece in front of a blocker starts
    at the blocker before it (a scan over the call), the last piece at the
    furthest blocker (an aggregate); nothing is ordered per interval.
    """
    b = scan(sliced(blockers.select("call_id", F.col("g_start").alias("bs"), F.col("g_end").alias("be")), "bs"), KEYS, "chunk", ["bs", "be"],
             {"pe": ("max", F.col("be"), False)})

    def buckets(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_bk", F.explode(F.sequence(F.floor(F.col(s) / width_ms), F.floor(F.col(e) / width_ms))))

    first_shared = F.floor(F.greatest("start", "bs") / width_ms)  # a pair counts in the first bucket that both lie in
    pairs = buckets(iv, "start", "end").join(buckets(b.drop("chunk"), "bs", "be"), ["call_id", "_bk"]).where(
        (F.col("bs") < F.col("end")) & (F.col("be") > F.col("start")) & (F.col("_bk") == first_shared)).drop("_bk")
    pairs = settle(pairs)
    front = pairs.select("call_id", F.greatest("start", "pe").alias("start"), F.col("bs").alias("end"))
    last = pairs.groupBy("call_id", "start", "end").agg(F.max("be").alias("be")).select("call_id", F.col("be").alias("start"), "end")
    whole = iv.select("call_id", "start", "end").join(pairs.select("call_id", "start", "end").distinct(), ["call_id", "start", "end"], "left_anti")
    return reduce(DataFrame.unionByName, [front, last, whole]).where(F.col("end") - F.col("start") > min_ms)


def cleanup_metadata(stats: DataFrame, clean: DataFrame, hold: DataFrame) -> DataFrame:
    """Seconds removed by the cleanup; applied only when at least one second goes."""
    c = clean.groupBy("call_id").agg(F.sum(F.col("end") - F.col("start")).alias("cleaned"), F.count(F.lit(1)).alias("segments_stitched"))
    h = hold.where("is_hold").groupBy("call_id").agg(F.sum(F.col("g_end") - F.col("g_start")).alias("hold"))
    j = stats.select("call_id", F.col("end_ms").alias("original")).join(c, "call_id", "left").join(h, "call_id", "left").fillna(0)
    used = (F.col("cleaned") > 0) & (F.col("original") - F.col("cleaned") >= 1000)
    zero = F.lit(0).cast("bigint")
    return j.select("call_id", F.col("original").alias("original_ms"), F.when(used, F.col("cleaned")).otherwise(F.col("original")).alias("cleaned_ms"),
                    F.when(used, F.greatest(zero, F.col("original") - F.col("cleaned") - F.col("hold"))).otherwise(zero).alias("dead_air_ms"),
                    F.when(used, F.col("hold")).otherwise(zero).alias("hold_ms"), F.when(used, F.col("segments_stitched")).otherwise(zero).alias("segments_stitched"),
                    used.alias("cleanup_applied"))


def flux_outliers(fr: DataFrame, stats: DataFrame, factor: float = 5.0, near_ms: int = 500, margin_ms: int = 2000) -> DataFrame:
    """Clusters of frames above median + 5 sigma, reported at their middle frame."""
    x = attach(fr.select("call_id", "event_id", "t_ms", "v100", "chunk"), stats.where("n >= 10").select("call_id", "median", "sd", "end_ms"), KEYS, "chunk")
    out = settle(scan(x.where(F.col("v100") > F.col("median") + factor * F.col("sd")), KEYS, "chunk", ORDER, {"prev": ("last", F.col("t_ms"), False)}))
    new = (F.col("prev").isNull() | (F.col("t_ms") - F.col("prev") >= near_ms)).cast("bigint")
    one = F.lit(1).cast("bigint")
    out = settle(scan(out, KEYS, "chunk", ORDER, {"grp": ("sum", new, True), "pos": ("sum", one, False)}))
    g = out.groupBy("call_id", "grp").agg(F.min("pos").alias("p0"), F.count(F.lit(1)).alias("n"), F.max("v100").alias("top"))
    mid = g.withColumn("pos", F.col("p0") + F.floor(F.col("n") / 2))
    c = mid.join(out.select("call_id", "pos", "t_ms", "median", "end_ms"), ["call_id", "pos"])
    dev = F.col("top") / F.greatest(F.col("median"), F.lit(0.01))
    sev = F.when(dev > 10, "high").when(dev > 7, "medium")
    conf = F.when(dev > 10, F.least(F.lit(0.9), dev / 15)).otherwise(F.least(F.lit(0.7), dev / 15))
    keep = (F.col("t_ms") >= margin_ms) & (F.col("t_ms") <= F.col("end_ms") - margin_ms) & sev.isNotNull()
    return c.where(keep).select("call_id", F.lit("spectral_discontinuity").alias("signal_type"), "t_ms", half_up(conf, 3).alias("confidence"), sev.alias("severity"))


def silence_anomalies(r: DataFrame, zero_min_ms: int = 50) -> DataFrame:
    """All-zero gaps between active runs, and gap lengths that vary too much."""
    inner = r.where(~F.col("active") & (F.col("run") > 0) & ~F.col("is_last")).withColumn("d", F.col("end") - F.col("start"))
    zero = inner.where(F.col("all_zero") & (F.col("d") > zero_min_ms)).select(
        "call_id", F.lit("silence_anomaly").alias("signal_type"), F.col("start").alias("t_ms"), F.lit(0.85).alias("confidence"), F.lit("high").alias("severity"))
    some = (F.col("d") > 100) & (F.col("d") < 5000)
    d = F.when(some, F.col("d"))
    g = inner.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.count(d).alias("k"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"))
    mean = F.col("s") / F.col("k")
    cv = F.sqrt(F.greatest(F.col("ss") / F.col("k") - mean * mean, F.lit(0.0))) / mean
    wild = g.where("n >= 5 and k >= 3").withColumn("cv", cv).where("cv > 2").select(
        "call_id", F.lit("silence_anomaly").alias("signal_type"), F.lit(0).cast("bigint").alias("t_ms"), half_up(F.least(F.lit(0.7), F.col("cv") / 4), 3).alias("confidence"),
        F.lit("medium").alias("severity"))
    return zero.unionByName(wild)


def gap_variation(r: DataFrame) -> DataFrame:
    """Number of gaps per call and their coefficient of variation inside (0.1 s, 5 s)."""
    inner = r.where(~F.col("active") & (F.col("run") > 0) & ~F.col("is_last")).withColumn("d", F.col("end") - F.col("start"))
    d = F.when((F.col("d") > 100) & (F.col("d") < 5000), F.col("d"))
    g = inner.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.count(d).alias("k"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"), F.count_if("all_zero").alias("n_zero"))
    mean = F.col("s") / F.col("k")
    cv = F.sqrt(F.greatest(F.col("ss") / F.col("k") - mean * mean, F.lit(0.0))) / mean
    return g.select("call_id", "n_gaps", "n_zero", half_up(cv, 4).alias("cv"), ((F.col("n_gaps") >= 5) & (F.col("k") >= 3) & F.coalesce(cv > 2, F.lit(False))).alias("irregular"))


def sliding(fr: DataFrame, stats: DataFrame, size_ms: int = 5000, hop_ms: int = 2000) -> DataFrame:
    """5th percentile of loudness in windows of 5 s every 2 s that fit into the call."""
    w = fr.groupBy("call_id", F.window(F.timestamp_millis("t_ms"), f"{size_ms} milliseconds", f"{hop_ms} milliseconds")).agg(
        F.percentile("v100", 0.05).alias("noise_floor"), F.count(F.lit(1)).alias("n_frames"))
    w = w.select("call_id", (F.unix_micros("window.start") / 1000).cast("bigint").alias("w_ms"), "noise_floor", "n_frames").where("w_ms >= 0")
    ok = stats.where("end_ms >= 10000").select("call_id", "end_ms")
    return w.join(ok, "call_id").where(F.col("w_ms") < F.col("end_ms") - size_ms)


def noise_floor_outliers(w: DataFrame, limit: Column | float = 3.0) -> DataFrame:
    """Windows whose noise floor is far from the median of the call."""
    w = settle(w.withColumn("chunk", F.floor(F.col("w_ms") / 60_000)))
    med = exact_quantile(w, KEYS, "noise_floor", 0.5, "med")
    sd = w.groupBy(*KEYS).agg(F.stddev_pop("noise_floor").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    x = attach(w, med.join(sd, KEYS), KEYS, "chunk").where("med > 0")
    dev = F.abs(F.col("noise_floor") - F.col("med")) / F.greatest(F.col("sd"), F.col("med") * 0.1)
    lim = F.lit(limit) if isinstance(limit, float) else limit
    return x.withColumn("dev", dev).where(F.col("dev") > lim).select(
        "call_id", F.lit("noise_floor_inconsistency").alias("signal_type"), F.col("w_ms").alias("t_ms"), half_up(F.least(F.lit(0.8), F.col("dev") / 5), 3).alias("confidence"),
        F.when(F.col("dev") < 5, "medium").otherwise("high").alias("severity"))


def corroborated(signals: DataFrame) -> DataFrame:
    """A call with signals of a single type keeps at most medium severity."""
    types = signals.groupBy("call_id").agg(F.count_distinct("signal_type").alias("n_types"))
    x = attach(signals.withColumn("_c", F.floor(F.col("t_ms") / SLICE_MS)), types, KEYS, "_c").drop("_c")
    return x.withColumn("severity", F.when((F.col("n_types") < 2) & (F.col("severity") == "high"), "medium").otherwise(F.col("severity")))


def tamper_risk(signals: DataFrame) -> DataFrame:
    g = signals.groupBy("call_id").agg(F.count_distinct("signal_type").alias("n_types"), F.count_if(F.col("severity") == "high").alias("n_high"), F.count(F.lit(1)).alias("n_signals"))
    t, h, n = F.col("n_types"), F.col("n_high"), F.col("n_signals")
    risk = F.when((t >= 3) & (h >= 2), "high").when((t >= 2) & ((h >= 1) | (n >= 4)), "medium").when(n > 0, "low").otherwise("none")
    return g.withColumn("tamper_risk", risk)


def quality(fr: DataFrame, stats: DataFrame, iv: DataFrame, hnr: Column, clip_at: int = 20_000) -> DataFrame:
    """Quality score: 0.4 SNR, 0.2 each of clipping, speech share and harmonics."""
    x = attach(fr.select("call_id", "v100", "chunk"), stats.select("call_id", "median"), KEYS, "chunk")
    loud = F.col("v100") > F.col("median") * 1.5
    g = x.groupBy("call_id").agg(
        F.sum(F.when(loud, F.col("v100"))).alias("ls"), F.count_if(loud).alias("ln"), F.sum(F.when(~loud, F.col("v100"))).alias("qs"), F.count_if(~loud).alias("qn"),
        (F.count_if(F.col("v100") >= clip_at) * 100 / F.count(F.lit(1))).alias("clip_pct"))
    sp = iv.groupBy("call_id").agg(F.sum(F.col("end") - F.col("start")).alias("speech"))
    j = g.join(stats.select("call_id", "end_ms"), "call_id").join(sp, "call_id", "left")
    tiny = F.lit(1e-10)
    se = F.when(F.col("ln") > 0, F.col("ls") / F.col("ln")).otherwise(tiny)
    ne = F.greatest(F.when(F.col("qn") > 0, F.col("qs") / F.col("qn")).otherwise(tiny), tiny)
    snr = F.greatest(F.lit(0.0), F.least(F.lit(40.0), 10 * F.log10(se / ne)))
    clip = F.col("clip_pct")
    share = F.when(F.col("end_ms") > 0, F.coalesce("speech", F.lit(0)) * 100.0 / F.col("end_ms")).otherwise(0.0)
    j = j.withColumns({"snr_db": snr, "clip": F.when(clip < 0.1, 100.0).when(clip < 0.5, 80.0).when(clip < 2.0, 50.0).otherwise(20.0), "share": share,
                       "hnr": F.when(hnr >= 15, 100.0).when(hnr >= 8, 80.0).when(hnr >= 3, 60.0).when(hnr >= 0, 40.0).otherwise(20.0)})
    sr = F.when(F.col("share") >= 50, 100.0).when(F.col("share") >= 30, 60.0).when(F.col("share") >= 15, 30.0).otherwise(10.0)
    score = F.floor(half_up(F.least(F.lit(100.0), F.col("snr_db") * 5) * 0.4 + F.col("clip") * 0.2 + sr * 0.2 + F.col("hnr") * 0.2, 6))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return j.select("call_id", score.cast("bigint").alias("quality_score"), F.when(score >= 70, "TRUSTWORTHY").when(score >= 40, "DEGRADED").otherwise("UNRELIABLE").alias("quality_flag"),
                    half_up(F.col("snr_db"), 1).alias("snr_db"), half_up(F.col("share"), 1).alias("speech_percentage"), F.col("clip").alias("clipping_score"))


def downsample(fr: DataFrame, blocks: int = 200) -> DataFrame:
    """Equal blocks by position, mean of absolute values, scaled by the largest block."""
    one = F.lit(1).cast("bigint")
    p = scan(fr, KEYS, "chunk", ORDER, {"pos": ("sum", one, False), "n": ("all_sum", one, True)})
    g = p.groupBy("call_id", F.floor(F.col("pos") * blocks / F.col("n")).alias("block")).agg((F.sum(F.abs("v100")) / F.count(F.lit(1))).alias("m"))
    top = F.max("m").over(Window.partitionBy("call_id"))  # at most ``blocks`` rows per call
    return g.select("call_id", "block", half_up(F.col("m") / F.greatest(top, F.lit(0.001)), 4).alias("height"))
