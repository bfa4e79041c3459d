"""Aggregates over frame, spectrum and spectrogram tables; each clip is a group, the transform is an input contract.

frames(clip, channel, frame, samples), spectrum(clip, freq, power), spectrogram(clip, frame, freq, power), curve(clip, t, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import a_weight_db

from .rollup import cumulative_threshold, switch_count


def band_share(spec: DataFrame, clip: str = "clip", bands: tuple[float, float, float] = (20.0, 1000.0, 4000.0)) -> DataFrame:
    """Percent of power under the first limit, and of A-weighted power from the other two up."""
    w = F.col("power") * F.pow(F.lit(10.0), a_weight_db("freq") / 10)
    pct = lambda v, cond: 100 * F.sum(F.when(cond, v).otherwise(0.0)) / F.sum(v)
    low, mid, high = bands
    return spec.groupBy(clip).agg(pct(F.col("power"), F.col("freq") < low).alias("low_pct"), pct(w, F.col("freq") >= mid).alias("mid_pct"), pct(w, F.col("freq") >= high).alias("high_pct"))


def level_variation(frames: DataFrame, clip: str = "clip", samples: str = "samples") -> DataFrame:
    """Population SD over mean of the frames' RMS, and the overall level in dB."""
    sq = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = frames.select(clip, sq.alias("_sq"), F.size(samples).alias("_n")).withColumn("_rms", F.sqrt(F.col("_sq") / F.col("_n")))
    return rows.groupBy(clip).agg((F.stddev_pop("_rms") / F.avg("_rms")).alias("cv"), (10 * F.log10(F.sum("_sq") / F.sum("_n"))).alias("rms_db"))


def stereo_corr(frames: DataFrame, clip: str = "clip", samples: str = "samples") -> DataFrame:
    """Correlation of the two channels over all samples."""
    side = lambda k, n: frames.where(F.col("channel") == k).select(clip, "frame", F.col(samples).alias(n))
    pairs = side(0, "l").join(side(1, "r"), [clip, "frame"]).select(clip, F.explode(F.arrays_zip("l", "r")).alias("s"))
    return pairs.groupBy(clip).agg(F.corr(F.col("s.l").cast("double"), F.col("s.r").cast("double")).alias("stereo_r"))


def tonality(sg: DataFrame, clip: str = "clip", lo: float = 100.0, hi: float = 8000.0) -> DataFrame:
    """Per frame flatness (geometric over arithmetic mean) and peak (max over median) in dB, averaged over frames."""
    p = F.col("power") + 1e-20
    per = sg.where(F.col("freq").between(lo, hi)).groupBy(clip, "frame").agg((10 * F.log10(F.exp(F.avg(F.ln(p))) / F.avg(p))).alias("flat_db"),
        (10 * F.log10(F.max(p) / F.percentile(p, F.lit(0.5)))).alias("peak_db"))
    return per.groupBy(clip).agg(F.avg("flat_db").alias("flat_db"), F.avg("peak_db").alias("peak_db"))


def brightness(spec: DataFrame, clip: str = "clip", share: float = 0.85) -> DataFrame:
    """Spectral centroid and roll-off over 20 Hz to 20 kHz, and tilt: dB per octave over the third-octave bands around
    100 Hz to 10 kHz that have lines (null for three or fewer)."""
    heard = spec.where(F.col("freq").between(20, 20000))
    cent = heard.groupBy(clip).agg((F.sum(F.col("freq") * F.col("power")) / F.sum("power")).alias("centroid"))
    band = F.floor(F.log2(F.col("freq") / 100.0) * 3 + 0.5)
    bands = spec.where("freq > 0").groupBy(clip, band.alias("band")).agg(F.sum("power").alias("p")).where(F.col("band").between(0, 19))
    slope = F.regr_slope(10 * F.log10(F.col("p") + 1e-30), F.col("band") / 3.0)
    tilt = bands.groupBy(clip).agg(F.when(F.count(F.lit(1)) > 3, slope).alias("tilt"))
    return cent.join(cumulative_threshold(heard, [clip], "freq", "power", share), clip).join(tilt, clip, "left")


def hum(sg: DataFrame, clip: str = "clip", line: tuple[float, float] = (30.0, 130.0), floor: tuple[float, float] = (200.0, 2000.0),
    low: tuple[float, float] = (0.0, 200.0), mid: tuple[float, float] = (200.0, 6000.0)) -> DataFrame:
    """From a spectrogram: the strongest line of a low band in the mean spectrum (of equal ones the lowest), its
    prominence in dB over the median of the band `floor`, the power of the band `low` against that of `mid` (sums
    over half-open bands, in dB); the share of frames in which the low band is within 6 dB of its loudest frame, and
    how often it switches on or off: its level against the middle of its 10th and 90th percentile, after a median
    filter of three frames with zero edges; no switches unless these percentiles are more than 6 dB apart."""
    tiny = 1e-20
    db = lambda x: 10 * F.log10(x + tiny)
    inside = lambda b: F.col("freq").between(*b)
    band = lambda b: F.coalesce(F.sum(F.when((F.col("freq") >= b[0]) & (F.col("freq") < b[1]), F.col("power"))), F.lit(0.0))
    mean = sg.groupBy(clip, "freq").agg(F.avg("power").alias("power"))
    top = F.max(F.when(inside(line), F.struct(F.col("power").alias("p"), (-F.col("freq")).alias("neg"))))
    one = mean.groupBy(clip).agg(top.alias("_top"), F.percentile(F.when(inside(floor), F.col("power")), F.lit(0.5)).alias("_med"), band(low).alias("_low"), band(mid).alias("_mid"))
    one = one.select(clip, (-F.col("_top.neg")).alias("line_hz"), (db(F.col("_top.p")) - db(F.col("_med"))).alias("prominence_db"), (db(F.col("_low")) - db(F.col("_mid"))).alias("low_mid_db"))
    frames = sg.where(inside(line)).groupBy(clip, "frame").agg(db(F.sum("power")).alias("_level"))
    limits = frames.groupBy(clip).agg(F.max("_level").alias("_max"), F.percentile("_level", F.lit(0.9)).alias("_hi"), F.percentile("_level", F.lit(0.1)).alias("_lw"))
    frames = frames.join(limits, clip)
    on = frames.groupBy(clip).agg(F.avg((F.col("_level") > F.col("_max") - 6).cast("double")).alias("on_share"), F.first("_hi").alias("_hi"), F.first("_lw").alias("_lw"))
    turns = switch_count(frames, [clip], ["frame"], F.col("_level") > (F.col("_hi") + F.col("_lw")) / 2).select(clip, F.col("switches").alias("_turns"))
    out = one.join(on, clip).join(turns, clip)
    return out.select(clip, "line_hz", "prominence_db", "low_mid_db", "on_share", F.when(F.col("_hi") - F.col("_lw") > 6, F.col("_turns")).otherwise(F.lit(0).cast("long")).alias("switches"))


def curve_percentiles(curve: DataFrame, clip: str = "clip", value: str = "value") -> DataFrame:
    """N5 and N50 (exceeded 5 and 50 % of the time), mean, and the share of segments over zero."""
    return curve.groupBy(clip).agg(F.percentile(value, F.lit(0.95)).alias("n5"), F.percentile(value, F.lit(0.5)).alias("n50"),
        F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("share_pos"))


def channel_mean(df: DataFrame, clip: str, cols: list[str], prefix: str) -> DataFrame:
    return df.groupBy(clip).agg(*(F.avg(c).alias(f"{prefix}{c}") for c in cols))


def label_summary(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*(f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
