"""Scores, bins and numeric expressions: Columns (null in, null out), and a few functions of whole tables at the end."""

from __future__ import annotations

from math import cos, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C45 = cos(pi / 4)
SPAN = 4 + sqrt(32)
# Five pleasantness bins with their upper edges, loudness words with their upper limits.
BIN_EDGES, BINS = [-0.5, -0.15, 0.15, 0.5], ["very_unpleasant", "unpleasant", "neutral", "pleasant", "very_pleasant"]
LOUDNESS5 = ([50, 60, 70, 80], ["quiet", "moderately quiet", "moderately loud", "loud", "very loud"])
LOUDNESS3 = ([60, 70], ["quiet", "moderate", "loud"])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_pleasant(pl, ca, vi, un, mo, an, ev, ch) -> Column:
    """Circumplex pleasantness of the eight 1..5 items."""
    pl, ca, vi, mo, an, ch = map(_c, (pl, ca, vi, mo, an, ch))
    return ((pl - an) + C45 * (ca - ch) + C45 * (vi - mo)) / SPAN


def iso_eventful(pl, ca, vi, un, mo, an, ev, ch) -> Column:
    ca, vi, un, mo, ev, ch = map(_c, (ca, vi, un, mo, ev, ch))
    return ((ev - un) + C45 * (ch - ca) + C45 * (vi - mo)) / SPAN


def iso_pleasant_alt(pl, ca, vi, un, mo, an, ev, ch) -> Column:
    """The other weighting in use, for consistency checks only."""
    pl, ca, vi, mo, an, ch = map(_c, (pl, ca, vi, mo, an, ch))
    return (C45 * (pl - an) + (ca - ch) + C45 * (vi - mo)) / SPAN


def ladder(x, edges: list[float], labels: list[str], closed: str = "right") -> Column:
    """The label of the first edge that x doesn't pass (right: x <= edge, left: x < edge)."""
    x = _c(x)
    out = F.when(x.isNull() | F.isnan(x.cast("double")), None)
    for e, label in zip(edges, labels):
        out = out.when((x <= e) if closed == "right" else (x < e), label)
    return out.otherwise(labels[-1])


def pleasantness_bin(x) -> Column:
    return ladder(x, BIN_EDGES, BINS)


def bin_order(b) -> Column:
    """1..5, for ordering bins."""
    return F.array_position(F.array(*map(F.lit, BINS)), _c(b)).cast("int")


def loudness5(x) -> Column:
    return ladder(x, *LOUDNESS5, closed="left")


def loudness3(x) -> Column:
    return ladder(x, *LOUDNESS3, closed="left")


def a_weight_db(freq) -> Column:
    """A-weighting in dB at a frequency in Hz."""
    f2 = F.pow(F.greatest(_c(freq).cast("double"), F.lit(1e-3)), 2)
    n, a, b, c = 12194.0**2, 20.6**2, 107.7**2, 737.9**2
    return 20 * F.log10(n * f2 * f2 / ((f2 + a) * F.sqrt((f2 + b) * (f2 + c)) * (f2 + n))) + 2.0


def spl_factor(rms, spl) -> Column:
    """Factor that scales a signal of this rms to a sound pressure level in dB."""
    return 20e-6 * F.pow(F.lit(10.0), _c(spl) / 20) / _c(rms)


def db(power) -> Column:
    return 10 * F.log10(_c(power))


def nearest_label(x, levels: list[float], words: list[str]) -> Column:
    """The word of the nearest level; of two as near, the first."""
    near = F.array(*(F.struct(F.abs(_c(x) - lv).alias("d"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, (lv, w) in enumerate(zip(levels, words))))
    return F.when(_c(x).isNotNull(), F.array_min(near)["w"])


def argmax_label(cols: list[str]) -> Column:
    """The name of the largest column; of equal ones, the first."""
    return F.array_max(F.array(*(F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("w")) for i, c in enumerate(cols))))["w"]


def order_key(seed: int, *cols) -> Column:
    """The pseudo-random order of sampling: md5 of the seed and the key, equal on every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(_c(c).cast("string") for c in cols)))


def hash_int(seed: int, *cols) -> Column:
    """0 .. 2**32 - 1 from the order key."""
    return F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("long")


def rint(x) -> Column:
    """Half-even rounding to a whole number."""
    return F.rint(_c(x)).cast("long")


#: The seven predictors of a recording, in order.
PSYCHO = ["LA50", "LA10_LA90", "LC50_LA50", "N5", "R", "FS", "T"]


def psycho(df: DataFrame, mapping: dict[str, str | tuple[str, str]], keep: list[str]) -> DataFrame:
    """`keep` and the seven predictors of one source's schema: a column, or the difference of a pair of columns."""
    of = lambda m: (_c(m) if isinstance(m, str) else _c(m[0]) - _c(m[1])).cast("double")
    return df.select(*keep, *(of(mapping[p]).alias(p) for p in PSYCHO))


def durations(df: DataFrame, span: str, rate: float = 44100.0) -> DataFrame:
    """df with dur_known and dur: seconds from the text "(start, end)" in samples, the mean of the known ones where
    there is none."""
    num = lambda k: F.regexp_extract(span, r"\((\d+), ?(\d+)\)", k).try_cast("long")
    rows = df.withColumn("_sec", (num(2) - num(1)) / rate)
    mean = rows.agg(F.avg("_sec").alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("dur_known", F.col("_sec").isNotNull()).withColumn("dur", F.coalesce("_sec", "_mean")).drop("_sec", "_mean")


def min_max(df: DataFrame, col: str, limit: float = 1.5) -> DataFrame:
    """df with `col` scaled to 0..1 by its range if its largest value is over `limit`, else as it is."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    scaled = F.when(F.col("_hi") > limit, (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(col))
    return df.crossJoin(F.broadcast(ends)).withColumn(col, scaled).drop("_lo", "_hi")
