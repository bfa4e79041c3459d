"""Correlations, bootstrap intervals, tests and fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.scratch import SMALL, cut

from .resample import resampled_sums
from .rollup import avg_rank
from .screen import prefix_sums, value_buckets


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str, parts: int = 200) -> DataFrame:
    """counts: distinct values of each group with their number of rows. Adds `rank`, the mean place of a value's
    rows: the values are cut at approximate quantiles, so no window has much more than screen.ROWS of them."""
    out = prefix_sums(value_buckets(counts, keys, value, parts), [value], n, F.col("bucket"), "_before", keys)
    return out.withColumn("rank", F.col("_before") + (F.col(n) + 1) / 2).drop("_before", "bucket")


#: Values with more than one in HOT of all rows are broadcast with their rank: fewer than HOT of them.
HOT = 1_000
#: Pairs of values of a group that one window ranks at most.
WINDOW = 500_000


def _join_rank(rows: DataFrame, ranks: DataFrame, keys: list[str], name: str, distinct: int, total: int) -> DataFrame:
    """rows with `name` from ranks (keys, _n, name): by broadcast where its rows are few; else those of common values are, and
    the others meet by shuffle."""
    if distinct <= SMALL:
        return rows.join(F.broadcast(ranks.drop("_n")), keys)
    many = total / HOT
    rows = rows.join(F.broadcast(ranks.where(F.col("_n") > many).select(*keys, F.col(name).alias("_hot"))), keys, "left")
    rare = rows.where("_hot IS NULL").drop("_hot").join(ranks.where(F.col("_n") <= many).drop("_n"), keys)
    return rows.where("_hot IS NOT NULL").withColumnRenamed("_hot", name).unionByName(rare)


def _with_rank(rows: DataFrame, counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the average rank of their value among its group's rows. counts: keys, value, _n."""
    ranks = cut(average_ranks(counts, keys, value, "_n").select(*keys, value, "_n", F.col("rank").alias(name)), "ranks")
    distinct, total = ranks.agg(F.count(F.lit(1)), F.sum("_n")).first()
    return _join_rank(rows, ranks, [*keys, value], name, distinct, total or 0)


def _weighted_corr(x: str, y: str, n: str) -> Column:
    """Correlation of x and y over rows that stand for n each; null where one is constant."""
    w, a, b = F.sum(n), F.col(x) * F.col(n), F.col(y) * F.col(n)
    spread = lambda c, v: F.sum(v * F.col(c)) - F.sum(v) * F.sum(v) / w
    return F.try_divide(F.sum(a * F.col(y)) - F.sum(a) * F.sum(b) / w, F.sqrt(F.greatest(F.lit(0.0), spread(x, a) * spread(y, b))))


def spearman_by(df: DataFrame, keys: list[str], x: str, y: str, min_levels: int = 2) -> DataFrame:
    """Rank correlation per group; groups that are constant in x or y, or have few levels of x, are left out. Rows are
    counted by pair of values first. Groups of up to WINDOW pairs are ranked by a window; if there is a larger one, no task
    ranks a whole group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = cut(rows.groupBy("_k", "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "value-pairs")
    ranked, most = pairs, pairs.groupBy("_k").count().agg(F.max("count")).first()[0] or 0
    for v in ("_x", "_y"):
        if most <= WINDOW:
            # rows up to this value, less half of those that share it
            upto, same = Window.partitionBy("_k").orderBy(v), Window.partitionBy("_k", v)
            ranked = ranked.withColumn(f"_r{v}", F.sum("_n").over(upto) - (F.sum("_n").over(same) - 1) / 2)
        else:
            ranked = _with_rank(ranked, pairs.groupBy("_k", v).agg(F.sum("_n").alias("_n")), ["_k"], v, f"_r{v}")
    g = ranked.groupBy("_k").agg(_weighted_corr("_r_x", "_r_y", "_n").alias("rho"), F.sum("_n").alias("n"), F.count_distinct("_x").alias("_lx"), F.count_distinct("_y").alias("_ly"))
    return g.where((F.col("_lx") >= min_levels) & (F.col("_ly") > 1)).select("_k.*", "rho", "n")


def sign_counts(df: DataFrame, keys: list[str], rho: str = "rho") -> DataFrame:
    """Groups with a positive and with a negative correlation, and the mean; what is 0 but for the noise of its sums
    has no sign."""
    sign = F.signum(F.round(rho, 12))
    return df.groupBy(*keys).agg(F.count_if(sign > 0).alias("n_pos"), F.count_if(sign < 0).alias("n_neg"), F.avg(rho).alias("mean_rho"))


def spearman_matrix(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """Long matrix x, y, rho, n over complete rows: all columns are ranked by the counts of their values, the ranks go
    back to the rows column by column, then all pairs are one aggregate."""
    cols = list(dict.fromkeys([*xs, *ys]))
    rows = df.na.drop(subset=cols).select(*(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)))
    counts = cut(rows.unpivot([], [f"_v{i}" for i in range(len(cols))], "_c", "_v").groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ranks = cut(average_ranks(counts, ["_c"], "_v", "_n").select("_c", "_v", "_n", "rank"), "ranks")
    sizes = {r["_c"]: (r["d"], r["t"]) for r in ranks.groupBy("_c").agg(F.count(F.lit(1)).alias("d"), F.sum("_n").alias("t")).collect()}  # a row a column
    for i in range(len(cols)):
        mine = ranks.where(F.col("_c") == f"_v{i}").select(F.col("_v").alias(f"_v{i}"), "_n", F.col("rank").alias(f"_rank{i}"))
        rows = _join_rank(rows, mine, [f"_v{i}"], f"_rank{i}", *sizes.get(f"_v{i}", (0, 0)))
    pairs = [(x, y) for x in xs for y in ys]
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *(F.corr(f"_rank{cols.index(x)}", f"_rank{cols.index(y)}").alias(f"c{i}") for i, (x, y) in enumerate(pairs)))
    return wide.select("n", F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("rho")) for i, (x, y) in enumerate(pairs)))).alias("m")).select("m.*", "n")


#: Lanczos coefficients of the log-gamma function (g = 7).
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
]
#: Terms of the continued fraction: beyond the largest degrees of freedom's need, by the reflection below.
TERMS = 400


def log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 0.5."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + k)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def beta_fraction(x: Column, a: Column, b: Column, terms: int = TERMS) -> Column:
    """The continued fraction of the incomplete beta function as a fold over its terms, by Lentz's method: the fraction,
    its ratios of numerators and of denominators are the fold's state."""
    keep = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    state = lambda h, c, d: F.struct(h.alias("h"), c.alias("c"), d.alias("d"))

    def step(s: Column, n: Column) -> Column:
        m = n.cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def half(s: Column, num: Column) -> Column:
            d, c = 1 / keep(1 + num * s["d"]), keep(1 + num / s["c"])
            return state(s["h"] * c * d, c, d)

        return F.aggregate(F.array(even, odd), s, half)

    first = 1 / keep(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), state(first, F.lit(1.0), first), step, lambda s: s["h"])


def t_two_sided(t: Column, df: Column, terms: int = TERMS) -> Column:
    """Two-sided p of Student's t with df degrees of freedom: the regularised incomplete beta function."""
    df, square = df.cast("double"), t * t
    x, a, b = df / (df + square), df / 2, F.lit(0.5)
    # the fraction converges quickly on the side of the mean; the other side is one less that
    swap = x > (a + 1) / (a + b + 2)
    u, p, q = F.when(swap, square / (df + square)).otherwise(x), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    # what is used more than once is bound by a lambda, so that it is computed once
    bound = F.struct(u.alias("u"), p.alias("p"), q.alias("q"), swap.alias("swap"))

    def value(v: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + v["p"] * F.ln(v["u"]) + v["q"] * F.log1p(-v["u"])) / v["p"]
        part = front * beta_fraction(v["u"], v["p"], v["q"], terms)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v["swap"], 1 - part).otherwise(part)))

    return F.when(t == 0, 1.0).otherwise(F.get(F.transform(F.array(bound), value), 0))


def correlation_p(df: DataFrame, r: str = "rho", n: str = "n") -> DataFrame:
    """t statistic and two-sided p of a correlation; null where |r| is 1 or n below 3."""
    t = F.col(r) * F.sqrt((F.col(n) - 2) / (1 - F.col(r) * F.col(r)))
    out = df.withColumn("t", F.when((F.abs(r) < 1) & (F.col(n) > 2), t))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided(F.abs("t"), F.col(n) - 2)))


def adjust_p(df: DataFrame, keys: list[str], p: str, method: str, tie: list[str]) -> DataFrame:
    """Benjamini-Hochberg (bh) or Bonferroni adjustment within each family, and stars. For report tables: a family is one
    task's rows."""
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    m = F.count(p).over(w)
    if method == "bonferroni":
        adj = F.least(F.lit(1.0), F.col(p) * m)
        out = df.withColumn("p_adj", adj)
    else:
        ranked = df.withColumn("_q", F.col(p) * m / F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *tie)))
        out = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.col(p).desc_nulls_first(), *(F.desc(x) for x in tie)).rowsBetween(Window.unboundedPreceding, 0)))).drop("_q")
    return out.withColumn("stars", F.when(F.col("p_adj") < 0.001, "***").when(F.col("p_adj") < 0.01, "**").when(F.col("p_adj") < 0.05, "*").otherwise(""))


def matrix_similarity(a: DataFrame, b: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Rank correlation of cells, sign agreement, slope of b on a, mean absolute difference. For report tables: all cells
    are one task's rows."""
    j = a.select(*cell, F.col(value).alias("_a")).join(b.select(*cell, F.col(value).alias("_b")), cell).where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("_k", F.lit(1))
    r = j.withColumn("_ra", avg_rank("_a", ["_k"])).withColumn("_rb", avg_rank("_b", ["_k"]))
    return r.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"),
        F.avg((F.signum("_a") == F.signum("_b")).cast("double")).alias("same_sign"), F.regr_slope("_b", "_a").alias("slope"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mad"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, n: int, seed: int, order: list[str]) -> DataFrame:
    """Mean and 95 % interval from n resamples of each group's rows with replacement; `order` is the rows' key."""
    reps = resampled_sums(df, keys, {"_s": F.col(value)}, n, seed, order).withColumn("_m", F.col("_s") / F.col("_n"))
    ci = reps.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))
    return _beside(df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n")), ci, keys)


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row a group side by side; null keys meet."""
    right = b.withColumnsRenamed({k: f"_of{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return a.join(right, on).drop(*(f"_of{i}" for i in range(len(keys))))


def moments(x: str, y: str) -> list[Column]:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return [F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]


def corr_of_moments(sx: str = "sx", sy: str = "sy", sxx: str = "sxx", syy: str = "syy", sxy: str = "sxy") -> Column:
    """Correlation by sums; null without spread."""
    n, sx, sy, sxx, syy, sxy = map(F.col, ("n", sx, sy, sxx, syy, sxy))
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(F.lit(0.0), (n * sxx - sx * sx) * (n * syy - sy * sy))))


def _cluster_reps(df: DataFrame, cluster: str, sums: list[Column], n: int, seed: int) -> DataFrame:
    """Resamples of moment sums over drawn clusters: a cluster's sums are added as often as it is drawn, never its rows."""
    per = cut(df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*sums), "clusters")
    cols = [c for c in per.columns if c != cluster]
    # the number of rows is one of the moments, so the number of draws stays apart
    reps = resampled_sums(per, [], {f"_sum_{c}": F.col(c) for c in cols}, n, seed, [cluster])
    return reps.select("rep", *(F.col(f"_sum_{c}").alias(c) for c in cols))


def cluster_bootstrap(df: DataFrame, cluster: str, x: str, y: str, n: int, seed: int) -> DataFrame:
    """r and its 95 % interval over resampled clusters; resamples without spread have no r."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    reps = _cluster_reps(rows, cluster, moments(x, y), n, seed).withColumn("r", corr_of_moments())
    ci = reps.agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"))
    return rows.agg(*moments(x, y)).select(corr_of_moments().alias("r"), "n").join(F.broadcast(ci))


def paired_bootstrap(df: DataFrame, cluster: str, obs: str, a: str, b: str, n: int, seed: int) -> DataFrame:
    """a's R2 and correlation with the observed less b's, over the same resampled clusters: diff, lo, hi, p of R2 and
    dr, dr_lo, dr_hi, dr_p of the correlation; p is two-sided."""
    o, pa, pb = (F.col(c).cast("double") for c in (obs, a, b))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(o).alias("so"), F.sum(o * o).alias("soo"), F.sum((o - pa) * (o - pa)).alias("ea"), F.sum((o - pb) * (o - pb)).alias("eb")]
    for c, p in (("a", pa), ("b", pb)):
        sums += [F.sum(p).alias(f"s{c}"), F.sum(p * p).alias(f"s{c}{c}"), F.sum(o * p).alias(f"so{c}")]
    d = F.try_divide(F.col("eb") - F.col("ea"), F.col("soo") - F.col("so") * F.col("so") / F.col("n"))
    r = lambda c: corr_of_moments("so", f"s{c}", "soo", f"s{c}{c}", f"so{c}")
    both = {"d": d, "dr": r("a") - r("b")}
    rows = df.na.drop(subset=[obs, a, b])
    reps = _cluster_reps(rows, cluster, sums, n, seed).withColumns(both)

    def interval(c: str, lo: str, hi: str, p: str) -> list[Column]:
        below, above = F.avg((F.col(c) <= 0).cast("double")), F.avg((F.col(c) >= 0).cast("double"))
        return [F.percentile(c, F.lit(0.025)).alias(lo), F.percentile(c, F.lit(0.975)).alias(hi), F.least(F.lit(1.0), 2 * F.least(below, above)).alias(p)]

    ci = reps.agg(*interval("d", "lo", "hi", "p"), *interval("dr", "dr_lo", "dr_hi", "dr_p"))
    return rows.where(F.col(cluster).isNotNull()).agg(*sums).select(d.alias("diff"), both["dr"].alias("dr")).join(F.broadcast(ci))


def gap_bootstrap(a: DataFrame, b: DataFrame, keys: list[str], value: str, n: int, seed: int, order: list[str]) -> DataFrame:
    """Mean of a minus mean of b per group with a 95 % interval; both sides are resampled."""
    reps = [resampled_sums(d, keys, {"_s": F.col(value)}, n, seed + i, order).select(*keys, "rep", (F.col("_s") / F.col("_n")).alias(f"_m{i}")) for i, d in enumerate((a, b))]
    ci = _beside(reps[0], reps[1], [*keys, "rep"]).withColumn("_d", F.col("_m0") - F.col("_m1"))
    ci = ci.groupBy(*keys).agg(F.percentile("_d", F.lit(0.025)).alias("lo"), F.percentile("_d", F.lit(0.975)).alias("hi"))
    mean = _beside(a.groupBy(*keys).agg(F.avg(value).alias("_a")), b.groupBy(*keys).agg(F.avg(value).alias("_b")), keys)
    return _beside(mean.select(*keys, (F.col("_a") - F.col("_b")).alias("gap")), ci, keys)


def line_fit(df: DataFrame, keys: list[str], x: str, y: str, lo: float, hi: float) -> DataFrame:
    """Slope, intercept, r2 and the expected change between two levels."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")).withColumn("expected", F.col("slope") * (hi - lo))


def within_group_rho(df: DataFrame, group: str, x: str, y: str, min_n: int) -> DataFrame:
    return spearman_by(df, [group], x, y).where(F.col("n") >= min_n).agg(F.percentile("rho", F.lit(0.5)).alias("median_rho"), F.count(F.lit(1)).alias("groups"))


def eta_squared(df: DataFrame, group: str, y: str) -> DataFrame:
    """Share of variance between groups, adjusted (null if every row is a group of its own), and the SD within."""
    g = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    total, within = F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("ss") - F.col("b")
    eta, free = 1 - F.try_divide(within, total), F.col("n") - F.col("k")
    adjusted = 1 - F.try_divide((1 - eta) * (F.col("n") - 1), free)
    return t.select("n", "k", eta.alias("eta2"), adjusted.alias("eta2_adj"), F.sqrt(F.greatest(F.lit(0.0), within) / F.greatest(free, F.lit(1))).alias("sd_within"))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    a, b, c = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    return df.na.drop(subset=[x, y, z]).agg(((a - b * c) / F.sqrt((1 - b * b) * (1 - c * c))).alias("partial_r"))


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve per group, by the rank sum over distinct scores; groups with one class are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    at = rows.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))
    g = average_ranks(at, keys, score, "_n").groupBy(*keys).agg(
        F.sum("_p").alias("n_pos"), F.sum(F.col("_n") - F.col("_p")).alias("n_neg"), F.sum(F.col("_p") * F.col("rank")).alias("_s")
    ).where("n_pos > 0 AND n_neg > 0")
    return g.withColumn("auc", (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).drop("_s")


def ks(df: DataFrame, keys: list[str], is_a: Column, value: str, least: int = 5) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group, from running sums of the two samples over distinct values, range
    by range; null where a side has fewer than `least` rows. The last row, with null keys and `overall` true, is over all
    rows (null keys of the data are a group of their own, `overall` false)."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_a", is_a.cast("int"))
    at = rows.groupBy(F.struct(F.lit(False).alias("overall"), *keys).alias("_k"), value).agg(F.sum("_a").alias("_na"), F.sum(1 - F.col("_a")).alias("_nb"))
    none = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    every = rows.groupBy(value).agg(F.sum("_a").alias("_na"), F.sum(1 - F.col("_a")).alias("_nb"))
    at = at.unionByName(every.select(F.struct(F.lit(True).alias("overall"), *none).alias("_k"), value, "_na", "_nb"))
    return _ks(at, value, least).select("_k.*", "ks", "n_a", "n_b")


def _ks(at: DataFrame, value: str, least: int) -> DataFrame:
    """at: _k, value, _na, _nb (rows of either sample with that value)."""
    keys = ["_k"]
    totals = at.groupBy(*keys).agg(F.sum("_na").alias("n_a"), F.sum("_nb").alias("n_b"))
    at = value_buckets(at.join(totals, keys), keys, value)
    for side in "ab":
        at = prefix_sums(at, [value], f"_n{side}", F.col("bucket"), f"_r{side}", keys)
    share = lambda side: F.try_divide(F.col(f"_r{side}") + F.col(f"_n{side}"), F.col(f"n_{side}"))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return at.groupBy(*keys).agg(F.max(F.when(enough, F.abs(share("a") - share("b")))).alias("ks"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def fit_quality(df: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """R2, R2 after removing the bias, bias, r, RMSE and the ratio of spreads."""
    o, p = F.col(obs), F.col(pred)
    g = df.na.drop(subset=[obs, pred]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p - o).alias("bias"),
        F.avg((o - p) * (o - p)).alias("_mse"), F.var_pop(obs).alias("_v"), F.corr(obs, pred).alias("r"), (F.stddev_samp(pred) / F.stddev_samp(obs)).alias("spread"))
    return g.select(*keys, "n", "bias", "r", "spread", (1 - F.col("_mse") / F.col("_v")).alias("r2"),
        (1 - (F.col("_mse") - F.col("bias") * F.col("bias")) / F.col("_v")).alias("r2_centred"), F.sqrt("_mse").alias("rmse"))


def agreement(df: DataFrame, obs: str, pred: str, place: str) -> DataFrame:
    """One row: n, r and rank correlation of prediction and observation, r of their means by place (null for fewer than three
    places), number of places, bias and ratio of spreads."""
    rows = df.na.drop(subset=[obs, pred]).select(F.col(obs).cast("double").alias("_o"), F.col(pred).cast("double").alias("_p"), F.col(place).alias("_at"), F.lit(1).alias("_all"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.corr("_o", "_p").alias("r"), F.avg(F.col("_p") - F.col("_o")).alias("bias"), F.try_divide(F.stddev_samp("_p"), F.stddev_samp("_o")).alias("spread"))
    means = rows.where("_at IS NOT NULL").groupBy("_at").agg(F.avg("_o").alias("_o"), F.avg("_p").alias("_p"))
    places = means.agg(F.count(F.lit(1)).alias("n_places"), F.when(F.count(F.lit(1)) > 2, F.corr("_o", "_p")).alias("r_place"))
    rho = spearman_by(rows, ["_all"], "_o", "_p").agg(F.max("rho").alias("rho"))
    return one.crossJoin(F.broadcast(places)).crossJoin(F.broadcast(rho)).select("n", "r", "rho", "r_place", "n_places", "bias", "spread")


def stability_rule(full: DataFrame, other: DataFrame, keys: list[str], key: str, pred: str, obs: str, min_r: float, max_shift: float, max_drop: float) -> DataFrame:
    """Per condition, on shared ids: correlation with the full condition, mean shift, change in r with the observed; passed
    if the first is high enough, the shift small enough, and r drops by max_drop at most (it may rise)."""
    j = other.select(*keys, key, F.col(pred).alias("_p"), F.col(obs).alias("_o")).join(full.select(key, F.col(pred).alias("_f")), key)
    g = j.groupBy(*keys).agg(F.corr("_p", "_f").alias("r_full"), F.avg(F.col("_p") - F.col("_f")).alias("shift"), (F.corr("_p", "_o") - F.corr("_f", "_o")).alias("dr"))
    return g.withColumn("passed", (F.col("r_full") >= min_r) & (F.abs("shift") <= max_shift) & (F.col("dr") >= -max_drop))


def paired_losses(df: DataFrame, item: str, cond: str, loss: str, base: str, keys: list[str], others: list[str], reps: int = 0, seed: int = 0) -> DataFrame:
    """Mean difference to the base condition, and the share over zero, per other condition and subset; with reps
    also the mean's 95 % interval from so many resamples of the items."""
    wide = df.groupBy(*keys, item).agg(F.avg(F.when(F.col(cond) == base, F.col(loss))).alias("_b"), *(F.avg(F.when(F.col(cond) == o, F.col(loss))).alias(f"_o{i}") for i, o in enumerate(others)))
    diffs = F.array(*(F.struct(F.lit(o).alias("condition"), (F.col(f"_o{i}") - F.col("_b")).alias("d")) for i, o in enumerate(others)))
    long = wide.select(*keys, item, F.explode(diffs).alias("m")).select(*keys, item, "m.*").where("d IS NOT NULL")
    by = [*keys, "condition"]
    out = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.avg((F.col("d") > 0).cast("double")).alias("share_worse"))
    return out.join(bootstrap_mean(long, by, "d", reps, seed, [item]).select(*by, "lo", "hi"), by) if reps else out


def prompt_effect(df: DataFrame, prompt: str, level: str, score: str, least: int = 3) -> DataFrame:
    """Per prompt of at least `least` rows: rank correlation of level and score (0 where one is constant), its two-sided p
    (1 there) and the number of rows."""
    rows = df.where(F.col(level).isNotNull() & F.col(score).isNotNull()).select(prompt, level, score)
    sized = rows.groupBy(prompt).agg(F.count(F.lit(1)).alias("n_levels")).where(F.col("n_levels") >= least)
    rho = correlation_p(spearman_by(rows, [prompt], level, score)).select(F.col(prompt).alias("_of"), "rho", "p")
    p = F.when(F.col("rho").isNull(), 1.0).when(F.abs("rho") >= 1, 0.0).otherwise(F.col("p"))
    return sized.join(rho, F.col(prompt).eqNullSafe(F.col("_of")), "left").select(prompt, F.coalesce("rho", F.lit(0.0)).alias("rho"), p.alias("p"), "n_levels")


def effect_summary(effects: DataFrame, rho: str = "rho") -> DataFrame:
    """Mean correlation over prompts, its standard error, 95 % interval and size (large, medium, small)."""
    g = effects.agg(F.count(rho).alias("prompts"), F.avg(rho).alias("mean_r"), (F.stddev_samp(rho) / F.sqrt(F.count(rho))).alias("se_r"))
    size = F.when(F.abs("mean_r") > 0.5, "large").when(F.abs("mean_r") > 0.3, "medium").otherwise("small")
    return g.select("*", (F.col("mean_r") - 1.96 * F.col("se_r")).alias("ci_lower"), (F.col("mean_r") + 1.96 * F.col("se_r")).alias("ci_upper"), size.alias("effect_size"))


def source_independence(df: DataFrame, level: str, sources: list[str], limit: float = 0.3) -> DataFrame:
    """Per source score: its rank correlation with the level over all rows (0 where one is constant), and whether it is
    independent of it."""
    scores = F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).cast("double").alias("_v")) for s in sources))
    long = df.select(F.col(level).cast("double").alias("_l"), F.explode(scores).alias("m")).select("_l", "m.*")
    names = long.select("source").distinct()
    rho = spearman_by(long, ["source"], "_l", "_v").select("source", "rho")
    out = names.join(rho, "source", "left").select("source", F.coalesce("rho", F.lit(0.0)).alias("rho"))
    return out.withColumn("independent", F.abs("rho") < limit)


def adherence(df: DataFrame, similarity: str) -> DataFrame:
    """Mean and population SD of the similarity of texts and sounds, and its quality (good, fair, poor)."""
    g = df.agg(F.avg(similarity).alias("mean_similarity"), F.stddev_pop(similarity).alias("std_similarity"))
    return g.withColumn("quality", F.when(F.col("mean_similarity") > 0.25, "good").when(F.col("mean_similarity") > 0.15, "fair").otherwise("poor"))


def recognition_matrix(df: DataFrame, scores: list[str], items: list[str]) -> DataFrame:
    """r of every score with every item, in one aggregate: score, item, r."""
    pairs = [(a, b) for a in scores for b in items]
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("score"), F.lit(b).alias("item"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(cells).alias("m")).select("m.*")


def effect_against_fit(train: DataFrame, gen: DataFrame, keys: list[str], x: str, y: str, level: str, value: str, pair: list[str], lo: float,
    hi: float, band: tuple[float, float] = (0.5, 0.9)) -> DataFrame:
    """Per key: the line of y on x in train and its expected change from lo to hi, the difference of train's extreme
    groups (|x| within `band`), the mean paired change of gen's value between the levels, its ratio to the expected
    one, and gen's bias against the line at lo, 0 and hi."""
    near, far = band
    side = lambda a, b: F.avg(F.when(F.col(x).between(a, b), F.col(y)))
    fit = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (side(near, far) - side(-far, -near)).alias("extreme_delta")
    ).withColumn("expected", F.col("slope") * (hi - lo))
    at = lambda v: F.avg(F.when(F.col(level) == v, F.col(value)))
    pairs = gen.groupBy(*keys, *pair).agg(at(lo).alias("_lo"), at(hi).alias("_hi")).where("_lo IS NOT NULL AND _hi IS NOT NULL")
    delta = pairs.groupBy(*keys).agg(F.avg(F.col("_hi") - F.col("_lo")).alias("generated"), F.count(F.lit(1)).alias("n_pairs"))
    means = gen.groupBy(*keys).agg(at(lo).alias("_a"), at(0.0).alias("_b"), at(hi).alias("_c"))
    out = fit.join(delta, keys).join(means, keys).withColumn("ratio", F.when(F.abs("expected") > 1e-9, F.col("generated") / F.col("expected")))
    bias = {"bias_lo": ("_a", lo), "bias_mid": ("_b", 0.0), "bias_hi": ("_c", hi)}
    out = out.withColumns({n: F.col(c) - (F.col("intercept") + F.col("slope") * at_) for n, (c, at_) in bias.items()})
    return out.drop("_a", "_b", "_c")
