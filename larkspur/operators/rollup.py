"""Rollups, cross tabulations, experiment-grid effects and ordered-window measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import fmt2
from larkspur.sources.scratch import cut

from .screen import prefix_sums, value_buckets


def rollup(df: DataFrame, keys: list[str], means: list[str], firsts: list[str] | None = None, order: str | None = None, count: str = "n_ratings") -> DataFrame:
    """Per key: the first value of `firsts` in `order`, the number of rows and the means; null keys are dropped."""
    rows = df.na.drop(subset=keys)
    return rows.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in firsts or []), F.count(F.lit(1)).alias(count), *(F.avg(c).alias(c) for c in means))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).count().fillna(0)


def top_share(df: DataFrame, keys: list[str], col: str, k: int) -> DataFrame:
    """The k most frequent values of each group: value, n, share, place; ties by value."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), col)))
    return ranked.where(F.col("place") <= k)


def top_text(df: DataFrame, keys: list[str], col: str, k: int, share: bool = False, name: str = "top") -> DataFrame:
    """Per group the k most frequent values as one text: "a (12), b (5)", or with share "a 60%, b 25%" of the values that
    aren't null; ties by value."""
    top = top_share(df.where(F.col(col).isNotNull()), keys, col, k)
    pct = F.concat(F.call_function("format_number", 100 * F.col("share"), F.lit("0")), F.lit("%"))
    item = F.concat_ws(" ", F.col(col).cast("string"), pct if share else F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")")))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("t")))), lambda x: x["t"]), ", ").alias(name))


def describe_by(df: DataFrame, keys: list[str], cols: list[str], qs: list[float], exact: bool = True) -> DataFrame:
    """count, mean, sd, extremes and quantiles per group and column, in long form. Exact quantiles are read off the running
    counts of the distinct values, which are cut into ranges, so that no task holds a group's values; exact=False takes
    approximate ones."""
    num = lambda c: F.col(c).cast("double")
    some = lambda c: [f(num(c)).alias(n) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "lo"), (F.max, "hi"))]
    near = lambda c: [] if exact else [F.percentile_approx(num(c), F.lit(x)).alias(f"q{round(100 * x)}") for x in qs]
    flat = df.groupBy(*keys).agg(*(a.alias(f"_{i}_{j}") for i, c in enumerate(cols) for j, a in enumerate([*some(c), *near(c)])))
    names = ["n", "mean", "sd", "lo", "hi", *([] if exact else [f"q{round(100 * x)}" for x in qs])]
    rows = flat.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), *(F.col(f"_{i}_{j}").alias(n) for j, n in enumerate(names))) for i, c in enumerate(cols)))).alias("m")).select(*keys, "m.*")
    if not exact:
        return rows
    long = df.select(*keys, *(num(c).alias(f"_v{i}") for i, c in enumerate(cols))).unpivot([*keys], [f"_v{i}" for i in range(len(cols))], "_m", "_v")
    counts = long.where("_v IS NOT NULL").groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # null keys are groups, so one column that is never null stands for a group
    counts = cut(counts.select(F.to_json(F.struct(*keys)).alias("_g"), "_m", "_v", "_n"), "describe-counts")
    run = prefix_sums(value_buckets(counts, ["_g", "_m"], "_v"), ["_v"], "_n", F.col("bucket"), "_before", ["_g", "_m"])
    run = run.join(counts.groupBy("_g", "_m").agg(F.sum("_n").alias("_all")), ["_g", "_m"])
    at = lambda x: (F.col("_all") - 1) * F.lit(float(x))
    held = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("_v")))
    ends = [f(at(x)) for x in qs for f in (F.floor, F.ceil)]
    got = run.groupBy("_g", "_m").agg(F.max("_all").alias("_all"), *(held(k).alias(f"_e{i}") for i, k in enumerate(ends)))
    share = lambda x: at(x) - F.floor(at(x))
    q = [(F.col(f"_e{2 * i}") * (1 - share(x)) + F.col(f"_e{2 * i + 1}") * share(x)).alias(f"q{round(100 * x)}") for i, x in enumerate(qs)]
    which = F.create_map(*(v for i, c in enumerate(cols) for v in (F.lit(f"_v{i}"), F.lit(c))))
    got = got.select("_g", which[F.col("_m")].alias("metric"), *q)
    return rows.withColumn("_g", F.to_json(F.struct(*keys))).join(got, ["_g", "metric"], "left").drop("_g")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    ok = F.col(value).isNotNull()
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(ok, F.col(weight)))).alias("wmean"), F.avg(value).alias("mean"), F.sum(weight).alias("weight"))


def rating_agreement(df: DataFrame, bin_col: str, listed: str, train: str, rated: str, within: str) -> DataFrame:
    """Per bin: number of files, their mean training rating and mean model rating, each file as often as it is listed, the SD
    of the model ratings over files and the mean SD inside a file. The last row, with a null bin and `overall` true, is over
    all files; bias is the listed mean of model less training rating."""
    rows = df.where(F.col(train).isNotNull() & F.col(rated).isNotNull())
    mean = lambda v: F.try_divide(F.sum(v * F.col(listed)), F.sum(listed))
    aggs = [F.count(F.lit(1)).alias("files"), F.sum(listed).alias("entries"), mean(F.col(train)).alias("train_mean"), mean(F.col(rated)).alias("rated_mean"),
        mean(F.col(rated) - F.col(train)).alias("bias"), F.stddev_samp(rated).alias("rated_sd"), F.avg(within).alias("within_sd")]
    bins = rows.groupBy(F.col(bin_col).alias("bin")).agg(*aggs).withColumn("overall", F.lit(False))
    return bins.unionByName(rows.agg(*aggs).withColumns({"bin": F.lit(None).cast("string"), "overall": F.lit(True)}))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width, right-closed bins over the range; the lowest value belongs to the first."""
    edge = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(col) - F.col("_lo")) / width)))
    return df.where(F.col(col).isNotNull()).join(F.broadcast(edge)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def binned_mean(df: DataFrame, x: str, y: str, lo: float, hi: float, bins: int, least: int) -> DataFrame:
    """Mean of y over equal, left-closed bins of x in [lo, hi); bins of fewer than `least` rows are left out."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(x) - lo) / ((hi - lo) / bins))).cast("int")
    rows = df.where((F.col(x) >= lo) & (F.col(x) < hi) & F.col(y).isNotNull())
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y")).where(F.col("n") >= least)


def text_diversity(df: DataFrame, col: str) -> DataFrame:
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_texts"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"))


def top_words(df: DataFrame, col: str, k: int, longer_than: int = 3, before: str = "[ISOPleasant") -> DataFrame:
    """The k most frequent words of more than `longer_than` characters ahead of the tag, with their number over that of all
    texts, in percent. Words stand between ASCII white space, punctuation included; texts without the tag have none."""
    words = df.where(F.col(col).contains(before)).select(F.explode(F.split(F.lower(F.substring_index(col, before, 1)), r"[ \t-\r]+")).alias("word"))
    top = words.where(F.length("word") > longer_than).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)
    return top.crossJoin(F.broadcast(df.agg(F.count(col).alias("_all")))).select("word", "n", (100 * F.col("n") / F.col("_all")).alias("pct"))


def repeated_texts(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k texts that occur most often, and more than once: text and n; ties by text."""
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").orderBy(F.desc("n"), "text").limit(k)


def seed_sd(df: DataFrame, keys: list[str], group: list[str], value: str) -> DataFrame:
    """Mean over groups of the sample SD; single-row groups say nothing."""
    return df.groupBy(*keys, *group).agg(F.stddev_samp(value).alias("_sd")).groupBy(*keys).agg(F.avg("_sd").alias("seed_sd"))


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The total change, and whether there is one and all steps have its sign."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = df.withColumn("_step", F.col(value) - F.lag(value).over(w))
    g = steps.groupBy(*keys).agg((F.max_by(value, order) - F.min_by(value, order)).alias("effect"), F.collect_list(F.signum("_step")).alias("_s"))
    return g.withColumn("ordered", (F.signum("effect") != 0) & F.forall("_s", lambda s: s == F.signum("effect"))).drop("_s")


def grid_effects(df: DataFrame, grid: list[str], item: str, level: str, metric: str, value: str, k: float = 2.0) -> DataFrame:
    """Per grid, item and metric, over the levels (to 4 decimals) that all items of the grid share: low, high,
    effect, ratio to the seed SD (over all levels, as measured), clear (ratio of at least k) and ordered (all steps
    have the effect's sign). A grid with fewer than two shared levels is left out."""
    df = df.withColumn(level, F.round(level, 4))
    items = df.groupBy(*grid).agg(F.count_distinct(item).alias("_items"))
    shared = df.groupBy(*grid, level).agg(F.count_distinct(item).alias("_with")).join(items, grid).where("_with = _items").select(*grid, level)
    enough = shared.groupBy(*grid).agg(F.count(F.lit(1)).alias("_levels")).where("_levels > 1").select(*grid)
    rows = df.join(shared.join(enough, grid), [*grid, level])
    means = rows.groupBy(*grid, item, metric, level).agg(F.avg(value).alias("_m"))
    eff = monotone(means, [*grid, item, metric], level,
        "_m").join(means.groupBy(*grid, item, metric).agg(F.min_by("_m", level).alias("low"), F.max_by("_m", level).alias("high")), [*grid, item, metric])
    sd = seed_sd(df, [*grid, metric], [item, level], value)
    ratio = F.when(F.col("seed_sd") > 0, F.col("effect") / F.col("seed_sd"))
    return eff.join(sd, [*grid, metric]).withColumn("ratio", ratio).withColumn("clear", F.coalesce(F.abs("ratio") >= k, F.lit(False)))


def effects_summary(eff: DataFrame, keys: list[str]) -> DataFrame:
    return eff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("clear").alias("n_clear"),
        F.count_if(F.col("clear") & F.col("ordered")).alias("n_clear_ordered"),
            F.count_if(F.col("clear") & ~F.col("ordered")).alias("n_clear_unordered"), F.percentile(F.abs("ratio"), F.lit(0.5)).alias("median_ratio"))


def prediction_stability(cube: DataFrame, clip: str, level: str, ckpt: str, value: str, other: str | None = None) -> DataFrame:
    """Mean, SD over all cells, mean over levels of the SD over checkpoints, SD of the level means; with `other`, a
    second way to the same value, also the gap between the two means."""
    per = cube.groupBy(clip, level).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    by = per.groupBy(clip).agg(F.avg("_sd").alias("sd_ckpt"), F.stddev_samp("_m").alias("sd_level"))
    gap = [F.abs(F.avg(value) - F.avg(other)).alias("gap")] if other else []
    return cube.groupBy(clip).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *gap).join(by, clip)


def prediction_spread(outputs: DataFrame, clip: str, value: str, others: list[str] | None = None) -> DataFrame:
    """Per clip, over all outputs of all models: mean and SD of the value (0 for a single output) and means of the others."""
    sd = F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(0.0)
    return outputs.groupBy(clip).agg(F.avg(value).alias("mean"), sd.alias("sd"), *(F.avg(o).alias(o) for o in others or []))


def label_set_scores(probs: DataFrame, key: str, label: str, p: str, sets: dict[str, list[str]]) -> DataFrame:
    """Per key: the largest probability in each label set, and the three likeliest labels with their probability in two
    decimals as text."""
    best = probs.groupBy(key).agg(*(F.max(F.when(F.col(label).isin(names), F.col(p))).alias(s) for s, names in sets.items()))
    w = Window.partitionBy(key).orderBy(F.desc(p), label)
    top = probs.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.concat_ws(" ", label, fmt2(p)).alias("_t")))), lambda x: x["_t"]), "; ").alias("top3"))
    return best.join(top, key)


def group_screen(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in scores for n, q in (("median", 0.5), ("p90", 0.9))))


def threshold_table(df: DataFrame, col: str, thresholds: list[float], weight: str) -> DataFrame:
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return df.where(F.col(col).isNotNull()).select(t, col, weight).groupBy("threshold").agg(F.count_if(F.col(col) >= F.col("threshold")).alias("n"),
        F.sum(F.when(F.col(col) >= F.col("threshold"), F.col(weight)).otherwise(0)).alias("kept"))


def head_tail_mean(df: DataFrame, keys: list[str], step: str, value: str, window: int) -> DataFrame:
    ends = df.groupBy(*keys).agg(F.min(step).alias("_a"), F.max(step).alias("_b"))
    g = df.join(ends, keys).groupBy(*keys).agg(F.avg(F.when(F.col(step) < F.col("_a") + window, F.col(value))).alias("head"),
        F.avg(F.when(F.col(step) > F.col("_b") - window, F.col(value))).alias("tail"))
    return g.withColumn("change", (F.col("tail") - F.col("head")) / F.col("head"))


def combinations(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """The k most frequent combinations of values, ties in the columns' order."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols).limit(k)


def class_means(values: DataFrame, match: DataFrame, key: str, cls: str, cols: list[str], source: list[str] | None = None) -> DataFrame:
    """Mean of each variable per class (and source) over the ids that `match` (key, cls) puts there: class, source,
    metric, n and mean; an id may be in several classes."""
    keys = [cls, *(source or [])]
    long = values.join(match.select(key, cls), key).unpivot([*keys], cols, "metric", "_v")
    return long.groupBy(*keys, "metric").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))


def control_means(df: DataFrame, control: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Mean per item and level, next to the control run's mean at the same level (null where it has none)."""
    base = control.groupBy(level).agg(F.avg(value).alias("control"))
    return df.groupBy(*keys, level).agg(F.avg(value).alias("mean")).join(base, level, "left")


def cluster_agreement(lab: DataFrame, field: DataFrame, cluster: str, targets: list[str], least: int = 5) -> DataFrame:
    """Per target: r of the clusters' mean in the lab set with that in the field set, over clusters with at least
    `least` rated field rows (null for fewer than three clusters)."""
    a = lab.groupBy(cluster).agg(*(F.avg(t).alias(f"_a{i}") for i, t in enumerate(targets)))
    b = field.groupBy(cluster).agg(F.count(targets[0]).alias("_n"), *(F.avg(t).alias(f"_b{i}") for i, t in enumerate(targets))).where(F.col("_n") >= least)
    one = a.join(b, cluster).where("_b0 IS NOT NULL").agg(F.count(F.lit(1)).alias("clusters"), *(F.corr(f"_a{i}", f"_b{i}").alias(f"_r{i}") for i in range(len(targets))))
    cells = F.array(*(F.struct(F.lit(t).alias("target"), F.when(F.col("clusters") >= 3, F.col(f"_r{i}")).alias("r")) for i, t in enumerate(targets)))
    return one.select("clusters", F.explode(cells).alias("c")).select("c.target", "clusters", "c.r")


def paired_profiles(lab: DataFrame, field: DataFrame, cluster: str, targets: list[str], rated: str, lab_label: str, field_label: str, k: int = 3) -> DataFrame:
    """Per cluster of either set: rows of both and rated rows of the field set (`rated` > 0), the targets' means in the lab
    set (lab_<target>) and over rated field rows (field_<target>), and the k most frequent labels of each set as text."""
    name = F.col(cluster).alias("cluster")
    a = lab.groupBy(name).agg(F.count(F.lit(1)).alias("n_lab"), *(F.avg(t).alias(f"lab_{t}") for t in targets))
    own = F.coalesce(F.col(rated) > 0, F.lit(False))
    b = field.groupBy(name).agg(F.count(F.lit(1)).alias("n_field"), F.count_if(own).alias("n_rated"), *(F.avg(F.when(own, F.col(t))).alias(f"field_{t}") for t in targets))
    texts = [top_text(df.select(name, F.col(label).alias("_v")), ["cluster"], "_v", k, share, out) for df, label, share, out in ((lab, lab_label, True, "lab_top"), (field, field_label, False, "field_top"))]
    out = a.join(b, "cluster", "full").join(texts[0], "cluster", "left").join(texts[1], "cluster", "left")
    return out.where("cluster IS NOT NULL").na.fill(0, ["n_lab", "n_field", "n_rated"])


def mean_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half"))
    return g.withColumn("label", F.concat(F.lit("n="), F.col("n").cast("string")))


def mean_embedding(df: DataFrame, key: list[str], vec: str) -> DataFrame:
    """Mean vector of each key's windows, scaled to length one."""
    el = df.select(*key, F.posexplode(vec).alias("i", "x")).groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = el.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_v"))
    return norm.select(*key, F.transform("_v", lambda s: s["x"] / F.col("_n")).alias("embedding"))


def fill(df: DataFrame, keys: list[str], order: list[str], col: str, parts: int = 200) -> DataFrame:
    """Forward, then backward fill. Rows are cut at quantiles of the first (numeric) order column: what a range leaves
    open comes from the ranges around it, so no window runs over a whole group. A row that nothing precedes, in its range or
    before, takes its range's first value; no window looks ahead, which would read the rest of the range for each row."""
    rows = value_buckets(df, keys, order[0], parts).withColumnRenamed("bucket", "_b")
    at = F.when(F.col(col).isNotNull(), F.struct(*order))
    ends = rows.groupBy(*keys, "_b").agg(F.min_by(col, at).alias("_first"), F.max_by(col, at).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_b")
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.join(ends.select(*keys, "_b", "_first", before.alias("_before"), after.alias("_after")), [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    fwd = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(col, F.coalesce(fwd, F.col("_before"), F.col("_first"), F.col("_after"))).select(*(F.col(f"`{c}`") for c in df.columns))


def cumulative_threshold(df: DataFrame, keys: list[str], order: str, value: str, share: float) -> DataFrame:
    """The first position where the running share of the total reaches `share`."""
    w = Window.partitionBy(*keys)
    run = F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(w)
    return df.withColumn("_s", run).groupBy(*keys).agg(F.min(F.when(F.col("_s") >= share, F.col(order))).alias("rolloff"))


def switch_count(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Share of frames that are on, and switches after a median filter of three frames with zero edges."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_f", flag.cast("int"))
    on = (F.coalesce(F.lag("_f").over(w), F.lit(0)) + F.col("_f") + F.coalesce(F.lead("_f").over(w), F.lit(0)) >= 2).cast("int")
    rows = rows.withColumn("_on", on).withColumn("_was", F.lag("_on").over(w))
    return rows.groupBy(*keys).agg(F.avg("_f").alias("on_share"), F.count_if(F.col("_on") != F.col("_was")).alias("switches"))


def avg_rank(col: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean place."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(col)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, col)) - 1) / 2


def pick_low_mid_high(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(value, name))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(name)))
    return r.groupBy(*keys).agg(at(F.lit(1)).alias("low"), at(F.floor(F.col("_n") / 2) + 1).alias("mid"), at(F.col("_n")).alias("high"))


def closest_to_median(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return df.join(med, keys).groupBy(*keys).agg(F.min_by(name, F.struct(F.abs(F.col(value) - F.col("median")), F.col(name))).alias("nearest"), F.first("median").alias("median"))
