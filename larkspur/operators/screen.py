"""Filters, funnels and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.scratch import cut, sent


def valid_responses(df: DataFrame, items: list[str], fold: str = "fold", attention: str = "is_attention") -> DataFrame:
    return df.where(F.col(fold).between(0, 5) & (F.col(attention) == 0)).na.drop(subset=items)


def rated_usable(df: DataFrame, n: str, least: int, score: str, path: str | None = None) -> DataFrame:
    """Rows with at least `least` ratings and a score, and a path where one is named."""
    ok = (F.col(n) >= least) & F.col(score).isNotNull() & ~F.coalesce(F.isnan(F.col(score).cast("double")), F.lit(False))
    return df.where(ok if path is None else ok & F.col(path).isNotNull())


def selection_rule(n_any: Column, tag: Column, k: int, strict: bool = False) -> Column:
    """At least k keyword hits, or the tag and one; strict: the tag and at least k."""
    tagged = F.coalesce(tag, F.lit(False))
    return tagged & (n_any >= k) if strict else (n_any >= k) | (tagged & (n_any >= 1))


def near_level(x: str, levels: list[float], eps: float = 1e-4) -> Column:
    return F.exists(F.array(*map(F.lit, levels)), lambda v: F.abs(F.col(x) - v) < eps)


def any_substring(cols: list[str], words: list[str]) -> Column:
    """Whether the columns' texts, joined by a space and lower-cased, contain one of the words; true without words."""
    hay = F.lower(F.concat_ws(" ", *cols))
    return F.exists(F.array(*map(F.lit, words)), lambda w: hay.contains(F.lower(w))) if words else F.lit(True)


def screen(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop rows that a rule (masker, side; side null: either) names."""
    r = rules.select(F.col("masker").alias("_m"), F.col("side").alias("_s"))
    return df.join(r, (F.col("masker") == F.col("_m")) & (F.col("_s").isNull() | (F.col("side") == F.col("_s"))), "left_anti")


def score_screen(df: DataFrame, scores: DataFrame, key: str, base: str, score: str, max_file: float | None = None, max_base: float | None = None) -> DataFrame:
    """df with `verdict`: unscored if `scores` (key, base, score; several rows a file) doesn't have the row's file, removed if
    the file's largest score or the median over all scores of its base is over a limit, else kept."""
    per_file = scores.where(F.col(score).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(score).alias("_most"))
    per_base = scores.where(F.col(score).isNotNull()).groupBy(F.col(base).alias("_b")).agg(F.percentile(score, F.lit(0.5)).alias("_median"))
    rows = df.join(per_file, F.col(key) == F.col("_k"), "left").join(per_base, F.col(base) == F.col("_b"), "left")
    over = lambda c, limit: F.lit(False) if limit is None else F.coalesce(F.col(c) > limit, F.lit(False))
    verdict = F.when(F.col("_most").isNull(), "unscored").when(over("_most", max_file) | over("_median", max_base), "removed").otherwise("kept")
    return rows.withColumn("verdict", verdict).drop("_k", "_b", "_most", "_median")


def funnel(df: DataFrame, steps: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Per step, over rows that pass it and all before: rows and the sums of the measures; in one pass."""
    aggs, passed, names = [], F.lit(True), []
    for i, (name, cond) in enumerate(steps.items()):
        passed = passed & F.coalesce(cond, F.lit(False))
        names.append(name)
        aggs += [F.count_if(passed).alias(f"n{i}"), *(F.sum(F.when(passed, m)).alias(f"m{i}_{k}") for k, m in measures.items())]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"n{i}").alias("n"), *(F.col(f"m{i}_{k}").alias(k) for k in measures)) for i, n in enumerate(names)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def exact_quantile(df: DataFrame, col: str, q: float, parts: int = 200) -> DataFrame:
    """The interpolated q-quantile of a column as one row, `quantile`: values are counted, cut into ranges, and
    added up range by range, so no task holds all distinct values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.lit(1).alias("_g"), F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows = prefix_sums(value_buckets(counts, ["_g"], "_v", parts), ["_v"], "_n", F.col("bucket"), "_before", ["_g"])
    total = counts.agg(F.sum("_n").alias("_total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("_at", (F.col("_total") - 1) * q)
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    lo, hi = F.floor("_at"), F.ceil("_at")
    ends = rows.agg(F.max(F.when(holds(lo), F.col("_v"))).alias("_a"), F.max(F.when(holds(hi), F.col("_v"))).alias("_b"), F.max(F.col("_at") - lo).alias("_f"))
    return ends.select((F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


def percentile_cut(df: DataFrame, cols: list[str], q: float) -> DataFrame:
    """Rows at or under the q-quantile (interpolated) of every column."""
    cuts = None
    for i, c in enumerate(cols):
        one = exact_quantile(df, c, q).select(F.col("quantile").alias(f"_q{i}"))
        cuts = one if cuts is None else cuts.crossJoin(one)
    ok = F.lit(True)
    for i, c in enumerate(cols):
        ok = ok & (F.col(c) <= F.col(f"_q{i}"))
    return df.join(F.broadcast(cuts)).where(ok).drop(*(f"_q{i}" for i in range(len(cols))))


def any_column_contains(df: DataFrame, word: str) -> Column:
    hit = F.lit(False)
    for c, t in df.dtypes:
        if t == "string":
            hit = hit | F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))
    return hit


def rule_hits(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `rules`, the names of the rules that a row breaks."""
    return df.withColumn("rules", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))))


def rule_counts(hits: DataFrame) -> DataFrame:
    return hits.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that break no rule, rows that do, counts per rule)."""
    hits = rule_hits(df, rules)
    return hits.where(F.size("rules") == 0).drop("rules"), hits.where(F.size("rules") > 0), rule_counts(hits)


def path_rules(path: str) -> dict[str, Column]:
    """What is wrong with a path of one audio file: it is empty, holds a pipe or several file names, or, if none of these,
    a control character. White space at its ends doesn't count."""
    p = F.regexp_replace(F.coalesce(F.col(path), F.lit("")), r"^\s+|\s+$", "")
    times = lambda ext: F.regexp_count(p, F.lit(rf"\.{ext}"))
    single = ~p.contains("|") & (times("wav") == 1) & (times("mp3") <= 1)
    return {
        "empty_path": p == "", "pipe_in_path": p.contains("|"), "multiple_extensions": (times("wav") > 1) | (times("mp3") > 1),
        "suspicious_name": single & p.rlike(r"[\n\r\t\x00]"),
    }


def duration_rules(seconds: str, error: str, expected: float = 10.0, off: float = 1.0) -> dict[str, Column]:
    """A clip that can't be read, is empty, or is more than `off` seconds longer or shorter than expected; one of them."""
    sec, read = F.col(seconds), F.col(error).isNull()
    return {"load_error": ~read, "zero_duration": read & (sec == 0), "wrong_duration": read & (sec != 0) & (F.abs(sec - expected) > off)}


#: Limits of a usable recording, and the category of each rule in the report (all others: Other).
USABLE = {"bytes": 1000, "rate": 44100, "shortest": 9.0, "longest": 11.0, "rms": 0.001, "peak": 0.99, "db": -40.0}
CATEGORY = {
    "wrong_rate": "Wrong sample rate", "wrong_duration": "Wrong duration", "silent": "Silent/low volume", "clipping": "Clipping", "low_loudness": "Low loudness",
    "empty_audio": "Empty audio", "load_error": "Cannot load file",
}


def audio_rules(limits: dict[str, float] = USABLE) -> dict[str, Column]:
    """What is wrong with a recording, by its measures: bytes (null: no such file), error (null: it could be read), samples
    (per channel), channels, rate, rms, peak, has_nan, has_inf. A missing, tiny, unreadable or empty file has that one fault;
    any other may have several. A measure that is null or NaN breaks no limit."""
    c = F.col
    under = lambda x, y: x.isNotNull() & ~F.isnan(x.cast("double")) & (x < y)
    over = lambda x, y: x.isNotNull() & ~F.isnan(x.cast("double")) & (x > y)
    missing, tiny = c("bytes").isNull(), F.coalesce(c("bytes") < limits["bytes"], F.lit(False))
    broken = ~missing & ~tiny & c("error").isNotNull()
    empty = ~missing & ~tiny & ~broken & F.coalesce(c("samples") == 0, F.lit(False))
    sound = ~missing & ~tiny & ~broken & ~empty
    seconds = F.try_divide(c("samples").cast("double"), c("rate"))
    rules = {
        "wrong_rate": c("rate") != limits["rate"], "wrong_duration": under(seconds, limits["shortest"]) | over(seconds, limits["longest"]),
        "silent": under(c("rms"), limits["rms"]), "clipping": over(c("peak"), limits["peak"]), "low_loudness": under(20 * F.log10(c("rms") + 1e-10), limits["db"]),
        "has_nan": c("has_nan"), "has_inf": c("has_inf"), "channel_count": ~c("channels").isin(1, 2),
    }
    return {"no_file": missing, "tiny_file": tiny, "load_error": broken, "empty_audio": empty, **{n: sound & r for n, r in rules.items()}}


def category_counts(hits: DataFrame, category: dict[str, str] = CATEGORY) -> DataFrame:
    """Per category of rules: how many faults there are, and in how many rows."""
    known = F.create_map(*(F.lit(x) for kv in category.items() for x in kv))
    mine = hits.select(F.transform("rules", lambda r: F.coalesce(known[r], F.lit("Other"))).alias("_all"))
    each = F.transform(F.array_distinct("_all"), lambda c: F.struct(c.alias("category"), F.size(F.filter("_all", lambda x: x == c)).alias("n")))
    return mine.select(F.explode(each).alias("e")).groupBy("e.category").agg(F.sum("e.n").alias("faults"), F.count(F.lit(1)).alias("rows"))


def thin(df: DataFrame, by: list[str], n: int, order: list[str]) -> DataFrame:
    """n evenly spaced rows of each group: those at floor(k * (N - 1) / (n - 1))."""
    ranked = places(df, by, order).withColumnsRenamed({"place": "_i", "group_rows": "_n"})
    k = F.ceil(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.floor(k * (F.col("_n") - 1) / (n - 1)) == F.col("_i")
    return ranked.where((F.col("_n") <= n) | hit).drop("_i", "_n")


def prefix_sums(df: DataFrame, order: list[str], value: str, bucket: Column, out: str = "before", by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Sum of value over all rows before each (of its group `by`), in an order whose leading part is `bucket`: sums
    per bucket, their running sum (one row a bucket), then a window inside each bucket. With `total`, also the group's sum."""
    keys = by or []
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    along = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_base"), *([F.sum("_s").over(Window.partitionBy(*(keys or [F.lit(1)]))).alias(total)] if total else []))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [*keys, "_b"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_b", "_base")


#: Rows of a group that one window takes, on average.
ROWS = 50_000


def value_buckets(df: DataFrame, by: list[str], col: str, parts: int = 200) -> DataFrame:
    """df with `bucket`: how many of its group's approximate quantiles lie below the value (null: -1). A group has about one
    bucket for ROWS rows, at most `parts`, so small groups cost no comparisons."""
    marks = [i / parts for i in range(1, parts)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(col, marks, 10 * parts).alias("_every"), F.count(col).alias("_n"))
    step = F.ceil(F.lit(parts) / F.ceil(F.greatest(F.col("_n"), F.lit(1)) / ROWS))
    # few groups are large ones: their cuts are broadcast, so that no task gets all rows of a group
    cuts = sent(cuts.select(*by, F.filter("_every", lambda c, i: (i + 1) % step == 0).alias("_cuts")), 5_000)
    # binary steps over the sorted cuts: the largest number of them that all lie below the value
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(parts.bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("_cuts", n + step - 1) < F.col(col), n + step).otherwise(n))
    at = F.when(F.col(col).isNull() | F.col("_cuts").isNull(), -1).otherwise(below)
    rows = df.join(cuts, by, "left") if by else df.crossJoin(F.broadcast(cuts))
    return rows.withColumn("bucket", at).drop("_cuts")


def places(df: DataFrame, by: list[str], order: list[str], bucket: Column | None = None, parts: int = 200) -> DataFrame:
    """df with `place`, the 0-based number of each row in its group in this order, and `group_rows`. No window has
    more than a bucket of a group: by default buckets are quantile ranges of the first (numeric) order column."""
    rows = value_buckets(df, by, order[0], parts) if bucket is None else df.withColumn("bucket", bucket)
    # the group's size comes with its buckets' sums: a join by group alone would send a whole group to one task
    return prefix_sums(rows.withColumn("_one", F.lit(1)), order, "_one", F.col("bucket"), "place", by, "group_rows").drop("bucket", "_one")


def lookup_default(df: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    return df.join(table, keys, "left").fillna(defaults)


def flag_in(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def paired_delta(df: DataFrame, keys: list[str], level: str, lo, hi, value: str) -> DataFrame:
    """lo, hi and delta per key; keys without both are dropped."""
    at = lambda v: F.avg(F.when(F.col(level) == v, F.col(value)))
    return df.where(F.col(level).isin(lo, hi)).groupBy(*keys).agg(at(lo).alias("lo"), at(hi).alias("hi")).where("lo IS NOT NULL AND hi IS NOT NULL").withColumn("delta", F.col("hi") - F.col("lo"))


def rank_mirror(df: DataFrame, by: list[str], value: str, key: list[str]) -> DataFrame:
    """The i-th lowest row gets the i-th highest value as `mirror`."""
    up = cut(places(df, by, [value, *key]), "places")
    other = up.select(*by, F.col("place").alias("_q"), F.col(value).alias("mirror"))
    return up.withColumn("_q", F.col("group_rows") - 1 - F.col("place")).join(other, [*by, "_q"]).drop("place", "group_rows", "_q")


def complete_candidates(df: DataFrame, keys: list[str], member: str, n: int) -> DataFrame:
    """Keys that occur with all n members, with the sorted members."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(member)).alias("members")).where(F.size("members") == n)


def best_key_match(df: DataFrame, candidates: dict[str, Column], ids: DataFrame, id_col: str, min_share: float) -> DataFrame:
    """The candidate key that finds most of the ids, the first of equal ones: key, found, share, enough."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), c.cast("string").alias("v")) for n, c in candidates.items()))).alias("s")).select("s.*").distinct()
    want = ids.select(F.col(id_col).cast("string").alias("v")).distinct()
    found = stacked.join(want, "v", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("found"))
    total = want.agg(F.count(F.lit(1)).alias("_n"))
    turn = F.array_position(F.array(*map(F.lit, candidates)), F.col("key"))
    top = found.agg(F.max_by(F.struct("key", "found"), F.struct("found", -turn)).alias("b")).select("b.*")
    return top.join(F.broadcast(total)).select("key", "found", (F.col("found") / F.col("_n")).alias("share"), (F.col("found") / F.col("_n") >= min_share).alias("enough"))


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
