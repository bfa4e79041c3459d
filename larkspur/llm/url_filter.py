"""URL filters: longest-match host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are counted over all URLs
on which a rule decides (grouped aggregation; all orders at once). Every context is kept: the counts stay
a table of the cluster, and each URL's (context, next) positions are joined to it. Smoothing interpolates
each order with the one below by Witten-Bell weights; a context that a model has not seen says what its
longest seen suffix says. A URL without a rule is judged by its log-likelihood difference per character
against a threshold. For that, models of the other rule-decided URLs score a held-out fifth (every
HELD-th by hash), and the threshold with the best balanced accuracy is taken; the final models are
counted over all of them. Both kinds of model come from the same counts and score in the same pass: the counts of all
suffixes of a context meet in one row, where the orders are folded.

Defined cases: a null URL, or one without ://, has empty host and path, no rule, and is allowed (no
evidence); a score equal to the threshold accepts; URLs of any length are read whole, one row a character; if either class has no labelled URL all others are allowed; repeated rows count once each;
an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: (rule, verdict): host and path prefix as one string.
RULES: list[tuple[str, str]] = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
ORDER = 4
HELD = 5
BINS = 400
#: Half the width of the score range in the calibration histogram, in nats per character.
SPAN = 4.0
#: (context, next) pairs with more than one in HOT of all positions are joined by broadcast: at most HOT.
HOT = 1_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def positions(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """rows (host, path, others): the others with context (at most `order` characters) and next, one row
    per character. \\x02 begins a URL, \\x03 ends it."""
    others = [c for c in rows.columns if c not in ("host", "path")]
    s = F.concat(F.lit("\x02"), F.col("host"), F.col("path"), F.lit("\x03"))
    at = rows.select(*others, s.alias("s")).select(*others, "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    k = F.least(F.lit(order), F.col("i") - 1)
    return at.select(*others, F.substring(F.col("s"), F.col("i") - k, k).alias("context"), F.substring(F.col("s"), F.col("i"), F.lit(1)).alias("next"))


def grams(judged: DataFrame, order: int = ORDER) -> DataFrame:
    """(verdict, held, context, next, n): how often a character follows each context of 0 to `order`
    characters, apart for the held-out URLs."""
    held = (F.pmod(F.xxhash64("host", "path"), F.lit(HELD)) == 0).alias("held")
    longest = positions(judged.select("host", "path", "verdict", held), order).groupBy("verdict", "held", "context", "next").agg(F.count(F.lit(1)).alias("n"))
    ks = F.explode(F.sequence(F.lit(0), F.length("context"))).alias("k")
    rows = longest.select("verdict", "held", "context", "next", "n", ks)
    suffix = F.expr("substring(context, length(context) - k + 1, k)").alias("context")
    return rows.groupBy("verdict", "held", suffix, "next").agg(F.sum("n").alias("n"))


def held_out(host: str = "host", path: str = "path") -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(HELD)) == 0


class Ratio:
    """Log-likelihood difference of the two models. table: (verdict, held, context, next, n), all of them. The models
    proper count all URLs; beside them stand those without the held-out URLs, for calibration."""

    def __init__(self, table: DataFrame, order: int):
        self.table, self.order = table, order
        first = table.where("context = ''").groupBy("next").agg(F.bool_and("held").alias("held"))
        every, rest = first.agg(F.count(F.lit(1)), F.count_if(~F.col("held"))).first()
        self.alphabets = {"": every + 1, "_fit": rest + 1}
        classes = {(r[0], r[1]) for r in table.where("context = ''").select("verdict", "held").distinct().collect()}
        self.complete = {v for v, _ in classes} == {"allow", "block"}
        #: whether both classes have URLs to fit on and held-out ones
        self.calibrates = len(classes) == 4

    def stats(self, wanted: DataFrame) -> DataFrame:
        """wanted: distinct (suffix, next). Their counts, and their suffix's counts and kinds of next, for both classes
        and both kinds of model, in the struct `of`. No join key has more rows than the alphabet has characters."""
        sides = [(v, m, (F.col("verdict") == v) & (F.lit(True) if m == "" else ~F.col("held"))) for v in ("allow", "block") for m in self.alphabets]
        both = self.table.groupBy("context", "next").agg(*(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(f"n_{v}{m}") for v, m, of in sides))
        both = cut(both, "url-counts")
        sums = [f(f"n_{v}{m}").alias(f"{c}_{v}{m}") for v, m, _ in sides for c, f in (("t", F.sum), ("k", lambda x: F.count_if(F.col(x) > 0)))]
        model = both.groupBy("context").agg(*sums)
        found = wanted.join(both.withColumnRenamed("context", "suffix"), ["suffix", "next"], "left").join(model.withColumnRenamed("context", "suffix"), "suffix", "left")
        names = [f"{c}_{v}{m}" for v, m, _ in sides for c in "ntk"]
        return found.select(*wanted.columns, F.struct(*(F.coalesce(n, F.lit(0)).alias(n) for n in names)).alias("of"))

    def steps(self, pairs: DataFrame) -> DataFrame:
        """pairs: distinct (context, next). Their steps by both kinds of model: the counts of all suffixes of a context
        come together in one row and are folded there, from the shortest on."""
        ks = F.explode(F.sequence(F.lit(0), F.length("context"))).alias("k")
        spread = pairs.select("context", "next", ks).withColumn("suffix", F.expr("right(context, k)"))
        wanted = cut(spread.groupBy("suffix", "next").agg(F.count(F.lit(1)).alias("times")), "url-suffixes")
        many = (wanted.agg(F.sum("times")).first()[0] or 0) / HOT
        stats = cut(self.stats(wanted), "url-stats")
        joined = _hot_join(spread, stats, ["suffix", "next"], "times", many, "of")
        rows = joined.groupBy("context", "next").agg(F.sort_array(F.collect_list(F.struct("k", "of"))).alias("orders"))

        def p(v: str, m: str) -> Column:
            def mix(q: Column, at: Column) -> Column:
                n, t, k = (at["of"][f"{c}_{v}{m}"] for c in "ntk")
                return F.when(k > 0, (n + k * q) / (t + k)).otherwise(q)

            return F.aggregate("orders", F.lit(1.0 / self.alphabets[m]), mix)

        return rows.select("context", "next", *(F.ln(p("allow", m) / p("block", m)).alias(f"step{m}") for m in self.alphabets))

    def score_rows(self, rows: DataFrame, held: str | None = None) -> DataFrame:
        """rows (host, path, others) with score: nats per character in favour of accepting. Where the column `held` is
        true, by the models without the held-out URLs."""
        rows = cut(rows.withColumn("url_row", F.monotonically_increasing_id()), "url-rows")
        at = positions(rows.select("url_row", "host", "path", (F.col(held) if held else F.lit(False)).alias("by_fit")), self.order)
        pairs = cut(at.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n")), "url-pairs")
        many = (pairs.agg(F.sum("n")).first()[0] or 0) / HOT
        steps = cut(self.steps(pairs).join(pairs, ["context", "next"]).withColumn("steps", F.struct("step", "step_fit")), "url-steps")
        found = _hot_join(at, steps, ["context", "next"], "n", many, "steps")
        step = F.when(F.col("by_fit"), F.col("steps.step_fit")).otherwise(F.col("steps.step"))
        # decimals, so that a score doesn't depend on the order of its sum
        score = (F.sum(step.cast("decimal(24,14)")).cast("double") / F.count(F.lit(1))).alias("score")
        return rows.join(found.groupBy("url_row").agg(score), "url_row").drop("url_row")


def _hot_join(rows: DataFrame, table: DataFrame, keys: list[str], times: str, many: float, value: str) -> DataFrame:
    """rows with the table's value by key; keys with more than `many` rows, fewer than HOT of them, are broadcast."""
    hot = table.where(F.col(times) > many).select(*keys, F.col(value).alias("hot_value"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    rare = rows.where("hot_value IS NULL").drop("hot_value").join(table.where(F.col(times) <= many).select(*keys, value).hint("merge"), keys)
    return rows.where("hot_value IS NOT NULL").withColumnRenamed("hot_value", value).unionByName(rare)


def fit(judged: DataFrame, order: int = ORDER) -> Ratio | None:
    """judged: host, path, verdict. The models, or None if a class is missing."""
    ratio = Ratio(cut(grams(judged, order), "url-grams"), order)
    return ratio if ratio.complete else None


def cutoff(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on held-out rows (verdict, score)."""
    size = 2 * SPAN / BINS
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / size)))
    hist = {(r[0], r[1]): r[2] for r in scored.groupBy("verdict", place.alias("bin")).count().collect()}  # two rows a bin
    totals = {v: sum(n for (w, _), n in hist.items() if w == v) for v in ("allow", "block")}
    best, below = (-1.0, 0.0), {"allow": 0, "block": 0}
    for b in range(BINS + 1):
        balanced = 1 - below["allow"] / totals["allow"] + below["block"] / totals["block"]
        if balanced > best[0] + 1e-12:
            best = (balanced, b * size - SPAN)
        for v in below:
            below[v] += hist.get((v, b), 0)
    return best[1]


def train(judged: DataFrame, order: int = ORDER) -> tuple[Ratio, float] | None:
    """judged: host, path, verdict. The models and their threshold (0 with nothing to fit or to calibrate on), or None
    if a class is missing."""
    ratio = fit(judged, order)
    if ratio is None or not ratio.calibrates:
        return ratio and (ratio, 0.0)
    held = judged.where(held_out()).select("host", "path", "verdict", F.lit(True).alias("held"))
    return ratio, cutoff(cut(ratio.score_rows(held, "held"), "url-held"))


def judge_urls(df: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (null where a rule decided, or without a model)."""
    u = F.col(f"`{url}`")
    rows = df.select(F.col(f"`{page_id}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumn("rule", rule).withColumn("verdict", verdict), "url-rules")
    decided, open_ = rows.where("verdict IS NOT NULL"), rows.where("verdict IS NULL")
    ratio = fit(decided.select("host", "path", "verdict"))
    none = F.lit(None).cast("double")
    if ratio is None:
        return decided.withColumn("score", none).unionByName(open_.withColumn("verdict", F.lit("allow")).withColumn("score", none))
    # held-out URLs, by the models without them, and URLs without a rule are scored in the same pass
    held = F.lit(ratio.calibrates) & F.col("verdict").isNotNull() & held_out()
    asked = rows.withColumn("held", held).where("held OR verdict IS NULL")
    scored = cut(ratio.score_rows(asked, "held"), "url-scores")
    threshold = cutoff(scored.where("held")) if ratio.calibrates else 0.0
    empty = (F.col("host") == "") & (F.col("path") == "")
    scored = scored.where("NOT held").drop("held").withColumn("verdict", F.when(empty | (F.col("score") >= threshold), "allow").otherwise("block"))
    return decided.withColumn("score", none).unionByName(scored)
