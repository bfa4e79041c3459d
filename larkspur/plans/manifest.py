"""Plans: chunks, splits, repeats, windows, grids, blind trials, counterfactual captions, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import hash_int, order_key, rint
from larkspur.functions.text import fmt2, tag
from larkspur.operators.screen import any_column_contains, places, prefix_sums, rank_mirror
from larkspur.operators.select import sample_per_group
from larkspur.sources.scratch import cut, sent


def chunk_plan(df: DataFrame, length: str, step: float, tol: float = 0.0) -> DataFrame:
    """chunk, start, end and pad of fixed chunks: floor((length + tol) / step) of them; the last may be padded."""
    n = F.floor((F.col(length) + tol) / step).cast("int")
    out = df.where(n >= 1).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumn("start", F.col("chunk") * step).withColumn("end", F.least(F.col(length).cast("double"), (F.col("chunk") + 1) * step))
    return out.withColumn("pad", F.greatest(F.lit(0.0), (F.col("chunk") + 1) * step - F.col(length)))


def split_plan(df: DataFrame, length: str, max_len: float, min_len: float) -> DataFrame:
    """Whole, or ceil(length / max) equal parts with half-even bounds; a recording under min_len has none, a longer one keeps
    all its parts."""
    n = F.ceil(F.col(length) / max_len).cast("int")
    bound = lambda k: F.rint(k * F.col(length) / F.col("parts"))
    out = df.where((F.col(length) > 0) & (F.col(length) >= min_len)).withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("start", bound(F.col("part"))).withColumn("end", bound(F.col("part") + 1))


def whole_or_chunks(df: DataFrame, length: str, min_len: float, max_len: float, step: float) -> DataFrame:
    """A recording from min_len to max_len long as one piece; any other as its full chunks of `step`, without a shorter last
    one: piece, start, end."""
    whole = F.col(length).between(min_len, max_len) if max_len > 0 else F.lit(False)
    n = F.when(whole, 1).otherwise(F.floor(F.col(length) / step)).cast("int")
    out = df.where(n >= 1).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("start", F.col("piece") * F.lit(float(step))).withColumn("end", F.when(whole, F.col(length).cast("double")).otherwise((F.col("piece") + 1) * F.lit(float(step))))


def window_starts(df: DataFrame, length: str, width: float, n: int = 3) -> DataFrame:
    """n evenly spaced window starts; a clip that is no longer than the window has the start 0, n times."""
    room = F.greatest(F.lit(0.0), F.col(length) - width)
    return df.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(k * room / (n - 1)))).alias("win", "start"))


def repeat_rows(df: DataFrame, bin_col: str, weights: dict[str, int], name: str, extra: Column | None = None, more: int = 1) -> DataFrame:
    """rep and file per repeat; the first keeps its name, the others get _r<k>. Rows where `extra` holds have `more`
    repeats; no row has none, whatever the weights."""
    reps = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col(bin_col)], F.lit(1)) + (F.when(extra, more).otherwise(0) if extra is not None else 0)
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.greatest(reps, F.lit(1)) - 1)))
    return out.withColumn("file", F.when(F.col("rep") == 0, F.col(name)).otherwise(F.concat(F.regexp_replace(name, r"\.wav$", ""), F.lit("_r"), F.col("rep").cast("string"), F.lit(".wav"))))


def exposure(plan: DataFrame, bin_col: str, base: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per bin: recordings, distinct chunks, chunks with repeats, distinct and seen seconds."""
    first = F.col("rep") == 0
    sec = F.col(end) - F.col(start)
    return plan.groupBy(bin_col).agg(F.count_distinct(base).alias("recordings"), F.count_if(first).alias("chunks"),
        F.count(F.lit(1)).alias("chunks_seen"), F.sum(F.when(first, sec).otherwise(0.0)).alias("seconds"), F.sum(sec).alias("seconds_seen"))


def grid_plan(seeds: DataFrame, items: DataFrame, levels: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """seed x item x level with file name and prompt; files that are done are skipped. All three are small lists."""
    g = seeds.crossJoin(sent(items)).crossJoin(sent(levels))
    g = g.withColumn("file", F.concat(F.lit("s"), F.col("seed").cast("string"), F.lit("_"), F.regexp_replace("item", " ", "_"), F.lit("_p"),
        fmt2("p"), F.lit(".wav"))).withColumn("prompt", F.concat(F.col("item"), tag("p")))
    return g if done is None else g.join(done.select("file"), "file", "left_anti")


def label_matrix(df: DataFrame, key: str, labels: Column, classes: list[str]) -> DataFrame:
    return df.select(key, *(F.array_contains(labels, c).cast("int").alias(f"lab_{c}") for c in classes))


def twin_manifests(df: DataFrame, file: str, text: str, score: str) -> tuple[DataFrame, DataFrame]:
    """The same rows captioned with and without the rating."""
    return df.select(file, F.concat(F.col(text), tag(score)).alias("caption")), df.select(file, F.col(text).alias("caption"))


def blind_pairs(pairs: DataFrame, key: list[str], lo: str, hi: str, seed: int) -> DataFrame:
    """Trials in hash order with a hash bit for the side of the higher one: trial, a, b, answer."""
    swap = hash_int(seed + 1, *key) % 2 == 1
    rows = pairs.withColumn("_h", order_key(seed, *key)).withColumn("_one", F.lit(1))
    out = prefix_sums(rows, ["_h", *key], "_one", F.substring("_h", 1, 3)).withColumn("trial", (F.col("before") + 1).cast("int"))
    return out.select(*key, "trial", F.when(swap, F.col(hi)).otherwise(F.col(lo)).alias("a"), F.when(swap, F.col(lo)).otherwise(F.col(hi)).alias("b"), F.when(swap, "a").otherwise("b").alias("answer"))


def blind_candidates(df: DataFrame, key: list[str], members: str, seed: int) -> DataFrame:
    """Trials numbered from 1 in hash order, each with its candidates in an order of its own: trial, slot (from 1), candidate."""
    rows = df.select(*key, members).withColumn("_h", order_key(seed + 1, *key)).withColumn("_one", F.lit(1))
    rows = prefix_sums(rows, ["_h", *key], "_one", F.substring("_h", 1, 3)).withColumn("trial", (F.col("before") + 1).cast("int"))
    m = F.array_sort(F.transform(members, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key), x.cast("string"))).alias("h"), x.alias("candidate"))))
    return rows.select(*key, "trial", F.posexplode(m).alias("slot", "s")).select(*key, "trial", (F.col("slot") + 1).alias("slot"), "s.candidate")


def quality_order(df: DataFrame, by: list[str], seed: str, masker: str, level: str, levels: list[float], path: str) -> DataFrame:
    """The open listening order of each set (`by`): by masker, seed, and the given order of levels (others are left out), with
    the playlist's label: by, place (from 1), label, path."""
    turn = F.array_position(F.array(*map(F.lit, levels)), F.col(level).cast("double"))
    rows = df.withColumn("_turn", turn).where(F.col("_turn") > 0)
    # rows are numbered inside each masker, behind the rows of the maskers before it
    rows = prefix_sums(rows.withColumn("_one", F.lit(1)), [seed, "_turn", path], "_one", F.col(masker), "place", by)
    label = F.concat(F.concat_ws(" / ", *(F.col(b).cast("string") for b in by)), F.lit(" | s"), F.col(seed).cast("string"), F.lit(" p="), F.format_string("%+.1f", F.col(level).cast("double")), F.lit(" | "), F.col(masker).cast("string"))
    return rows.select(*by, (F.col("place") + 1).cast("int").alias("place"), label.alias("label"), F.col(path).alias("path"))


def counterfactuals(df: DataFrame, by: list[str], key: str, text: str, value: str, seed: int) -> DataFrame:
    """Per row five captions: correct, flip (sign), mirror (rank), shuffle (another row's value), none. The shuffled values
    are the next row's in hash order; where that differs by less than 0.05 from a row's own, the row swaps with the one half
    a group away, so that they stay a permutation of the values."""
    m = rank_mirror(df, by, value, [key]).withColumn("_h", order_key(seed, key))
    m = cut(places(m, by, ["_h", key], F.substring("_h", 1, 3)).withColumnsRenamed({"place": "_r", "group_rows": "_n"}), "places")
    other = m.select(*by, F.col("_r").alias("_s"), F.col(value).alias("_next"))
    m = cut(m.withColumn("_s", (F.col("_r") + 1) % F.col("_n")).join(other, [*by, "_s"]).withColumn("_near", F.abs(F.col("_next") - F.col(value)) < 0.05), "places")
    half = F.floor(F.col("_n") / 2)
    partner = F.when(F.col("_r") < half, F.col("_r") + half).when(F.col("_r") < 2 * half, F.col("_r") - half).otherwise(F.col("_r"))
    far = m.select(*by, F.col("_r").alias("_f"), F.col("_next").alias("_far"), F.col("_near").alias("_far_near"))
    m = m.withColumn("_f", partner.cast("int")).join(far, [*by, "_f"])
    m = m.withColumn("shuffled", F.when(F.col("_near") | F.col("_far_near"), F.col("_far")).otherwise(F.col("_next")))
    cap = lambda v: F.concat(F.col(text), tag(v))
    return m.select(*by, key, cap(value).alias("correct"), cap(-F.col(value)).alias("flip"), cap("mirror").alias("mirror"), cap("shuffled").alias("shuffle"), F.col(text).alias("none"))


def job_plan(df: DataFrame, key: list[str], conditions: list[str], n: int, seed: int, by: list[str]) -> DataFrame:
    """Every row in the condition `full`; the others only for n rows of each group."""
    sub = sample_per_group(df.select(*dict.fromkeys([*by, *key])), by, n, seed, key).select(*key)
    rest = sub.withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return df.select(*key).withColumn("condition", F.lit("full")).unionByName(rest.select(*key, "condition"))


def joint_manifest(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    return a.withColumn("source", F.lit(names[0])).unionByName(b.withColumn("source", F.lit(names[1])), allowMissingColumns=True)


def replace_rows(old: DataFrame, new: DataFrame, word: str) -> DataFrame:
    """old without rows that contain the word anywhere, plus new; raises unless as many go as come, or if a new row
    contains the word."""
    gone, come = old.where(any_column_contains(old, word)).count(), new.count()
    if left := new.where(any_column_contains(new, word)).count():
        raise ValueError(f"{left} new rows still contain {word!r}")
    if gone != come:
        raise ValueError(f"{gone} rows go, {come} come")
    return old.where(~any_column_contains(old, word)).unionByName(new)


def refresh_captions(records: DataFrame, captions: DataFrame, keys: list[str]) -> DataFrame:
    """records with the first new caption of their key, and whether there was one."""
    first = captions.groupBy(*keys).agg(F.min("new_caption").alias("new_caption"))
    j = records.join(first, keys, "left")
    return j.withColumn("matched", F.col("new_caption").isNotNull()).withColumn("caption", F.coalesce("new_caption", "caption")).drop("new_caption")


def rebuild_records(subset: DataFrame, records: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(per subset row the first record of its key, by `order`, with the row's new_caption as caption; subset rows whose
    key has no record). Keys of several subset rows use the same record."""
    cols = [c for c in records.columns if c not in (*keys, "caption")]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_first")).select(*keys, "_first.*")
    found = subset.select(*keys, F.col("new_caption").alias("caption")).join(first, keys)
    return found, subset.join(records.select(*keys).distinct(), keys, "left_anti")


def mix_plan(stim: DataFrame, bases: DataFrame, maskers: DataFrame, levels: list[int]) -> DataFrame:
    """Gain of each masker at base level minus SMR: looked up at the rounded level, residual in dB.
    maskers: masker, gain_<r>dB, leq_<r>dB (wide)."""
    long = maskers.select("masker", F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("at"), F.col(f"gain_{r}dB").alias("gain"),
        F.col(f"leq_{r}dB").alias("leq")) for r in levels))).alias("m")).select("masker", "m.*")
    want = stim.join(bases, "base").withColumn("want", F.col("base_leq") - F.col("smr")).withColumn("at", rint("want"))
    return want.join(long, ["masker", "at"]).withColumn("residual_db", F.col("want") - F.col("leq"))


def resolve_path(df: DataFrame, candidates: list[Column], index: DataFrame) -> DataFrame:
    """path of the first candidate key that the file index has; found is false where none has."""
    out, got = df, []
    for i, c in enumerate(candidates):
        out = out.withColumn(f"_k{i}", c).join(index.select(F.col("key").alias(f"_k{i}"), F.col("path").alias(f"_p{i}")), f"_k{i}", "left")
        got.append(F.col(f"_p{i}"))
    return out.withColumn("path", F.coalesce(*got)).withColumn("found", F.col("path").isNotNull()).drop(*(f"_{x}{i}" for i in range(len(candidates)) for x in "kp"))
