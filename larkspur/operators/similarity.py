"""Embedding similarity: z-scores from moments, prototypes, source scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.scratch import sent


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def second_moments(df: DataFrame, vec: str) -> np.ndarray:
    """The sum of v v' over all rows, with v = (1, the vector): a matrix product a batch, one matrix a task, summed row by
    row. What the driver holds has the size of one matrix, whatever the number of rows."""
    first = df.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    p = 1 + (first[0] if first else 0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((p, p))
        for batch in batches:
            if batch.num_rows:
                v = np.ones((batch.num_rows, p))
                v[:, 1:] = matrix(batch.column("v"))
                m += v.T @ v
        yield pa.record_batch({"i": pa.array(np.arange(p, dtype=np.int32)), "row": pa.array(m.tolist(), pa.list_(pa.float64()))})

    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")).mapInArrow(partial, "i int, row array<double>")
    out = np.zeros((p, p))
    for r in rows.groupBy("i").agg(*(F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(p))).collect():
        out[r["i"]] = r[1:]
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def caption_z(audio: DataFrame, captions: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Per clip and own caption: similarity, and its z against all other clips' captions.

    Mean and variance of a.t over all captions are a.mu and a'Ma - (a.mu)^2, with mu the mean caption and M the mean
    outer product (second_moments()), instead of clips x captions similarities; a clip's own captions are then taken
    out of the sums. captions: key, cap, vec. The matrix goes to all tasks; its size depends on the dimension only.
    """
    m = second_moments(captions, vec)
    kind = audio.schema[key].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = matrix(batch.column("a"))
                yield pa.record_batch({key: batch.column(key), "a": batch.column("a").cast(pa.list_(pa.float64())), "sum_all": pa.array(a @ m[0, 1:]), "sq_all": pa.array(np.einsum("ij,ij->i", a @ m[1:, 1:], a))})

    a = audio.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("a")).mapInArrow(sums, f"`{key}` {kind}, a array<double>, sum_all double, sq_all double")
    own = captions.select(key, "cap", F.col(vec).alias("t")).join(a, key).withColumn("sim", dot(F.col("a"), F.col("t")))
    by = own.groupBy(key).agg(F.count(F.lit(1)).alias("_k"), F.sum("sim").alias("_s1"), F.sum(F.col("sim") * F.col("sim")).alias("_s2"))
    j = own.drop("a", "t").join(by, key)
    n = F.lit(int(m[0, 0])) - F.col("_k")
    mean = F.try_divide(F.col("sum_all") - F.col("_s1"), n)
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("sq_all") - F.col("_s2"), n) - mean * mean)
    return j.select(key, "cap", "sim", ((F.col("sim") - mean) / (F.sqrt(var) + 1e-9)).alias("z"))


#: Products within this of the own similarity are summed again term by term, as `dot` does.
SLACK = 1e-9
#: Pairs that are summed so at once.
CLOSE = 65_536


def rounded(x: np.ndarray) -> np.ndarray:
    """To 12 decimals, halves away from zero as SQL rounds (numpy's go to the even neighbour)."""
    y = x * 1e12
    return np.where(np.abs(y - np.trunc(y)) == 0.5, np.trunc(y) + np.sign(y), np.rint(y)) / 1e12


def in_order(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Row by row the dot product, added up from the first coordinate on: equal vectors get equal products, bit by bit."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * t[:, d]
    return out


def caption_percentile(audio: DataFrame, captions: DataFrame, key: str, vec: str = "vec", block: int = 4096, lead: int | None = None) -> DataFrame:
    """Share of all other clips' captions that are less similar to a clip than its own caption, exact: key, cap, sim, pct,
    multiplied (the share of captions whose whole product was needed).

    Vectors are turned to the captions' principal axes, so that their first `lead` coordinates (an eighth of all, by default)
    hold most of their length. By Cauchy and Schwarz the rest of a product is at most the product of the rests' lengths:
    a caption whose leading product is further than that from the own similarity is surely below or surely above it, and
    only what lies between is multiplied out, and what then is next to the own similarity is summed in its order. Clips and
    captions are dealt to blocks of about `block` rows; each pair of blocks is one task, whose counts are added up.
    Similarities are compared to 12 decimals."""
    m = second_moments(captions, vec)[1:, 1:]
    axes = np.linalg.eigh(m)[1][:, ::-1].T
    lead = max(1, len(axes) // 8) if lead is None else min(lead, len(axes))
    own = captions.select(key, "cap", F.col(vec).alias("t")).join(audio.select(key, F.col(vec).alias("a")), key)
    own = own.select(key, "cap", "a", dot(F.col("a"), F.col("t")).alias("sim"))
    pool = captions.where(F.col(vec).isNotNull()).select(F.col(key).alias("other"), "cap", F.col(vec).alias("t"))
    n = max(1, -(-captions.count() // block))
    turn = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides' block numbers are of one type: a cogroup casts nothing, and an int and a long hash differently
    left = own.withColumn("_i", F.pmod(F.xxhash64(key, "cap"), F.lit(n)).cast("int")).withColumn("_j", turn())
    right = pool.withColumn("_j", F.pmod(F.xxhash64("other", "cap"), F.lit(n)).cast("int")).drop("cap").withColumn("_i", turn())
    kind, cap = captions.schema[key].dataType.simpleString(), captions.schema["cap"].dataType.simpleString()

    def count(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = mine[[key, "cap", "sim"]].assign(less=0, total=0, pairs=0)
        if len(mine) and len(others):
            t, k = np.stack(others["t"]).astype(float), others["other"].to_numpy()
            raw = mine["sim"].to_numpy()
            sims = rounded(raw)
            a = np.stack(mine["a"]).astype(float)
            at_, tt = a @ axes.T, t @ axes.T
            rest_a, rest_t = (np.sqrt((v[:, lead:] ** 2).sum(axis=1)) for v in (at_, tt))
            head = np.ascontiguousarray(tt[:, :lead].T)
            for at in range(0, len(mine), 256):
                part = slice(at, at + 256)
                apart = mine[key].to_numpy()[part, None] != k[None, :]
                gap, bound = at_[part, :lead] @ head - sims[part, None], rest_a[part, None] * rest_t + SLACK
                below = gap + bound < 0
                between = apart & ~below & (gap - bound < 0)
                if between.mean() > 0.05:  # one product of matrices costs less than the rows of so many pairs
                    gap = a[part] @ t.T - raw[part, None]
                    near = between & (gap < -SLACK)
                    i, j = np.nonzero(between & (np.abs(gap) <= SLACK))
                else:
                    near = np.zeros(apart.shape, bool)
                    i, j = np.nonzero(between)
                for at_pair in range(0, len(i), CLOSE):
                    u, v = i[at_pair : at_pair + CLOSE], j[at_pair : at_pair + CLOSE]
                    near[u, v] = rounded(in_order(a[part][u], t[v])) < sims[part][u]
                out.iloc[part, 3], out.iloc[part, 4] = (apart & (below | near)).sum(axis=1), apart.sum(axis=1)
                out.iloc[part, 5] = between.sum(axis=1)
        return out

    counted = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(count, f"{key} {kind}, cap {cap}, sim double, less long, total long, pairs long")
    sums = counted.groupBy(key, "cap").agg(F.first("sim").alias("sim"), *(F.sum(c).alias(f"_{c}") for c in ("less", "total", "pairs"))).where("_total > 0")
    return sums.select(key, "cap", "sim", (F.col("_less") / F.col("_total")).alias("pct"), (F.col("_pairs") / F.col("_total")).alias("multiplied"))


def best_caption(z: DataFrame, key: str, texts: DataFrame, threshold: float) -> DataFrame:
    """Best caption per clip by z (of equal ones the first), its z, how many are over the threshold, and these joined by
    ' || ', in the captions' order."""
    over = F.sort_array(F.collect_list(F.when(F.col("z") >= threshold, F.struct("cap", "text"))))
    return z.join(texts, [key, "cap"]).groupBy(key).agg(F.max_by("cap", F.struct("z", -F.col("cap"))).alias("best"), F.max("z").alias("best_z"),
        F.count_if(F.col("z") >= threshold).alias("n_over"), F.array_join(F.transform(over, lambda s: s["text"]), " || ").alias("texts"))


def prototype_softmax(emb: DataFrame, protos: DataFrame, key: list[str], vec: str = "vec", temp: float = 100.0) -> DataFrame:
    """Probability of each prototype: softmax of temp * cosine. protos (name, proto) are few."""
    sims = emb.crossJoin(sent(protos)).select(*key, "name", (temp * cosine(F.col(vec), F.col("proto"))).alias("s"))
    g = sims.groupBy(*key).agg(F.max("s").alias("_top"), F.collect_list(F.struct("name", "s")).alias("_all"))
    z = F.aggregate("_all", F.lit(0.0), lambda a, t: a + F.exp(t["s"] - F.col("_top")))
    return g.withColumn("_z", z).select(*key, F.explode("_all").alias("e"), "_top", "_z").select(*key, "e.name", (F.exp(F.col("e.s") - F.col("_top")) / F.col("_z")).alias("p"))


def source_scores(emb: DataFrame, phrases: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    """Mean cosine to each set's phrases (source, proto), minus the row's mean over sets."""
    s = emb.crossJoin(sent(phrases)).groupBy(*key, "source").agg(F.avg(cosine(F.col(vec), F.col("proto"))).alias("raw"))
    mean = s.groupBy(*key).agg(F.avg("raw").alias("_m"))
    return s.join(mean, key).select(*key, "source", (F.col("raw") - F.col("_m")).alias("score"))


def nearest_prototype(emb: DataFrame, protos: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    """The closest centroid by Euclidean distance, ties by name."""
    d = F.aggregate(F.zip_with(F.col(vec), F.col("proto"), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    return emb.crossJoin(sent(protos)).groupBy(*key).agg(F.min_by("name", F.struct(d, F.col("name"))).alias("name"), F.min(d).alias("d2"))


def pairwise_distance(protos: DataFrame, name: str, vec: str, label: str) -> DataFrame:
    """Euclidean distance and label difference of all pairs of a small table."""
    # the prototypes are few (a row a label); nothing is hinted, so Spark broadcasts them only if they are small
    a, b = (protos.select(F.col(name).alias(f"{p}_name"), F.col(vec).alias(f"{p}_v"), F.col(label).alias(f"{p}_l")) for p in "ab")
    return a.join(b, F.col("a_name") < F.col("b_name")).select("a_name", "b_name", euclidean("a_v", "b_v").alias("distance"), F.abs(F.col("a_l") - F.col("b_l")).alias("label_gap"))


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def _neighbours(protos: DataFrame, name: str, vec: str, label: str, written: str | None) -> DataFrame:
    """Each prototype and the next one in label order: before, after, distance, differs (whether their labels are written
    differently), and the labels."""
    along = Window.partitionBy(F.lit(1)).orderBy(label, name)
    after = lambda c: F.lead(c).over(along)
    rows = protos.select(F.col(name).alias("before"), after(name).alias("after"), F.col(vec).alias("_a"), after(vec).alias("_b"), F.col(label).alias("_la"), after(label).alias("_lb"),
        (F.lit(True) if written is None else F.col(written) != after(written)).alias("differs"))
    return rows.where("after IS NOT NULL").select("before", "after", euclidean("_a", "_b").alias("distance"), "differs", "_la", "_lb")


def neighbour_jumps(protos: DataFrame, name: str, vec: str, label: str, written: str | None = None) -> DataFrame:
    """Euclidean distance of each prototype to the next one in label order, and its ratio to the median of these distances:
    before, after, distance, jump. With `written`, the label's text, the median is over neighbours with different texts.
    protos is a small table, a row a label."""
    rows = _neighbours(protos, name, vec, label, written)
    median = rows.where("differs").agg(F.percentile("distance", F.lit(0.5)).alias("_median"))
    return rows.crossJoin(median).select("before", "after", "distance", F.try_divide("distance", "_median").alias("jump"))


def jump_around(protos: DataFrame, name: str, vec: str, label: str, at: float = 0.0, written: str | None = None) -> DataFrame:
    """One row: the label nearest to `at` (the lower one of two), the mean distance to its neighbours, the median over all
    neighbours, and their ratio; the mean and the ratio are null if the label is written like a neighbour's."""
    rows = _neighbours(protos, name, vec, label, written)
    nearest = protos.agg(F.min_by(label, F.struct(F.abs(F.col(label) - at), F.col(label))).alias("label"))
    mine = (F.col("_la") == F.col("label")) | (F.col("_lb") == F.col("label"))
    one = rows.crossJoin(F.broadcast(nearest)).groupBy("label").agg(
        F.when(F.min(F.when(mine, F.col("differs"))), F.avg(F.when(mine, F.col("distance")))).alias("around"), F.percentile(F.when(F.col("differs"), F.col("distance")), F.lit(0.5)).alias("median"))
    return one.withColumn("ratio", F.try_divide("around", "median"))
