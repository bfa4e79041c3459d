"""Clusters. Linear models are in linear.py and text_ridge.py, boosted trees in boosting.py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import order_key
from larkspur.sources.scratch import cut

#: Rows whose distances to all models' centres are held at a time; they stay in a core's cache.
ROWS = 256


def clusters(train: DataFrame, apply: DataFrame, key: str, vec: str, ks: range, pca: int = 50, sample: int = 5000, seed: int = 1, starts: int = 10) -> DataFrame:
    """Scaled, reduced and clustered by k-means: of `starts` starts the one with the lowest inertia for each k, then the k
    with the best silhouette on the first `sample` rows in hash order; apply's rows get the nearest cluster: key, cluster,
    k, silhouette."""
    v = lambda d: d.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec)).alias("raw"))
    width = train.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    if width is None:
        return apply.limit(0).select(key, F.lit(0).alias("cluster"), F.lit(0).alias("k"), F.lit(0.0).alias("silhouette"))
    prep = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=min(pca, width[0]), inputCol="scaled", outputCol="features")]).fit(v(train))
    flat = lambda d: prep.transform(v(d)).select(key, vector_to_array("features").alias("features"))
    fitted = cut(flat(train), "cluster-rows")
    best = best_starts(fitted, key, "features", ks, starts, seed)
    probe = np.array([r[0] for r in fitted.orderBy(order_key(seed, key), key).limit(sample).select("features").collect()])  # `sample` rows
    scores = {k: silhouette(probe, nearest_centre(probe, c)) for k, (c, _) in best.items()}
    k = max(scores, key=lambda k: (scores[k], -k))
    centres = best[k][0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_centre(_matrix(batch.column("features")), centres)
                yield pa.record_batch({key: batch.column(key), "cluster": pa.array(near.astype(np.int32))})

    kind = apply.schema[key].dataType.simpleString()
    out = flat(apply).mapInArrow(place, f"`{key}` {kind}, cluster int")
    return out.select(key, "cluster", F.lit(k).alias("k"), F.lit(float(scores[k])).alias("silhouette"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own square, which doesn't change what is nearest."""
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equal ones."""
    return _distances(x, centres).argmin(axis=1)


def assigned(x: np.ndarray, centres: np.ndarray, ends: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For models whose centres follow each other (`sizes` of them, up to `ends`): 1 where a centre is a model's nearest to
    a row, the first of equal ones, else 0 (centres x rows), and those least distances (models x rows), less each row's own
    square."""
    d = np.column_stack([-2 * centres, (centres * centres).sum(axis=1)]) @ np.column_stack([x, np.ones(len(x))]).T
    low, one = np.minimum.reduceat(d, ends - sizes, axis=0), np.empty_like(d)
    models = [slice(e - k, e) for e, k in zip(ends, sizes)]
    for i, m in enumerate(models):
        np.equal(d[m], low[i], out=one[m], casting="unsafe")
    if one.sum() != low.size:  # a row has equally near centres
        for m in models:
            tied = np.flatnonzero(one[m].sum(axis=0) != 1)
            one[m, tied] = 0
            one[m.start + d[m, tied].argmin(axis=0), tied] = 1
    return one, low


def best_starts(rows: DataFrame, key: str, vec: str, ks: range, starts: int, seed: int, rounds: int = 100, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """For each k the centres with the lowest inertia, and that, of `starts` k-means fits. All fits advance in the same passes
    over the rows: a task multiplies its batches with the centres of all of them at once, adds up rows by centre, and
    sends one row a centre. A fit rests once its centres move by less than tol of the columns' mean variance; an empty
    cluster keeps its centre. First centres are drawn by distance (k-means++) from a hash sample of at most 64 rows for
    each of the most clusters."""
    spread = rows.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.avg("v")).first()[0] or 0.0
    pool = np.array([r[0] for r in rows.orderBy(order_key(seed + 1, key), key).limit(64 * max(ks)).select(vec).collect()])  # bounded by the largest k
    models = {(k, j): _spaced(pool, k, np.random.default_rng([seed, k, j])) for k in ks for j in range(starts)}
    inertia = dict.fromkeys(models, 0.0)
    live = list(models)
    for turn in range(rounds + 1):
        names, sizes = list(live), [len(models[m]) for m in live]
        ends = np.cumsum(sizes)
        centres = np.concatenate([models[m] for m in names])

        def partial(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres, ends: np.ndarray = ends, sizes: list[int] = sizes) -> Iterator[pa.RecordBatch]:
            sums, counts, costs = np.zeros_like(centres), np.zeros(len(centres), np.int64), np.zeros(len(sizes))
            for batch in batches:
                rows = _matrix(batch.column("v")) if batch.num_rows else centres[:0]
                for at in range(0, len(rows), ROWS):
                    x = rows[at : at + ROWS]
                    one, low = assigned(x, centres, ends, sizes)
                    costs += (x * x).sum() + low.sum(axis=1)
                    sums += one @ x
                    counts += one.sum(axis=1).astype(np.int64)
            cost = np.zeros(len(centres))
            cost[ends - np.array(sizes)] = costs
            yield pa.record_batch({"at": pa.array(np.arange(len(centres), dtype=np.int32)), "n": pa.array(counts), "cost": pa.array(cost), "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

        wide = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centres.shape[1])]
        got = rows.select(F.col(vec).alias("v")).mapInArrow(partial, "at int, n long, cost double, sums array<double>").groupBy("at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *wide)
        moved, cost = centres.copy(), np.zeros(len(centres))
        for r in got.collect():  # a row a centre
            cost[r["at"]] = r["cost"]
            if r["n"]:
                moved[r["at"]] = [r[f"s{i}"] / r["n"] for i in range(centres.shape[1])]
        live = []
        for m, e, k in zip(names, ends, sizes):
            inertia[m] = cost[e - k]
            if turn < rounds and ((moved[e - k : e] - models[m]) ** 2).sum() > tol * spread:
                models[m] = moved[e - k : e]
                live.append(m)
        if not live:
            break
    return {k: min(((models[k, j], inertia[k, j]) for j in range(starts)), key=lambda t: t[1]) for k in ks}


def _spaced(pool: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the pool, each drawn by its squared distance to those before it (rows may repeat if there are fewer)."""
    at = [int(rng.integers(len(pool)))]
    d = ((pool - pool[at[0]]) ** 2).sum(axis=1)
    while len(at) < k:
        at.append(int(rng.choice(len(pool), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(pool))))
        d = np.minimum(d, ((pool - pool[at[-1]]) ** 2).sum(axis=1))
    return pool[at]


def silhouette(x: np.ndarray, label: np.ndarray, block: int = 512) -> float:
    """Mean Euclidean silhouette of a bounded sample: 0 for rows alone in their cluster; -1 if there is one cluster only."""
    names, code = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return -1.0
    sizes, square, total = np.bincount(code), (x * x).sum(axis=1), 0.0
    one = np.eye(len(names))[code]
    for at in range(0, len(x), block):
        mine, part = code[at : at + block], x[at : at + block]
        d = np.sqrt(np.maximum(square[at : at + block, None] + square - 2 * part @ x.T, 0))
        d[np.arange(len(part)), np.arange(at, at + len(part))] = 0.0
        sums, own = d @ one, sizes[mine]
        rows = np.arange(len(part))
        a = sums[rows, mine] / np.maximum(own - 1, 1)
        means = sums / sizes
        means[rows, mine] = np.inf
        b = means.min(axis=1)
        total += np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
    return total / len(x)


def cluster_profiles(df: DataFrame, cluster: str, cols: list[str], least: int = 5) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in cols)).where(F.col("n") >= least)
