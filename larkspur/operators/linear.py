"""Linear models from Gram states: sums of products per group or fold add up to any training set, so the rows are read
once however many models are fitted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.scratch import cut, sent

#: A pivot below this share of its column's own square counts as zero: the feature adds nothing to those before it.
TINY = 1e-10
#: Penalties of the grid search: 13 evenly spaced in the exponent from 1 to 10**6.
RIDGE_GRID = tuple(10.0 ** (i / 2) for i in range(13))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cholesky(m: Column) -> Column:
    """The lower factor of a symmetric matrix (array of rows), row by row. A pivot that is zero, as of a feature that
    depends on those before it, becomes infinite, so that whatever is divided by it vanishes."""
    none = F.array().cast("array<double>")

    def row(done: Column, a: Column) -> Column:
        i = F.size(done)

        def entry(r: Column, j: Column) -> Column:
            above = F.get(done, j)
            inner = (F.get(a, j) - _dot(r, F.slice(above, 1, j))) / F.get(above, j)
            rest = F.get(a, j) - _dot(r, r)
            pivot = F.when(rest > TINY * F.abs(F.get(a, j)), F.sqrt(rest)).otherwise(float("inf"))
            return F.concat(r, F.array(F.when(j < i, inner).otherwise(pivot)))

        return F.concat(done, F.array(F.aggregate(F.sequence(F.lit(0), i), none, entry)))

    return F.aggregate(m, F.array().cast("array<array<double>>"), row)


def solve(m: Column, b: Column) -> Column:
    """x with m x = b by forward and backward substitution; 0 for features that depend on those before them."""
    none = F.array().cast("array<double>")

    def substituted(low: Column) -> Column:
        def down(z: Column, i: Column) -> Column:
            return F.concat(z, F.array((F.get(b, i) - _dot(z, F.slice(F.get(low, i), 1, i))) / F.get(F.get(low, i), i)))

        z = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), none, down)

        def up(x: Column, i: Column) -> Column:
            below = F.transform(F.slice(low, i + 2, F.size(x)), lambda r: F.get(r, i))
            return F.concat(F.array((F.get(z, i) - _dot(below, x)) / F.get(F.get(low, i), i)), x)

        return F.aggregate(F.sequence(F.size(b) - 1, F.lit(0), F.lit(-1)), none, up)

    # the factor is computed once: it is bound by a lambda over an array of one
    return F.get(F.transform(F.array(cholesky(m)), substituted), 0)


def _scaled(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with _u0, _u1 ...: the columns less their mean over their spread, the one row of means and spreads): sums of
    such products lose no digits to a large mean."""
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("_mean", F.avg), ("_sd", F.stddev_pop))))
    unit = [F.when(F.col(f"_sd{i}") > 0, F.col(f"_sd{i}")).otherwise(1.0) for i in range(len(cols))]
    rows = df.crossJoin(F.broadcast(ends))
    return rows.select("*", *(((F.col(c).cast("double") - F.col(f"_mean{i}")) / unit[i]).alias(f"_u{i}") for i, c in enumerate(cols))), ends


def _sums(k: int) -> list[Column]:
    """Number, sums and sums of products of _u0 .. _u(k-1)."""
    pairs = [F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")).alias(f"_p{i}_{j}") for i in range(k) for j in range(i, k)]
    return [F.count(F.lit(1)).alias("_n"), *(F.sum(f"_u{i}").alias(f"_s{i}") for i in range(k)), *pairs]


def _fit(k: int, of) -> list[Column]:
    """Weights and intercept of column k - 1 on those before it; of(name) is a sum of the training rows."""
    n = of("_n")
    centred = lambda i, j: of(f"_p{min(i, j)}_{max(i, j)}") - of(f"_s{i}") * of(f"_s{j}") / n
    m = F.array(*(F.array(*(centred(i, j) for j in range(k - 1))) for i in range(k - 1)))
    w = solve(m, F.array(*(centred(i, k - 1) for i in range(k - 1))))
    means = F.array(*(of(f"_s{i}") / n for i in range(k - 1)))
    return [F.when(n > 0, w).alias("_w"), F.when(n > 0, of(f"_s{k - 1}") / n).alias("_my"), F.when(n > 0, means).alias("_mx")]


def group_oof(df: DataFrame, xs: list[str], y: str, group: str) -> DataFrame:
    """df's complete rows with `pred`, the least-squares prediction from all other groups (null if there is none). One
    Gram state a group; each group's training set is the total less its own state."""
    k = len(xs) + 1
    rows, _ = _scaled(df.na.drop(subset=[*xs, y, group]), [*xs, y])
    own = cut(rows.groupBy(group).agg(*_sums(k)), "gram-groups")
    names = [c for c in own.columns if c.startswith("_")]
    total = own.agg(*(F.sum(c).alias(f"_all{c}") for c in names))
    rest = own.crossJoin(F.broadcast(total)).select(group, *((F.col(f"_all{c}") - F.col(c)).alias(c) for c in names))
    fits = rest.select(group, *_fit(k, F.col))
    shift = F.zip_with(F.array(*(F.col(f"_u{i}") for i in range(k - 1))), F.col("_mx"), lambda u, m: u - m)
    unit = F.when(F.col(f"_sd{k - 1}") > 0, F.col(f"_sd{k - 1}")).otherwise(1.0)
    pred = F.col(f"_mean{k - 1}") + unit * (F.col("_my") + _dot(F.col("_w"), shift))
    return rows.join(sent(fits), group).select(*(F.col(f"`{c}`") for c in df.columns), pred.alias("pred"))


def standard_weights(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """feature, weight, n: the least-squares weights over all complete rows, in standard deviations of y per standard
    deviation of the feature."""
    rows, _ = _scaled(df.na.drop(subset=[*xs, y]), [*xs, y])
    fit = rows.agg(*_sums(len(xs) + 1)).select("_n", *_fit(len(xs) + 1, F.col))
    cells = F.arrays_zip(F.array(*map(F.lit, xs)).alias("feature"), F.col("_w").alias("weight"))
    return fit.select("_n", F.explode(cells).alias("c")).select(F.col("c.feature").alias("feature"), F.col("c.weight").alias("weight"), F.col("_n").alias("n"))


def moment_rows(df: DataFrame, cols: list[str], fold: str) -> tuple[DataFrame, list[float]]:
    """(fold, i, row: the sums of v v' over each fold's rows, with v = (1, the columns less their means), row by row; the
    means). Each task adds matrix products of its batches and sends one matrix a fold."""
    means = [float(m or 0.0) for m in df.agg(*(F.avg(F.col(c).cast("double")) for c in cols)).first()]
    p = len(cols) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.ones((batch.num_rows, p))
            v[:, 1:] = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p - 1) - means
            coded = batch.column("f").dictionary_encode()
            code = coded.indices.to_numpy()
            for i, f in enumerate(coded.dictionary.to_pylist()):
                part = v[code == i]
                sums[f] = sums.get(f, 0) + part.T @ part
        if sums:
            folds = pa.array(np.repeat(np.arange(len(sums)), p))
            yield pa.record_batch({"fold": pa.array(list(sums), kind).take(folds), "i": pa.array(np.tile(np.arange(p, dtype=np.int32), len(sums))),
                "row": pa.array([r for m in sums.values() for r in m.tolist()], pa.list_(pa.float64()))})

    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(df.schema[fold].dataType), df.schema[fold].dataType.simpleString()
    rows = df.select(F.col(fold).alias("f"), F.array(*(F.col(c).cast("double") for c in cols)).alias("v"))
    rows = rows.mapInArrow(partial, f"fold {name}, i int, row array<double>")
    return rows.groupBy("fold", "i").agg(F.array(*(F.sum(F.get("row", F.lit(j))) for j in range(p))).alias("row")), means


class RidgeSearch:
    """Ridge on standardised features with its penalty chosen on given folds.

    One pass gives a moment matrix per fold. The eigenvectors of each training set's correlations give the weights of
    all penalties at once, and the held-out fold's own matrix gives their errors, so no row is read again until
    predictions are asked for. What is broadcast is one weight vector a fold."""

    def __init__(self, df: DataFrame, xs: list[str], y: str, fold: str, alphas: tuple[float, ...] = RIDGE_GRID):
        self.xs, self.y, self.fold, self.alphas = xs, y, fold, alphas
        self.rows = df.na.drop(subset=[*xs, y, fold])
        moments, self.means = moment_rows(self.rows, [*xs, y], fold)
        moments = cut(moments, "ridge-moments")
        kind = df.schema[fold].dataType.simpleString()
        folds = [r[0] for r in moments.select("fold").distinct().orderBy("fold").collect()]  # a handful
        p = len(xs) + 2

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            held, last = pdf["held"].iloc[0], bool(pdf["last"].iloc[0])
            own, m = np.zeros((p, p)), np.zeros((p, p))
            for f, part in pdf.groupby("fold"):
                matrix = np.stack(part.sort_values("i")["row"])
                if not last and f == held:
                    own = matrix
                else:
                    m += matrix
            out = []
            if m[0, 0]:
                n, mean = m[0, 0], m[0, 1:] / m[0, 0]
                c = m[1:, 1:] - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0) / n)
                sd[sd <= 0] = 1.0
                lam, q = np.linalg.eigh(c[:-1, :-1] / np.outer(sd, sd))
                b = q.T @ (c[:-1, -1] / sd)
                mean_own = own[0, 1:] / own[0, 0] if own[0, 0] else None
                spread = own[-1, -1] - own[0, 0] * mean_own[-1] ** 2 if own[0, 0] else 0.0
                for a in alphas:
                    down = np.maximum(lam, 0) + a
                    w = q @ np.where(down > TINY * n, b / np.where(down > 0, down, 1), 0) / sd
                    b0 = mean[-1] - w @ mean[:-1]
                    miss = np.r_[-b0, -w, 1.0]
                    r2 = 1 - miss @ own @ miss / spread if spread > TINY * own[0, 0] else None
                    out.append((None if last else held, last, float(a), int(n), int(own[0, 0]), float(b0), w.tolist(), r2))
            return pd.DataFrame(out, columns=["held", "last", "alpha", "n_train", "n", "intercept", "weights", "r2"])

        sets = F.explode(F.array(*(F.struct(F.lit(f).cast(kind).alias("held"), F.lit(False).alias("last")) for f in folds), F.struct(F.lit(None).cast(kind).alias("held"), F.lit(True).alias("last"))))
        models = moments.select("fold", "i", "row", sets.alias("s")).select("fold", "i", "row", "s.*").groupBy("held", "last")
        out = models.applyInPandas(fit, f"held {kind}, last boolean, alpha double, n_train long, n long, intercept double, weights array<double>, r2 double")
        #: per held-out fold and penalty (last: fitted on all folds) intercept and weights, around the columns' means
        self.models = cut(out, "ridge-models")

    def scores(self) -> DataFrame:
        """fold, alpha, n and r2 of the held-out fold."""
        return self.models.where("NOT last").select(F.col("held").alias("fold"), "alpha", "n", "r2")

    def choice(self) -> DataFrame:
        """alpha, mean_r2 and edge of the penalty with the best mean R2 over the folds (of equal ones the smallest); edge
        is top or bottom if it is the grid's last or first one, so that the best may lie beyond."""
        by = self.scores().groupBy("alpha").agg(F.avg("r2").alias("mean_r2"))
        best = by.agg(F.max_by(F.struct("alpha", "mean_r2"), F.struct(F.coalesce("mean_r2", F.lit(float("-inf"))), -F.col("alpha"))).alias("b")).select("b.*")
        low, high = min(self.alphas), max(self.alphas)
        return best.where("alpha IS NOT NULL").withColumn("edge", F.when(F.col("alpha") == high, "top").when(F.col("alpha") == low, "bottom"))

    def _predict(self, df: DataFrame, models: DataFrame, on: Column) -> DataFrame:
        shift = F.array(*(F.col(x).cast("double") - m for x, m in zip(self.xs, self.means)))
        rows = df.join(F.broadcast(models.select(F.col("held").alias("_held"), F.col("alpha").alias("_alpha"), F.col("intercept").alias("_b0"), F.col("weights").alias("_w"))), on)
        pred = self.means[-1] + F.col("_b0") + _dot(F.col("_w"), shift)
        return rows.select(*(F.col(f"`{c}`") for c in df.columns), F.col("_alpha").alias("alpha"), pred.alias("pred"))

    def _chosen(self) -> DataFrame:
        return self.models.join(F.broadcast(self.choice().select("alpha")), "alpha")

    def oof(self) -> DataFrame:
        """The rows with alpha and pred, their out-of-fold prediction by the chosen penalty."""
        return self._predict(self.rows, self._chosen().where("NOT last"), F.col(self.fold) == F.col("_held"))

    def predict(self, df: DataFrame) -> DataFrame:
        """Other rows, predicted by the chosen penalty fitted on all folds."""
        return self._predict(df.na.drop(subset=self.xs), self._chosen().where("last"), F.lit(True))

    def external(self, df: DataFrame, stimulus: str) -> DataFrame:
        """level, n, r2 and r on other rows: by row, and by stimulus (means of observed and predicted values)."""
        rows = self.predict(df.na.drop(subset=[self.y])).select(F.col(stimulus).alias("_s"), F.col(self.y).cast("double").alias("y"), "pred")
        means = rows.groupBy("_s").agg(F.avg("y").alias("y"), F.avg("pred").alias("pred"))
        out = [d.agg(F.count(F.lit(1)).alias("n"), r2_of("y", "pred").alias("r2"), F.corr("y", "pred").alias("r")).select(F.lit(n).alias("level"), "*") for n, d in (("row", rows), ("stimulus", means))]
        return out[0].unionByName(out[1])


def r2_of(y: str, pred: str) -> Column:
    """R2; null where y is constant."""
    return 1 - F.try_divide(F.avg((F.col(y) - F.col(pred)) ** 2), F.var_pop(y))
