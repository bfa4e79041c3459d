"""Histogram gradient boosting of squared error, over a grid of settings and folds at once.

Features are binned at their quantiles once. Every (settings, fold) pair is a model of its own, and all models grow their
trees in the same passes over the rows: a pass adds up number and gradient per (model, node, feature, bin) and sends one
histogram a task; the driver picks the splits. Trees grow best-first to a number of leaves: where the best leaf's
children haven't been measured yet, they are asked for in the next pass together with all others that are wanted, so a
tree takes about as many passes as it has levels. Rows carry the residuals of all models; the trees since the last
writing are applied on the fly, and residuals are written anew every KEEP trees.

Where binned rows share few cells (bins of all features, fold, stopping row or not), number, mean and squared deviations of y
in each cell are all that fitting needs: rows are added up to cells once, each model grows in one task over the cells, and
predictions go back to the rows by their bins. CELLS bounds what a task holds; beyond it models grow by passes over the rows.

A model stops when its loss on the hash-drawn tenth of its training rows hasn't improved for PATIENCE trees. What the
driver holds are histograms and trees; their size depends on the settings only.
"""

from __future__ import annotations

import dataclasses
import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.scratch import cut, sent

BINS, KEEP, PATIENCE, TOL = 255, 10, 10, 1e-7
#: One in HELD of a model's training rows decides when it stops.
HELD = 10
#: Cells up to which a model grows in one task: about 60 MB of numbers.
CELLS = 1_000_000
#: The grid: largest number of leaves, fewest rows of a leaf, penalty on leaf values.
GRID = tuple(itertools.product((15, 31), (50, 200), (0.0, 1.0)))


@dataclasses.dataclass(slots=True)
class Split:
    node: int
    feature: int
    bin: int
    left: int
    right: int


@dataclasses.dataclass(slots=True)
class Tree:
    """Splits in the order in which they apply, and the leaves' values by node."""

    splits: list[Split]
    values: dict[int, float]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for s in self.splits:
            at = np.flatnonzero(node == s.node)
            node[at] = np.where(bins[at, s.feature] <= s.bin, s.left, s.right)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        table = np.zeros(max(self.values) + 1)
        table[list(self.values)] = list(self.values.values())
        return table[self.nodes(bins)]


class Model:
    """One (settings, fold): the trees so far and the tree that grows."""

    def __init__(self, leaves: int, least: int, l2: float, fold, rate: float):
        self.leaves, self.least, self.l2, self.fold, self.rate = leaves, least, l2, fold, rate
        self.trees: list[Tree] = []
        self.base, self.losses, self.done = 0.0, [], False

    def begin(self) -> None:
        #: node -> (rows, gradient sum, best split as (gain, feature, bin) or None); children of split nodes
        self.known: dict[int, tuple[int, float, tuple[float, int, int] | None]] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.next = 1

    def measure(self, node: int, hist: np.ndarray) -> None:
        """hist: features x bins x (rows, gradient)."""
        n, g = hist[0, :, 0].sum(), hist[0, :, 1].sum()
        left = np.cumsum(hist, axis=1)[:, :-1]
        ln, lg = left[..., 0], left[..., 1]
        rn, rg = n - ln, g - lg
        ok = (ln >= self.least) & (rn >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, lg * lg / (ln + self.l2) + rg * rg / (rn + self.l2) - g * g / (n + self.l2), -np.inf)
        best = None
        if gain.size and np.isfinite(gain.max()) and gain.max() > 1e-12 * (1 + abs(g)):
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            best = (float(gain[f, b]), int(f), int(b))
        self.known[node] = (int(n), float(g), best)

    def judge(self, n: float, square: float, last: bool) -> None:
        """Stop if the loss on the stopping rows is, for PATIENCE trees, no better than before these."""
        if self.done:
            return
        self.losses.append(square / n / 2 if n else 0.0)
        recent = self.losses[-PATIENCE:]
        self.done = last or len(self.losses) > PATIENCE and not any(v < self.losses[-PATIENCE - 1] - TOL for v in recent)

    def fit(self, bins: np.ndarray, n: np.ndarray, mean: np.ndarray, square: np.ndarray, held: np.ndarray, rounds: int) -> None:
        """All trees from cells: their bins, number of rows, mean and squared deviations of y, and whether they decide when to stop."""
        use, width, many = ~held, int(bins.max(initial=0)) + 1, bins.shape[1]
        mine, weight, resid = np.ascontiguousarray(bins[use]), n[use].astype(float), np.full(len(n), self.base) - mean
        for turn in range(rounds + 1):
            if self.done:
                break
            self.begin()
            self.judge(n[held].sum(), (square[held] + n[held] * resid[held] ** 2).sum(), turn == rounds)
            wanted, tree, gradient = ([] if self.done else [0]), None, weight * resid[use]
            while wanted:
                node = tree.nodes(mine) if tree else np.zeros(len(mine), np.int64)
                place = np.full(max(int(node.max(initial=0)), *wanted) + 1, -1)
                place[wanted] = np.arange(len(wanted))
                slot = place[node]
                at = np.flatnonzero(slot >= 0)
                hist, size = np.zeros((len(wanted), many, width, 2)), len(wanted) * width
                for j in range(many):
                    cell = slot[at] * width + mine[at, j]
                    hist[:, j, :, 0] = np.bincount(cell, weight[at], minlength=size).reshape(-1, width)
                    hist[:, j, :, 1] = np.bincount(cell, gradient[at], minlength=size).reshape(-1, width)
                for w, h in zip(wanted, hist):
                    self.measure(w, h)
                tree, wanted = self.grow()
            if not self.done:
                if tree.splits:
                    self.trees.append(tree)
                    resid += tree.predict(bins)
                else:
                    self.done = True

    def grow(self) -> tuple[Tree, list[int]]:
        """(the tree by what is known, the nodes to measure before it is final): best-first, as far as the children of a
        split are known; where they aren't, they are wanted, and the others go on."""
        heap, order, splits, wanted, leaves = [], itertools.count(), [], [], {0}

        def offer(node: int) -> None:
            if node in self.known and self.known[node][2]:
                heapq.heappush(heap, (-self.known[node][2][0], next(order), node))

        offer(0)
        while heap and len(leaves) < self.leaves:
            _, _, node = heapq.heappop(heap)
            if node not in self.children:
                self.children[node] = (self.next, self.next + 1)
                self.next += 2
            left, right = self.children[node]
            _, f, b = self.known[node][2]
            splits.append(Split(node, f, b, left, right))
            leaves = leaves - {node} | {left, right}
            for child in (left, right):
                if child in self.known:
                    offer(child)
                else:
                    wanted.append(child)
        values = {node: -self.rate * self.known[node][1] / (self.known[node][0] + self.l2) for node in leaves if node in self.known and self.known[node][0] + self.l2 > 0}
        return Tree(splits, values), wanted


def edges_of(df: DataFrame, x: str, bins: int = BINS) -> list[float]:
    """Upper ends of all bins but the last: the distinct values if there are few, else approximate quantiles."""
    few = [r[0] for r in df.select(F.col(x).cast("double")).distinct().limit(bins + 1).collect()]
    if len(few) <= bins:
        return sorted(few)[:-1]
    marks = df.agg(F.percentile_approx(F.col(x).cast("double"), [i / bins for i in range(1, bins)], 100 * bins)).first()[0]
    return sorted(set(marks))


class Boosting:
    """Boosted trees for every setting of the grid and every fold (fitted on the others), and on all rows."""

    def __init__(self, df: DataFrame, xs: list[str], y: str, fold: str, key: str, grid=GRID, rate: float = 0.05, rounds: int = 500, bins: int = BINS):
        self.xs, self.y, self.fold, self.key, self.grid = xs, y, fold, key, grid
        rows = df.na.drop(subset=[*xs, y, fold, key])
        self.edges = [edges_of(rows, x, bins) for x in xs]
        self.folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]  # a handful
        self.models = [Model(*g, f, rate) for g in grid for f in [*self.folds, None]]
        code = F.array_position(F.array(*(F.lit(f) for f in self.folds)), F.col(fold)) - 1 if self.folds else F.lit(0)
        table = rows.select(F.col(key).alias("key"), F.col(y).cast("double").alias("y"), code.cast("int").alias("fold"), (F.pmod(F.xxhash64(F.col(key), F.lit("stop")), F.lit(HELD)) == 0).alias("held"),
            F.array(*map(self._bin, xs, self.edges)).alias("bins"))
        self.kind = rows.schema[key].dataType.simpleString()
        table = self.table = cut(table.withColumn("resid", F.lit(None).cast("array<double>")), "boost-rows")
        if self.folds:
            self._start()
            cells = table.groupBy("bins", "fold", "held").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), (F.count(F.lit(1)) * F.var_pop("y")).alias("square"))
            cells = cut(cells, "boost-cells")
            if cells.count() <= CELLS:
                self._fit_cells(cells, rounds)
            else:
                self._run(rounds)

    @staticmethod
    def _bin(x: str, edges: list[float]):
        if not edges:
            return F.lit(0)
        steps, cuts = F.array(*(F.lit(1 << i) for i in reversed(range(len(edges).bit_length())))), F.array(*map(F.lit, edges))
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) < F.col(x).cast("double"), n + step).otherwise(n))

    def _start(self) -> None:
        """The mean of each model's training rows is its first prediction."""
        cells = {(r["fold"], r["held"]): (r["n"], r["s"]) for r in self.table.groupBy("fold", "held").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()}  # two rows a fold
        for m in self.models:
            of = [v for (f, held), v in cells.items() if not held and (m.fold is None or self.folds[f] != m.fold)]
            n = sum(v[0] for v in of)
            m.base, m.done = (sum(v[1] for v in of) / n if n else 0.0), not n
        self.written = [0] * len(self.models)

    def _fit_cells(self, cells: DataFrame, rounds: int) -> None:
        """A task a model, over the cells; then the rows get the predictions of their bins."""
        models, names = self.models, self.folds

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            i = int(pdf["model"].iloc[0])
            m, pdf = models[i], pdf.sort_values(["fold", "held", "order"])
            if m.fold is not None:
                pdf = pdf[pdf["fold"] != names.index(m.fold)]
            m.fit(np.stack(pdf["bins"]).astype(np.int64), *(pdf[c].to_numpy() for c in ("n", "mean", "square", "held")), rounds)
            return pd.DataFrame({"model": [i], "made": [pickle.dumps((m.trees, m.losses))]})

        each = cells.withColumn("order", F.concat_ws(" ", F.transform("bins", lambda b: F.lpad(b.cast("string"), 4, "0"))))
        todo = [F.lit(i) for i, m in enumerate(models) if not m.done]
        each = each.withColumn("model", F.explode(F.array(*todo).cast("array<int>"))).repartitionByRange(len(models), "model")
        for r in each.groupBy("model").applyInPandas(fit, "model int, made binary").collect():  # a row a model
            self.models[r["model"]].trees, self.models[r["model"]].losses = pickle.loads(r["made"])
            self.models[r["model"]].done = True
        trees, bases, many = [m.trees for m in self.models], [m.base for m in self.models], len(self.xs)
        made = self.table.sparkSession.sparkContext.broadcast((trees, bases))

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, bases = made.value
            for batch in batches:
                if batch.num_rows:
                    bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, many)
                    pred = np.stack([b + sum((t.predict(bins) for t in some), np.zeros(len(bins))) for b, some in zip(bases, trees)], axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("bins"), pa.array(pred.tolist(), pa.list_(pa.float64()))], ["bins", "pred"])

        preds = cells.select("bins").distinct().repartition(4 * len(models)).mapInArrow(predict, "bins array<int>, pred array<double>")
        rows = self.table.drop("resid").join(sent(preds), "bins")
        self.table = cut(rows.select("key", "y", "fold", "held", "bins", F.transform("pred", lambda p: p - F.col("y")).alias("resid")), "boost-rows")
        self.written = [len(m.trees) for m in self.models]

    @staticmethod
    def _residuals(batch: pa.RecordBatch, bins: np.ndarray, trees: list[list[Tree]], bases: list[float]) -> np.ndarray:
        """rows x models: prediction less y."""
        y = batch.column("y").to_numpy()
        kept = batch.column("resid")
        out = kept.flatten().to_numpy().reshape(len(y), -1).copy() if kept.null_count == 0 and len(y) else np.stack([b - y for b in bases], axis=1)
        for i, some in enumerate(trees):
            for t in some:
                out[:, i] += t.predict(bins)
        return out

    def _pass(self, wanted: list[list[int]], growing: list[Tree | None]) -> tuple[np.ndarray, np.ndarray]:
        """(histograms of the wanted nodes, one after the other: features x bins x (rows, gradient); per model the number and
        the squared error of its stopping rows)."""
        at = np.cumsum([0, *map(len, wanted)])
        trees, bases, folds = [m.trees[w:] for m, w in zip(self.models, self.written)], [m.base for m in self.models], [m.fold for m in self.models]
        width, many, names = max(len(e) for e in self.edges) + 1, len(self.xs), self.folds
        residuals = self._residuals

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist, loss = np.zeros((at[-1], many, width, 2)), np.zeros((len(folds), 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, many)
                r = residuals(batch, bins, trees, bases)
                fold, held = batch.column("fold").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
                for i, f in enumerate(folds):
                    mine = np.ones(len(fold), bool) if f is None else fold != names.index(f)
                    stop = mine & held
                    loss[i] += stop.sum(), (r[stop, i] ** 2).sum()
                    if not wanted[i]:
                        continue
                    use = np.flatnonzero(mine & ~held)
                    node = growing[i].nodes(bins[use]) if growing[i] else np.zeros(len(use), np.int64)
                    place = np.full(max(int(node.max(initial=0)), *wanted[i]) + 1, -1)
                    place[wanted[i]] = np.arange(at[i], at[i + 1])
                    slot = place[node]
                    use, slot = use[slot >= 0], slot[slot >= 0] - at[i]
                    for j in range(many):
                        cell, size = slot * width + bins[use, j], len(wanted[i]) * width
                        hist[at[i] : at[i + 1], j, :, 0] += np.bincount(cell, minlength=size).reshape(-1, width)
                        hist[at[i] : at[i + 1], j, :, 1] += np.bincount(cell, r[use, i], minlength=size).reshape(-1, width)
            flat = hist.reshape(at[-1], -1)
            yield pa.record_batch({"what": pa.array(np.arange(at[-1] + 1, dtype=np.int32)), "v": pa.array([*flat.tolist(), loss.ravel().tolist()], pa.list_(pa.float64()))})

        def add(pdf):
            return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"]), axis=0)])

        got = self.table.select("y", "fold", "held", "bins", "resid").mapInArrow(partial, "what int, v array<double>").groupBy("what").applyInPandas(add, "what int, v array<double>")
        hist, loss = np.zeros((at[-1], many, width, 2)), np.zeros((len(folds), 2))
        for r in got.collect():  # a row a node
            if r["what"] == at[-1]:
                loss = np.array(r["v"]).reshape(-1, 2)
            else:
                hist[r["what"]] = np.array(r["v"]).reshape(many, width, 2)
        return hist, loss

    def _run(self, rounds: int) -> None:
        for turn in range(rounds + 1):
            live = [not m.done for m in self.models]
            if not any(live):
                break
            for m in self.models:
                m.begin()
            wanted, growing = [[0] if a else [] for a in live], [None] * len(self.models)
            first = True
            while any(wanted):
                hist, loss = self._pass(wanted, growing)
                if first:
                    for m, (n, square) in zip(self.models, loss):
                        m.judge(n, square, turn == rounds)
                    first = False
                at = 0
                for i, m in enumerate(self.models):
                    for node in wanted[i]:
                        m.measure(node, hist[at])
                        at += 1
                    growing[i], wanted[i] = m.grow() if wanted[i] and not m.done else (growing[i], [])
            for i, m in enumerate(self.models):
                if not m.done:
                    if not growing[i].splits:
                        m.done = True  # no split is allowed or gains anything: further trees would be the same
                    else:
                        m.trees.append(growing[i])
            if (turn + 1) % KEEP == 0:
                self._write()
        self._write()

    def _write(self) -> None:
        trees, bases, many = [m.trees[w:] for m, w in zip(self.models, self.written)], [m.base for m in self.models], len(self.xs)
        residuals = self._residuals

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, many)
                    r = pa.array(residuals(batch, bins, trees, bases).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "y", "fold", "held", "bins")), r], ["key", "y", "fold", "held", "bins", "resid"])

        self.table = cut(self.table.mapInArrow(rows, f"key {self.kind}, y double, fold int, held boolean, bins array<int>, resid array<double>"), "boost-rows")
        self.written = [len(m.trees) for m in self.models]

    def _settings(self) -> DataFrame:
        rows = [(i, *(self.grid[i // (len(self.folds) + 1)]), None if m.fold is None else self.folds.index(m.fold), len(m.trees)) for i, m in enumerate(self.models)]
        return self.table.sparkSession.createDataFrame(rows, "model int, leaves int, least int, l2 double, fold int, trees int")

    def _name(self, code: str):
        return F.get(F.array(*map(F.lit, self.folds)), F.col(code))

    def scores(self) -> DataFrame:
        """leaves, least, l2, fold, trees, n and r2 of the held-out fold."""
        long = self.table.select("y", "fold", F.posexplode("resid").alias("model", "r"))
        rows = long.join(F.broadcast(self._settings()), ["model", "fold"])
        r2 = 1 - F.try_divide(F.avg(F.col("r") ** 2), F.var_pop("y"))
        g = rows.groupBy("leaves", "least", "l2", "fold", "trees").agg(F.count(F.lit(1)).alias("n"), r2.alias("r2"))
        return g.withColumn("fold", self._name("fold"))

    def choice(self) -> DataFrame:
        """leaves, least, l2 and mean_r2 of the settings with the best mean R2 over the folds; of equal ones the first."""
        by = self.scores().groupBy("leaves", "least", "l2").agg(F.avg("r2").alias("mean_r2"))
        order = F.struct(F.coalesce("mean_r2", F.lit(float("-inf"))), -F.col("leaves"), -F.col("least"), -F.col("l2"))
        return by.agg(F.max_by(F.struct("leaves", "least", "l2", "mean_r2"), order).alias("b")).select("b.*")

    def oof(self) -> DataFrame:
        """key, fold, pred: the out-of-fold predictions of the chosen settings."""
        best = self._settings().join(F.broadcast(self.choice()), ["leaves", "least", "l2"]).select("model", "fold")
        rows = self.table.select("key", "y", "fold", F.posexplode("resid").alias("model", "r")).join(F.broadcast(best), ["model", "fold"])
        return rows.select(F.col("key").alias(self.key), self._name("fold").alias("fold"), (F.col("y") + F.col("r")).alias("pred"))

    def predict(self, df: DataFrame) -> DataFrame:
        """df's complete rows with pred, by the chosen settings fitted on all folds."""
        best = self.choice().first()
        at = [i for i, m in enumerate(self.models) if m.fold is None and (m.leaves, m.least, m.l2) == (best["leaves"], best["least"], best["l2"])]
        model, many, names = self.models[at[0]], len(self.xs), df.columns

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = batch.column("_bins").flatten().to_numpy().reshape(batch.num_rows, many)
                    pred = model.base + sum((t.predict(bins) for t in model.trees), np.zeros(len(bins)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred)], [*names, "pred"])

        done = df.na.drop(subset=self.xs).withColumn("_bins", F.array(*map(self._bin, self.xs, self.edges)))
        fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return done.mapInArrow(rows, f"{fields}, pred double")
