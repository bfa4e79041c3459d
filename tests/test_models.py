"""Gram-state models, exact bootstraps and the snapshot log against brute force."""

import collections
import hashlib
import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions.scores import order_key
from larkspur.operators import boosting as BO
from larkspur.operators import linear as LM
from larkspur.operators import models as M
from larkspur.operators import resample as B
from larkspur.operators import similarity as E
from larkspur.operators import stats as ST
from larkspur.operators import text_ridge as TR
from larkspur.sources import io as IO
from larkspur.sources.scratch import folder
from larkspur.sources.snapshots import Conflict, SnapshotLog


def frame(spark, x, y, g):
    names = "abcdefhk"[: x.shape[1]]
    rows = [(i, *map(float, x[i]), float(y[i]), int(g[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names) + ", y double, g int"), list(names)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_group_oof(spark, k):
    """Predictions and weights equal a fit per group, with large means and a last feature that depends on the others."""
    r = np.random.default_rng(k)
    x, g = r.normal(500, 3, (200, k)), r.integers(0, 7, 200)
    y = x @ r.normal(size=k) + r.normal(size=200) + 1e4
    wide = np.c_[x, x @ np.arange(1, k + 1)]
    df, names = frame(spark, wide, y, g)
    got = {row.id: row.pred for row in LM.group_oof(df, names, "y", "g").collect()}
    for j in set(g):
        a = np.c_[np.ones((g != j).sum()), x[g != j]]
        w = np.linalg.lstsq(a, y[g != j], rcond=None)[0]
        assert np.allclose(np.c_[np.ones((g == j).sum()), x[g == j]] @ w, [got[i] for i in np.flatnonzero(g == j)], atol=1e-6)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.lstsq(z, (y - y.mean()) / y.std(), rcond=None)[0]
    weights = {row.feature: row.weight for row in LM.standard_weights(df.drop(names[-1]), names[:-1], "y").collect()}
    assert [weights[n] for n in names[:-1]] == pytest.approx(beta, abs=1e-8)


def test_group_oof_odd_rows(spark):
    """One group alone has no training rows; nulls drop out; a constant feature has no weight; an empty table."""
    df = spark.createDataFrame([(1, 2.0, 5.0, 1.0, "x"), (2, None, 5.0, 1.0, "x"), (3, 3.0, 5.0, 2.0, "x")], "id int, a double, b double, y double, g string")
    assert {r.id: r.pred for r in LM.group_oof(df, ["a", "b"], "y", "g").collect()} == {1: None, 3: None}
    two = df.unionByName(df.withColumn("g", F.lit("z")).withColumn("y", F.col("y") + 1))
    assert {(r.id, r.g): r.pred for r in LM.group_oof(two, ["a", "b"], "y", "g").collect()} == {(1, "x"): 2.0, (3, "x"): 3.0, (1, "z"): 1.0, (3, "z"): 2.0}
    assert LM.group_oof(df.limit(0), ["a"], "y", "g").collect() == []


def test_ridge_search(spark):
    """Scores of all folds and penalties, the choice, the out-of-fold and the external table equal the closed form."""
    r = np.random.default_rng(1)
    x, fold = r.normal(100, 5, (240, 4)), np.arange(240) % 4
    x[:, 3] = 7.0  # constant
    y = x[:, :3] @ [1.0, -2.0, 0.3] + 4 * r.normal(size=240)
    df, names = frame(spark, x, y, fold)
    alphas = (0.0, 1.0, 10.0, 100.0, 1000.0)
    search = LM.RidgeSearch(df, names, "y", "g", alphas)

    def fit(train, alpha):
        mu, sd = x[train].mean(0), x[train].std(0)
        sd[sd == 0] = 1
        z = (x[train] - mu) / sd
        w = np.linalg.lstsq(z.T @ z + alpha * np.eye(4), z.T @ (y[train] - y[train].mean()), rcond=None)[0]
        return lambda v: (v - mu) / sd @ w + y[train].mean()

    want = {}
    for k in range(4):
        for a in alphas:
            test = fold == k
            want[k, a] = 1 - ((y[test] - fit(~test, a)(x[test])) ** 2).mean() / y[test].var()
    assert {(q.fold, q.alpha): q.r2 for q in search.scores().collect()} == pytest.approx(want, abs=1e-9)
    mean = {a: np.mean([want[k, a] for k in range(4)]) for a in alphas}
    best = max(alphas, key=lambda a: (mean[a], -a))
    choice = search.choice().first()
    assert (choice.alpha, choice.edge) == (best, "bottom" if best == 0 else "top" if best == 1000 else None) and choice.mean_r2 == pytest.approx(mean[best])
    oof = {q.id: q.pred for q in search.oof().collect()}
    assert all(oof[i] == pytest.approx(fit(fold != fold[i], best)(x[i]), abs=1e-7) for i in range(240))
    other = df.where("id < 60").withColumn("s", F.col("id") % 7)
    p = fit(fold >= 0, best)(x[:60])
    got = {q.level: q for q in search.external(other, "s").collect()}
    assert got["row"].r2 == pytest.approx(1 - ((y[:60] - p) ** 2).mean() / y[:60].var()) and got["row"].n == 60
    my, mp = (np.array([v[:60][np.arange(60) % 7 == j].mean() for j in range(7)]) for v in (y, p))
    assert got["stimulus"].r2 == pytest.approx(1 - ((my - mp) ** 2).mean() / my.var()) and got["stimulus"].r == pytest.approx(np.corrcoef(my, mp)[0, 1])


def test_ridge_wide(spark):
    """More features than rows of a fold, and a choice at the top of the grid."""
    r = np.random.default_rng(2)
    x, y, g = r.normal(size=(40, 8)), r.normal(size=40), np.arange(40) % 10
    df, names = frame(spark, x, y, g)
    search = LM.RidgeSearch(df, names, "y", "g", (1.0, 1e6))
    assert search.choice().first().edge == "top"
    tr = g != 3
    z = (x[tr] - x[tr].mean(0)) / x[tr].std(0)
    w = np.linalg.solve(z.T @ z + np.eye(8), z.T @ (y[tr] - y[tr].mean()))
    p = (x[~tr] - x[tr].mean(0)) / x[tr].std(0) @ w + y[tr].mean()
    got = {(q.fold, q.alpha): q.r2 for q in search.scores().collect()}
    assert got[3, 1.0] == pytest.approx(1 - ((y[~tr] - p) ** 2).mean() / y[~tr].var())


# ---- bootstrap


def test_resamples_never_vanish(spark):
    """n resamples of as many draws as rows for groups of 1, 2, 40, 5,000 and a million rows and for null keys; their
    means spread as they should."""
    df = spark.sql(
        "SELECT 'one' g, 1L id, 5.0D x UNION ALL SELECT 'two', id, id FROM range(2) UNION ALL SELECT null, id, id % 7 FROM range(40) UNION ALL SELECT 'mid', id, id % 10 "
        "FROM range(5000) UNION ALL SELECT 'big', id, id % 1000 FROM range(1000000) UNION ALL SELECT 'none', id, null FROM range(3)"
    )
    got = B.resampled_sums(df, ["g"], {"s": F.col("x")}, 120, 3, ["id"]).toPandas()
    sizes = {"one": 1, "two": 2, None: 40, "mid": 5000, "big": 1_000_000}
    spread = {"one": 0.0, "two": 0.5 / 2**0.5, None: np.std(np.arange(40) % 7) / 40**0.5, "mid": np.std(np.arange(10)) / 5000**0.5, "big": np.std(np.arange(1000)) / 1000}
    got["g"] = got["g"].astype(object).where(got["g"].notna(), None)
    assert {g: len(d) for g, d in got.groupby(got["g"].map(str))} == {str(k): 120 for k in sizes}
    for g, n in sizes.items():
        d = got[got["g"].map(str) == str(g)]
        assert (d["_n"] == n).all() and sorted(d["rep"]) == list(range(120))
        assert (d["s"] / n).std() == pytest.approx(spread[g], rel=0.25, abs=1e-12)


def test_multiplicities_are_multinomial(spark):
    """Each row is drawn once on average, with the variance and the covariance of drawing with replacement, in one leaf
    and in a tree of leaves, and the leaves don't depend on the partitioning."""
    df = spark.range(64).selectExpr("id", *(f"CAST(id = {k} AS DOUBLE) AS v{k}" for k in range(4)))
    for leaf in (4096, 4):
        args = (["g"], {f"v{k}": F.col(f"v{k}") for k in range(4)}, 3000, 5, ["id"], leaf)
        a = B.resampled_sums(df.withColumn("g", F.lit(1)), *args).toPandas().sort_values("rep")
        b = B.resampled_sums(df.withColumn("g", F.lit(1)).repartition(7, "id"), *args).toPandas().sort_values("rep")
        assert (a[["_n", "v0", "v1", "v2", "v3"]].to_numpy() == b[["_n", "v0", "v1", "v2", "v3"]].to_numpy()).all()
        w = a[["v0", "v1", "v2", "v3"]].to_numpy()
        assert w.mean(axis=0) == pytest.approx([1] * 4, abs=0.08) and w.var(axis=0) == pytest.approx([63 / 64] * 4, abs=0.12)
        assert np.cov(w.T)[~np.eye(4, dtype=bool)] == pytest.approx([-1 / 64] * 12, abs=0.08)


def test_large_groups_draw_the_slots(spark):
    """Groups over a leaf take the rows that slot_sql() names, in one slab or several, null keys and all."""
    r = np.random.default_rng(8)
    rows = [(g, i, float(r.normal()), float(i)) for g, many in (("a", 5000), (None, 70), ("b", 3)) for i in range(many)]
    df = spark.createDataFrame(rows, "g string, id long, x double, z double")
    md5 = lambda *v: hashlib.md5("|".join(map(str, v)).encode()).hexdigest()
    for leaf, slab in ((B.LEAF, B.SLAB), (60, 128)):
        got = B.resampled_sums(df, ["g"], {"x": F.col("x"), "z": F.col("z")}, 40, 3, ["id"], leaf, slab).collect()
        assert len(got) == 120
        for g in ("a", None, "b"):
            mine = np.array([(x, z) for _, _, x, z in sorted((q for q in rows if q[0] == g), key=lambda q: md5(3, q[1]))])
            took = B.slot_rows(int(md5(*(v for v in (3, g) if v is not None))[:8], 16), np.arange(40), len(mine), len(mine))
            want = mine[took].sum(axis=1)
            for q in (q for q in got if q.g == g):
                assert q._n == len(mine) and (q.x, q.z) == pytest.approx(tuple(want[q.rep]), abs=1e-6)


def test_hash_is_even():
    """Draws hit every row alike, whatever the group, the resample and the slot."""
    for base in (0, 1, 2**32 - 1, 123456789):
        took = B.slot_rows(base, np.arange(400), 500, 50)
        n = np.bincount(took.ravel(), minlength=50)
        assert ((n - 4000) ** 2 / 4000).sum() < 90  # chi-square with 49 degrees, p about 0.0003
        assert abs(np.corrcoef(took[:, :-1].ravel(), took[:, 1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(took[:-1].ravel(), took[1:].ravel())[0, 1]) < 0.01


def test_intervals(spark):
    df = spark.range(4000).selectExpr("id", "1 AS g", "CAST(id % 10 AS DOUBLE) AS v")
    r = ST.bootstrap_mean(df, ["g"], "v", 400, 3, ["id"]).first()
    half = 1.96 * 8.25**0.5 / 4000**0.5
    assert r.lo < 4.5 < r.hi and (r.hi - r.lo) / 2 == pytest.approx(half, rel=0.2) and r.n == 4000
    gap = ST.gap_bootstrap(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["g"], "v", 400, 3, ["id"]).first()
    assert gap.gap == -1 and gap.lo < -1 < gap.hi


def test_paired_bootstrap_by_hand(spark):
    """A better and a worse prediction over clusters: both differences are a's less b's."""
    r = np.random.default_rng(7)
    o = r.normal(size=600)
    rows = [(int(i) % 30, float(v), float(v + 0.1 * r.normal()), float(v + 2 * r.normal())) for i, v in enumerate(o)]
    got = ST.paired_bootstrap(spark.createDataFrame(rows, "c int, o double, a double, b double"), "c", "o", "a", "b", 400, 3).first()
    a, b = (np.array([x[k] for x in rows]) for k in (2, 3))
    r2 = lambda p: 1 - ((o - p) ** 2).sum() / ((o - o.mean()) ** 2).sum()
    assert got["diff"] == pytest.approx(r2(a) - r2(b)) and got.dr == pytest.approx(np.corrcoef(o, a)[0, 1] - np.corrcoef(o, b)[0, 1])
    assert got.lo < got["diff"] < got.hi and got.dr_lo < got.dr < got.dr_hi and got.p == got.dr_p == 0
    same = ST.paired_bootstrap(spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0)], "c int, o double, a double, b double"), "c", "o", "a", "b", 50, 3).first()
    assert same["diff"] is None and same.dr is None  # no spread, no R2


# ---- rules worked out by hand


def test_stability_rule_lets_r_rise(spark):
    """r with the observed goes from 0.7 to 1: passed; from 1 to 0.7: a drop of 0.3, failed."""
    full = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 5.0)], "id int, p double")
    up = [(k, p + d, o) for (k, p), d, o in zip([(1, 1.0), (2, 2.0), (3, 3.0), (4, 5.0)], (0.01, -0.01, 0.02, 0.0), (1.01, 1.99, 3.02, 5.0))]
    rows = [("up", *x) for x in up] + [("down", k, p, o) for (k, p, _), o in zip(up, (2.0, 1.0, 5.0, 3.0))]
    df = spark.createDataFrame(rows, "cond string, id int, p double, o double")
    got = {r.cond: r for r in ST.stability_rule(full, df, ["cond"], "id", "p", "o", 0.95, 0.05, 0.0).collect()}
    assert got["up"].dr > 0 and got["up"].passed
    assert got["down"].passed == (got["down"].dr >= 0)


def test_ks_keeps_small_groups(spark):
    rows = [("x", "a", float(i)) for i in range(6)] + [("x", "b", float(i) + 3) for i in range(6)] + [("y", "a", 1.0), ("y", "b", 2.0)]
    got = {(r.g, r.overall): (r.ks, r.n_a, r.n_b) for r in ST.ks(spark.createDataFrame(rows, "g string, s string, v double"), ["g"], F.col("s") == "a", "v").collect()}
    # over all: up to 2 five of the seven a's (0, 1, 1, 2 and one more below 3) and one of the b's
    assert got == {("x", False): (0.5, 6, 6), ("y", False): (None, 1, 1), (None, True): (pytest.approx(4 / 7 - 1 / 7), 7, 7)}


# ---- snapshots


def log_of(spark, tmp_path, version="v"):
    return SnapshotLog(spark, str(tmp_path / "m"), ["file"], version)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "file string, v int, text string")


def content(log):
    return {(r.file, r.v, r.text) for r in log.read().collect()}


def test_snapshots(spark, tmp_path):
    """Duplicate keys, older versions that come late, replays, and reads of earlier versions."""
    log = log_of(spark, tmp_path)
    assert log.read() is None and log.latest() is None
    assert log.commit(rows_of(spark, [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "x")]), "one") == 0
    assert log.commit(rows_of(spark, [("b", 0, "late"), ("a", 3, "again"), ("c", None, "n")]), "two") == 1
    assert content(log) == {("a", 3, "again"), ("b", 1, "x"), ("c", None, "n")}
    assert log.commit(rows_of(spark, [("b", 9, "replayed")]), "one") is None
    assert content(log) == {("a", 3, "again"), ("b", 1, "x"), ("c", None, "n")} and [c["batch"] for c in log.commits()] == ["one", "two"]
    assert {(r.file, r.v) for r in log.read(0).collect()} == {("a", 3), ("b", 1)}
    log.commit(rows_of(spark, []), "three")
    assert len(content(log)) == 3


def test_killed_writes(spark, tmp_path):
    """A writer that is stopped before or while it commits leaves the manifest as it was, and its batch can come again."""
    log = log_of(spark, tmp_path)
    log.commit(rows_of(spark, [("a", 1, "x")]), "one")

    class Killed(SnapshotLog):
        def _create(self, number, data, batch):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Killed(spark, log.root, ["file"], "v").commit(rows_of(spark, [("a", 2, "lost")]), "two")
    assert content(log) == {("a", 1, "x")}
    half = tmp_path / "m" / "commits" / f"{1:012d}.json"
    half.write_text('{"number": 1, "batch": "two", "da')
    assert content(log) == {("a", 1, "x")} and log.latest()["number"] == 0
    assert log.commit(rows_of(spark, [("a", 2, "kept")]), "two") == 2
    assert content(log) == {("a", 2, "kept")}
    assert len(log.vacuum(keep=1)) == 2 and content(log) == {("a", 2, "kept")}
    assert log.commit(rows_of(spark, [("a", 9, "x")]), "one") is None


def test_writers_at_once(spark, tmp_path):
    """A writer that loses the race merges again on the winner's snapshot."""
    log, seen = log_of(spark, tmp_path), []

    class Slow(SnapshotLog):
        def _create(self, number, data, batch):
            if not seen:
                seen.append(log.commit(rows_of(spark, [("a", 1, "first")]), "fast"))
            super()._create(number, data, batch)

    assert Slow(spark, log.root, ["file"], "v").commit(rows_of(spark, [("b", 1, "second")]), "slow") == 1
    assert content(log) == {("a", 1, "first"), ("b", 1, "second")} and seen == [0]
    assert len(os.listdir(tmp_path / "m" / "data")) == 2

    class Never(SnapshotLog):
        def _create(self, number, data, batch):
            raise Conflict("x")

    with pytest.raises(Conflict):
        Never(spark, log.root, ["file"], "v").commit(rows_of(spark, [("c", 1, "x")]), "never")


def test_upsert_is_partition_free(spark):
    """Of several new rows of one key the same one wins, in any order and number of partitions."""
    rows = [("k", i % 3, f"t{i}") for i in range(30)] + [("j", None, "n"), ("j", None, "m")]
    base = rows_of(spark, [("k", 2, "old"), ("j", 0, "old")])
    for version, want in (("v", {("k", 2, "t8"), ("j", 0, "old")}), (None, {("k", 2, "t8"), ("j", None, "n")})):
        for df in (rows_of(spark, rows), rows_of(spark, rows[::-1]).repartition(5, "text")):
            assert {tuple(r) for r in IO.upsert(base, df, ["file"], version).collect()} == want
    assert collections.Counter(r.file for r in IO.upsert(base, rows_of(spark, rows), ["file"]).collect()) == {"k": 1, "j": 1}


# ---- clusters and similarity


def plain_kmeans(x, centres, tol):
    for _ in range(100):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        moved = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if ((moved - centres) ** 2).sum() <= tol:
            break
        centres = moved
    return centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_best_starts(spark):
    """All fits in shared passes give what each gives alone from its own first centres, and the best of them is kept."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.6, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0), (0, 0, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    got = M.best_starts(df, "id", "v", range(2, 6), 4, 11)
    pool = np.array([q[0] for q in df.orderBy(order_key(12, "id"), "id").limit(320).select("v").collect()])
    tol = 1e-4 * x.var(axis=0).mean()
    for k in range(2, 6):
        fits = [plain_kmeans(x, M._spaced(pool, k, np.random.default_rng([11, k, j])), tol) for j in range(4)]
        best = min(fits, key=lambda t: t[1])
        assert got[k][1] == pytest.approx(best[1], rel=1e-9) and np.allclose(got[k][0], best[0])
    assert got[4][1] < got[3][1] < got[2][1]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id int, v array<double>")
    assert M.best_starts(same, "id", "v", range(4, 5), 2, 1)[4][1] == 0


def test_silhouette():
    """Equal to the definition, with single rows and equal rows."""
    r = np.random.default_rng(4)
    x, label = r.normal(size=(150, 3)), r.integers(0, 5, 150)
    x[:6], label[7:150][label[7:150] == 4] = x[0], 3
    label[149] = 4  # alone
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(150):
        own = (label == label[i]) & (np.arange(150) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b) if max(a, b) else 0.0)
    assert M.silhouette(x, label, block=32) == pytest.approx(np.mean(want))
    assert M.silhouette(x, np.zeros(150, int)) == -1


def test_clusters(spark):
    """Four far groups are found, with k by the silhouette; other rows get the nearest; nulls drop out."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.3, (40, 4)) for c in np.eye(4) * 9])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {q.id: q for q in M.clusters(df.where("id % 2 = 0"), df, "id", "v", range(2, 7), pca=3, starts=5).collect()}
    assert len(got) == 160 and {q.k for q in got.values()} == {4}
    assert len({got[i].cluster for i in range(160)}) == 4 and all(len({got[i].cluster for i in range(g * 40, g * 40 + 40)}) == 1 for g in range(4))
    assert M.clusters(df.limit(0), df, "id", "v", range(2, 4)).collect() == []


def test_assigned():
    """All models at once give each row one centre a model, the first of equally near ones, as one model at a time does."""
    r = np.random.default_rng(2)
    x, sizes = r.normal(size=(300, 5)).round(1), [2, 4, 1, 3]
    ends, centres = np.cumsum(sizes), r.normal(size=(10, 5)).round(1)
    centres[3] = centres[4] = centres[2]  # a model with three equal centres
    x[:3], centres[7], centres[8] = 0.0, 1.0, -1.0  # rows between two centres
    one, low = M.assigned(x, centres, ends, sizes)
    for i, (e, k) in enumerate(zip(ends, sizes)):
        near = M.nearest_centre(x, centres[e - k : e])
        assert (one[e - k : e] == np.eye(k)[:, near]).all()
        assert low[i] + (x * x).sum(axis=1) == pytest.approx(((x - centres[e - k : e][near]) ** 2).sum(axis=1))


def test_caption_bounds(spark):
    """Percentiles are exact at any number of leading coordinates, also with ties; few products are needed where the vectors
    have few directions, and the moments of z need no pairs at all."""
    r = np.random.default_rng(6)
    axes = np.linalg.qr(r.normal(size=(24, 24)))[0]
    vec = lambda: np.round((r.normal(size=24) * np.array([1.0] * 3 + [0.02] * 21)) @ axes, 3)
    audio, caps = [(k, vec()) for k in range(60)], [(k, c, vec()) for k in range(60) for c in range(2)]
    caps += [(60 + k, 0, caps[k][2]) for k in range(5)]  # equal captions of clips that aren't there
    a = spark.createDataFrame([(k, v.tolist()) for k, v in audio], "k int, vec array<double>")
    c = spark.createDataFrame([(k, n, v.tolist()) for k, n, v in caps], "k int, cap int, vec array<double>")
    of = dict(audio)
    sims = {(k, n): [round(float(of[k] @ t), 12) for j, _, t in caps if j != k] for k, n, _ in caps if k in of}
    own = {(k, n): round(float(of[k] @ t), 12) for k, n, t in caps if k in of}
    want = {x: sum(s < own[x] for s in sims[x]) / len(sims[x]) for x in own}
    for lead in (1, 3, 24, None):
        got = E.caption_percentile(a, c, "k", block=50, lead=lead).collect()
        assert {(q.k, q.cap): q.pct for q in got} == pytest.approx(want)
        if lead == 3:
            assert np.mean([q.multiplied for q in got]) < 0.1
    z = {(q.k, q.cap): q.z for q in E.caption_z(a, c, "k").collect()}
    raw = {x: [float(of[x[0]] @ t) for j, _, t in caps if j != x[0]] for x in own}
    assert z == pytest.approx({(k, n): (float(of[k] @ t) - np.mean(raw[k, n])) / (np.std(raw[k, n]) + 1e-9) for k, n, t in caps if k in of}, abs=1e-6)


# ---- text ridge


def test_text_ridge(spark):
    """Penalties, predictions' R2 and the pooled R2 equal dense ridges in closed form, with empty texts, terms of one text
    only, repeated texts and terms that a training set doesn't know; nulls drop out."""
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)] + ["é漢", "a", "B_1"]
    rows = [(i, " ".join(r.choice(words, r.integers(0, 15))), 0.0) for i in range(80)]
    rows = [(i, t, float(t.count("w1 ") - t.count("w2 ") + 0.2 * r.normal())) for i, t, _ in rows] + [(80, rows[3][1], 1.0), (81, "", 2.0)]
    df = spark.createDataFrame([*rows, (82, None, 1.0), (83, "x y", None)], "id int, text string, y double")
    cells = {q.id: (q.f, q.i) for q in df.where("id < 82").select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("f"), F.pmod(F.xxhash64("id", F.lit("inner")), F.lit(5)).alias("i")).collect()}
    alphas = (0.01, 0.3, 3.0, 30.0)

    def terms(t):
        w = re.findall(r"\w\w+", t.lower())
        return collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    def fit(train, test, alphas):
        df_ = collections.Counter(x for k in train for x in terms(rows[k][1]))
        at = {x: j for j, x in enumerate(sorted(df_))}

        def dense(ks):
            x = np.zeros((len(ks), len(at)))
            for i, k in enumerate(ks):
                for w, c in terms(rows[k][1]).items():
                    if w in at:
                        x[i, at[w]] = c * (np.log((1 + len(train)) / (1 + df_[w])) + 1)
            n = np.sqrt((x * x).sum(axis=1))
            return x / np.where(n > 0, n, 1)[:, None]

        a, b, y = dense(train), dense(test), np.array([rows[k][2] for k in train])
        z = a - a.mean(axis=0)
        return [y.mean() + (b - a.mean(axis=0)) @ np.linalg.solve(z.T @ z + s * np.eye(z.shape[1]), z.T @ (y - y.mean())) for s in alphas]

    want, preds, ys = {}, [], []
    for f in sorted({c[0] for c in cells.values()}):
        train, test = [k for k in cells if cells[k][0] != f], [k for k in cells if cells[k][0] == f]
        part, probe = [k for k in train if cells[k][1]], [k for k in train if not cells[k][1]]
        loss = [((np.array([rows[k][2] for k in probe]) - p) ** 2).sum() for p in fit(part, probe, alphas)]
        best = alphas[int(np.argmin(loss))]
        p, y = fit(train, test, [best])[0], np.array([rows[k][2] for k in test])
        want[f] = (best, len(test), 1 - ((y - p) ** 2).mean() / y.var())
        preds, ys = [*preds, *p], [*ys, *y]
    got = TR.text_ridge(df, "text", "y", "id", alphas).collect()
    assert {q.fold: (q.alpha, q.n) for q in got} == {f: w[:2] for f, w in want.items()} and {q.permutation for q in got} == {0}
    assert {q.fold: q.r2 for q in got} == pytest.approx({f: w[2] for f, w in want.items()}, abs=1e-5)
    assert got[0].pooled_r2 == pytest.approx(1 - ((np.array(ys) - preds) ** 2).mean() / np.var(ys), abs=1e-5)
    control = {q.permutation: q.pooled_r2 for q in TR.text_ridge(df, "text", "y", "id", alphas, permutations=3).collect()}
    assert set(control) == {1, 2, 3} and len(set(control.values())) == 3 and max(control.values()) < got[0].pooled_r2
    assert TR.text_ridge(df.limit(0), "text", "y", "id").collect() == []


def test_text_ridge_holds_no_number_of_a_term(spark, monkeypatch):
    """With about 40,000 shared terms the driver holds numbers of the texts only. Systems solved one by one, as where they are
    too many to be held together, equal dense ridges over the texts' products in closed form."""
    monkeypatch.setattr(TR, "HELD", 1, raising=False)
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in r.integers(0, 3000, 2000)) for _ in range(12)] * 2
    rows = [(i, t, float(i % 12 % 5 + 0.3 * r.normal())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, y double").repartition(3)
    cell = np.array([(q.f, q.i) for q in df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("f"), F.pmod(F.xxhash64("id", F.lit("inner")), F.lit(5)).alias("i")).orderBy("id").collect()])
    tracemalloc.start()
    got = {q.fold: (q.alpha, q.n, q.r2) for q in TR.text_ridge(df, "text", "y", "id", (0.5,), folds=3).collect()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    counts = [collections.Counter((w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]) for t in texts]
    at, y, want = {x: j for j, x in enumerate(sorted(set().union(*counts)))}, np.array([q[2] for q in rows]), {}
    tf = np.zeros((len(texts), len(at)))
    for i, c in enumerate(counts):
        tf[i, [at[w] for w in c]] = list(c.values())
    for f in sorted(set(cell[:, 0].tolist())):
        train, test = cell[:, 0] != f, cell[:, 0] == f
        known = (tf[train] > 0).sum(axis=0)
        x = tf * np.where(known > 0, np.log((1 + train.sum()) / (1 + known)) + 1, 0)
        x /= np.linalg.norm(x, axis=1)[:, None]
        x -= x[train].mean(axis=0)
        a = np.linalg.solve(x[train] @ x[train].T + 0.5 * np.eye(train.sum()), y[train] - y[train].mean())
        pred = y[train].mean() + x[test] @ (x[train].T @ a)
        if (train & (cell[:, 1] == 0)).any():
            want[f] = (0.5, int(test.sum()), pytest.approx(1 - ((y[test] - pred) ** 2).mean() / y[test].var(), abs=1e-5))
    assert len(want) > 1 and got == want


def test_text_ridge_control_holds_no_number_of_a_term(spark):
    """Nor do the systems of texts dealt anew, all together."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in r.integers(0, 3000, 2000)) for _ in range(6)] * 2
    df = spark.createDataFrame([(i, t, float(i % 5)) for i, t in enumerate(texts)], "id int, text string, y double")
    tracemalloc.start()
    got = TR.text_ridge(df, "text", "y", "id", (0.5, 5.0), folds=2, permutations=2).collect()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {q.permutation for q in got} == {1, 2} and peak < 5_000_000


def test_text_ridge_deals_without_texts(spark):
    """Permutations are those of the md5 orders, worked out in plain Python; no text is dealt with them."""
    rows = spark.range(40).select(F.col("id").alias("_key"), F.lit("a text").alias("text"), (F.col("id") * 1.0).alias("y"))
    got = TR._variants(rows, "_key", 3, 2, 7)
    assert got.columns == ["_key", "no", "at"]
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    by = sorted(range(40), key=lambda k: md5(str(k)))
    orders = [sorted(range(40), key=lambda k: md5(f"{7 + p}|{k}")) for p in range(2)]
    want = {k: (by.index(k), [float(by[o.index(k)]) for o in orders]) for k in range(40)}
    assert {q._key: (q.no, [a.y for a in q.at]) for q in got.collect()} == want


def test_text_ridge_leaves_nothing(spark):
    """Shuffles of hundreds of passes would fill the disks, as would a copy of the counts for each group of systems."""
    files = lambda: set(filter(None, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    tables = lambda: {f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    stood = tables()
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to = spark.conf.get(name)
    df = spark.createDataFrame([(i, f"ab cd{i % 3} ef{i % 4} gh{i}", float(i % 5)) for i in range(30)], "id int, text string, y double")
    assert len(TR.text_ridge(df, "text", "y", "id", (0.5, 5.0), folds=2, permutations=2).collect()) == 4
    assert not [f for f in files() - before if "shuffle_" in f]
    assert {t.rsplit("-", 1)[0] for t in tables() - stood} <= {"text-numbers", "text-variants"} and spark.conf.get(name) == set_to


def test_text_ridge_counts_once_a_text(spark, monkeypatch):
    """Tasks send a text's terms counted, as digests that are equal where the terms are, however words are cut into stretches;
    a pair isn't one of its words, nor the pair the other way round, nor does it reach into the next text."""
    texts = ["ab cd ab cd AB", "", "cd ab", "x ab_1 é漢 ab_1", "ab", "ab cd ab cd ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, text string").repartition(1)
    batch = df.orderBy("no").select("no", TR.words_of("text").alias("words")).toArrow().combine_chunks().to_batches()[0]

    def terms(t):
        w = re.findall(r"\w\w+", t.lower())
        return collections.Counter([(a,) for a in w] + list(zip(w, w[1:])))

    want = collections.Counter((i, k, c) for i, t in enumerate(texts) for k, c in terms(t).items())
    for words in (1, 3, 10**6):
        monkeypatch.setattr(TR, "WORDS", words)
        got = [q for out in TR._counted(iter([batch.slice(0, 3), batch.slice(3)])) for q in out.to_pylist()]
        for i, t in enumerate(texts):
            mine = sorted(q["tf"] for q in got if q["no"] == i)
            assert mine == sorted(terms(t).values())
        by = collections.defaultdict(set)
        for q in got:
            by[q["term"]].add((q["no"], q["tf"]))
        names = collections.defaultdict(set)
        for i, k, c in want:
            names[k].add((i, c))
        assert len(got) == len(want) and sorted(map(sorted, by.values())) == sorted(map(sorted, names.values())) and all(len(t) == TR.DIGEST for t in by)


def test_text_ridge_needs_few_passes(spark, monkeypatch):
    """Residuals stay orthogonal to the first ones, so that large eigenvalues far apart cost their passes once only (87 passes
    without that)."""
    r = np.random.default_rng(7)
    rows = [(i, " ".join([f"g{i % 2}"] * int(r.integers(20, 60)) + [f"h{i % 6}"] * int(r.integers(5, 30)) + [f"w{w}" for w in r.integers(0, 60, 12)]), float(r.normal())) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, text string, y double").repartition(2)
    passes, by_text = [], TR._by_text
    monkeypatch.setattr(TR, "_by_text", lambda *a, **b: passes.append(1) or by_text(*a, **b))
    got = TR.text_ridge(df, "text", "y", "id", (1e-6,), folds=2).collect()
    assert len(got) == 2 and len(passes) < 65


def test_text_tiles(monkeypatch):
    """Terms stay whole in a tile, however batches and tiles cut their rows."""
    r = np.random.default_rng(1)
    rows = sorted((f"t{t:03}", int(no), int(r.integers(1, 9))) for t in range(60) for no in r.choice(40, r.choice([1, 2, 5, 30]), replace=False))
    by = collections.defaultdict(list)
    for t, no, tf in rows:
        by[t].append((no, tf))
    table = pa.table({"term": [q[0] for q in rows], "no": pa.array([q[1] for q in rows], pa.int32()), "tf": pa.array([q[2] for q in rows], pa.int32())})
    for tile, batch in ((1, 1), (1, 7), (100, 3), (10**6, 10), (10**6, 10**6)):
        monkeypatch.setattr(TR, "TILE", tile)
        shared, own = [], []
        for out in TR._packed(iter(table.to_batches(max_chunksize=batch))):
            no, tf, texts, own_no, own_tf = (next(TR._ints(c)).tolist() for c in out.columns)
            own += zip(own_no, own_tf)
            for k in texts:
                shared.append(list(zip(no[:k], tf[:k])))
                no, tf = no[k:], tf[k:]
            assert not no
        assert shared == [v for v in by.values() if len(v) > 1] and own == [v[0] for v in by.values() if len(v) == 1]


# ---- boosting


def grown(x, g, leaves, least, l2, rate):
    """A best-first tree by trying every cut of every leaf: the leaves' rules and values."""

    def best(rows):
        top, total = None, g[rows].sum() ** 2 / (len(rows) + l2)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(low), len(high)) >= least:
                    gain = g[low].sum() ** 2 / (len(low) + l2) + g[high].sum() ** 2 / (len(high) + l2) - total
                    top = (gain, f, v) if top is None or gain > top[0] + 1e-12 else top
        return top

    every = np.arange(len(x))
    out = [([], every, best(every))]
    while len(out) < leaves and (able := [o for o in out if o[2] and o[2][0] > 1e-9]):
        top = max(able, key=lambda o: o[2][0])
        (_, f, v), (rule, rows, _) = top[2], top
        low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
        out = [o for o in out if o is not top] + [([*rule, (f, v, True)], low, best(low)), ([*rule, (f, v, False)], high, best(high))]
    return [(rule, -rate * g[rows].sum() / (len(rows) + l2)) for rule, rows, _ in out]


def falls(tree, x):
    out = np.zeros(len(x))
    for rule, value in tree:
        out[np.all([(x[:, f] <= v) == low for f, v, low in rule] or [np.ones(len(x), bool)], axis=0)] = value
    return out


def test_boosting(spark):
    """Trees, early stopping, scores, choice and predictions of all models equal trees grown by trying every cut."""
    r = np.random.default_rng(0)
    n, rate, most = 240, 0.4, 14
    x = np.round(r.normal(size=(n, 2)), 1)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) + 0.4 * r.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 3) for i in range(n)] + [(n, None, 1.0, 1.0, 0)], "id int, a double, b double, y double, f int")
    grid = ((6, 10, 0.0), (3, 40, 2.0))
    boost = BO.Boosting(df, ["a", "b"], "y", "f", "id", grid=grid, rounds=most, rate=rate)
    stop = {q.id for q in df.where(F.pmod(F.xxhash64("id", F.lit("stop")), F.lit(BO.HELD)) == 0).select("id").collect()}
    stops = np.array([i in stop for i in range(n)])
    got, want, kept = {(q.leaves, q.least, q.l2, q.fold): (q.trees, q.r2) for q in boost.scores().collect()}, {}, {}
    for g in grid:
        for f in (0, 1, 2, None):
            mine = np.ones(n, bool) if f is None else np.arange(n) % 3 != f
            train, held = mine & ~stops, mine & stops
            p, losses, trees = np.full(n, y[train].mean()), [], 0
            while True:
                losses.append(((p - y)[held] ** 2).mean() / 2)
                if trees == most or len(losses) > BO.PATIENCE and not any(v < losses[-BO.PATIENCE - 1] - BO.TOL for v in losses[-BO.PATIENCE :]):
                    break
                tree = grown(x[train], (p - y)[train], *g, rate)
                if len(tree) < 2:
                    break
                p, trees = p + falls(tree, x), trees + 1
            kept[g, f] = p
            if f is not None:
                want[(*g, f)] = (trees, 1 - ((y - p)[~mine] ** 2).mean() / y[~mine].var())
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-9)
    best = max(grid, key=lambda g: np.mean([want[(*g, f)][1] for f in range(3)]))
    choice = boost.choice().first()
    assert (choice.leaves, choice.least, choice.l2) == best
    assert all(q.pred == pytest.approx(kept[best, q.f][q.id]) for q in boost.oof().withColumnRenamed("fold", "f").collect())
    assert all(q.pred == pytest.approx(kept[best, None][q.id]) for q in boost.predict(df.drop("y", "f")).collect())


def test_boosting_by_cells(spark, monkeypatch):
    """Few cells are fitted without a pass over the rows, with the same trees and scores as by passes."""
    df = spark.range(3000).selectExpr("id", "CAST(id * 31 % 23 AS DOUBLE) AS a", "CAST(id * 7 % 11 AS DOUBLE) AS b", "sin(id * 31 % 23) + id * 7 % 11 / 5 + id * 13 % 17 / 20 AS y", "id % 3 AS f")
    make = lambda: BO.Boosting(df, ["a", "b"], "y", "f", "id", grid=((6, 10, 0.0), (4, 50, 1.0)), rounds=4, rate=0.3)
    rows = lambda b: {(q.leaves, q.fold): (q.trees, q.n, round(q.r2, 9)) for q in b.scores().collect()}
    monkeypatch.setattr(BO, "CELLS", 0)
    by_passes = make()
    monkeypatch.undo()
    monkeypatch.setattr(BO.Boosting, "_pass", None)
    by_cells = make()
    assert rows(by_cells) == rows(by_passes) and len(rows(by_cells)) == 6
    assert [[t.splits for t in m.trees] for m in by_cells.models] == [[t.splits for t in m.trees] for m in by_passes.models]


def test_boosting_edges(spark):
    """Nothing to split, more distinct values than bins, and an empty table."""
    flat = spark.range(30).selectExpr("id", "1.0D AS a", "CAST(id AS DOUBLE) AS y", "id % 2 AS f")
    assert {(q.trees, q.n) for q in BO.Boosting(flat, ["a"], "y", "f", "id", grid=((4, 2, 0.0),)).scores().collect()} == {(0, 15)}
    many = spark.range(2000).selectExpr("id", "CAST(id AS DOUBLE) AS a", "CAST(id > 700 AS DOUBLE) AS y", "id % 2 AS f")
    got = BO.Boosting(many, ["a"], "y", "f", "id", grid=((4, 20, 0.0),), rounds=3, rate=1.0).scores().collect()
    assert all(q.r2 > 0.95 for q in got)
    assert BO.Boosting(many.limit(0), ["a"], "y", "f", "id").scores().collect() == []
