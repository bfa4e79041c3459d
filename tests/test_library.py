"""Boundary fixtures and properties of the library: bins, number text, quotas, chunks, sources, sinks, resume."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions import text as T
from larkspur.operators import models as M
from larkspur.operators import rollup as R
from larkspur.operators import screen as X
from larkspur.operators import select as L
from larkspur.operators import signal as G
from larkspur.operators import similarity as E
from larkspur.operators import stats as ST
from larkspur.plans import manifest as P
from larkspur.sources import io as IO
from larkspur.sources.snapshots import SnapshotLog
from larkspur.streaming import incremental as INC


def col(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_bins_at_edges(spark):
    got = [r[0] for r in col(spark, [-0.51, -0.5, -0.15, 0.15, 0.5, 0.51, None, float("nan")]).select(S.pleasantness_bin("x")).collect()]
    assert got == ["very_unpleasant", "very_unpleasant", "unpleasant", "neutral", "pleasant", "very_pleasant", None, None]


def test_number_text(spark):
    got = [r[0] for r in col(spark, [0.125, 0.345, 2.675, -0.001, -0.004, 1.0]).select(T.fmt2("x")).collect()]
    assert got == ["0.12", "0.34", "2.67", "0.00", "0.00", "1.00"]


def test_top_sources_ties(spark):
    df = spark.createDataFrame([(3.5, 3.5, 5.0, None), (3.4, float("nan"), 1.0, 2.0), (4.0, 4.0, 4.0, 4.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(T.top_sources({"traffic": F.col("a"), "other_noise": F.col("b"), "human": F.col("c"), "natural": F.col("d")})).collect()]
    assert got == [["human sounds", "traffic noise"], [], ["traffic noise", "other noise"]]


def loop_fill(caps, quota):
    take = dict.fromkeys(caps, 0)
    left = min(quota, sum(caps.values()))
    while left:
        active = [k for k in caps if take[k] < caps[k]]
        step = min(min(caps[k] - take[k] for k in active), left // len(active))
        if step == 0:
            for k in sorted(active, key=lambda k: (take[k] - caps[k], k))[:left]:
                take[k] += 1
            break
        for k in active:
            take[k] += step
        left -= step * len(active)
    return take


def test_waterfill_property(spark):
    rng = random.Random(3)
    groups = [({f"k{i}": rng.choice([0, 1, 5, 5, rng.randint(0, 60)]) for i in range(rng.randint(1, 7))}, rng.choice([0, 1, 7, rng.randint(0, 200)])) for _ in range(60)]
    rows = [(g, k, c, q) for g, (caps, q) in enumerate(groups) for k, c in caps.items()]
    got = {(r.g, r.k): r["take"] for r in L.waterfill(spark.createDataFrame(rows, "g int, k string, cap long, quota long"), "quota", ["k"], by=["g"]).collect()}
    for g, (caps, q) in enumerate(groups):
        take = {k: got[g, k] for k in caps}
        assert sum(take.values()) == min(q, sum(caps.values())) and all(take[k] <= caps[k] for k in caps)
        assert take == loop_fill(caps, q), (caps, q)


def test_selection_is_partition_free(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 5).alias("b"), (F.col("id") % 7).alias("c"))
    pick = lambda d: {r.id for r in L.round_robin(d, ["b"], ["c"], 20, 1, ["id"]).collect()}
    assert pick(df) == pick(df.repartition(7, "c")) and len(pick(df)) == 100
    budget = lambda d: {r.id for r in L.take_budget(d, "c", 300, 1, ["id"]).collect()}
    assert budget(df) == budget(df.repartition(9))
    assert L.round_robin(df.limit(0), ["b"], ["c"], 3, 1, ["id"]).count() == 0


def test_chunks_cover(spark):
    rows = P.chunk_plan(col(spark, [9.7, 9.8, 20.0, 29.8, 0.0]), "x", 10.0, 0.25).orderBy("x", "chunk").collect()
    assert [(r.x, r.chunk, r.start, r.end, round(r.pad, 2)) for r in rows] == [(9.8, 0, 0.0, 9.8, 0.2), (20.0, 0, 0.0, 10.0, 0.0),
        (20.0, 1, 10.0, 20.0, 0.0), (29.8, 0, 0.0, 10.0, 0.0), (29.8, 1, 10.0, 20.0, 0.0), (29.8, 2, 20.0, 29.8, 0.2)]
    parts = P.split_plan(col(spark, [45.0, 5.0]), "x", 30.0, 1.0).orderBy("x", "part").collect()
    assert [(r.start, r.end) for r in parts] == [(0.0, 5.0), (0.0, 22.0), (22.0, 45.0)]
    assert [r.start for r in P.window_starts(col(spark, [15.0, 5.0]), "x", 10.0).orderBy("x", "win").collect()] == [0.0, 0.0, 0.0, 0.0, 2.0, 5.0]


def test_p_values(spark):
    """Table values of Student's t, ends, and thousands of degrees of freedom."""
    cases = [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (12.706, 1, 0.05), (3.169, 10, 0.01), (4.587, 10, 0.001), (1.812, 10, 0.1), (63.657, 1, 0.01), (2.576, 1e6, 0.01), (0.7, 10, 0.49989), (1e-9, 7, 1.0)]
    df = spark.createDataFrame([(float(t), float(d), p) for t, d, p in cases], "t double, d double, want double")
    for r in df.withColumn("p", ST.t_two_sided(F.col("t"), F.col("d"))).collect():
        assert r.p == pytest.approx(r.want, rel=1e-3), r
    # closed forms of 1 and 2 degrees of freedom, to twelve digits
    one = spark.range(1, 40).select((F.col("id") / 7).alias("t"))
    for r in one.select("t", ST.t_two_sided(F.col("t"), F.lit(1.0)).alias("p1"), ST.t_two_sided(F.col("t"), F.lit(2.0)).alias("p2")).collect():
        assert r.p1 == pytest.approx(1 - 2 * math.atan(r.t) / math.pi, rel=1e-11) and r.p2 == pytest.approx(1 - r.t / math.sqrt(2 + r.t * r.t), rel=1e-11)
    for x in (0.5, 1.0, 1.5, 7.25, 1000.5):
        assert spark.range(1).select(ST.log_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
    bad = spark.createDataFrame([(1.0, 10), (0.5, 2), (None, 9), (0.5, 1)], "rho double, n long")
    assert {r.p for r in ST.correlation_p(bad).collect()} == {None}


def test_files(spark, tmp_path):
    for name in ("a/X.hdf.wav", "a/X.wav", "b/X.wav", "b/._X.wav", "__MACOSX/Y.wav", "b/Z.1.wav"):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_bytes(b"0")
    got = {r.key: r.path.split("/w/")[1] for r in IO.file_index(spark, str(tmp_path / "w")).collect()}
    assert got == {"X": "a/X.wav", "Z": "b/Z.1.wav"}
    (tmp_path / "l.txt").write_text("# c\nid1|g|a thing\n\nplain\n")
    assert [tuple(r) for r in IO.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()] == [(2, "id1", "g", "a thing"), (4, "prompt04", None, "plain")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"id": "a", "v": 1}')
    (tmp_path / "j" / "2.json").write_text("{broken")
    recs = IO.read_json_dir(spark, str(tmp_path / "j"), "id string, v int").collect()
    assert sorted((r.id, r._corrupt_record is not None) for r in recs if r.id) == [("a", False)] and len(recs) == 2
    (tmp_path / "t.csv").write_text("id,x\n1,2.5\n2,nan\n3,\nbad,1\n")
    assert [r.x for r in IO.read_table(spark, str(tmp_path / "t.csv"), "id string, x double").orderBy("id").collect()] == [2.5, None, None, 1.0]
    good, bad = IO.read_loose(spark, str(tmp_path / "t.csv"), ["id", "x"], {"id": "int", "x": "double"})
    assert [r.id for r in good.collect()] == [1] and bad.count() == 3
    for s in ("dev", "eval"):
        (tmp_path / f"captions_{s}.csv").write_text(f"file_name,caption\nf{s},café\n", encoding="utf-8")
        (tmp_path / f"metadata_{s}.csv").write_bytes(f"file_name,who\nf{s},Zoé\n".encode("latin-1"))
    stacked = IO.read_splits(spark, str(tmp_path), ["dev", "eval"], "file_name string, caption string", "file_name string, who string").collect()
    assert sorted((r.split, r.caption, r.who) for r in stacked) == [("dev", "café", "Zoé"), ("eval", "café", "Zoé")]
    pairs = IO.pair_sidecars(spark.createDataFrame([("r/b1/x.wav",), ("r/b1/y.wav",)], "path string"), spark.createDataFrame([("r/b1/x.txt", " cap \n")], "path string, value string"))
    assert [tuple(r) for r in pairs.select("bin", "stem", "file", "caption").collect()] == [("b1", "x", "r/b1/x.wav", "cap \n".strip())] or pairs.count() == 1


def test_zip_lines(spark):
    t = lambda s: spark.createDataFrame([(s,)], "value string")
    assert [tuple(r) for r in IO.zip_lines({"a": t("1\n2\n"), "b": t("x\ny")}).orderBy("line_no").collect()] == [(0, "1", "x"), (1, "2", "y")]
    with pytest.raises(Exception):  # noqa: B017
        IO.zip_lines({"a": t("1\n2"), "b": t("x")}).collect()


def test_manifest_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", "one"), ("b.wav", "two")], "file string, caption string")
    out = str(tmp_path / "m")
    IO.write_manifest(df, out, {"chunk_info": df.select("file")}, {"seed": 1})
    assert spark.read.parquet(f"{out}/metadata").count() == 2 and spark.read.parquet(f"{out}/chunk_info").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        IO.write_manifest(df, out)
    done = spark.read.parquet(f"{out}/metadata")
    assert IO.pending(df, done, ["file"]).count() == 0
    assert {(r.file, r.caption) for r in IO.upsert(done, spark.createDataFrame([("b.wav", "new")], df.schema), ["file"]).collect()} == {("a.wav", "one"), ("b.wav", "new")}
    ok, bad = IO.split_errors(spark.createDataFrame([(1, "r", None), (2, None, "e")], "id int, result string, error string"))
    assert [r.id for r in ok.collect()] == [1] and [r.error for r in bad.collect()] == ["e"]
    IO.write_report(df, str(tmp_path / "r"), ["file"], "\t", "idx")
    IO.write_playlist(df, str(tmp_path / "p"), F.concat_ws(",", "file", "caption"), ["file"])
    assert spark.read.text(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        P.replace_rows(df, df, "one")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "file string, v int, ts int").coalesce(1).write.parquet(src)
    log = SnapshotLog(spark, str(tmp_path / "m"), ["file"], "ts")
    for more in ([], [("b", 2, 2), ("b", 3, 3), ("b", 9, 1)]):
        if more:
            spark.createDataFrame(more, "file string, v int, ts int").coalesce(1).write.mode("append").parquet(src)
        INC.upsert_stream(spark.readStream.schema("file string, v int, ts int").parquet(src), log, str(tmp_path / "c"), "files").awaitTermination()
    assert {(r.file, r.v) for r in log.read().collect()} == {("a", 1), ("b", 3)}
    assert [c["batch"] for c in log.commits()] == ["files/0", "files/1"]
    # a stream whose checkpoint is lost replays its batches under the same numbers: they are known
    INC.upsert_stream(spark.readStream.schema("file string, v int, ts int").parquet(src), log, str(tmp_path / "c2"), "files").awaitTermination()
    assert len(log.commits()) == 2
    assert {(r.file, r.v) for r in INC.latest_by_key(spark.read.parquet(src), ["file"], "ts").collect()} == {("a", 1), ("b", 3)}


def test_entry_without_llm(tmp_path):
    """The entry module imports, and keeps its own queries, where the llm folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})


def test_scene_of_unknown(spark):
    df = spark.createDataFrame([("bird", "quiet"), (" Bird ", "quiet"), ("bird", "deafening"), ("drone", "quiet"), ("drone", "loud"), ("drone", "moderate"), ("drone", "x")], "m string, lv string")
    got = [tuple(r.s) for r in df.select(T.scene_of("m", "lv").alias("s")).collect()]
    assert got[0] == got[1] == (T.SCENES["bird", "quiet"], 0.9) and got[2] == (T.SCENES["bird", "moderate"], 0.9)
    assert got[3:] == [("quiet environment", 0.5), ("loud environment", 0.5), ("moderate activity environment", 0.5), ("moderate activity environment", 0.5)]


def test_grid_effects_by_hand(spark):
    """A grid with one shared level is left out; an effect of 0 isn't ordered; levels meet at four decimals; the seed
    SD is that of all measured levels."""
    rows = [("g", "a", 0.0, s, v) for s, v in ((1, 1.0), (2, 3.0))] + [("g", "a", 0.50001, s, v) for s, v in ((1, 4.0), (2, 6.0))] + [("g", "a", 1.0, s, v) for s, v in ((1, 8.0), (2, 10.0))]
    rows += [("g", "b", 0.0, s, 5.0) for s in (1, 2)] + [("g", "b", 0.50002, s, 7.0) for s in (1, 2)] + [("g", "b", 1.0, s, 5.0) for s in (1,
        2)] + [("g", "b", 2.0, s, v) for s, v in ((1, 0.0), (2, 4.0))]
    rows += [("h", "a", 0.0, 1, 1.0), ("h", "a", 1.0, 1, 2.0), ("h", "b", 0.0, 1, 1.0), ("h", "b", 3.0, 1, 2.0)]
    df = spark.createDataFrame(rows, "grid string, item string, p double, seed int, value double").withColumn("metric", F.lit("m"))
    got = {(r.grid, r.item): r for r in R.grid_effects(df, ["grid"], "item", "p", "metric", "value", 2.0).collect()}
    assert set(got) == {("g", "a"), ("g", "b")}
    sd = (2**0.5 * 3 + 0 * 3 + 8**0.5) / 7
    a, b = got["g", "a"], got["g", "b"]
    assert (a.low, a.high, a.effect, a.ordered, a.clear) == (2.0, 9.0, 7.0, True, True) and a.seed_sd == pytest.approx(sd) and a.ratio == pytest.approx(7 / sd)
    assert (b.effect, b.ordered, b.clear) == (0.0, False, False)


def test_hum_by_hand(spark):
    """Two clips of eight frames: a 50 Hz line that goes off for four frames, and one that stays."""
    rows = []
    for clip, on in (("switched", [1, 1, 0, 0, 0, 0, 1, 1]), ("steady", [1] * 8)):
        for frame, k in enumerate(on):
            rows += [(clip, frame, 50.0, 100.0 if k else 0.01), (clip, frame, 60.0, 0.0), (clip, frame, 300.0, 1.0), (clip, frame, 1000.0, 2.0),
                (clip, frame, 2000.0, 4.0), (clip, frame, 5000.0, 3.0), (clip, frame, 7000.0, 50.0)]
    got = {r.clip: r for r in G.hum(spark.createDataFrame(rows, "clip string, frame int, freq double, power double")).collect()}
    s, t = got["switched"], got["steady"]
    mean = (4 * 100 + 4 * 0.01) / 8
    assert s.line_hz == 50.0 and s.prominence_db == pytest.approx(10 * math.log10(mean / 2)) and s.low_mid_db == pytest.approx(10 * math.log10(mean / 10))
    assert (s.on_share, s.switches) == (0.5, 2)
    assert t.prominence_db == pytest.approx(10 * math.log10(50)) and (t.on_share, t.switches) == (1.0, 0)


def test_sign_counts_noise(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", -0.5), ("a", 1.6e-16), ("a", -3e-17), ("a", 0.0)], "k string, rho double")
    r = ST.sign_counts(df, ["k"]).first()
    assert (r.n_pos, r.n_neg) == (1, 1)


def test_selection_functions(spark):
    df = spark.createDataFrame([(1, 3, 0.1, "p"), (2, 2, 0.1, "p"), (3, 3, None, "p"), (4, 3, float("nan"), "p"), (5, 9, 0.0, None)], "id int, n int, score double, path string")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(X.rated_usable(df, "n", 3, "score")) == [1, 5] and ids(X.rated_usable(df, "n", 3, "score", "path")) == [1]
    rules = spark.createDataFrame([(1, 3, False), (2, 1, True), (3, 1, False), (4, 0, True), (5, 3, True), (6, 2, None)], "id int, n int, tag boolean")
    assert ids(rules.where(X.selection_rule(F.col("n"), F.col("tag"), 3))) == [1, 2, 5]
    assert ids(rules.where(X.selection_rule(F.col("n"), F.col("tag"), 3, strict=True))) == [5]
    assert [r[0] for r in col(spark, [0.5, 0.50005, 0.51, -1.0, None]).select(X.near_level("x", [0.5, -1.0])).collect()] == [True, True, False, True, None]
    words = spark.createDataFrame([("Wind chimes", "ae_1"), (None, "BIRD"), ("rain", None)], "a string, b string")
    assert [r[0] for r in words.select(X.any_substring(["a", "b"], ["bird", "CHIME"])).collect()] == [True, True, False]
    assert [r[0] for r in words.select(X.any_substring(["a"], [])).collect()] == [True] * 3


def test_table_functions(spark):
    spans = spark.createDataFrame([(1, "(0, 44100)"), (2, "(44100, 176400)"), (3, None), (4, "none")], "id int, span string")
    assert [(r.dur_known, r.dur) for r in S.durations(spans, "span").orderBy("id").collect()] == [(True, 1.0), (True, 3.0), (False, 2.0), (False, 2.0)]
    assert sorted(r.x for r in S.min_max(col(spark, [1.0, 2.0, 5.0]), "x").collect()) == [0.0, 0.25, 1.0]
    assert sorted(r.x for r in S.min_max(col(spark, [0.2, 1.5]), "x").collect()) == [0.2, 1.5]
    src = spark.createDataFrame([("k", 60.0, 66.0, 55.0, 70.0, 9.0, 1.0, 0.5, 0.2)], "k string, l50 double, l10 double, l90 double, c50 double, n5 double, r double, fs double, t double")
    got = S.psycho(src, {"LA50": "l50", "LA10_LA90": ("l10", "l90"), "LC50_LA50": ("c50", "l50"), "N5": "n5", "R": "r", "FS": "fs", "T": "t"}, ["k"]).first()
    assert tuple(got) == ("k", 60.0, 11.0, 10.0, 9.0, 1.0, 0.5, 0.2)
    lab = spark.createDataFrame([(c, float(c), float(-c)) for c in range(4) for _ in range(2)], "c int, a double, b double")
    field = spark.createDataFrame([(c, float(2 * c), float(c)) for c in range(3) for _ in range(5)] + [(3, 0.0, 9.0)] * 4, "c int, a double, b double")
    got = {r.target: (r.clusters, r.r) for r in R.cluster_agreement(lab, field, "c", ["a", "b"]).collect()}
    assert got["a"] == (3, pytest.approx(1.0)) and got["b"] == (3, pytest.approx(-1.0))
    assert {r.r for r in R.cluster_agreement(lab, field.where("c < 2"), "c", ["a"]).collect()} == {None}


@pytest.mark.parametrize("rows", [2, 50_000])
def test_ranks_and_quantiles(spark, monkeypatch, rows):
    """Bucketed places, ranks and quantiles equal those of one sorted list, with ties and nulls."""
    monkeypatch.setattr(X, "ROWS", rows)
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([None, *range(40)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r.id: (r.place, r.group_rows) for r in X.places(df, ["g"], ["v", "id"], parts=7).collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in mine] == [(k, len(mine)) for k in range(len(mine))]
    vals = sorted(r[2] for r in rows if r[2] is not None)
    for q in (0.0, 0.25, 0.5, 0.77, 1.0):
        at = (len(vals) - 1) * q
        want = vals[math.floor(at)] + (vals[math.ceil(at)] - vals[math.floor(at)]) * (at - math.floor(at))
        assert X.exact_quantile(df, "v", q, parts=5).first()[0] == pytest.approx(want)
    assert X.exact_quantile(df.limit(0), "v", 0.5).first()[0] is None
    counts = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in ST.average_ranks(counts, ["g"], "v", "n", parts=5).collect():
        mine = sorted(x[2] for x in rows if x[1] == r.g and x[2] is not None)
        assert r["rank"] == mine.index(r.v) + (mine.count(r.v) + 1) / 2


def test_caption_percentile_blocks(spark):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    audio = [(k, vec()) for k in range(30)]
    caps = [(k, c, vec()) for k in range(30) for c in range(2)]
    a, c = spark.createDataFrame(audio, "k int, vec array<double>"), spark.createDataFrame(caps, "k int, cap int, vec array<double>")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    want = {(k, n): sum(dot(dict(audio)[k], t) < dot(dict(audio)[k], v) for j, _, t in caps if j != k) / 58 for k, n, v in caps}
    for block in (7, 4096):
        got = {(r.k, r.cap): r.pct for r in E.caption_percentile(a, c, "k", block=block).collect()}
        assert got == pytest.approx(want)


def test_caption_percentile_over_partitions(spark):
    """Blocks of clips meet all blocks of captions, also where tasks aren't joined into one; equal vectors are ties to the last bit."""
    rng = np.random.default_rng(12)
    kinds = rng.normal(size=(40, 33)).astype(np.float32)
    audio = [(k, kinds[k % 40].tolist()) for k in range(120)]
    caps = [(k, c, kinds[(k * 7 + c) % 40].tolist()) for k in range(120) for c in range(2)]
    a, c = spark.createDataFrame(audio, "k bigint, vec array<float>"), spark.createDataFrame(caps, "k bigint, cap bigint, vec array<float>")
    of = np.array([v for _, v in audio])
    mine, sims = np.array([k for k, _, _ in caps]), of @ np.array([v for _, _, v in caps]).T
    want = {(k, n): np.mean(sims[k][mine != k] < sims[k, 2 * k + n] - 1e-10) for k, n, _ in caps}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.cap): r.pct for r in E.caption_percentile(a, c, "k", block=30).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == pytest.approx(want)


@pytest.mark.parametrize("window", [0, 500_000])
def test_spearman_by_ranges(spark, monkeypatch, window):
    """Rank correlations with ties and null keys, by one window a group and range by range, with common values broadcast."""
    monkeypatch.setattr(X, "ROWS", 5)
    monkeypatch.setattr(ST, "WINDOW", window)
    monkeypatch.setattr(ST, "SMALL", 3)
    monkeypatch.setattr(ST, "HOT", 10)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([0, 0, 0, *range(1, 20)])), rng.random() if rng.random() < 0.6 else 0.5) for _ in range(300)]
    rows += [("c", 1.0, 2.0)] * 4 + [("a", None, 1.0)]
    got = {r.g: (r.rho, r.n) for r in ST.spearman_by(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    rank = lambda v, of: sum(u < v for u in of) + (of.count(v) + 1) / 2
    want = {}
    for g in ("a", "b", None):
        x, y = zip(*((b, c) for a, b, c in rows if a == g and b is not None))
        want[g] = (pytest.approx(statistics.correlation([rank(v, x) for v in x], [rank(v, y) for v in y])), len(x))
    assert got == want
    matrix = {(r.x, r.y): r.rho for r in ST.spearman_matrix(spark.createDataFrame(rows, "g string, x double, y double"), ["x"], ["y", "x"]).collect()}
    x, y = zip(*((b, c) for _, b, c in rows if b is not None))
    assert matrix == pytest.approx({("x", "y"): statistics.correlation([rank(v, x) for v in x], [rank(v, y) for v in y]), ("x", "x"): 1.0})


def test_describe_by_ranges(spark, monkeypatch):
    """Quantiles over several ranges of values, with null keys, null values and columns without any; no task collects a group."""
    monkeypatch.setattr(X, "ROWS", 7)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(60)), rng.random()]), None) for _ in range(400)]
    out = R.describe_by(spark.createDataFrame(rows, "g string, x double, z double"), ["g"], ["x", "z"], [0.0, 0.25, 0.5, 0.9])
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.g, r.metric): r for r in out.collect()}
    assert len(got) == 6
    for g in ("a", "b", None):
        v = np.array([x for h, x, _ in rows if h == g and x is not None])
        r = got[g, "x"]
        assert (r.n, r.mean, r.sd, r.lo, r.hi, r.q0, r.q25, r.q50, r.q90) == pytest.approx((len(v), v.mean(), v.std(ddof=1), v.min(), v.max(), *np.quantile(v, [0, 0.25, 0.5, 0.9])))
        assert got[g, "z"].n == 0 and got[g, "z"].q50 is None


def test_places_join_by_no_group(spark):
    """No shuffle has the group alone as its key; sizes and places are right."""
    df = spark.range(400).selectExpr("id", "id % 2 AS g", "id * 37 % 401 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.places(df, ["g"], ["v"])._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert joins and all("_b#" in line for line in joins)
        rows = X.places(df, ["g"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    for g in (0, 1):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.v)
        assert [(r.place, r.group_rows) for r in mine] == [(i, 200) for i in range(200)]


def test_fill_looks_ahead_in_no_range(spark):
    """A frame from the row to its range's end is read again for each row: none is in the plan."""
    df = spark.createDataFrame([("a", i, None if i < 4 or i % 3 else i) for i in range(30)], "g string, t int, v int")
    out = R.fill(df, ["g"], ["t"], "v", 4)
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.v for r in out.orderBy("t").collect()] == [max(6, i // 3 * 3) for i in range(30)]


def test_value_buckets_count_the_cuts_below(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 1)
    df = spark.range(500).selectExpr("id % 2 AS g", "CASE WHEN id % 50 = 0 THEN NULL ELSE CAST(id * 37 % 101 AS DOUBLE) END AS v")
    for parts in (2, 7, 64, 200):
        cuts = {r.g: r.c for r in df.groupBy("g").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10 * parts).alias("c")).collect()}
        for r in X.value_buckets(df, ["g"], "v", parts).collect():
            assert r.bucket == (-1 if r.v is None else sum(c < r.v for c in cuts[r.g]))


def test_fill_across_ranges(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, None, None, i])) for g in "ab" for i in range(120)] + [("c", i, None) for i in range(5)] + [("d", i, 7 if i == 3 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(5)
    for parts in (2, 9, 200):
        got = {(r.g, r.t): r.v for r in R.fill(df, ["g"], ["t"], "v", parts).collect()}
        assert len(got) == len(rows)
        for g in "abcd":
            mine = [v for h, _, v in rows if h == g]
            known = next((v for v in mine if v is not None), None)
            last = None
            for i, v in enumerate(mine):
                last = v if v is not None else last
                assert got[g, i] == (last if last is not None else known)


def test_brightness_by_hand(spark):
    lines = [(10.0, 99.0), (100.0, 8.0), (200.0, 4.0), (400.0, 2.0), (800.0, 1.0), (25000.0, 99.0)]
    few = [(100.0, 1.0), (200.0, 1.0)]
    df = spark.createDataFrame([("a", f, p) for f, p in lines] + [("b", f, p) for f, p in few], "clip string, freq double, power double")
    got = {r.clip: r for r in G.brightness(df).collect()}
    assert got["a"].centroid == pytest.approx((800 + 800 + 800 + 800) / 15) and got["a"].rolloff == 400.0
    assert got["a"].tilt == pytest.approx(-10 * math.log10(2)) and got["b"].tilt is None


def test_bands_and_bins_by_hand(spark):
    df = spark.range(200).selectExpr("id", "'g' AS g", "CAST(id AS DOUBLE) AS v")
    got = L.quantile_bands(df, ["g"], "v", 1000, 1, ["id"]).collect()
    ids = {b: sorted(r.id for r in got if r.band == b) for b in range(5)}
    assert ids == {0: list(range(50)), 1: list(range(50, 150)), 2: list(range(150, 180)), 3: list(range(180, 198)), 4: [198, 199]}
    small = L.quantile_bands(df.where("id < 2"), ["g"], "v", 4, 1, ["id"]).collect()
    assert sorted((r.id, r.band) for r in small) == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4)]
    rows = spark.createDataFrame([(-1.0, 1.0)] * 5 + [(0.95, 2.0)] * 4 + [(0.99, 7.0)] + [(1.0, 50.0)] * 9, "x double, y double")
    assert {r.bin: (r.n, r.mean_y) for r in R.binned_mean(rows, "x", "y", -1.0, 1.0, 10, 5).collect()} == {0: (5, 1.0), 9: (5, 3.0)}
