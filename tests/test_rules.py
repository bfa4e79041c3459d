"""Rules of clips, captions and trends, each with cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import rollup as R
from larkspur.operators import screen as X
from larkspur.operators import select as L
from larkspur.operators import similarity as E
from larkspur.operators import stats as ST
from larkspur.plans import manifest as P


def test_path_rules(spark):
    paths = {
        None: [], "": [], "  \n": [], "a.wav": [], " a.wav\n": [], "a.wav|b.wav": ["pipe_in_path", "multiple_extensions"], "a|b.wav": ["pipe_in_path"], "a.wav.wav": ["multiple_extensions"],
        "x\ty.wav": ["suspicious_name"], "x\ty.flac": [], "x\0y.wav.mp3": ["suspicious_name"], "a.mp3.mp3": ["multiple_extensions"],
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.rules for r in X.rule_hits(df, X.path_rules("path")).collect()}
    assert got == {p: want if (p or "").strip() else ["empty_path"] for p, want in paths.items()}


def test_duration_rules(spark):
    rows = [(0.0, None, "zero_duration"), (9.0, None, None), (11.0, None, None), (11.01, None, "wrong_duration"), (8.9, None, "wrong_duration"), (0.0, "broken", "load_error"), (None, "broken", "load_error"), (None, None, None)]
    df = spark.createDataFrame(rows, "sec double, error string, want string")
    kept, gone, counts = X.quarantine(df, X.duration_rules("sec", "error"))
    assert all(r.want is None for r in kept.collect()) and kept.count() == 3
    assert all(r.rules == [r.want] for r in gone.collect())
    assert {r.rule: r.n for r in counts.collect()} == {"zero_duration": 1, "wrong_duration": 2, "load_error": 2}


def test_audio_rules(spark):
    good = {"bytes": 5000, "error": None, "samples": 441000, "channels": 2, "rate": 44100, "rms": 0.1, "peak": 0.5, "has_nan": False, "has_inf": False}
    cases = [
        ({}, []), ({"bytes": None, "samples": 0}, ["no_file"]), ({"bytes": 999, "rms": 0.0}, ["tiny_file"]), ({"error": "x", "samples": 0}, ["load_error"]), ({"samples": 0, "rate": 8000}, ["empty_audio"]),
        ({"rate": 48000}, ["wrong_rate"]), ({"samples": 44100 * 12}, ["wrong_duration"]), ({"samples": 44100 * 11}, []), ({"rms": 0.0005}, ["silent", "low_loudness"]), ({"rms": 0.009}, ["low_loudness"]),
        ({"peak": 1.0, "channels": 3}, ["clipping", "channel_count"]), ({"rms": math.nan, "peak": math.nan, "has_nan": True}, ["has_nan"]), ({"peak": math.inf, "has_inf": True}, ["clipping", "has_inf"]),
    ]
    schema = "bytes long, error string, samples long, channels int, rate long, rms double, peak double, has_nan boolean, has_inf boolean, i int"
    df = spark.createDataFrame([(*(good | change).values(), i) for i, (change, _) in enumerate(cases)], schema)
    hits = X.rule_hits(df, X.audio_rules())
    assert [r.rules for r in hits.orderBy("i").collect()] == [want for _, want in cases]
    got = {r.category: (r.faults, r.rows) for r in X.category_counts(hits).collect()}
    assert got == {"Other": (5, 5), "Cannot load file": (1, 1), "Empty audio": (1, 1), "Wrong sample rate": (1, 1), "Wrong duration": (1, 1), "Silent/low volume": (1, 1), "Low loudness": (2, 2), "Clipping": (2, 2)}


def test_captions(spark):
    rows = [(" a park. Loudness: loud. Pleasantness: x", "0.125", "good"), ("a park ", "nan", ""), (None, "x", None), ("b", "-2.5", "NaN"), ("b", None, "good")]
    df = spark.createDataFrame(rows, "c string, s string, b string")
    got = df.select(T.caption_rated("c", "s"), T.caption_binned("c", "b", "s")).collect()
    assert [r[0] for r in got] == ["a park. [ISOPleasant: 0.12]", "a park", "", "b. [ISOPleasant: -2.50]", "b"]
    assert [r[1] for r in got] == [" a park. Loudness: loud. Pleasantness: x [pleasantness: good] (iso_pleasantness: 0)", "a park ", "", "b (iso_pleasantness: -2)", "b [pleasantness: good]"]


def test_words_and_repeats(spark):
    texts = ["Birds, birds sing [ISOPleasant: 0.10]", "birds sing  loudly [ISOPleasant: 0.20]", "birds sing untagged", "birds sing untagged", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(r) for r in R.top_words(df, "text", 10).collect()]
    assert got == [("birds", 2, 50.0), ("sing", 2, 50.0), ("birds,", 1, 25.0), ("loudly", 1, 25.0)]
    assert [tuple(r) for r in R.repeated_texts(df, "text", 10).collect()] == [("birds sing untagged", 2)]


def test_splits_and_repeats(spark):
    df = spark.createDataFrame([(4.0,), (5.0,), (25.0,), (21.0,), (9.0,)], "x double")
    split = sorted((r.x, r.start, r.end) for r in P.split_plan(df, "x", 20.0, 5.0).collect())
    # parts of 12 and 10 s stay, though shorter than many a whole recording; 12.5 is rounded half-even
    assert split == [(5.0, 0, 5), (9.0, 0, 9), (21.0, 0, 10), (21.0, 10, 21), (25.0, 0, 12), (25.0, 12, 25)]
    long = P.split_plan(df, "x", 20.0, 15.0).collect()
    assert sorted((r.x, r.start) for r in long) == [(21.0, 0), (21.0, 10), (25.0, 0), (25.0, 12)]
    whole = sorted((r.x, r.start, r.end) for r in P.whole_or_chunks(df, "x", 6.0, 22.0, 10.0).collect())
    assert whole == [(9.0, 0, 9), (21.0, 0, 21), (25.0, 0, 10), (25.0, 10, 20)]
    assert sorted((r.x, r.start) for r in P.whole_or_chunks(df, "x", 6.0, 0.0, 10.0).collect()) == [(21.0, 0), (21.0, 10), (25.0, 0), (25.0, 10)]
    files = spark.createDataFrame([("a.wav", "none", True), ("b.wav", "none", False), ("c.wav", "two", True)], "f string, bin string, nat boolean")
    got = sorted(r.file for r in P.repeat_rows(files, "bin", {"none": 0, "two": 2}, "f", F.col("nat"), 2).collect())
    assert got == ["a.wav", "a_r1.wav", "b.wav", "c.wav", "c_r1.wav", "c_r2.wav", "c_r3.wav"]


def test_replace_and_rebuild(spark):
    old = spark.createDataFrame([(1, "a Bird"), (2, "rain")], "id int, t string")
    with pytest.raises(ValueError, match="still contain"):
        P.replace_rows(old, spark.createDataFrame([(3, "birdsong")], "id int, t string"), "bird")
    records = spark.createDataFrame([(1, 7, "x", "old"), (1, 5, "y", "old"), (2, 1, "z", "old"), (1, 5, "z", "old")], "k int, seq int, code string, caption string")
    subset = spark.createDataFrame([(1, "new"), (3, "none")], "k int, new_caption string")
    found, missed = P.rebuild_records(subset, records.where("code != 'z' OR k = 2"), ["k"], "seq")
    assert [tuple(r) for r in found.select("k", "caption", "seq", "code").collect()] == [(1, "new", 5, "y")] and [r.k for r in missed.collect()] == [3]
    keys = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    best = X.best_key_match(keys, {"b": F.col("b"), "a": F.col("a")}, keys.select("a"), "a", 0.95).first()
    assert (best.key, best.found, best.enough) == ("b", 2, True)


def test_prompt_effect(spark):
    rows = [("up", i, float(i)) for i in range(1, 6)] + [("flat", i, 1.0) for i in range(1, 6)] + [("two", 1, 0.0), ("two", 2, 1.0), (None, 1, 3.0), (None, 2, 2.0), (None, 3, 1.0), ("mix", 1, 1.0), ("mix", 2, 3.0), ("mix", 3, 2.0), ("mix", 4, 4.0)]
    df = spark.createDataFrame(rows, "prompt string, level int, score double")
    effects = ST.prompt_effect(df, "prompt", "level", "score")
    got = {r.prompt: (round(r.rho, 6), round(r.p, 6), r.n_levels) for r in effects.collect()}
    # r = 0.8 of four rows: t = 1.8856 with two degrees of freedom, p = 0.2
    assert got == {"up": (1.0, 0.0, 5), "flat": (0.0, 1.0, 5), None: (-1.0, 0.0, 3), "mix": (0.8, 0.2, 4)}
    s = ST.effect_summary(effects).first()
    sem = math.sqrt(((1 - 0.2) ** 2 + 0.2**2 + 1.2**2 + 0.6**2) / 3) / 2
    assert s.prompts == 4 and s.mean_r == pytest.approx(0.2) and s.se_r == pytest.approx(sem) and s.ci_upper == pytest.approx(0.2 + 1.96 * sem) and s.effect_size == "small"
    both = df.withColumn("same", F.lit(1.0)).withColumn("down", -F.col("level"))
    got = {r.source: (round(r.rho, 6), r.independent) for r in ST.source_independence(both, "level", ["same", "down"]).collect()}
    assert got == {"same": (0.0, True), "down": (-1.0, False)}
    one = ST.adherence(spark.createDataFrame([(0.1,), (0.3,)], "s double"), "s").first()
    assert (round(one.mean_similarity, 6), round(one.std_similarity, 6), one.quality) == (0.2, 0.1, "fair")


def test_embedding_trend(spark):
    rows = [("a", -0.1, "-0.1", [0.0, 0.0]), ("b", 0.0, "0.0", [3.0, 4.0]), ("c", 0.1, "0.1", [3.0, 5.0]), ("d", 0.11, "0.1", [3.0, 15.0])]
    df = spark.createDataFrame(rows, "n string, v double, s string, e array<double>")
    pairs = {(r.a_name, r.b_name): r.distance for r in E.pairwise_distance(df, "n", "e", "v").collect()}
    assert pairs["a", "b"] == 5.0 and pairs["b", "d"] == 11.0
    jumps = [(r.before, r.distance, round(r.jump, 6)) for r in E.neighbour_jumps(df, "n", "e", "v", "s").orderBy("before").collect()]
    assert jumps == [("a", 5.0, round(5 / 3, 6)), ("b", 1.0, round(1 / 3, 6)), ("c", 10.0, round(10 / 3, 6))]
    at = E.jump_around(df, "n", "e", "v", 0.0, "s").first()
    assert (at.label, at.around, at.median, at.ratio) == (0.0, 3.0, 3.0, 1.0)
    assert E.jump_around(df, "n", "e", "v", 0.2, "s").first().around is None


def test_degenerate_groups(spark):
    own = ST.eta_squared(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, y double"), "g", "y").first()
    assert own.eta2 == 1.0 and own.eta2_adj is None and own.sd_within == 0.0
    flat = ST.eta_squared(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, y double"), "g", "y").first()
    assert flat.eta2 is None and flat.sd_within == 0.0
    spread = {r.c: (r["mean"], r.sd) for r in R.prediction_spread(spark.createDataFrame([("x", 1.0), ("y", 1.0), ("y", 3.0)], "c string, v double"), "c", "v").collect()}
    assert spread == {"x": (1.0, 0.0), "y": (2.0, math.sqrt(2))}


def test_selection_by_ranges(spark, monkeypatch):
    """Large groups, numbered range by range, give the rows that windows give; null groups and cells are groups too."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold").alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("c"), F.lit(40).alias("n"))
    runs = [
        lambda: L.round_robin(df, ["g"], ["c"], 50, 7, ["id"]), lambda: L.round_robin(df, ["g"], ["c"], F.col("n"), 7, ["id"], reshuffle=True), lambda: L.sample_per_group(df, ["g"], 1500, 7, ["id"]),
        lambda: L.sample_per_group(df, ["g"], F.col("n"), 7, ["id"]), lambda: L.proportional_select(df.where("g IS NOT NULL"), ["g"], 100, 7, ["id"]), lambda: L.balanced_select(df.na.drop(subset=["g"]).na.fill(9), 500, "g", "c", ["n"], 7, ["id"]),
    ]
    ids = lambda d: sorted(r.id for r in d.collect())
    by_window = [ids(r()) for r in runs]
    assert [len(x) for x in by_window[:4]] == [150, 120, 1500 + 600 + 300, 120]
    monkeypatch.setattr(L, "WINDOW", 20)
    assert [ids(r()) for r in runs] == by_window
    assert runs[0]().columns == df.columns


def test_agreement(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 3.0, 9.0), ("b", 4.0, 8.0), ("c", 5.0, 20.0), (None, 6.0, 30.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "at string, o double, p double")
    got = ST.agreement(df, "o", "p", "at").first()
    # ranks 1 2 4 3 5 6 against 1..6: 1 - 6 * 2 / 210; means of the places 1.5 3.5 5 and 2.5 8.5 20
    assert got.n == 6 and got.n_places == 3 and got.rho == pytest.approx(1 - 12 / 210) and got.bias == pytest.approx(72 / 6 - 21 / 6)
    assert got.r_place == pytest.approx(ST.agreement(spark.createDataFrame([("x", 1.5, 2.5), ("y", 3.5, 8.5), ("z", 5.0, 20.0)], "at string, o double, p double"), "o", "p", "at").first().r)
    assert ST.agreement(df.where("at = 'a'"), "o", "p", "at").first().r_place is None
    files = spark.createDataFrame([("lo", 3, -1.0, 0.0, 0.1), ("lo", 1, -0.6, -0.4, 0.3), ("hi", 2, 1.0, 0.5, None), ("hi", 0, 0.0, 9.5, 0.2)], "bin string, n int, t double, s double, w double")
    got = {r.bin: r for r in R.rating_agreement(files, "bin", "n", "t", "s", "w").collect()}
    lo, hi, every = got["lo"], got["hi"], got[None]
    assert (lo.files, lo.entries, round(lo.train_mean, 6), round(lo.rated_mean, 6), round(lo.within_sd, 6)) == (2, 4, -0.9, -0.1, 0.2)
    assert (hi.train_mean, hi.rated_mean, hi.within_sd) == (1.0, 0.5, 0.2) and hi.rated_sd == pytest.approx(9 / math.sqrt(2))
    assert every.overall and every.bias == pytest.approx((3 * 1.0 + 0.2 + 2 * -0.5) / 6)


def test_labels_and_captions_as_text(spark):
    probs = spark.createDataFrame([("x", "rain", 0.5), ("x", "bird", 0.256), ("x", "car", 0.25), ("x", "dog", 0.1), ("y", "dog", 1.0)], "k string, label string, p double")
    got = {r.k: (r.nature, r.top3) for r in R.label_set_scores(probs, "k", "label", "p", {"nature": ["rain", "bird"]}).collect()}
    assert got == {"x": (0.5, "rain 0.50; bird 0.26; car 0.25"), "y": (None, "dog 1.00")}
    z = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 2.0), ("c", 3, 2.0), ("c", 4, -1.0)], "k string, cap int, z double")
    texts = spark.createDataFrame([("c", i, f"t{i}") for i in range(1, 5)], "k string, cap int, text string")
    r = E.best_caption(z, "k", texts, 0.5).first()
    assert (r.best, r.n_over, r.texts) == (2, 3, "t1 || t2 || t3")


def test_top_texts_and_score_screen(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("a", "y")] * 2 + [("a", "w")] * 2 + [("a", None), ("b", "z"), ("c", None)], "g string, v string")
    assert {r.g: r.top for r in R.top_text(df, ["g"], "v", 2).collect()} == {"a": "x (5), w (2)", "b": "z (1)"}
    assert {r.g: r.top for r in R.top_text(df, ["g"], "v", 3, share=True).collect()} == {"a": "x 56%, w 22%, y 22%", "b": "z 100%"}
    rows = spark.createDataFrame([("f1", "p"), ("f2", "p"), ("f3", "q"), ("f4", "q"), (None, "q"), ("f6", "q")], "id string, base string")
    scores = spark.createDataFrame([("f1", "p", 0.1), ("f1", "p", 0.2), ("f2", "p", 0.9), ("f3", "q", 0.6), ("f4", "q", None), ("f6", "q", 0.5)], "id string, base string, s double")
    got = lambda **limits: [r.verdict for r in X.score_screen(rows, scores, "id", "base", "s", **limits).orderBy(F.asc_nulls_last("id")).collect()]
    assert got(max_file=0.5) == ["kept", "removed", "removed", "unscored", "kept", "unscored"]
    assert got(max_base=0.2) == ["kept", "kept", "removed", "unscored", "removed", "unscored"]
    assert got() == ["kept", "kept", "kept", "unscored", "kept", "unscored"]


def test_paired_profiles(spark):
    lab = spark.createDataFrame([(1, 2.0, "m"), (1, 4.0, "m"), (1, None, "n"), (2, 1.0, "n"), (None, 9.0, "n")], "c int, t double, m string")
    field = spark.createDataFrame([(1, 5.0, 3, "here"), (1, 7.0, 0, "there"), (1, 9.0, None, "here"), (3, 1.0, 1, "here")], "c int, t double, n int, l string")
    got = {r.cluster: (r.n_lab, r.n_field, r.n_rated, r.lab_t, r.field_t, r.lab_top, r.field_top) for r in R.paired_profiles(lab, field, "c", ["t"], "n", "m", "l").collect()}
    assert got == {
        1: (3, 3, 1, 3.0, 5.0, "m 67%, n 33%", "here (2), there (1)"), 2: (1, 0, 0, 1.0, None, "n 100%", None), 3: (0, 1, 1, None, 1.0, None, "here (1)"),
    }
