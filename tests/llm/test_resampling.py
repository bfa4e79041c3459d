"""Importance resampling against a brute-force version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, resampling

from .helpers import SCHEMA, lower, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    w = WORD.findall(lower(text))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, longest=1, percent=10, least=20):
    found = [(d, *grams(t, longest)) for d, t in docs]
    corpus, wanted = collections.Counter(b for _, f, _ in found for b in f), collections.Counter(b for t in target for b in grams(t, longest)[0])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in corpus}
    out = []
    for d, f, words in found:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], -r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df, target, **options):
    return sorted((tuple(r) for r in resampling.resample(df, target, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"longest": 3}, {"percent": 100, "least_words": 0}, {"percent": 45, "least_words": 2}, {"percent": 0}])
def test_brute(spark, options):
    """Nulls, empty and long texts, words of two texts that touch, long words, ties, repeated rows."""
    data = rows() + [(None, None, None, None, None), (None, "thirty words " * 20, None, None, 1), (9, "end", "x", "y", 1), (9, "Start" + "é" * 300 + " 漢字 b2b", "x", "y", 1)]
    data += [(500 + i, f"alpha beta gamma {'delta ' * (i % 9)}" * 8, "en", "s", 1) for i in range(60)] + [(500, "alpha beta gamma " * 8, "en", "s", 1)] * 7
    target = [None, "", "alpha delta one two", "The quick brown fox", "The quick brown FOX"]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("x") for c in ("t", "score", "rank", "weight", "n_words", "place", "_range")})
    brute_options = {{"least_words": "least"}.get(k, k): v for k, v in options.items()}
    assert got(df, spark.createDataFrame([(t,) for t in target], "text string"), **options) == brute([r[:2] for r in data], target, **brute_options)


def test_tables(spark, sf):
    docs, bench = common.load(spark, sf, "documents"), common.load(spark, sf, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in bench.collect()])
    assert got(docs, bench) == want
    drawn = {r[0] for r in want if r[4] is not None}
    assert {r.doc_id for r in resampling.drawn_documents(docs.withColumn("drawn_id", F.lit(1)), bench).collect()} == drawn


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows(), SCHEMA)
    assert got(none, some) == [] and got(none, none) == []
    assert got(some, none) == brute([r[:2] for r in rows()], [])


@pytest.mark.parametrize("kind", ["same", "two", "steps", "spread"])
@pytest.mark.parametrize("k", [1, 2, 499, 500, 999, 1000])
def test_bracket_holds_the_cutoff(spark, kind, k):
    """Whatever the ties: fewer than k rows above the bracket, and at least k down to its low end."""
    r = random.Random(5)
    make = {"same": lambda: 7, "two": lambda: r.choice([1, 1, 1, 2]), "steps": lambda: r.randrange(10), "spread": lambda: r.randrange(-10**9, 10**9)}[kind]
    values = [make() for _ in range(1000)]
    low, high, above = resampling.bracket(spark.createDataFrame([(v,) for v in values], "score long").repartition(3), "score", k, 1000, accuracy=20)
    assert above == sum(v > high for v in values) < k <= sum(v >= low for v in values)


def test_features_over_slices(monkeypatch):
    """Texts in several arrays have the features that they have in one."""
    r = random.Random(6)
    texts = ["".join(r.choice(["Ab", "c", "é", " ", "1", "-", "漢", "z" * 70]) for _ in range(r.randrange(30))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    for longest in (1, 2, 3):
        bucket, of, words = resampling.features(data, offsets, longest)
        for i, t in enumerate(texts):
            want, n = grams(t, longest)
            assert sorted(bucket[of == i].tolist()) == sorted(want) and words[i] == n
