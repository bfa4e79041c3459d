"""Product codes against a brute-force version in Python integers."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    whole = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in whole if len(r[1]) == len(whole[0][1])]
    size = -(-len(kept[0][1]) // parts)
    limit = V._bound(len(kept[0][1]))
    ints = [[max(-limit, min(limit, math.floor(4096 * float(np.float32(x))))) for x in r[1]] + [0] * (size * parts - len(r[1])) for r in kept]
    cut = [[z[p * size : (p + 1) * size] for p in range(parts)] for z in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            by = collections.defaultdict(list)
            for c in cut:
                by[near(c[p], books[p])[1]].append(c[p])
            for k, xs in by.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = collections.Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, error)), key=str)


def made(n, width, seed, spread=1.0, step=None):
    r = random.Random(seed)
    value = (lambda: r.choice([-1, 0, 1]) * step) if step else (lambda: r.gauss(0, spread))
    return [(i, [float(np.float32(value())) for _ in range(width)], r.choice([None, 1, 1, 1, 2, 3])) for i in range(n)]


ODD = [(None, [0.5] * 64, 1), (7, None, 1), (-5, [], 2), (-4, [1.0, None] * 32, 2), (-3, [math.nan] * 64, 2), (-2, [math.inf] + [0.0] * 63, None), (300, [1.0] * 63, 1), (301, [1.0] * 65, 1), (302, [3e38, -3e38] * 32, 9)]


@pytest.mark.parametrize(
    "rows",
    [made(200, 64, 1), made(120, 64, 2, step=0.25), made(90, 64, 3) + ODD + made(5, 64, 3), made(40, 8, 4), made(50, 13, 5), made(3, 64, 6), made(30, 64, 7, step=0.0), [(1, [0.1] * 64, None)] * 20],
)
def test_brute(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("id", "v", "code", "error", "of", "n", "part", "sums")})
    assert sorted((tuple(r) for r in V.compress(df).collect()), key=str) == brute(rows)


def test_empty_and_text_ids(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [], None), (3, [math.nan], 2)], SCHEMA)
    assert V.compress(df).collect() == [] and V.compress(df.limit(0)).collect() == []
    rows = made(30, 16, 8)
    got = V.compress(spark.createDataFrame(rows, SCHEMA).withColumn("vec_id", F.format_string("v%03d", "vec_id")))
    assert sorted(r.code for r in got.collect()) == sorted(r[1] for r in brute(rows))
    assert dict(got.dtypes)["vec_id"] == "string"


@pytest.mark.parametrize("size,entries,most", [(8, 16, 1000), (8, 16, 2), (1, 16, 3), (3, 1, 5), (16, 7, 300), (8, 16, 2**27)])
def test_nearest(size, entries, most):
    """The search equals a look at all entries, with many ties, and sees fewer of them."""
    r = np.random.default_rng(size * entries)
    for _ in range(10):
        x, book = r.integers(-most, most + 1, (300, size)), r.integers(-most, most + 1, (entries, size))
        d = ((x[:, None].astype(object) - book[None]) ** 2).sum(axis=2).astype(np.int64)
        which, best = V.nearest(x, book)
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_integers_of_a_slice():
    """A slice of a longer array keeps its own rows."""
    rows = pa.array([[9.0, 9.0], None, [1.0, -0.3], [2.0], [None, 1.0], [0.5, 0.25]], pa.list_(pa.float32())).slice(1)
    keep, x = V.integers(rows, 2, parts=2)
    assert keep.tolist() == [1, 4] and x.reshape(2, 2).tolist() == [[4096, -1229], [2048, 1024]]


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    """With many labels, hot ones are broadcast and the others meet by shuffle."""
    monkeypatch.setattr(V, "SMALL", 3)
    monkeypatch.setattr(V, "HOT", 4)
    rows = made(300, 16, 9)
    rows += [(1000 + i, v, i) for i, (_, v, _) in enumerate(made(40, 16, 10))]
    assert sorted((tuple(r) for r in V.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
