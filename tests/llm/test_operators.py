"""Each operator against a brute-force version, on edge cases and on the sf0.001 tables."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, common, exact_dedup, html_extract, language_id, line_dedup, mixing, quality_rules, queries, simhash, token_files, url_filter

from .helpers import SCHEMA, WORD, lower, rows, sha

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def edge(spark):
    return common.cut(spark.createDataFrame(rows(), SCHEMA), "edge")


@pytest.fixture(scope="module", params=["edge", "sf"])
def docs(request, spark, edge, sf):
    return edge if request.param == "edge" else common.load(spark, sf, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def spaced(df, **names):
    """Columns that clash with the operators' own."""
    for c in ("size", "taken", "target", "n_words", "kept", "fail_bits", "position", "row", "t", "k0", "ids", "digest", "fp", "lines", "score", "copy", "gone_id", "lost_id", "lost_sha", "lost_key", "lost_row", "lost_sig", "keep_id", "held"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# ---- 7 quality rules


def test_quality_brute(docs):
    want = collections.Counter()
    for d, t in texts(docs):
        t = t or ""
        w = WORD.findall(t)
        tri = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(tri)
        hit = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), base] += 1
    led = quality_rules.apply_policy(quality_rules.ledger(docs))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in led.collect())
    assert got == want
    assert led.where("base_failed AND kept").count() == 0


def test_quality_policies(docs, empty):
    led = quality_rules.ledger(docs, keep=["doc_id"]).cache()
    all_ = {r.rule: r for r in quality_rules.ablation(led, "v2").collect()}
    bits = [r.fail_bits for r in led.collect()]
    for name, bit in quality_rules.BIT.items():
        assert all_[name].n_failed == sum(b & bit > 0 for b in bits)
        assert all_[name].n_only_this == sum(b == bit for b in bits)
        assert all_[name].kept_without == sum(b & ~bit == 0 for b in bits)
    kept = quality_rules.judge(spaced(docs))
    assert kept.columns == spaced(docs).columns
    assert kept.count() == quality_rules.apply_policy(led).where("kept").count()
    assert quality_rules.judge(empty).count() == 0 and quality_rules.ledger(empty).count() == 0
    assert quality_rules.ledger(spaced(docs)).count() == docs.count()


# ---- 9 exact dedup


def test_exact_brute(docs, empty):
    groups = collections.defaultdict(list)
    for d, t in texts(docs):
        groups[lower(t)].append(d)
    # of rows that repeat the largest doc_id with equal texts one stays
    want = sorted((d, max(g), len(g), i == g.index(max(g)), sha(t)) for t, g in groups.items() for i, d in enumerate(g))
    for batches in (1, 2, 4):
        got = sorted(tuple(r) for r in exact_dedup.deduplicate(spaced(docs), batches=batches).collect())
        assert got == want
    assert exact_dedup.deduplicate(empty).count() == 0
    left = exact_dedup.drop_duplicates(spaced(docs))
    assert left.columns == spaced(docs).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, _, k, _ in want if k)


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "A"), (None, "b"), (None, None), (None, "c"), (None, "C"), (7, "d"), (7, "D"), (7, "e")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df).collect())
    assert got == {
        (None, 1, 3, False): 2, (1, 1, 3, True): 1, (None, None, 1, True): 2, (None, None, 2, True): 1, (None, None, 2, False): 1, (7, 7, 2, True): 1, (7, 7, 2, False): 1, (7, 7, 1, True): 1,
    }
    left = exact_dedup.drop_duplicates(df)
    assert sorted(((r.doc_id, lower(r.text)) for r in left.collect()), key=str) == sorted([(1, "a"), (None, "b"), (None, ""), (None, "c"), (7, "d"), (7, "e")], key=str)


def test_exact_hot_digests(spark, sf, monkeypatch):
    """Large groups joined by broadcast, and representatives dealt over many keys, change nothing."""
    docs = common.load(spark, sf, "documents")
    docs = docs.unionByName(docs.where("doc_id < 3").crossJoin(spark.range(60)).withColumn("doc_id", F.col("doc_id") * 1000 + F.col("id") + 10**6).drop("id"))
    want = sorted(tuple(r) for r in exact_dedup.deduplicate(docs).collect())
    assert sum(r[2] > 50 for r in want) >= 183
    left = sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect())
    for module, name, value in ((exact_dedup, "COPIES", 4), (common, "SMALL", 0)):
        monkeypatch.setattr(module, name, value)
        assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == left
        assert sorted(tuple(r) for r in exact_dedup.deduplicate(docs).collect()) == want
    dig = common.cut(exact_dedup.digests(docs), "hot")
    many = exact_dedup.group_batches(dig, []).where("n > 1")
    assert sorted(map(tuple, exact_dedup.attach(dig, many, 10).collect()), key=str) == sorted(map(tuple, exact_dedup.attach(dig, many, 10**9).collect()), key=str)


def test_exact_same_digest_other_bytes(spark, monkeypatch):
    """Texts that share a digest are told apart by their bytes."""
    df = common.cut(spark.createDataFrame([(1, "a1"), (2, "a2"), (3, "a1"), (4, "a2"), (5, "b")], "doc_id long, text string"), "odd")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c if not isinstance(c, str) else F.col(c), 1, 1))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df).collect()}
    assert got == {(1, 3, 2, False), (3, 3, 2, True), (2, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    made = exact_dedup.build_fuse(keys)
    assert exact_dedup.probe_fuse(keys, *made).all()
    other = np.random.default_rng(n + 1).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert exact_dedup.probe_fuse(other, *made).mean() < 0.02


# ---- 3 simhash


def brute_print(t):
    w = WORD.findall(lower(t))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """fp -> smallest fp reachable."""
    fps = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(f): int(fps[root(i)]) for i, f in enumerate(fps)}


def test_simhash_brute(docs, empty):
    pairs = [(d, brute_print(t)) for d, t in texts(docs)]
    cls = brute_classes([p for _, p in pairs])
    least = {}
    for d, p in pairs:
        least[cls[p]] = min(d, least.get(cls[p], d))
    want = sorted((d, p, least[cls[p]]) for d, p in pairs)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.drop_near_duplicates(spaced(docs).drop("fp"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, c in want if d == c)


def test_simhash_links_exact(spark):
    """Planted fingerprints at 0 to 5 bits, chains and dense groups: the classes are those of brute force."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(3000)]
    for base in fps[:300]:
        for bits in (1, 2, 3, 4, 5):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    x = fps[7]
    for _ in range(60):  # a chain
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(x)
    fps += [fps[9] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]  # a dense group
    cls = brute_classes(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in set(fps)]
    df = common.cut(spark.createDataFrame(signed, "fp long"), "fps")
    for n in (len(signed), 10**6, 10**9):  # other depths of the trees
        edges = simhash.links(df, n)
        roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
        byroot = collections.defaultdict(set)
        for f in set(fps):
            byroot[roots.get(f, f)].add(f)
        brute = collections.defaultdict(set)
        for f, c in cls.items():
            brute[c].add(f)
        assert sorted(map(sorted, byroot.values())) == sorted(map(sorted, brute.values()))


# ---- 4 BPE, 6 token files


def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_library(docs, empty):
    t = lib()
    want = []
    for d, x in texts(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))))
    for spread, leaf in ((bpe.SPREAD, bpe.LEAF), (5000, 256)):
        got = bpe.encode(spaced(docs), PATH, digests=True, spread=spread, leaf=leaf)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((d, x or "") for d, x in texts(docs))
    assert bpe.encode(empty, PATH).count() == 0


ALPHABETS = ["ab", "abcdefghij", "aA1!'s t", "äöabé", "漢字かな", "a'sdtre", "0123ab", "!?'s", "🙂a", " \n\t\u00a0\u2003x", "<|endoftext|> a",
    "\x1c\x1fa b", "don't we'll ", "a,b.c-d 'x", "a  \n\tb.", "a \u180e\u200b\ufeff\u3000\u0085", "x \r\n\n's"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_bpe_trees(alphabet):
    rng, t = random.Random(alphabet), lib()
    codec = bpe.Codec(PATH, leaf=64)
    for n in (1, 10, 63, 64, 65, 500, 3000):
        for _ in range(12):
            s = "".join(rng.choice([alphabet, *alphabet]) if rng.random() < 0.02 else rng.choice(alphabet) for _ in range(n))
            want = t.encode(s, add_special_tokens=False).ids
            assert codec.tree(s) == want
            assert np.frombuffer(codec.encode([s])[0], "<u4").tolist() == want


@pytest.mark.parametrize("piece", ["a1", "!?", "lorem", "x\n", "'s", "🙂é", "漢字a", "a,b", "12.5%", "The quick brown fox, it's 7 o'clock. "])
def test_bpe_reencoded(piece, monkeypatch):
    """Joining halves encodes little of the text again, and gives the library's ids."""
    rng, codec, again = random.Random(piece), bpe.Codec(PATH, leaf=512), []
    text = "".join(piece if rng.random() < 0.98 else rng.choice("aB1!é") for _ in range(60_000 // len(piece)))
    want, whole = codec.whole(text), codec.whole
    monkeypatch.setattr(codec, "whole", lambda s: again.append(len(s)) or whole(s))
    assert codec.tree(text) == want
    assert len(again) >= 100 and sum(again) < 0.5 * len(text)


def test_bpe_batches(monkeypatch):
    """Many texts at once, with shared parts, odd spaces and a cache that overflows."""
    rng, t = random.Random(1), lib()
    words = ["".join(rng.choice("aeiörstßn漢") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "'s", "***", "<|endoftext|>"]) for _ in range(3000)]
    texts = [None, "", " ", "a ", " a", *("".join(rng.choice(words) + rng.choice([" "] * 8 + ["\n", "  ", " \n", "\u00a0 ", " \u2003"]) for _ in range(n)).strip(" ") for n in [1, 5, 400] * 20)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for cache, group, quick in ((bpe.CACHE, bpe.GROUP, True), (100, 7, True), (100, 100, False)):
        monkeypatch.setattr(bpe, "CACHE", cache)
        monkeypatch.setattr(bpe, "GROUP", group)
        codec = bpe.Codec(PATH)
        assert codec.quick
        codec.quick = codec.quick if quick else None
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want
            assert [np.frombuffer(codec.encode([x])[0], "<u4").tolist() for x in texts] == want


def test_bpe_quick_parts():
    """Western parts, among them all tokens of the vocabulary, through tiktoken and through the library."""
    rng, t, codec = random.Random(2), lib(), bpe.Codec(PATH)
    western = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
    tokens = [b.decode("utf-8", "ignore") for b in codec.table]
    for draw in (lambda: rng.choice(western), lambda: rng.choice(tokens), lambda: rng.choice("-=.,'! s1é") * rng.randint(1, 20)):
        words = ["".join(draw() for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
        words = [w for w in words if " " not in w]
        text = "x " + " ".join(words)
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("merges", [[("b", "c"), ("a", "b"), ("ab", "c")], [("a", "b"), ("ab", "c")]])
def test_bpe_unreachable_token(tmp_path, merges):
    """A vocabulary with a token that its own bytes don't encode as goes through the library alone."""
    from tokenizers import models, pre_tokenizers

    vocab = {c: i for i, c in enumerate([*bpe._byte_of(), *map("".join, merges)])}
    t = Tokenizer(models.BPE(vocab, merges))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "t.json"))
    codec = bpe.Codec(str(tmp_path / "t.json"))
    assert (codec.quick is None) == (merges[0] == ("b", "c"))
    for text in ("abc", "abc abc xabc bcab", "ab abcabc cab"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == t.encode(text).ids


def test_token_files(spark, docs, empty):
    t, docs = lib(), spaced(docs)
    null = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    for given, block, file in ((docs, token_files.BLOCK, token_files.FILE), (docs.unionByName(null), 700, 5_000)):
        want, at = [], 0
        for d, x in sorted(texts(given), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = [tuple(r) for r in token_files.write_and_read(given, PATH, block=block, file=file).collect()]
        assert collections.Counter(got) == collections.Counter(want)
    assert token_files.write_and_read(empty, PATH).count() == 0
    assert bpe.vocab_size(PATH) == t.get_vocab_size(with_added_tokens=True)


def test_token_files_layout(spark, tmp_path):
    """Several files of several blocks; the manifest's first positions are the running sum of their ids."""
    ids = [np.arange(n, dtype="<u4") % 50 for n in (1000, 0, 1, 5000, 299, 2500, 800)]
    rows = [(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(ids)]
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"), f"{tmp_path}/t", 50, block=400, file=3000)
    blocks = spark.read.parquet(f"{tmp_path}/t/blocks").orderBy("file", "seq").collect()
    assert max(collections.Counter(b.file for b in blocks).values()) > 1 and max(b.n_ids for b in blocks) == 400
    assert (np.concatenate([token_files.unpack_block(bytes(b.block))[0] for b in blocks]) == np.concatenate(ids)).all()
    at = 0
    for m in spark.read.parquet(f"{tmp_path}/t/manifest").orderBy("file").collect():
        assert m.first == at and m.n_ids == sum(b.n_ids for b in blocks if b.file == m.file)
        at += m.n_ids


def test_coder():
    rng = np.random.default_rng(0)
    cases = [rng.integers(0, 50257, 5000), np.zeros(3000, int), rng.zipf(1.3, 40_000) % 50257, np.tile(rng.integers(0, 50257, 50), 400), np.array([50256]), np.arange(2000) % 7]
    for ids in cases:
        ids = ids.astype(np.uint32)
        raw = token_files.pack_block(ids, [(3, 0, len(ids), 0, len(ids))], 50257)
        back, docs = token_files.unpack_block(raw)
        assert (back == ids).all() and docs == [(3, 0, len(ids), 0, len(ids))]
        bad = bytearray(raw)
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack_block(bytes(bad))
    long = np.where(rng.random(300_000) < 0.3, rng.integers(0, 50257, 300_000), rng.zipf(1.2, 300_000) % 50257).astype(np.uint32)
    back, _ = token_files.unpack_block(token_files.pack_block(long, [], 50257))
    assert (back == long).all()
    assert len(token_files.pack_block(np.tile(cases[3], 4).astype(np.uint32), [], 50257)) < 0.6 * 2 * 4 * len(cases[3])


# ---- 5 line dedup


def test_lines_brute(docs, empty):
    data, first = texts(docs), {}
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    for d, t in data:
        for x in (t or "").split("\n"):
            first[key(x)] = min(d, first.get(key(x), d), key=lambda v: (v is not None, v or 0))
    want = []
    for d, t in data:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        want.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    for batches in (1, 3, 9):
        got = line_dedup.deduplicate_lines(spaced(docs).drop("lines"), batches=batches)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.deduplicate_lines(empty).count() == 0


def test_lines_compaction(spark, sf):
    """The default batches fill level 0 twice; what is left are two runs of level 1 and one of level 0, then nothing."""
    docs = common.load(spark, sf, "documents")
    runs = line_dedup.Runs(spark)
    line_dedup.dropped_lines(docs, runs=runs)
    assert runs.merges == 2 and [len(x) for x in runs.levels] == [1, 2]
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_runs_not_shuffled(spark, sf):
    """A run keeps its partitioning and its order in the joins; the runs' entries are the smallest doc_id of each hash."""
    rows = line_dedup.hashed_lines(common.load(spark, sf, "documents"))
    runs = line_dedup.Runs(spark)
    for k in range(5):
        part = rows.where(F.col("doc_id") % 5 == k).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        runs.add(runs.anti(part))
    with line_dedup.trusted_order(spark):
        plan = runs.anti(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "BatchEvalPython" not in plan
    assert runs.entries().groupBy("h1", "h2").count().where("count > 1").isEmpty()
    assert runs.entries().count() == rows.select("h1", "h2").distinct().count()
    runs.close()


# ---- 10 mixing


def test_mixing(docs, empty):
    size, total = collections.Counter(), 0
    data = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for _, t, s in data:
        size[s] += len(WORD.findall(t or ""))
    total = sum(size.values())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # share, stop at the cap, share the excess again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)
    got = mixing.plan(spaced(docs)).collect()
    assert len(got) == len(data)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    mixed = mixing.mix(spaced(docs))
    assert mixed.columns == [*spaced(docs).columns, "_position"]
    out = mixed.collect()
    at = [r["_position"] for r in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    words = collections.Counter()
    for r in out:
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == +taken
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_placed(spark, sf, docs):
    """op10's rows come from the pieces in training order: each source's demand is met along its schedule."""
    got = mixing.placed(spaced(docs)).collect()
    want = mixing.plan(docs).collect()
    cols = ("doc_id", "source", "size", "source_size", "target", "taken")
    assert collections.Counter(tuple(r[c] for c in cols) for r in got) == collections.Counter(tuple(r[c] for c in cols) for r in want)
    assert all((r.position is None) == (r.last_position is None) == (r.taken == 0) for r in got)
    place = {r.doc_id: r for r in want}
    for r in got:
        p = place[r.doc_id]
        if r.taken == 0 or p.size != r.size or r.size == 0 or sum(x.doc_id == r.doc_id for x in got) > 1:
            continue
        a = ((p.place - 1) % 3 - 1) / 2
        met = lambda t: ((1 - a) * t + a * t * t) * p.target  # noqa: B023, E731
        assert met(r.position) == pytest.approx(min(p.before, p.target), abs=1e-6 * p.source_size)
        last = p.passes - (0 if p.rest else 1)
        assert met(r.last_position) == pytest.approx(min(p.target, last * p.source_size + p.before), abs=1e-6 * p.source_size)


def test_mixing_queries(spark, sf, monkeypatch):
    """Both queries reach position()."""
    seen = []
    at = mixing.position
    monkeypatch.setattr(mixing, "position", lambda *a: seen.append(1) or at(*a))
    rows_ = queries.op10_mixing(spark, sf).collect()
    assert len(seen) == 1
    assert [r.position for r in rows_ if r.taken] == sorted(r.position for r in rows_ if r.taken)
    order = queries.op10_mixing_order(spark, sf).collect()
    assert len(seen) == 2 and {(r.doc_id, r.taken, r.first) for r in order} == {(r.doc_id, r.taken, r.position) for r in rows_ if r.taken}
    assert all(0 <= r.first <= r.last <= 1 for r in order)


def test_mixing_partitions(docs, monkeypatch):
    """Stretches of training time are even partitions in global order, and a long prefix gives the same plan."""
    base = sorted((tuple(r) for r in mixing.plan(docs).drop("nth").collect()), key=str)
    monkeypatch.setattr(mixing, "GROUP", 1)
    assert sorted((tuple(r) for r in mixing.plan(docs).drop("nth").collect()), key=str) == base
    words = sum(r.taken for r in mixing.plan(docs).collect())
    monkeypatch.setattr(mixing, "WORDS", max(1, words // 8))
    got = mixing.mix(docs).withColumn("pid", F.spark_partition_id()).collect()
    assert [r.position for r in sorted(got, key=lambda r: r.pid)] == sorted(r.position for r in got)
    sizes = collections.Counter()
    for r in got:
        sizes[r.pid] += len(WORD.findall(r.text or ""))
    assert len(sizes) > 1 and max(sizes.values()) < 4 * words / 8 + max(len(WORD.findall(r.text or "")) for r in got)


# ---- 2 HTML extraction


PAGE = """<!doctype html><html><head><title>No</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies, accept them.</p></div><article><h1>Title &amp; more</h1><p>First   paragraph, with some
words &eacute;t <b>bold</b> text that goes on for a while.<p>Second paragraph here, and it has a <a href=x>link</a> in it too.
<div class="ad">Buy now: cheap!</div><p>Third one closes the article, as it should be.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thanks for writing.</p></div></section><aside><p>Related: other things.</p></aside><footer>&copy; 2024 Us</footer></body></html>"""


def test_html_page():
    assert html_extract.trained().main_text(PAGE).split("\n") == ["Title & more",
        "First paragraph, with some words ét bold text that goes on for a while.", "Second paragraph here, and it has a link in it too.", "Third one closes the article, as it should be."]


ARTICLE = "<article><h1>Title here</h1><p>First paragraph, with words that go on for a while.<p>Second one, which closes the article as it should.</article>"


@pytest.mark.parametrize("start", ["<html><head><title>No</title>", "<html><head><meta charset=utf-8><link href=x><style>p{}</style></head><body>", "<html><head><title>No</title><body>"])
@pytest.mark.parametrize("dead", ["", "<div><TAG>", "<div><TAG></div>", "<TAG>", "<div><TAG></div><div><TAG>No</TAG></div>", "<div><TAG><div>No</TAG></div>", "<TAG/>"])
@pytest.mark.parametrize("tag", ["noscript", "template", "object", "canvas", "svg", "audio", "video"])
def test_html_left_open(start, dead, tag):
    """A head or dead element without its end tag doesn't take the article along."""
    text = [b.text for b in html_extract.blocks_of(start + dead.replace("TAG", tag) + ARTICLE)]
    assert text == ["Title here", "First paragraph, with words that go on for a while.", "Second one, which closes the article as it should."]


def test_html_head_and_math():
    texts_ = lambda p: [b.text for b in html_extract.blocks_of(p)]
    assert texts_("<html><head><title>x</title><p>text of the page") == ["text of the page"]
    assert texts_("<head><title>x</title>text of the page") == ["text of the page"]
    assert texts_("<head><title>x</title>\n<noscript><p>No</p></noscript></head>\n<p>text") == ["text"]
    assert texts_("<p>where <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["where a=2 holds"]
    assert texts_("<p>a</p>" + "<svg>" * 20_000 + "<p>b</p>") == ["a", "b"]


def test_html_held_out():
    from larkspur.llm.html_labelled import labelled_pages

    crf, right, n = html_extract.trained(), 0, 0
    for page, main in labelled_pages(200, 12345):
        blocks = html_extract.blocks_of(page)
        y = crf.viterbi(html_extract.features(blocks))
        right += sum(a == (b.text in main) for a, b in zip(y, blocks))
        n += len(y)
    assert right / n > 0.99


def test_html_viterbi_brute():
    import itertools

    crf, rng = html_extract.trained(), np.random.default_rng(3)
    for _ in range(20):
        feats = [sorted(rng.choice(len(html_extract.FEATURES), 6, replace=False).tolist()) for _ in range(7)]

        def total(y):
            s = crf.start[y[0]] + sum(crf.w[f].sum() for f, k in zip(feats, y) if k)
            return s + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))

        assert total(crf.viterbi(feats)) == pytest.approx(max(total(y) for y in itertools.product((0, 1), repeat=7)))


def test_html_table(spark, sf):
    df = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "v", ""), (2, "v", "<p>unclosed <b"), (3, "w", "<" * 2000),
        (4, None, "<div>" * 3000 + "x")], "page_id long, url string, html string")
    got = html_extract.extract(df.withColumn("text", F.lit(1))).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id is None} == {""}
    assert html_extract.extract(df.limit(0)).count() == 0
    pages = queries.op2_html_extraction(spark, sf).collect()
    raw = {r.page_id: r.html for r in common.load(spark, sf, "pages").collect()}
    for r in pages:
        assert all(html_extract.html.unescape(x) for x in r.text.split("\n")) and "Home" not in r.text
        assert r.text.split("\n")[0] in " ".join(html_extract.html.unescape(raw[r.page_id]).split())


# ---- 8 URL filters


def test_urls(spark, sf):
    data = [(1, "HTTPS://WWW.Example.com/en/x?q#f"), (2, "http://a.net/es/1"), (3, "http://b.org/x"), (4, None), (5, "no scheme"), (6, "x://com"),
        (7, "x://com/"), (8, "http://a.example.com/en/"), (9, "http://www.example.com/e"), (10, "http://net.org?://a.net/fr/"), (1, "HTTPS://WWW.Example.com/en/x?q#f")]
    got = {r.page_id: r for r in url_filter.judge_urls(spaced(spark.createDataFrame(data, "page_id long, url string"))).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 11)] == [
        ("www.example.com", "/en/x", "www.example.com/en/"), ("a.net", "/es/1", "net/es/"), ("b.org", "/x", None), ("", "", None), ("", "", None), ("com", "", None), ("com", "/", "com/"),
        ("a.example.com", "/en/", "example.com/en/"), ("www.example.com", "/e", "com/"), ("net.org", "", None),
    ]
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[4].verdict == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


class Plain:
    """The models' counts on the driver, and the score of one text by a plain loop."""

    def __init__(self, ratio):
        self.counts, self.order, self.alphabet = {"allow": {}, "block": {}}, ratio.order, ratio.alphabets[""]
        for r in ratio.table.groupBy("verdict", "context", "next").agg(F.sum("n").alias("n")).collect():
            self.counts[r.verdict].setdefault(r.context, {})[r.next] = r.n

    def p(self, verdict, context, nxt):
        p = 1.0 / self.alphabet
        for k in range(len(context) + 1):
            seen = self.counts[verdict].get(context[len(context) - k :])
            if seen is None:
                break  # longer contexts aren't seen either
            p = (seen.get(nxt, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(self, text):
        s = f"\x02{text}\x03"
        at = [(s[max(0, i - self.order) : i], s[i]) for i in range(1, len(s))]
        return sum(math.log(self.p("allow", *x) / self.p("block", *x)) for x in at) / len(at)


def test_url_model(spark):
    """Held-out URLs of two kinds are told apart."""
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(8))
    data = [(f"{word('abcdef')}.com", f"/{word('abcdef')}", "allow") for _ in range(400)] + [(f"{word('uvwxyz')}.net", f"/es/{word('uvwxyz')}", "block") for _ in range(400)]
    ratio, cutoff = url_filter.train(common.cut(spark.createDataFrame(data, "host string, path string, verdict string"), "urls"))
    plain = Plain(ratio)
    good = [plain.score(f"{word('abcdef')}.org/{word('abcdef')}") for _ in range(100)]
    bad = [plain.score(f"{word('uvwxyz')}.org/{word('uvwxyz')}") for _ in range(100)]
    assert sum(s >= cutoff for s in good) > 95 and sum(s < cutoff for s in bad) > 95
    for ctx in ("", "a", "ab.c", "zzzz"):  # smoothed probabilities sum to at most one over the seen alphabet
        assert sum(plain.p("allow", ctx, c) for c in {r for m in plain.counts.values() for x in m.values() for r in x}) <= 1 + 1e-9


def test_url_all_contexts(spark):
    """All contexts count, those of the held-out URLs too, and the joined scores are those of a plain loop."""
    rng = random.Random(3)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    letters = "".join(map(chr, [*range(97, 123), *range(0x3B1, 0x3C9)]))
    data = [(f"{word(letters, 30)}.com", f"/{word(letters, 20)}", "allow") for _ in range(900)] + [(f"{word(letters, 30)}.net", f"/es/{word(letters, 20)}", "block") for _ in range(900)]
    ratio, _ = url_filter.train(common.cut(spark.createDataFrame(data, "host string, path string, verdict string"), "urls"))
    want = {"allow": collections.defaultdict(collections.Counter), "block": collections.defaultdict(collections.Counter)}
    for h, p, v in data:
        s = f"\x02{h}{p}\x03"
        for i in range(1, len(s)):
            for k in range(min(4, i) + 1):
                want[v][s[i - k : i]][s[i]] += 1
    assert len(set(want["allow"]) | set(want["block"])) > 40_000
    plain = Plain(ratio)
    assert plain.counts == {v: {c: dict(n) for c, n in m.items()} for v, m in want.items()}
    some = [*data[:20], ("", "", "allow"), ("w" * 9, "/\x7f", "allow"), *((f"{word(letters, 9)}.org", "", "allow") for _ in range(50)), data[0]]
    got = ratio.score_rows(spark.createDataFrame(some, "host string, path string, verdict string")).collect()
    assert len(got) == len(some)
    for r in got:
        assert r.score == pytest.approx(plain.score(r.host + r.path), abs=1e-9)


def test_url_brute(spark, sf):
    """Threshold, scores and verdicts of the query recomputed in plain Python."""
    rows, order = [], url_filter.ORDER
    for r in common.load(spark, sf, "pages").collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(t), t, v) for t, v in url_filter.RULES if ("." + host).endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])]
        rows.append((r.page_id, host, path, *(max(fits)[1:] if fits else (None, None))))
    df = spark.createDataFrame([(h, p) for _, h, p, _, v in rows if v], "host string, path string").distinct()
    held = {(r.host, r.path) for r in df.where(F.pmod(F.xxhash64("host", "path"), F.lit(url_filter.HELD)) == 0).collect()}

    def count(urls):
        out = {"allow": collections.defaultdict(collections.Counter), "block": collections.defaultdict(collections.Counter)}
        for _, h, p, _, v in urls:
            s = f"\x02{h}{p}\x03"
            for i in range(1, len(s)):
                for k in range(min(order, i) + 1):
                    out[v][s[i - k : i]][s[i]] += 1
        return out

    def score(model, h, p):
        s, signs, out = f"\x02{h}{p}\x03", len(set(model["allow"][""]) | set(model["block"][""])) + 1, 0.0
        for i in range(1, len(s)):
            for v, sign in (("allow", 1), ("block", -1)):
                q = 1 / signs
                for k in range(min(order, i) + 1):
                    if (seen := model[v].get(s[i - k : i])) is not None:
                        q = (seen[s[i]] + len(seen) * q) / (sum(seen.values()) + len(seen))
                out += sign * math.log(q)
        return out / (len(s) - 1)

    decided = [r for r in rows if r[4]]
    fitted, final = count([r for r in decided if (r[1], r[2]) not in held]), count(decided)
    step = 2 * url_filter.SPAN / url_filter.BINS
    bins = [(min(url_filter.BINS - 1, max(0, math.floor((score(fitted, r[1], r[2]) + url_filter.SPAN) / step))), r[4]) for r in decided if (r[1], r[2]) in held]
    n = collections.Counter(v for _, v in bins)
    quality = [sum(b >= t for b, v in bins if v == "allow") / n["allow"] + sum(b < t for b, v in bins if v == "block") / n["block"] for t in range(url_filter.BINS + 1)]
    best = next(t for t, q in enumerate(quality) if q >= max(quality) - 1e-12)
    want = {}
    for page, h, p, rule, v in rows:
        s = None if v else score(final, h, p)
        want[page] = (h, p, rule, v or ("allow" if not (h or p) or s >= best * step - url_filter.SPAN else "block"), s)
    got = queries.op8_url_filters(spark, sf).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4]
        assert r.score == (None if want[r.page_id][4] is None else pytest.approx(want[r.page_id][4], abs=1e-9))


# ---- 1 language ID


def test_language(spark, sf, edge, empty):
    docs, pages = common.load(spark, sf, "documents"), common.load(spark, sf, "pages")
    out = queries.op1_language_id(spark, sf).collect()
    assert len(out) == docs.count() + pages.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    mine = [(r.lang, lang[r.doc_id]) for r in out if r.doc_id is not None]
    assert sum(a == b for a, b in mine) / len(mine) > 0.95
    said = [(r.lang, r.declared) for r in out if r.page_id is not None]
    assert sum(a == b for a, b in said) / len(said) > 0.9
    model = language_id.fit(docs)
    assert language_id.identify(edge, None, model).count() == edge.count()
    assert language_id.identify(empty, None, model).count() == 0
    assert {r.lang for r in language_id.identify(edge, None, None).collect()} == {None}


def test_language_brute(spark, sf):
    """Counts, priors and the posterior recomputed in plain Python."""
    docs, pages = common.load(spark, sf, "documents").collect(), common.load(spark, sf, "pages").collect()
    assert max(collections.Counter(r.lang for r in docs).values()) <= language_id.SAMPLE  # all of them are fitted on
    langs = sorted({r.lang for r in docs if r.lang})
    k = range(len(langs))

    def slots(text):
        c = [ord(x) if ord(x) >= 97 and not 122 < ord(x) < 192 else 32 for x in (text or "").lower()]
        for a, b, d in zip(c, c[1:], c[2:]):
            if not a == b == 32:
                h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ d * 0xC2B2AE35) & 0xFFFFFFFF
                yield (h ^ h >> 15) % language_id.SLOTS

    counts = [collections.Counter() for _ in k]
    for r in docs:
        if r.lang:
            counts[langs.index(r.lang)].update(slots(r.text))
    total = [sum(c.values()) + 0.1 * language_id.SLOTS for c in counts]

    def score(text):
        mine = list(slots(text))
        if not mine:
            return [0.0 for _ in k]
        ll = [sum(math.log((counts[i][s] + 0.1) / total[i]) for s in mine) * min(len(mine), language_id.WEIGHT) / len(mine) for i in k]
        return [x - max(ll) for x in ll]

    def soft(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    rows = [(r.doc_id, None, r.source, None, None, score(r.text)) for r in docs]
    for r in pages:
        host = re.match(r"(?s)^.*?://([^/?#:]*)", r.url or "")
        host = lower(host[1]) or None if host else None
        said = re.search(r"<html[^>]*\slang=[\"']?([a-zA-Z]+)", r.html or "")
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", r.html or "")
        rows.append((None, r.page_id, host, host and host.rsplit(".", 1)[-1], said and said[1].lower(), score(html.unescape(plain))))
    own = [soft(r[5]) for r in rows]
    add = lambda at: {key: [sum(o[i] for r, o in zip(rows, own) if r[at] == key) for i in k] for key in {r[at] for r in rows}}
    by_host, by_suffix, by_said = add(2), add(3), add(4)
    world = [sum(o[i] for o in own) + 1 for i in k]
    base = [x / sum(world) for x in world]
    kap = language_id.KAPPA
    smooth = lambda c, parent: [(x + kap * p) / (sum(c) + kap) for x, p in zip(c, parent)]
    want = {}
    for r, o in zip(rows, own):
        parent = smooth(by_suffix[r[3]], base) if r[3] else base
        prior = smooth([max(0.0, x - y) for x, y in zip(by_host[r[2]], o)], parent) if r[2] else base
        logs = [x + math.log(p) for x, p in zip(r[5], prior)]
        if r[4]:
            logs = [x + math.log((d + 0.5) / (w + 0.5 * len(langs))) for x, d, w in zip(logs, by_said[r[4]], world)]
        post = soft(logs)
        want[r[0], r[1]] = langs[post.index(max(post))], max(post), r[4], r[2]
    got = queries.op1_language_id(spark, sf).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        lang, sure, said, host = want[r.doc_id, r.page_id]
        assert (r.lang, r.declared, r.host) == (lang, said, host) and r.confidence == pytest.approx(sure, abs=2e-5)


def test_language_sample(spark, monkeypatch):
    """The limit on hashes leaves the same first rows of each language as a window over all."""
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 100 = 0 THEN 'rare' WHEN id < 29000 THEN 'main' END AS lang", "concat('text number ', id) AS text")
    counts = language_id.fit(df, sample=50)
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = np.zeros((2, language_id.SLOTS))
    for i, lang in enumerate(("main", "rare")):
        for d in sorted((r.doc_id for r in df.where(F.col("lang") == lang).collect()), key=order.get)[:50]:
            want[i] += np.bincount(language_id.slots_of(f"text number {d}"), minlength=language_id.SLOTS)
    assert counts.langs == ["main", "rare"] and np.allclose(counts.table, language_id.TextModel(counts.langs, want).table)


def test_language_declared_kinds():
    of = language_id.declared_of
    assert of('<html xml:lang="FR-ca">') == "fr" and of('<html xml:lang="fr" lang="de">') == "de"
    assert of('<html><meta http-equiv="Content-Language" content="es-ES"><p>x') == "es"
    assert of('<html><meta name="description" content="english text">') is None
    assert of('<meta http-equiv=content-language content=it><html lang=pt>') == "pt"


@pytest.mark.parametrize("before", ["", "<!-- licence, no <html lang=fr> -->" + "\n" * 5000, "<!--" + "x" * 100_000 + "-->"])
@pytest.mark.parametrize("attrs", ["", " class='" + "c " * 5000 + "'", " data-a='x > y'"])
def test_language_declared_anywhere(before, attrs):
    """The <html> tag and its lang may begin after any number of characters."""
    assert language_id.declared_of(f"{before}<HTML{attrs} lang=\"DE-at\"><body><html lang=en>") == "de"
    assert language_id.declared_of(f"{before}<html{attrs}><script>'<html lang=en>'</script><p>lang=en") is None
    assert language_id.declared_of(None) is None


def test_language_prior(spark):
    """Rows without text follow their host, a host with few rows its suffix."""
    model = language_id.TextModel(["de", "en"], np.ones((2, language_id.SLOTS)))
    data = [(i, "a.de", "de", None, [0.0, -9.0]) for i in range(50)] + [(100 + i, "b.com", "com", None, [-9.0, 0.0]) for i in range(50)] + [(200,
        "a.de", "de", None, [0.0, 0.0]), (201, "new.com", "com", None, [0.0, 0.0]), (202, None, None, None, [0.0, -9.0])]
    df = spark.createDataFrame(data, "doc_id long, host string, suffix string, declared string, ll array<double>")
    got = {r.doc_id: r.lang for r in language_id.fuse(df, model.langs).collect()}
    assert got[200] == "de" and got[201] == "en" and got[202] == "de" and got[0] == "de" and got[100] == "en"


# ---- state and failures


def test_runs_stay_for_the_caller(spark):
    """A second table loses the lines of the first; the caller's runs are closed by the caller alone."""
    runs = line_dedup.Runs(spark)
    one = spark.createDataFrame([(1, "a line that comes again\nonly here, once"), (2, "a line that comes again")], "doc_id long, text string")
    two = spark.createDataFrame([(7, "a line that comes again\nsomething new altogether"), (8, "something new altogether")], "doc_id long, text string")
    first = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(one, runs=runs).collect()}
    second = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(two, runs=runs).collect()}
    assert first == {1: "a line that comes again\nonly here, once", 2: ""} and second == {7: "something new altogether", 8: ""}
    assert runs.names()
    runs.close()
    assert not runs.names() and not [t for t in spark.catalog.listTables() if t.name.startswith(runs.tag)]


def test_runs_go_when_a_batch_fails(spark, monkeypatch):
    def fails(self, new):
        if self.made:
            raise RuntimeError("lost")
        self._push(0, self._write(new))

    monkeypatch.setattr(line_dedup.Runs, "add", fails)
    docs = spark.createDataFrame([(i, f"a line number {i} of many") for i in range(50)], "doc_id long, text string")
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dropped_lines(docs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_small_then_large_batch(spark):
    """The shards of a small snapshot's filters are enough for a large batch that follows."""
    docs = spark.createDataFrame([(i, f"text {i % 400}") for i in range(1000)], "doc_id long, text string")
    dig = common.cut(exact_dedup.digests(docs), "shards")
    got = {r.digest: (r.n, r.max_id) for r in exact_dedup.group_batches(dig, [3]).collect()}
    want = collections.defaultdict(list)
    for i in range(1000):
        want[sha(f"text {i % 400}")].append(i)
    assert got == {k: (len(v), max(v)) for k, v in want.items()}
