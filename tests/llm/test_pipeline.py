"""The pipeline's stages against brute force, stage by stage."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from larkspur.llm import bpe, common, mixing
from larkspur.sources.scratch import fresh_path

from .helpers import WORD, lower, sha
from .test_operators import brute_classes, brute_print, lib


def passes(text):
    """The current policy's rules in plain Python."""
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    n = collections.Counter(triples)
    repeated = {j for i, x in enumerate(triples) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and 10 * symbols <= len(words) and 100 * (len(lines) - len(set(lines))) <= 30 * len(lines)


def test_stages(spark, sf):
    docs = common.load(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    kept = common.cut(stage["quality rules"](spark, docs, sf), "q")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d for d, r in rows.items() if passes(r.text or "")}

    once = common.cut(stage["exact dedup"](spark, kept, sf), "e")
    last = {}
    for d in sorted(ids):
        last[lower(rows[d].text)] = d
    assert {r.doc_id for r in once.collect()} == set(last.values()) and once.columns == docs.columns

    near = common.cut(stage["simhash near-dedup"](spark, once, sf), "n")
    prints = {d: brute_print(rows[d].text) for d in last.values()}
    cls, first = brute_classes(prints.values()), {}
    for d in sorted(prints):
        first.setdefault(cls[prints[d]], d)
    assert {r.doc_id for r in near.collect()} == set(first.values()) and near.columns == docs.columns

    mixed = common.cut(stage["mixing"](spark, near, sf), "m")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(first.values())
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * len(WORD.findall(rows[d].text)) for d, n in words.items())

    t = lib()
    want = sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    done = stage["bpe"](spark, mixed, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in done.collect()) == want


def test_run(spark, sf):
    """run() gives what the stages give one after the other, and the ids and texts of the mix are the library's."""
    docs = common.load(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf), "stage")
        if name == "mixing":
            mixed = docs.collect()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(rows) == collections.Counter(docs.collect())
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    t = lib()
    want = collections.Counter()
    for r in mixed:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_training_order(spark, sf):
    """Sorted by its training_place, the pipeline's result is in the order of the mix's positions."""
    docs = common.load(spark, sf, "documents")
    laid = mixing.mix(docs)
    at = collections.defaultdict(list)
    for r in sorted(laid.collect(), key=lambda r: r.position):
        at[r.doc_id].append(r.position)
    stage = dict(corpus_pipeline.STAGES)
    done = stage["bpe"](spark, common.cut(stage["mixing"](spark, docs, sf), "order"), sf).collect()
    assert len({r.training_place for r in done}) == len(done) == sum(map(len, at.values()))
    seen = [at[r.doc_id].pop(0) for r in sorted(done, key=lambda r: r.training_place)]
    assert seen == sorted(seen) and len(set(seen)) > 100


def test_place_of_small_files(spark):
    """Many files of one task stay in order; long documents keep their place; without files it is null."""
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(i, words if i % 7 == 0 else f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = fresh_path(spark, "places")
    df.orderBy("doc_id").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 4).parquet(path)
    stored = spark.read.parquet(path)
    got = bpe.encode(stored, bpe.default_path(), spread=128, label=common.stored_place(stored)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.label)] == list(range(40)) and len({r.label for r in got}) == 40
    clash = stored.withColumns({"_metadata": F.lit(1), "label": F.lit(2)})
    assert {r.label for r in bpe.encode(clash, bpe.default_path(), label=common.stored_place(clash)).collect()} == {r.label for r in got}
    assert {r.label for r in bpe.encode(df, bpe.default_path(), label=common.stored_place(df)).collect()} == {None}
