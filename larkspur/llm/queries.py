"""The registered queries, one per operator and a few more of the same operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, exact_dedup, html_extract, language_id, line_dedup, mixing, quality_rules, resampling, sentencepiece_bpe, simhash, token_files, url_filter, vector_codes,
)
from .common import load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages")
    return language_id.identify(docs, pages, language_id.fit(docs))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"), bpe.default_path(), digests=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(load(spark, sf_dir, "documents"), bpe.default_path())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.stored(load(spark, sf_dir, "documents"), keep=["doc_id"])
    return quality_rules.apply_policy(led).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op7_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule: documents that fail it, that fail it alone, and that would be kept without it."""
    led = quality_rules.stored(load(spark, sf_dir, "documents"), keep=["doc_id"])
    parts = [quality_rules.ablation(led, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_only_this", "kept_without") for p in quality_rules.POLICIES]
    return functools.reduce(DataFrame.unionByName, parts)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and the longest rule of every page's url, with the rule's verdict."""
    url = F.col("url")
    rows = load(spark, sf_dir, "pages").select("page_id", url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"))
    return rows.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(load(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.placed(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "last_position").orderBy(F.asc_nulls_last("position"), "doc_id")


def op10_mixing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their source and their first and last training position."""
    out = mixing.placed(load(spark, sf_dir, "documents")).where("taken > 0")
    return out.select("doc_id", "source", "taken", F.col("position").alias("first"), F.col("last_position").alias("last"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(load(spark, sf_dir, "documents"), sentencepiece_bpe.default_path(), digests=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(load(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_language_id, op2_html_extraction, op3_simhash_near_dedup, op4_bpe, op5_line_dedup, op6_token_files,
    op7_quality_rules, op7_quality_ablation, op8_url_filters, op8_url_rules, op9_exact_dedup, op10_mixing, op10_mixing_order, op11_sentencepiece,
    op12_vector_codes, op13_resampling, pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        coalesce(sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
l AS (SELECT *, (total - capped) / (weights - gone) AS lev FROM r),
f AS (SELECT arg_min(lev, ROW(source_size / weight, place)) AS level FROM l WHERE lev * weight <= source_size * 3),
t AS (SELECT source, source_size, place, coalesce(least(level * weight, CAST(source_size * 3 AS DOUBLE)), 0.0) AS target FROM w CROSS JOIN f),
c AS (SELECT d.*, t.source_size, t.target, t.place, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS rest, ((place - 1) % 3 - 1) / CAST(2 AS DOUBLE) AS a FROM c),
q AS (SELECT *, CAST(passes * size + rest AS BIGINT) AS taken, least(CAST(1 AS DOUBLE), CAST(before AS DOUBLE) / target) AS q0,
        least(CAST(1 AS DOUBLE), CAST((passes - CASE WHEN rest > 0 THEN 0 ELSE 1 END) * source_size + before AS DOUBLE) / target) AS q1 FROM k)
"""
#: First and last training position, by the share of demand met before the first and the last piece.
_AT = "CASE WHEN taken > 0 THEN CASE WHEN a = 0 THEN {0} ELSE (a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * {0})) / (2 * a) END END"

#: The ledger: measurements, then fail_bits with the rules in bit order.
_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) AS tri FROM w),
n AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS seen FROM g),
p AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM n WHERE seen > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, 
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines, length(regexp_replace(t, '[^a-zA-Z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters FROM w LEFT JOIN p ON p.rid = w.rid),
led AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words > 0 
    AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::INT + 8 * (10 * n_symbols > n_words)::INT
        + 16 * (100 * n_dup_lines > 30 * n_lines)::INT + 32 * (n_words > 0 AND 100 * n_letters < 50 * word_chars)::INT AS INTEGER) AS fail_bits FROM m)
"""
_RULES = ", ".join(f"('{name}', {bit})" for name, bit in quality_rules.BIT.items())
_MASKS = ", ".join(f"('{name}', {mask})" for name, mask in quality_rules.POLICIES.items())


def _rule_case(what: int) -> str:
    """The column of the longest rule that fits."""
    whens = []
    for rule in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        host, _, path = rule[0].partition("/")
        whens.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule[what]}'")
    return f"CASE {' '.join(whens)} END"


def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Integer parts, then a codebook and an assignment a round, each from the one before."""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
u AS (SELECT rid, len(z) // {parts} AS size, unnest(z) AS x, generate_subscripts(z, 1) - 1 AS i FROM v),
p AS MATERIALIZED (SELECT rid, CAST(i // size AS INTEGER) AS part, CAST(i % size AS INTEGER) AS pos, x FROM u),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x AS c FROM p WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT rid, p.part, entry, sum((x - c) * (x - c)) AS d FROM p JOIN b{k} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p.part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM p JOIN a{k} a ON p.rid = a.rid AND p.part = a.part GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return ",\n".join(steps) + f""",
e AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN e ON v.rid = e.rid"""


_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RESAMPLE = f"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_FEATURES} AS words FROM documents),
dw AS MATERIALIZED (SELECT rid, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
y AS (SELECT w, list_transform(range(1, len(x), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1) AS bytes FROM h),
k AS MATERIALIZED (SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM y, crc),
n AS MATERIALIZED (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t
  FROM (SELECT w, 0 AS side FROM dw UNION ALL SELECT w, 1 AS side FROM bw) f JOIN k ON f.w = k.w GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM n),
q AS (SELECT rid, sum(gain) AS weight FROM dw JOIN k ON dw.w = k.w JOIN g ON k.bucket = g.bucket GROUP BY rid),
z AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, upper(substr(sha256('2024:' || doc_id), 1, 8)) AS hx FROM d LEFT JOIN q ON d.rid = q.rid),
o AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789ABCDEF', substr(hx, i, 1)) - 1),
  lambda a, b: 16 * a + b) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features DESC) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r"""


ORACLE = {
    "op12_vector_codes": _codes_sql(),
    "op13_resampling": _RESAMPLE,
    "op7_quality_rules": _LEDGER + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality_rules.BASE} != 0 AS base_failed,
  fail_bits & {quality_rules.BASE | quality_rules.POLICIES['v1']} = 0 AS kept, fail_bits FROM led""",
    "op7_quality_ablation": _LEDGER + f""", po AS (SELECT * FROM (VALUES {_MASKS}) v(policy, mask)), ru AS (SELECT * FROM (VALUES {_RULES}) v(rule, bit)),
b AS (SELECT policy, rule, bit, fail_bits & mask AS bits FROM led, po, ru WHERE bit & mask != 0)
SELECT policy, rule, count(*) FILTER (WHERE bits & bit != 0) AS n_failed, count(*) FILTER (WHERE bits = bit) AS n_only_this, count(*) 
    FILTER (WHERE bits = bit OR bits = 0) AS kept_without FROM b GROUP BY ALL""",
    "op8_url_rules": rf"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT *, {_rule_case(0)} AS rule, {_rule_case(1)} AS rule_verdict FROM u""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owned AS (
  SELECT *, min(doc_id) OVER (PARTITION BY k) AS owner FROM keyed
), marked AS (
  SELECT *, length(k) >= 10 AND owner < doc_id AS dropped FROM owned
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op10_mixing": f"{_MIX} SELECT doc_id, size, source_size, target, taken, {_AT.format('q0')} AS position, {_AT.format('q1')} AS last_position FROM q",
    "op10_mixing_order": f"{_MIX} SELECT doc_id, source, taken, {_AT.format('q0')} AS first, {_AT.format('q1')} AS last FROM q WHERE taken > 0",
}
