"""Registered queries: each applies library operators to whole tables, with the same result in SQL where it can be said in SQL.

VIEWS are the stand-in inputs (survey responses, clips, experiment grids and so on) as select lists that
both engines read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions import text as T
from larkspur.operators import boosting as BO
from larkspur.operators import linear as LM
from larkspur.operators import models as M
from larkspur.operators import resample as B
from larkspur.operators import rollup as R
from larkspur.operators import screen as X
from larkspur.operators import select as L
from larkspur.operators import signal as G
from larkspur.operators import similarity as E
from larkspur.operators import stats as ST
from larkspur.operators import text_ridge as TR
from larkspur.plans import manifest as P
from larkspur.sources import io as IO
from larkspur.sources.scratch import fresh_path
from larkspur.sources.snapshots import SnapshotLog

ITEMS = ["pl", "ca", "vi", "un", "mo", "an", "ev", "ch"]
_TYPE = "CASE l_suppkey % 6 WHEN 0 THEN 'bird' WHEN 1 THEN 'water' WHEN 2 THEN 'traffic' WHEN 3 THEN 'construction' WHEN 4 THEN 'wind' ELSE 'silence' END"
_LADDER = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} <= -0.5 THEN 'very_unpleasant' WHEN {0} <= -0.15 THEN 'unpleasant' WHEN {0} <= 0.15 THEN 'neutral' WHEN {0} <= 0.5 THEN 'pleasant' ELSE 'very_pleasant' END"
_SCORE = "(o_totalprice % 2000) / 1000 - 1"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
VIEWS: dict[str, tuple[str, list[str]]] = {
    "resp": ("lineitem", [
        "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS uid", "concat('S', CAST(l_partkey % 200 AS STRING)) AS base", f"{_TYPE} AS masker_type",
        f"concat({_TYPE}, '_', CAST(l_linenumber AS STRING)) AS masker", "l_quantity / 10 - 2.5 AS smr", "l_suppkey AS participant", "CAST(l_orderkey % 8 - 1 AS INT) AS fold", "CASE "
    "WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS is_attention",
        "CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE 1 + l_partkey % 5 END AS pl", "1 + (l_partkey + l_suppkey) % 5 AS ca",
            "1 + (l_partkey * 3 + l_linenumber) % 5 AS vi", "1 + (l_suppkey * 2 + l_linenumber) % 5 AS un",
                "1 + (l_partkey + 2 * l_linenumber) % 5 AS mo", "1 + (l_suppkey + 1) % 5 AS an", "1 + l_orderkey % 5 AS ev", "1 + (l_orderkey + l_partkey) % 5 AS ch",
        "40 + l_extendedprice % 45 AS la50", "l_discount AS disc", "l_tax AS tax", "l_quantity AS qty", "l_extendedprice AS price", "l_partkey % 40 AS part_group"]),
    "clips": ("orders", [
        "o_orderkey AS id", "concat('clip', CAST(o_orderkey AS STRING), '.wav') AS file", f"{_SCORE} AS score", f"{_LADDER.format('(' + _SCORE + ')')} AS bin", "CASE o_custkey % 5 "
    "WHEN 0 THEN 'bird' WHEN 1 THEN 'water' WHEN 2 THEN 'traffic' WHEN 3 THEN 'construction' ELSE 'wind' END AS masker",
        "o_orderstatus AS side", "o_orderpriority AS prio", "3 + o_custkey % 58 AS dur", "o_custkey % 300 AS base", "o_custkey AS cust", "o_totalprice AS price"]),
    "grid": ("events", [
        "event_id", "user_id", "user_id % 4 AS seed", "event_type AS item", f"({_K} % 5) / 2 - 1 AS p", f"{_K} AS k", "value", "event_id % 3 AS lev",
            "event_id % 4 AS ckpt", "user_id % 50 AS clip", "CASE "
    "WHEN event_id % 7 = 0 THEN NULL ELSE value END AS gappy"]),
    "docs": ("documents", ["doc_id", "text", "lang", "source", "n_chars", "(n_chars % 200) / 100 - 1 AS s", "concat('https://creativecommons.org/', CASE doc_id % 5 "
    "WHEN 0 THEN 'publicdomain/zero' WHEN 1 THEN 'licenses/by-nc/3' WHEN 2 THEN 'licenses/by/4' WHEN 3 THEN 'sampling+' ELSE 'other' END) AS licence"]),
    "cust": ("customer", ["c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal / 10000 AS score", "c_mktsegment AS seg", "c_acctbal AS bal"]),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table, cols = VIEWS[name]
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(*cols)


def register(sql: str | None = None, views: str = "", name: str | None = None):
    """The function gets the named views (a table's name stands for itself) and gives the query's rows."""

    def wrap(f):
        names = views.split()

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(*(view(spark, sf, v) if v in VIEWS else spark.read.parquet(f"{sf}/{v}.parquet") for v in names))

        key = name or f.__name__
        QUERIES[key] = run
        if sql is not None:
            head = [f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in names if v in VIEWS]
            body = sql.strip()
            if head:
                word, rest = next(((w, body[len(w) :]) for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), ("WITH ", None))
                body = f"{word}{', '.join(head)}" + (f", {rest}" if rest is not None else f" {body}")
            ORACLE[key] = body
        return f

    return wrap


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that the order of sums doesn't show; minus zero as zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def q6(*exprs: str) -> str:
    """`expr AS name` items rounded like r6."""
    return ", ".join(f"round({e.rpartition(' AS ')[0]}, 6) + 0.0 AS {e.rpartition(' AS ')[2]}" for e in exprs)


_C = "7.071067811865476e-1"
_SPAN = "9.65685424949238e0"
ISO_SQL = f"((pl - an) + {_C} * (ca - ch) + {_C} * (vi - mo)) / {_SPAN}"
EV_SQL = f"((ev - un) + {_C} * (ch - ca) + {_C} * (vi - mo)) / {_SPAN}"
VALID_SQL = "fold BETWEEN 0 AND 5 AND is_attention = 0 AND pl IS NOT NULL"
FMT = "CASE WHEN printf('%.2f', {0}) = '-0.00' THEN '0.00' ELSE printf('%.2f', {0}) END"
HASH = "md5(concat_ws('|', '{1}', CAST({0} AS VARCHAR)))"
STIM_SQL = f"""stim AS (SELECT concat_ws('|', base, masker, CAST(CAST(trunc(smr) AS INT) AS VARCHAR)) AS stimulus_id, min(base) AS base, 
    min(masker_type) AS masker_type, count(*) AS n_ratings, avg({ISO_SQL}) AS score, avg(la50) AS la50 FROM resp WHERE {VALID_SQL} GROUP BY 1)"""


def stimuli(resp: DataFrame) -> DataFrame:
    rows = X.valid_responses(resp, ITEMS).withColumn("stimulus_id", T.compound_key("base", "masker", "smr")).withColumn("score", S.iso_pleasant(*ITEMS))
    return R.rollup(rows, ["stimulus_id"], ["score", "la50"], ["base", "masker_type"], "uid")


# ---- projections


@register(f"SELECT uid, {q6(f'{ISO_SQL} AS iso_p', f'{EV_SQL} AS iso_e', f'({_C} * (pl - an) + (ca - ch) + {_C} * (vi - mo)) / {_SPAN} AS iso_alt')}, {_LADDER.format('(' + ISO_SQL + ')')} AS bin "
    f"FROM resp", "resp")
def p1_circumplex_scores(resp):
    return r6(resp.select("uid", S.iso_pleasant(*ITEMS).alias("iso_p"), S.iso_eventful(*ITEMS).alias("iso_e"),
        S.iso_pleasant_alt(*ITEMS).alias("iso_alt"), S.pleasantness_bin(S.iso_pleasant(*ITEMS)).alias("bin")))


@register("SELECT uid, concat_ws('|', base, masker, CAST(CAST(trunc(smr) AS INT) AS VARCHAR)) AS key, split_part(masker, '_', 1) AS mt, base AS b, masker AS m, "
    "CAST(trunc(smr) AS INT) AS s FROM resp", "resp")
def p2_p3_compound_keys(resp):
    k = resp.withColumn("key", T.compound_key("base", "masker", "smr"))
    b, m, s = T.split_key("key")
    return k.select("uid", "key", T.masker_type("masker").alias("mt"), b.alias("b"), m.alias("m"), s.alias("s"))


@register("""SELECT 'lab' AS src, uid AS key, la50::DOUBLE AS "LA50", (la50 - disc)::DOUBLE AS "LA10_LA90", (price - la50)::DOUBLE AS "LC50_LA50", 
    tax::DOUBLE AS "N5", qty::DOUBLE AS "R", disc::DOUBLE AS "FS", tax::DOUBLE AS "T" FROM resp UNION ALL
SELECT 'field', CAST(id AS VARCHAR), bal::DOUBLE, (bal - nation)::DOUBLE, (score - bal)::DOUBLE, nation::DOUBLE, score::DOUBLE, score::DOUBLE, nation::DOUBLE FROM cust""", "resp cust")
def p4_harmonised_predictors(resp, cust):
    """Two source schemas in one."""
    lab = {"LA50": "la50", "LA10_LA90": ("la50", "disc"), "LC50_LA50": ("price", "la50"), "N5": "tax", "R": "qty", "FS": "disc", "T": "tax"}
    field = {"LA50": "bal", "LA10_LA90": ("bal", "nation"), "LC50_LA50": ("score", "bal"), "N5": "nation", "R": "score", "FS": "score", "T": "nation"}
    a = S.psycho(resp.select(F.lit("lab").alias("src"), F.col("uid").alias("key"), "la50", "disc", "price", "tax", "qty"), lab, ["src", "key"])
    b = S.psycho(cust.select(F.lit("field").alias("src"), F.col("id").cast("string").alias("key"), "bal", "nation", "score"), field, ["src", "key"])
    return a.unionByName(b)


@register(f"""SELECT uid, CASE WHEN la50 < 50 THEN 'quiet' WHEN la50 < 60 THEN 'moderately quiet' WHEN la50 < 70 THEN 'moderately loud' WHEN la50 < 80 THEN 'loud' ELSE 'very loud' END AS loud5,
CASE WHEN la50 < 60 THEN 'quiet' WHEN la50 < 70 THEN 'moderate' ELSE 'loud' END AS loud3 FROM resp""", "resp")
def p6_p7_loudness_words(resp):
    return resp.select("uid", S.loudness5("la50").alias("loud5"), S.loudness3("la50").alias("loud3"))


_SCENES_SQL = ", ".join(f"('{m}', '{lv}', '{s}')" for (m, lv), s in T.SCENES.items())


@register(f"""WITH sc(m, lv, scene) AS (VALUES {_SCENES_SQL}), x AS (SELECT uid, masker_type, CASE WHEN la50 < 60 THEN 'quiet' WHEN la50 < 70 THEN 'moderate' 
    ELSE 'loud' END AS lv FROM resp WHERE masker_type != 'silence' UNION ALL SELECT uid || '?', 'unknown', CASE WHEN la50 < 60 THEN 'quiet' 
    WHEN la50 < 70 THEN 'moderate' ELSE 'loud' END FROM resp WHERE masker_type = 'silence')
SELECT uid, coalesce(scene, CASE x.lv WHEN 'quiet' THEN 'quiet environment' WHEN 'loud' THEN 'loud environment' ELSE 'moderate activity environment' END) AS scene, 
    CASE WHEN scene IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM x LEFT JOIN sc ON m = masker_type AND sc.lv = x.lv""", "resp")
def p8_p9_scene_lookup(resp):
    silent = F.col("masker_type") == "silence"
    rows = resp.select(F.when(silent, F.concat("uid", F.lit("?"))).otherwise(F.col("uid")).alias("uid"),
        T.scene_of(F.when(silent, "unknown").otherwise(F.initcap("masker_type")), S.loudness3("la50")).alias("s"))
    return rows.select("uid", "s.scene", "s.confidence")


@register(f"""SELECT id, 
    concat('park soundscape with ', masker, CASE WHEN side = 'F' THEN ' in the foreground' ELSE ' in the background' END, ' [ISOPleasant: ', {FMT.format('score')}, ']') AS short_caption,
concat('soundscape with ', CASE WHEN w = 'natural sounds' THEN w WHEN side = 'F' THEN w || ' and natural sounds' ELSE 'natural sounds and ' || w END, 
    ' [ISOPleasant: ', {FMT.format('score')}, ']') AS harmonised
FROM (SELECT *, CASE WHEN masker IN ('bird', 'water', 'wind') THEN 'natural sounds' WHEN masker = 'traffic' THEN 'traffic noise' ELSE 'other noise' END AS w FROM clips)""", "clips")
def p11_p15_short_captions(clips):
    fg = F.col("side") == "F"
    return clips.select("id", T.caption_short("masker", fg, "score").alias("short_caption"), T.caption_harmonised("masker", fg, "score").alias("harmonised"))


@register("""SELECT id, concat(prio, '. Loudness: ', loud, ' (LA50: ', CAST(round_even((price % 60 + 30) * 10, 0) / 10 AS VARCHAR), ' dB). Pleasantness: ', bin, 
    ' (ISOPleasant: ', CAST(round_even(score * 100, 0) / 100 AS VARCHAR), ').') AS long_caption
FROM (SELECT *, CASE WHEN price % 60 + 30 < 50 THEN 'quiet' WHEN price % 60 + 30 < 60 THEN 'moderately quiet' WHEN price % 60 + 30 < 70 THEN 'moderately loud' 
    WHEN price % 60 + 30 < 80 THEN 'loud' ELSE 'very loud' END AS loud FROM clips)""", "clips")
def p10_long_captions(clips):
    la = F.col("price") % 60 + 30
    return clips.select("id", T.caption_long("prio", S.loudness5(la), la, "bin", "score").alias("long_caption"))


@register("SELECT id, 'Customer Name ' || CAST(id AS VARCHAR) AS place FROM cust", "cust")
def p12_place_names(cust):
    return cust.select("id", T.place_name(F.concat(F.lit("CustomerName_-"), F.col("id").cast("string"))).alias("place"))


@register("""WITH l AS (SELECT uid, unnest([struct_pack(v := pl::DOUBLE, k := 'traffic', w := 'traffic noise'), struct_pack(v := ca::DOUBLE, k := 'other_noise', 
    w := 'other noise'), struct_pack(v := vi::DOUBLE, k := 'human', w := 'human sounds'), struct_pack(v := un::DOUBLE, k := 'natural', w := 'natural sounds')]) AS s 
    FROM (SELECT DISTINCT uid, pl, ca, vi, un FROM resp)),
r AS (SELECT uid, s.w AS w, row_number() OVER (PARTITION BY uid ORDER BY s.v DESC, s.k DESC) AS r FROM l WHERE s.v >= 3.5),
a AS (SELECT uid, string_agg(w, ' and ' ORDER BY r) AS ws FROM r WHERE r <= 2 GROUP BY uid)
SELECT DISTINCT resp.uid, concat('soundscape with ', coalesce(ws, 'no dominant sound source'), ' at ', base, ' in London [ISOPleasant: ', CASE WHEN printf('%.2f', 
    disc) = '-0.00' THEN '0.00' ELSE printf('%.2f', disc) END, ']') AS caption FROM resp LEFT JOIN a ON a.uid = resp.uid""", "resp")
def p13_p14_source_captions(resp):
    words = T.top_sources({"traffic": F.col("pl"), "other_noise": F.col("ca"), "human": F.col("vi"), "natural": F.col("un")})
    one = resp.select("uid", "base", "disc", words.alias("words"))
    return one.select("uid", T.caption_sources(F.col("words"), "disc", "base", F.lit("London")).alias("caption")).distinct()


_TAGGED = f"concat(prio, ' with ', masker, ' [ISOPleasant: ', {FMT.format('score')}, ']')"


@register(f"""WITH t AS (SELECT id, CASE WHEN id % 11 = 0 THEN prio ELSE {_TAGGED} END AS c FROM clips),
u AS (SELECT id, c, regexp_extract(c, '^(.*?)\\s*\\[ISOPleasant:\\s*(-?\\d+(?:\\.\\d+)?)\\]\\s*$', 1) AS x, TRY_CAST(NULLIF(regexp_extract(c, 
    '^(.*?)\\s*\\[ISOPleasant:\\s*(-?\\d+(?:\\.\\d+)?)\\]\\s*$', 2), '') AS DOUBLE) AS v FROM t)
SELECT id, CASE WHEN v IS NOT NULL THEN x END AS text, v AS value, v AS loose, v AS colon, CASE WHEN v IS NOT NULL THEN concat(x, ' [pleasantness: ', {_LADDER.format('v')}, ']') END AS retagged,
CASE WHEN v IS NULL THEN NULL WHEN abs(v + 1) <= least(abs(v + 0.5), abs(v), abs(v - 0.5), abs(v - 1)) THEN 'very unpleasant' WHEN abs(v + 0.5) <= least(abs(v), 
    abs(v - 0.5), abs(v - 1)) THEN 'unpleasant' WHEN abs(v) <= least(abs(v - 0.5), abs(v - 1)) THEN 'neutral' WHEN abs(v - 0.5) <= abs(v - 1) THEN 'pleasant' 
    ELSE 'very pleasant' END AS nearest FROM u""", "clips")
def p16_p17_p18_tags(clips):
    c = F.when(F.col("id") % 11 == 0, F.col("prio")).otherwise(F.concat("prio", F.lit(" with "), "masker", T.tag("score")))
    t = clips.select("id", c.alias("c"), T.parse_tag(c).alias("t"))
    colon = F.when(F.col("t.value").isNotNull(), T.after_last_colon("c"))
    return t.select("id", "t.text", "t.value", T.parse_tag_loose("c").alias("loose"), colon.alias("colon"),
        T.retag("c", S.pleasantness_bin("t.value")).alias("retagged"),
            S.nearest_label("t.value", [-1, -0.5, 0, 0.5, 1], ["very unpleasant", "unpleasant", "neutral", "pleasant", "very pleasant"]).alias("nearest"))


@register("""WITH n AS (SELECT id, CASE WHEN id % 3 = 0 THEN file ELSE replace(file, '.wav', '_r' || CAST(id % 4 AS VARCHAR) || '.wav') END AS f FROM clips)
SELECT f AS name, regexp_replace(f, '_r\\d+(\\.wav)$', '\\1') AS plain, f LIKE '%\\_r%' ESCAPE '\\' AS rep, count(*) OVER (PARTITION BY regexp_replace(f, 
    '_r\\d+(\\.wav)$', '\\1')) AS times FROM n""", "clips")
def p19_a15_repeat_suffix(clips):
    f = F.when(F.col("id") % 3 == 0, F.col("file")).otherwise(F.concat(F.regexp_replace("file", r"\.wav$", ""), F.lit("_r"), (F.col("id") % 4).cast("string"), F.lit(".wav")))
    rows = clips.select(f.alias("name")).withColumn("plain", T.strip_repeat("name"))
    return rows.select("name", "plain", T.is_repeat("name").alias("rep"), F.count(F.lit(1)).over(Window.partitionBy("plain")).alias("times"))


@register("""WITH g AS (SELECT id, concat(CASE WHEN id % 2 = 0 THEN 'Natural sounds ' ELSE '' END, CASE WHEN id % 3 = 0 THEN 'traffic noise ' ELSE '' END, CASE 
    WHEN id % 7 = 0 THEN 'human' ELSE '' END, CASE WHEN id % 13 = 0 THEN 'no dominant' ELSE '' END) AS s FROM clips)
SELECT id, CASE WHEN contains(s, 'no dominant') THEN 'none' WHEN (contains(s, 'Natural'))::INT + contains(s, 'traffic')::INT + contains(s, 
    'human')::INT != 1 THEN 'mixed' WHEN contains(s, 'Natural') THEN 'natural' WHEN contains(s, 'traffic') THEN 'traffic' ELSE 'human' END AS grp,
lower(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, lpad(CAST(id AS VARCHAR), 9, '0') AS padded FROM g""", "clips")
def p20_p26_groups_and_slugs(clips):
    w = lambda k, s: F.when(F.col("id") % k == 0, s).otherwise("")
    g = clips.select("id", F.concat(w(2, "Natural sounds "), w(3, "traffic noise "), w(7, "human"), w(13, "no dominant")).alias("s"))
    return g.select("id", T.source_group("s").alias("grp"), T.slug("s").alias("slug"), T.zero_pad("id", 9).alias("padded"))


@register("SELECT id, CASE WHEN id % 3 = 0 THEN 'London' WHEN nation = 1 THEN 'Venice' ELSE 'unknown' END AS city FROM cust", "cust")
def p21_city(cust):
    path = F.concat(F.lit("/data/"), F.when(F.col("id") % 3 == 0, "LONDON").otherwise("x"), F.lit("/a.wav"))
    return cust.select("id", T.city_of(path, F.col("nation").cast("string"), {"1": "Venice", "London": "London"}).alias("city"))


@register("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CC0' WHEN 1 THEN 'BY-NC' WHEN 2 THEN 'BY' WHEN 3 THEN 'Sampling+' ELSE licence END AS licence,
(lower(text) LIKE '%tion%')::INT + (lower(lang) LIKE '%en%')::INT AS a, b, (lower(text) LIKE '%tion%' OR b = 1)::INT + (lower(lang) LIKE '%en%')::INT AS n_any 
    FROM (SELECT *, (regexp_matches(lower(text), '(^|[^\\pL\\pN\\pM_])the([^\\pL\\pN\\pM_]|$)'))::INT AS b FROM docs)""", "docs")
def p22_p23_licences_and_keywords(docs):
    word = r"(?:^|[^\pL\pN\pM_])"
    hits = T.keyword_hits(["text", "lang"], {"a": r"tion|^en$", "b": rf"{word}the(?:[^\pL\pN\pM_]|$)"})
    return docs.select("doc_id", T.licence_class("licence").alias("licence"), *(c.alias(n) for n, c in hits.items()))


@register("""WITH d AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE dur * 2.0 END AS sec FROM clips)
SELECT id, sec IS NOT NULL AS known, round(coalesce(sec, avg(sec) OVER ()), 6) + 0.0 AS sec FROM d""", "clips")
def p24_durations(clips):
    span = F.when(F.col("id") % 9 != 0, F.concat(F.lit("("), F.col("dur").cast("string"), F.lit(", "), (F.col("dur") + F.col("dur") * 2 * 44100).cast("string"), F.lit(")")))
    return r6(S.durations(clips.select("id", span.alias("span")), "span").select("id", F.col("dur_known").alias("known"), F.col("dur").alias("sec")))


@register("""SELECT event_id, CAST(seed AS INT) AS seed, item, p, concat(item, ' at dawn') AS stripped, concat('s', item) AS sentence FROM grid""", "grid")
def p25_p27_p28_names(grid):
    name = F.concat(F.lit("s"), F.col("seed").cast("string"), F.lit("_"), "item", F.lit("_p"), T.fmt2("p"), F.lit(".wav"))
    n = grid.select("event_id", "item", T.parse_name(name).alias("n"))
    return n.select("event_id", "n.seed", "n.item", "n.p", T.strip_end(F.concat(F.lit(" "), "item", F.lit(" at dawn. . "))).alias("stripped"),
        T.first_sentence(F.concat(F.lit("s"), F.col("item"), F.lit(". Loudness: loud. "))).alias("sentence"))


_SENTENCE = "CASE WHEN side = 'F' THEN concat(' ', prio, '. Loudness: loud (80 dB). Pleasantness: high.') ELSE concat(prio, ' ') END"


@register("""SELECT id, concat(prio, '. [ISOPleasant: ', printf('%.2f', score), ']') AS rated, concat(prio, ' [pleasantness: ', bin, '] (iso_pleasantness: ', printf('%.0f', price / 1000), ')') AS binned, 
    prio AS bare FROM clips""", "clips")
def p28_caption_variants(clips):
    c = clips.withColumn("caption", F.expr(_SENTENCE))
    return c.select("id", T.caption_rated("caption", F.col("score").cast("string")).alias("rated"), T.caption_binned("prio", "bin", F.col("price") / 1000).alias("binned"),
        T.caption_rated("caption", F.lit("nan")).alias("bare"))


@register(f"SELECT id, ['quiet', 'calm and quiet', 'hushed'][(('0x' || substr(md5(concat_ws('|', '5', CAST(id AS VARCHAR))), 1, 8))::BIGINT % 3) + 1] AS phrase FROM clips", "clips")
def p29_varied_phrases(clips):
    return clips.select("id", T.pick_phrase(["quiet", "calm and quiet", "hushed"], 5, "id").alias("phrase"))


_FEATS = "qty * 150 AS sc, disc AS zcr, tax AS rms, disc / 2 + tax AS onset, qty * 100 AS bandwidth"


@register(f"""WITH f AS (SELECT DISTINCT uid, {_FEATS} FROM resp), h AS (SELECT uid, unnest(list_filter([
CASE WHEN sc > 3000 AND sc < 8000 AND zcr > 0.1 AND onset > 0.05 THEN {{'n': -0.85, 'i': 0, 'm': 'birds singing', 'a': 'natural soundscape with birdsong'}} END,
CASE WHEN sc < 2000 AND zcr < 0.05 AND rms > 0.01 THEN {{'n': -0.8, 'i': 1, 'm': 'flowing water', 'a': 'waterside environment with flowing water'}} END,
CASE WHEN sc > 500 AND sc < 4000 AND rms > 0.02 AND bandwidth > 2000 THEN {{'n': -0.8, 'i': 2, 'm': 'traffic noise', 'a': 'urban area with traffic noise'}} END,
CASE WHEN sc < 1000 AND zcr < 0.03 AND rms < 0.01 THEN {{'n': -0.75, 'i': 3, 'm': 'wind', 'a': 'outdoor environment with wind'}} END,
CASE WHEN rms > 0.03 AND onset > 0.1 AND bandwidth > 3000 THEN {{'n': -0.8, 'i': 4, 'm': 'construction machinery', 'a': 'construction site with heavy machinery'}} END,
CASE WHEN zcr > 0.08 AND zcr < 0.15 AND sc > 1500 AND sc < 4000 THEN {{'n': -0.75, 'i': 5, 'm': 'human voices', 'a': 'public space with human voices and activity'}} END,
CASE WHEN sc > 1000 AND sc < 5000 AND onset > 0.05 AND onset < 0.2 THEN {{'n': -0.7, 'i': 6, 'm': 'musical sounds', 'a': 'environment with musical sounds'}} END], 
    lambda x: x IS NOT NULL)) AS s FROM f),
r AS (SELECT uid, s.m AS m, s.a AS a, s.n AS n, s.i AS i, row_number() OVER (PARTITION BY uid ORDER BY s.n, s.i) AS r FROM h),
g AS (SELECT uid, count(*) AS c, string_agg(['birdsong', 'water', 'traffic', 'wind', 'construction', 'speech', 'music'][i + 1], ', ' ORDER BY r) AS names, min(a) FILTER (WHERE r = 1) AS alone, string_agg(m, ' and ' ORDER BY r) FILTER (WHERE r <= 3) AS many, -avg(n) AS conf FROM r GROUP BY uid)
SELECT f.uid, CASE WHEN c IS NULL THEN 'environment with ambient sounds' WHEN c = 1 THEN alone ELSE 'soundscape with ' || many END AS caption, coalesce(names, CASE 
    WHEN sc < 2000 THEN 'low_frequency_ambience' WHEN sc < 4000 THEN 'midrange_sounds' ELSE 'high_frequency_ambience' END) AS concepts, round(coalesce(conf, 
    0.6), 6) + 0.0 AS confidence FROM (SELECT DISTINCT uid, sc FROM f) f LEFT JOIN g ON g.uid = f.uid""", "resp")
def p30_rule_captions(resp):
    f = resp.dropDuplicates(["uid"]).selectExpr("uid", *_FEATS.split(", ")).withColumn("h", T.rule_labels())
    return r6(f.select("uid", T.rule_caption(F.col("h")).alias("caption"), T.rule_concepts(F.col("h")).alias("concepts"), T.rule_confidence(F.col("h")).alias("confidence")))


@register("SELECT uid, CASE WHEN disc >= tax AND disc >= qty / 500 THEN 'disc' WHEN tax >= qty / 500 THEN 'tax' ELSE 'q' END AS best, "
          + q6("20 * log10((148693636.0 * (qty * 100) ** 4) / (((qty * 100) ** 2 + 424.36) * sqrt(((qty * 100) ** 2 + 11599.29) * ((qty * 100) ** 2 + 544496.41)) * ((qty * 100) ** 2 + 148693636.0))) + 2.0 AS a_db", "0.00002 * 10 ** (la50 / 20) / qty AS factor", "10 * log10(price) AS db")
          + " FROM resp", "resp")
def p31_p32_p33_numeric(resp):
    rows = resp.withColumn("q", F.col("qty") / 500)
    return r6(rows.select("uid", S.argmax_label(["disc", "tax", "q"]).alias("best"), S.a_weight_db(F.col("qty") * 100).alias("a_db"),
        S.spl_factor("qty", "la50").alias("factor"), S.db("price").alias("db")))


@register("""WITH b AS (SELECT base, avg(la50) AS base_leq FROM resp GROUP BY base), m AS (SELECT masker_type AS masker, avg(disc) AS g FROM resp GROUP BY 1), 
    l AS (SELECT masker, unnest(range(46, 85)) AS at, g FROM m),
w AS (SELECT uid, masker_type AS masker, base_leq - smr AS want FROM resp JOIN b USING (base))
SELECT uid, l.at, round(g + l.at, 6) + 0.0 AS gain, round(want - (l.at + 0.25), 6) + 0.0 AS residual_db FROM w JOIN l ON l.masker = w.masker AND l.at = CAST(round_even(want, 0) AS BIGINT)""", "resp")
def p34_mix_plan(resp):
    levels = list(range(46, 85))
    g = F.col("g")
    maskers = resp.groupBy(F.col("masker_type").alias("masker")).agg(F.avg("disc").alias("g")).select("masker",
        *((g + r).alias(f"gain_{r}dB") for r in levels), *(F.lit(r + 0.25).alias(f"leq_{r}dB") for r in levels))
    bases = resp.groupBy("base").agg(F.avg("la50").alias("base_leq"))
    plan = P.mix_plan(resp.select("uid", "base", F.col("masker_type").alias("masker"), "smr"), bases, maskers, levels)
    return r6(plan.select("uid", "at", "gain", "residual_db"))


@register("SELECT id, CASE WHEN max(price) OVER () > 1.5 THEN (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) ELSE price END AS x FROM clips", "clips")
def p35_min_max(clips):
    return S.min_max(clips, "price").select("id", F.col("price").alias("x"))


@register("""SELECT id, CASE WHEN id % 4 = 0 THEN '/b/x' || cust || '.wav' WHEN id % 4 = 1 THEN '/a/clip' || id || '.wav' END AS path, id % 4 < 2 AS found FROM clips""", "clips")
def p36_resolve_paths(clips):
    index = clips.where("id % 4 = 1").select(F.concat(F.lit("clip"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("/a/"), "file").alias("path"))
    index = index.unionByName(clips.where("id % 4 = 0").select(F.concat(F.lit("x"), F.col("cust").cast("string"), F.lit("."),
        F.col("id").cast("string")).alias("key"), F.concat(F.lit("/b/x"), F.col("cust").cast("string"), F.lit(".wav")).alias("path")))
    a, b = F.regexp_replace("file", r"\.wav$", ""), F.concat(F.lit("x"), F.col("cust").cast("string"), F.lit("."), F.col("id").cast("string"))
    return P.resolve_path(clips, [a, b], index).select("id", "path", "found")


# ---- sources, sinks, set operations


@register("""SELECT base, count(*) AS n, count(*) FILTER (WHERE pl IS NULL) AS rejected FROM resp GROUP BY base""", "resp")
def s3_loose_scan(resp):
    raw = resp.select("base", F.coalesce(F.col("pl").cast("string"), F.lit("n/a")).alias("pl"), F.col("la50").cast("string").alias("la50"))
    good, bad = IO.loose(raw, {"pl": "int", "la50": "double"})
    g, b = good.groupBy("base").agg(F.count(F.lit(1)).alias("ok")), bad.groupBy("base").agg(F.count(F.lit(1)).alias("rejected"))
    j = g.join(b, "base", "full").na.fill(0)
    return j.select("base", (F.col("ok") + F.col("rejected")).alias("n"), "rejected")


@register("SELECT 'clip' || cust AS key, arg_min(p, length(p) || p) AS path FROM (SELECT cust, '/d' || id || '/clip' || cust || '.' || (CASE "
    "WHEN id % 2 = 0 THEN 'hdf.wav' ELSE 'wav' END) AS p, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS long FROM clips WHERE id % 5 != 0) WHERE NOT (long = 1 "
    "AND cust IN (SELECT cust FROM clips WHERE id % 5 != 0 AND id % 2 = 1)) AND p = (SELECT min(p2) FROM (SELECT cust AS c2, "
    "'/d' || id || '/clip' || cust || '.' || (CASE WHEN id % 2 = 0 THEN 'hdf.wav' ELSE 'wav' END) AS p2, id % 2 AS odd FROM clips WHERE id % 5 != 0) WHERE c2 = cust "
    "AND odd = (CASE WHEN long = 1 THEN 0 ELSE 1 END)) GROUP BY 1", "clips")
def s4_file_index(clips):
    ext = F.when(F.col("id") % 2 == 0, "hdf.wav").otherwise("wav")
    name = F.concat(F.lit("clip"), F.col("cust").cast("string"), F.lit("."), ext)
    path = F.when(F.col("id") % 5 != 0, F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/"), name)).when(F.col("id") % 2 == 0,
        F.concat(F.lit("/__MACOSX/"), name)).otherwise(F.concat(F.lit("/x/._"), name))
    return IO.index_files(clips.select(path.alias("path")))


@register("SELECT masker, count(*) AS n, count(price) AS known, round(sum(price), 2) + 0.0 AS total FROM (SELECT masker, CASE WHEN id % 7 = 0 THEN NULL "
    "ELSE price END AS price FROM clips) GROUP BY masker", "clips")
def s1_csv_scan(clips):
    """The clips as CSV with NaN where id % 7 = 0, read back with a declared schema."""
    out = fresh_path(clips.sparkSession, "s1")
    clips.select("id", "masker", F.when(F.col("id") % 7 == 0, "nan").otherwise(F.col("price").cast("string")).alias("price")).write.csv(out, header=True)
    back = IO.read_table(clips.sparkSession, out, "id long, masker string, price double")
    return back.groupBy("masker").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("known"), (F.round(F.sum("price"), 2) + 0.0).alias("total"))


@register("SELECT CASE WHEN id % 2 = 0 THEN 'dev' ELSE 'eval' END AS split, side, count(*) AS n, sum(dur)::BIGINT AS seconds FROM clips GROUP BY ALL", "clips")
def s2_multi_split_scan(clips):
    out = fresh_path(clips.sparkSession, "s2")
    for k, name in enumerate(("dev", "eval")):
        part = clips.where(F.col("id") % 2 == k)
        part.select(F.col("file").alias("file_name"), F.concat("prio", F.lit(" café")).alias("caption")).write.csv(f"{out}/captions_{name}.csv", header=True)
        part.select(F.col("file").alias("file_name"), "side", "dur").write.csv(f"{out}/metadata_{name}.csv", header=True, encoding="ISO-8859-1")
    both = IO.read_splits(clips.sparkSession, out, ["dev", "eval"], "file_name string, caption string", "file_name string, side string, dur long")
    return both.where("caption LIKE '% café'").groupBy("split", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("seconds"))


_LINES = "WITH l AS (SELECT trim(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), ' ') AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS no FROM docs), k AS (SELECT *, string_split(line, '|') AS f FROM l WHERE line != '' AND line NOT LIKE '#%')"


@register(_LINES + " SELECT CAST(no AS INT) AS line_no, CASE WHEN len(f) = 3 THEN trim(f[1], ' ') ELSE 'prompt' || substr(lpad(CAST(no AS VARCHAR), greatest(2, "
    "length(CAST(no AS VARCHAR)))::INT, '0'), 1) END AS id, CASE WHEN len(f) = 3 THEN trim(f[2], ' ') END AS grp, CASE WHEN len(f) = 3 THEN trim(f[3], ' ') "
    "ELSE line END AS item FROM k", "docs")
def s5_line_lists(docs):
    """Every line of every document as a commented list's line."""
    return IO.parse_lines(docs, "text")


@register("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS line_no, n_name AS a, CAST(n_regionkey AS VARCHAR) AS b FROM nation", "nation")
def s6_zip_lines(nation):
    """Two text files of a line a nation, written and joined by line number."""
    out, spark = fresh_path(nation.sparkSession, "s6"), nation.sparkSession
    for name, col in (("a", F.col("n_name")), ("b", F.col("n_regionkey").cast("string"))):
        IO.write_playlist(nation, f"{out}/{name}", col, ["n_nationkey"])
    return IO.zip_lines({n: spark.read.text(f"{out}/{n}", wholetext=True) for n in "ab"})


@register("SELECT n_nationkey::INT AS id, n_name AS name, n_regionkey::INT AS region FROM nation", "nation")
def s7_json_records(nation):
    """A JSON file a nation, read as one table; none is corrupt."""
    out = fresh_path(nation.sparkSession, "s7")
    nation.select("n_nationkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.partitionBy("n_nationkey").json(out)
    back = IO.read_json_dir(nation.sparkSession, out, "id int, name string, region int")
    return back.where("_corrupt_record IS NULL AND path LIKE '%.json'").select("id", "name", "region")


@register("SELECT bin, 'clip' || id AS stem, '/r/' || bin || '/' || file AS file, prio AS caption FROM clips WHERE id % 3 != 0 AND bin IS NOT NULL", "clips")
def s9_sidecars(clips):
    at = lambda name: F.concat(F.lit("/r/"), "bin", F.lit("/"), name)
    texts = clips.where("id % 3 != 0").select(at(F.regexp_replace("file", "wav$", "txt")).alias("path"), F.concat(F.lit("  "), "prio", F.lit(" ")).alias("value"))
    return IO.pair_sidecars(clips.select(at(F.col("file")).alias("path")), texts)


@register("SELECT masker, count(*) AS n, (row_number() OVER (ORDER BY masker))::INT AS idx FROM clips GROUP BY masker", "clips")
def s10_s11_reports(clips):
    """A small table as a headed CSV file and as a numbered TSV sheet; both are read back and agree."""
    small, spark, out = clips.groupBy("masker").agg(F.count(F.lit(1)).alias("n")), clips.sparkSession, fresh_path(clips.sparkSession, "s10")
    IO.write_report(small, f"{out}/csv", ["masker"])
    IO.write_report(small, f"{out}/tsv", ["masker"], "\t", "idx")
    csv, tsv = IO.read_table(spark, f"{out}/csv", "masker string, n long"), IO.read_table(spark, f"{out}/tsv", "masker string, n long, idx int", sep="\t")
    return csv.join(tsv, ["masker", "n"])


@register("SELECT bin, count(*) AS n, count(*) FILTER (WHERE dur > 30) AS long, 42 AS seed FROM clips GROUP BY bin", "clips")
def s12_manifest_bundle(clips):
    """The manifest, a side table and the configuration, written once and read back."""
    spark, out = clips.sparkSession, fresh_path(clips.sparkSession, "s12")
    IO.write_manifest(clips.select("file", "bin"), out, {"chunk_info": clips.where("dur > 30").select("file", "dur")}, {"seed": 42})
    rows = spark.read.parquet(f"{out}/metadata").join(spark.read.parquet(f"{out}/chunk_info"), "file", "left")
    seed = spark.read.text(f"{out}/config").select(F.from_json("value", "seed int").alias("c")).select("c.seed")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count("dur").alias("long")).crossJoin(seed)


@register("SELECT side, count(*) FILTER (WHERE dur % 5 != 0) AS ok, count(*) FILTER (WHERE dur % 5 = 0) AS failed, min(CASE "
    "WHEN dur % 5 = 0 THEN 'bad length ' || dur END) AS first_error FROM clips GROUP BY side", "clips")
def s16_error_output(clips):
    bad = F.col("dur") % 5 == 0
    rows = clips.select("side", F.when(~bad, F.col("score")).alias("result"), F.when(bad, F.concat(F.lit("bad length "), F.col("dur").cast("string"))).alias("error"))
    good, failed = IO.split_errors(rows)
    g = good.groupBy("side").agg(F.count(F.lit(1)).alias("ok"))
    return g.join(failed.groupBy("side").agg(F.count(F.lit(1)).alias("failed"), F.min("error").alias("first_error")), "side", "full").na.fill(0)


@register("SELECT (row_number() OVER (ORDER BY base) - 1)::INT AS line_no, base || ',' || n AS value FROM (SELECT base, count(*) AS n FROM clips GROUP BY base)", "clips")
def s17_playlist(clips):
    """An ordered text file, read back with its line numbers."""
    out = fresh_path(clips.sparkSession, "s17")
    IO.write_playlist(clips.groupBy("base").agg(F.count(F.lit(1)).alias("n")), out, F.concat_ws(",", F.col("base").cast("string"), F.col("n").cast("string")), ["base"])
    return IO.zip_lines({"value": clips.sparkSession.read.text(out, wholetext=True)})


@register("""WITH n AS (SELECT id, score * 2 AS score FROM clips WHERE id % 2 = 0) SELECT clips.id, file, n.score FROM clips LEFT JOIN n ON n.id = clips.id""", "clips")
def s13_refresh_columns(clips):
    new = clips.where("id % 2 = 0").select("id", (F.col("score") * 2).alias("score"))
    return IO.refresh_columns(clips.select("id", "file", "score"), new, ["id"], ["score"])


@register("SELECT cust, id, price AS v FROM clips QUALIFY row_number() OVER (PARTITION BY cust ORDER BY price DESC, id % 2, id DESC) = 1", "clips")
def s14_upsert(clips):
    """Rows of odd ids, then those of even ids, many of one key; the largest version wins."""
    rows = clips.select("cust", "id", F.col("price").alias("v"))
    return IO.upsert(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), ["cust"], "v")


@register("SELECT cust, id, price AS v FROM clips WHERE id % 3 != 2 QUALIFY row_number() OVER (PARTITION BY cust ORDER BY price DESC, id % 3 DESC, id DESC) = 1", "clips")
def s14_snapshot_log(clips):
    """Two commits and one of them again; the manifest as a reader finds it."""
    spark = clips.sparkSession
    log = SnapshotLog(spark, fresh_path(spark, "log"), ["cust"], "v")
    for k in (0, 1, 0):
        log.commit(clips.where(f"id % 3 = {k}").select("cust", "id", F.col("price").alias("v")), f"part {k}")
    return log.read()


@register("""SELECT id, id % 3 = 0 OR id % 5 = 0 AS need_a, id % 3 = 0 OR id % 7 = 0 AS need_b FROM clips WHERE id % 3 = 0 OR id % 5 = 0 OR id % 7 = 0""", "clips")
def s15_s16_pending_groups(clips):
    done = clips.where("id % 3 != 0").select("id", F.when(F.col("id") % 5 != 0, F.col("score")).alias("a"), F.when(F.col("id") % 7 != 0, F.col("price")).alias("b"))
    return IO.pending(clips, done, ["id"], {"a": ["a"], "b": ["b"]})


@register("SELECT base FROM resp WHERE la50 > 60 INTERSECT SELECT base FROM resp WHERE disc > 0.05 EXCEPT SELECT base FROM resp WHERE qty = 50 AND disc = 0.01", "resp")
def u2_u3_u4_sets(resp):
    b = lambda c: resp.where(c).select("base")
    return b("la50 > 60").intersect(b("disc > 0.05")).subtract(b("qty = 50 AND disc = 0.01"))


# ---- filters


@register(f"SELECT uid, base FROM resp WHERE {VALID_SQL}", "resp")
def f1_valid_responses(resp):
    return X.valid_responses(resp, ITEMS).select("uid", "base")


@register("SELECT base, n_ratings FROM (SELECT base, count(*) AS n_ratings, avg(pl) AS score, max(CASE WHEN qty > 40 THEN masker END) AS path FROM resp GROUP BY base) "
    "WHERE n_ratings >= 3 AND score IS NOT NULL AND path IS NOT NULL", "resp")
def f2_rated_usable(resp):
    recs = R.rollup(resp.withColumn("path", F.when(F.col("qty") > 40, F.col("masker"))), ["base"],
        ["pl"]).join(resp.where("qty > 40").groupBy("base").agg(F.max("masker").alias("path")), "base", "left")
    return X.rated_usable(recs, "n_ratings", 3, "pl", "path").select("base", "n_ratings")


@register("SELECT id FROM clips WHERE NOT (masker = 'traffic' AND side = 'F') AND masker != 'wind'", "clips")
def f3_f4_exclude_rules(clips):
    rules = clips.where("masker IN ('traffic', 'wind')").select("masker", F.when(F.col("masker") == "traffic", "F").alias("side")).distinct()
    return X.screen(clips, rules).select("id")


@register("""WITH s AS (SELECT base, quantile_cont(price, 0.5) AS med FROM clips GROUP BY base) SELECT clips.id FROM clips JOIN s ON s.base = clips.base 
    WHERE med <= 250000 AND price <= 400000""", "clips")
def f5_score_screens(clips):
    ok = R.group_screen(clips, "base", ["price"]).where("price_median <= 250000").select("base")
    return clips.where("price <= 400000").join(ok, "base", "left_semi").select("id")


@register("""WITH s AS (SELECT k, base, unnest([v, v / 2]) AS v FROM (SELECT id AS k, base, (price % 1000) / 1000 AS v FROM clips WHERE side != 'P')), f AS (SELECT k, max(v) AS most FROM s GROUP BY k), 
b AS (SELECT base, quantile_cont(v, 0.5) AS med FROM s GROUP BY base) SELECT id, CASE WHEN most IS NULL THEN 'unscored' WHEN most > 0.9 OR med > 0.35 THEN 'removed' ELSE 'kept' END AS verdict 
FROM clips LEFT JOIN f ON f.k = id LEFT JOIN b ON b.base = clips.base""", "clips")
def f5_score_verdicts(clips):
    v = (F.col("price") % 1000) / 1000
    scores = clips.where("side != 'P'").select("id", "base", F.explode(F.array(v, v / 2)).alias("v"))
    return X.score_screen(clips, scores, "id", "base", "v", 0.9, 0.35).select("id", "verdict")


@register("""SELECT * FROM (VALUES (0, 'rated'), (1, 'loud enough'), (2, 'foreground')) v(step_no, step) JOIN (SELECT 0 AS step_no, count(*) AS n, 
    sum(dur)::BIGINT AS seconds FROM clips WHERE score > -0.8 UNION ALL SELECT 1, count(*), sum(dur)::BIGINT FROM clips WHERE score > -0.8 AND dur > 10 UNION ALL 
    SELECT 2, count(*), sum(dur)::BIGINT FROM clips WHERE score > -0.8 AND dur > 10 AND side = 'F') x USING (step_no)""", "clips")
def f6_funnel(clips):
    return X.funnel(clips, {"rated": F.col("score") > -0.8, "loud enough": F.col("dur") > 10, "foreground": F.col("side") == "F"}, {"seconds": F.col("dur")})


@register("SELECT doc_id FROM (SELECT *, CASE WHEN lower(text) LIKE '%tion%' THEN 1 ELSE 0 END + CASE WHEN lang LIKE '%en%' THEN 1 ELSE 0 END AS n FROM docs) "
    "WHERE n >= 2 OR (source = 'src3' AND n >= 1)", "docs")
def f7_f10_selection_rule(docs):
    n = X.any_substring(["text"], ["TION", "no such text"]).cast("int") + X.any_substring(["lang"], ["en"]).cast("int")
    return docs.where(X.selection_rule(n, F.col("source") == "src3", 2)).select("doc_id")


@register("SELECT id FROM clips WHERE price <= (SELECT quantile_cont(price, 0.75) FROM clips) AND dur <= (SELECT quantile_cont(dur::DOUBLE, 0.75) FROM clips)", "clips")
def f8_percentile_cut(clips):
    return X.percentile_cut(clips, ["price", "dur"], 0.75).select("id")


@register("SELECT event_id FROM grid WHERE abs(p - 0.5) < 0.01 OR abs(p + 1) < 0.01", "grid")
def f9_levels(grid):
    return grid.where(X.near_level("p", [0.5, -1.0], 0.01)).select("event_id")


@register("SELECT id FROM clips WHERE lower(file) LIKE '%99%' OR lower(bin) LIKE '%99%' OR lower(masker) LIKE '%99%' OR lower(side) LIKE '%99%' OR lower(prio) LIKE '%99%'", "clips")
def f11_any_column(clips):
    return clips.where(X.any_column_contains(clips, "99")).select("id")


@register("""WITH b AS (SELECT CASE WHEN dur < 5 THEN 'short' END AS a, CASE WHEN score < -0.9 THEN 'low' END AS b, CASE WHEN file LIKE '%7.wav' THEN 'seven' END AS c 
    FROM clips), u AS (SELECT unnest([a, b, c]) AS rule FROM b) SELECT rule, count(*) AS n FROM u WHERE rule IS NOT NULL GROUP BY rule""", "clips")
def f12_f13_quality_counts(clips):
    return X.quarantine(clips, {"short": F.col("dur") < 5, "low": F.col("score") < -0.9, "seven": F.col("file").endswith("7.wav")})[2]


_PATH = """CASE cust % 7 WHEN 0 THEN '  ' WHEN 1 THEN concat(file, '|', file) WHEN 2 THEN concat('a', chr(9), file) WHEN 3 THEN concat(file, '.wav') WHEN 4 THEN 
    replace(file, '.wav', '.mp3') WHEN 5 THEN concat(file, chr(10)) ELSE file END"""


@register(f"""WITH p AS (SELECT id, regexp_replace({_PATH}, '^\\s+|\\s+$', '', 'g') AS p FROM clips), n AS (SELECT id, p, (length(p) - length(replace(p, '.wav', ''))) / 4 AS wav, 
    (length(p) - length(replace(p, '.mp3', ''))) / 4 AS mp3 FROM p)
SELECT id, concat_ws(', ', CASE WHEN p = '' THEN 'empty_path' END, CASE WHEN contains(p, '|') THEN 'pipe_in_path' END, CASE WHEN wav > 1 OR mp3 > 1 THEN 'multiple_extensions' END, 
    CASE WHEN NOT contains(p, '|') AND wav = 1 AND mp3 <= 1 AND regexp_matches(p, '[\\n\\r\\t]') THEN 'suspicious_name' END) AS rules FROM n""", "clips")
def f12_path_rules(clips):
    hits = X.rule_hits(clips.select("id", F.expr(_PATH).alias("path")), X.path_rules("path"))
    return hits.select("id", F.array_join("rules", ", ").alias("rules"))


_FAULTY = "id, (dur % 13)::DOUBLE AS seconds, CASE WHEN cust % 11 = 0 THEN 'unreadable' END AS error"


@register(f"""WITH f AS (SELECT {_FAULTY} FROM clips) SELECT id, seconds, CASE WHEN error IS NOT NULL THEN 'load_error' WHEN seconds = 0 THEN 'zero_duration' 
    WHEN abs(seconds - 10) > 1 THEN 'wrong_duration' ELSE 'kept' END AS verdict FROM f""", "clips")
def f13_duration_quarantine(clips):
    """Kept rows beside those in quarantine, with the rule that put them there."""
    rows = clips.select("id", (F.col("dur") % 13).cast("double").alias("seconds"), F.when(F.col("cust") % 11 == 0, "unreadable").alias("error"))
    kept, gone, _ = X.quarantine(rows, X.duration_rules("seconds", "error"))
    return kept.select("id", "seconds", F.lit("kept").alias("verdict")).unionByName(gone.select("id", "seconds", F.array_join("rules", ", ").alias("verdict")))


_MEASURES = [
    "id", "CASE WHEN cust % 31 = 0 THEN NULL ELSE 900 + (id % 997) * 40 END AS bytes", "CASE WHEN id % 29 = 0 THEN 'unreadable' END AS error", "(dur % 13) * 44100 AS samples",
    "1 + id % 3 AS channels", "CASE WHEN id % 17 = 0 THEN 48000 ELSE 44100 END AS rate", "(price % 1000) / 50000 AS rms", "(price % 777) / 776 AS peak", "id % 23 = 0 AS has_nan", "id % 41 = 0 AS has_inf",
]
_FAULTS = """f AS (SELECT id, CASE WHEN bytes IS NULL THEN ['Other'] WHEN bytes < 1000 THEN ['Other'] WHEN error IS NOT NULL THEN ['Cannot load file'] WHEN samples = 0 THEN ['Empty audio'] ELSE list_filter([
    CASE WHEN rate != 44100 THEN 'Wrong sample rate' END, CASE WHEN samples / rate < 9 OR samples / rate > 11 THEN 'Wrong duration' END, CASE WHEN rms < 0.001 THEN 'Silent/low volume' END,
    CASE WHEN peak > 0.99 THEN 'Clipping' END, CASE WHEN 20 * log10(rms + 1e-10) < -40 THEN 'Low loudness' END, CASE WHEN has_nan THEN 'Other' END, CASE WHEN has_inf THEN 'Other' END,
    CASE WHEN channels NOT IN (1, 2) THEN 'Other' END], lambda x: x IS NOT NULL) END AS faults FROM m)"""


@register(f"WITH m AS (SELECT {', '.join(_MEASURES)} FROM clips), {_FAULTS}, u AS (SELECT id, unnest(faults) AS category FROM f) SELECT category, count(*) AS faults, count(DISTINCT id) AS rows FROM u GROUP BY category", "clips")
def f13_audio_faults(clips):
    return X.category_counts(X.rule_hits(clips.selectExpr(*_MEASURES), X.audio_rules()))


@register("""WITH r AS (SELECT id, masker, row_number() OVER (PARTITION BY masker ORDER BY price, id) - 1 AS i, count(*) OVER (PARTITION BY masker) AS n 
    FROM clips), k AS (SELECT unnest(range(0, 20)) AS k)
SELECT DISTINCT r.id, r.masker FROM r LEFT JOIN k ON TRUE WHERE n <= 20 OR i = CAST(floor(k.k * (n - 1) / 19) AS BIGINT)""", "clips")
def f14_thinning(clips):
    return X.thin(clips, ["masker"], 20, ["price", "id"]).select("id", "masker")


# ---- joins


@register("""WITH s AS (SELECT DISTINCT base FROM clips WHERE dur > 55) SELECT clips.id, s.base IS NOT NULL AS has_long, coalesce(c.nation, -1) AS nation FROM clips LEFT 
    JOIN s ON s.base = clips.base LEFT JOIN (SELECT id AS cid, nation FROM cust WHERE id % 3 != 0) c ON c.cid = clips.cust""", "clips cust")
def j1_j5_lookup_joins(clips, cust):
    j = X.lookup_default(clips, cust.where("id % 3 != 0").select(F.col("id").alias("cust"), "nation"), ["cust"], {"nation": -1})
    return X.flag_in(j, clips.where("dur > 55"), ["base"], "has_long").select("id", "has_long", "nation")


@register("SELECT item, seed, " + q6("avg(value) FILTER (WHERE p = -1) AS lo", "avg(value) FILTER (WHERE p = 1) AS hi",
    "avg(value) FILTER (WHERE p = 1) - avg(value) FILTER (WHERE p = -1) AS delta") + " FROM grid "
    "GROUP BY item, seed HAVING count(*) FILTER (WHERE p = -1) > 0 AND count(*) FILTER (WHERE p = 1) > 0", "grid")
def j6_paired_delta(grid):
    return r6(X.paired_delta(grid, ["item", "seed"], "p", -1.0, 1.0, "value"))


@register("""WITH e AS (SELECT item, seed, avg(value) FILTER (WHERE p = 1) - avg(value) FILTER (WHERE p = -1) AS d, user_id % 2 AS half FROM grid GROUP BY item, seed, 
    user_id % 2) SELECT a.item, a.seed, """ + q6("a.d AS d0", "b.d AS d1") + " FROM e a "
    "JOIN e b ON a.item = b.item AND a.seed // 2 = b.seed // 2 AND a.half = 0 AND b.half = 1 WHERE a.d IS NOT NULL AND b.d IS NOT NULL", "grid")
def j7_j8_shared_effects(grid):
    side = lambda h, n: X.paired_delta(grid.where(F.col("user_id") % 2 == h), ["item", "seed"], "p", -1.0, 1.0, "value").select("item",
        F.floor(F.col("seed") / 2).alias("half"), F.col("seed").alias(f"seed{h}"), F.col("delta").alias(n))
    return r6(side(0, "d0").join(side(1, "d1"), ["item", "half"]).select("item", F.col("seed0").alias("seed"), "d0", "d1"))


@register("""WITH r AS (SELECT id, masker, score, row_number() OVER (PARTITION BY masker ORDER BY score, id) AS r, count(*) OVER (PARTITION BY masker) AS n FROM clips) 
    SELECT a.id, a.score, b.score AS mirror FROM r a JOIN r b ON a.masker = b.masker AND a.n + 1 - a.r = b.r""", "clips")
def j9_rank_mirror(clips):
    return X.rank_mirror(clips.select("id", "masker", "score"), ["masker"], "score", ["id"]).select("id", "score", "mirror")


@register("SELECT item, seed, p FROM grid GROUP BY item, seed, p HAVING count(DISTINCT lev) = 3", "grid")
def j10_complete_candidates(grid):
    return X.complete_candidates(grid, ["item", "seed", "p"], "lev", 3).select("item", "seed", "p")


@register("""WITH i AS (SELECT DISTINCT id FROM cust), c AS (SELECT 'cust' AS key, count(DISTINCT cust) AS found FROM clips WHERE cust IN (SELECT id FROM i) UNION ALL 
    SELECT 'base', count(DISTINCT base) FROM clips WHERE base IN (SELECT id FROM i)) SELECT key, found, found / (SELECT count(*) FROM i) AS share, 
    found / (SELECT count(*) FROM i) >= 0.95 AS enough FROM c ORDER BY found DESC, key DESC LIMIT 1""", "clips cust")
def j15_key_discovery(clips, cust):
    return X.best_key_match(clips, {"cust": F.col("cust"), "base": F.col("base")}, cust, "id", 0.95)


@register("SELECT cust, arg_max(id, (price, id)) AS id FROM clips GROUP BY cust", "clips")
def j16_first_match(clips):
    return X.dedupe(clips, ["cust"], [F.desc("price"), F.desc("id")]).select("cust", "id")


# ---- rollups


@register(f"WITH {STIM_SQL} SELECT stimulus_id, base, masker_type, n_ratings, {q6('score AS score', 'la50 AS la50')} FROM stim", "resp")
def a1_stimulus_rollup(resp):
    return r6(stimuli(resp))


@register("""WITH n AS (SELECT nation, avg(score) AS score, count(*) AS n FROM cust GROUP BY nation) SELECT n_regionkey AS region, count(*) AS locations, 
    sum(n)::BIGINT AS ratings, round(avg(score), 6) + 0.0 AS score FROM n JOIN nation ON n_nationkey = n.nation GROUP BY 1""", "cust nation")
def a2_two_level_rollup(cust, nation):
    loc = R.rollup(cust, ["nation"], ["score"]).join(nation, F.col("nation") == F.col("n_nationkey"))
    return r6(loc.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("locations"), F.sum("n_ratings").alias("ratings"), F.avg("score").alias("score")))


@register("SELECT masker, " + ", ".join(f"count(*) FILTER (WHERE bin = '{b}') AS {b}" for b in S.BINS) + " FROM clips GROUP BY masker", "clips")
def a4_crosstab(clips):
    return R.crosstab(clips, "masker", "bin", S.BINS)


@register("""WITH c AS (SELECT source, lang, count(*) AS n FROM docs GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, row_number() 
    OVER (PARTITION BY source ORDER BY n DESC, lang) AS place FROM c) SELECT source, lang, n, round(share, 6) + 0.0 AS share, place::INT AS place FROM r 
    WHERE place <= 3""", "docs")
def a5_top_shares(docs):
    return r6(R.top_share(docs, ["source"], "lang", 3))


_TOP = "WITH c AS (SELECT masker, prio, count(*) AS n FROM clips GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY masker) AS share, row_number() OVER (PARTITION BY masker ORDER BY n DESC, prio) AS place FROM c) "


@register(_TOP + "SELECT masker, string_agg(prio || ' (' || n || ')', ', ' ORDER BY place) AS counts, string_agg(prio || ' ' || printf('%.0f', 100 * share) || '%', ', ' ORDER BY place) AS shares "
    "FROM r WHERE place <= 3 GROUP BY masker", "clips")
def a5_top_texts(clips):
    return R.top_text(clips, ["masker"], "prio", 3, name="counts").join(R.top_text(clips, ["masker"], "prio", 3, share=True, name="shares"), "masker")


@register("SELECT base, count(DISTINCT participant) AS people, count(DISTINCT masker) AS maskers FROM resp GROUP BY base", "resp")
def a6_distinct_counts(resp):
    return resp.groupBy("base").agg(F.count_distinct("participant").alias("people"), F.count_distinct("masker").alias("maskers"))


@register("WITH l AS (SELECT masker_type, unnest([struct_pack(m := 'qty', v := qty::DOUBLE), struct_pack(m := 'price', v := price), struct_pack(m := 'la50', "
    "v := la50)]) AS s FROM resp) SELECT masker_type, s.m AS metric, count(s.v) AS n, " + q6("avg(s.v) AS mean", "stddev_samp(s.v) AS sd",
        "min(s.v) AS lo", "max(s.v) AS hi", "quantile_cont(s.v, 0.25) AS q25", "quantile_cont(s.v, 0.5) AS q50", "quantile_cont(s.v, 0.9) AS q90") + " FROM l GROUP BY ALL", "resp")
def a3_a7_a12_describe(resp):
    return r6(R.describe_by(resp, ["masker_type"], ["qty", "price", "la50"], [0.25, 0.5, 0.9]))


_EFF = """WITH it AS (SELECT seed % 2 AS g, count(DISTINCT item) AS n FROM grid GROUP BY 1), all_ AS (SELECT x.g, x.p FROM (SELECT seed % 2 AS g, p, 
    count(DISTINCT item) AS c FROM grid GROUP BY 1, 2) x JOIN it ON it.g = x.g WHERE x.c = it.n), sh AS (SELECT * FROM all_ WHERE g IN (SELECT g FROM all_ GROUP BY g 
    HAVING count(*) > 1)),
r AS (SELECT grid.*, seed % 2 AS g FROM grid JOIN sh ON sh.g = seed % 2 AND sh.p = grid.p), m AS (SELECT g, item, p, avg(value) AS m FROM r GROUP BY ALL),
st AS (SELECT *, m - lag(m) OVER (PARTITION BY g, item ORDER BY p) AS step FROM m), e AS (SELECT g, item, arg_min(m, p) AS low, arg_max(m, p) AS high, arg_max(m, 
    p) - arg_min(m, p) AS effect FROM m GROUP BY ALL),
o AS (SELECT st.g, st.item, coalesce(bool_and(sign(step) = sign(effect) AND effect != 0) FILTER (WHERE step IS NOT NULL), FALSE) AS ordered FROM st 
    JOIN e ON e.g = st.g AND e.item = st.item GROUP BY ALL),
sd AS (SELECT g, avg(s) AS seed_sd FROM (SELECT seed % 2 AS g, item, p, stddev_samp(value) AS s FROM grid GROUP BY ALL) GROUP BY g), z AS (SELECT e.*, ordered, 
    seed_sd, effect / seed_sd AS ratio, abs(effect / seed_sd) >= 0.02 AS clear FROM e JOIN o ON o.g = e.g AND o.item = e.item JOIN sd ON sd.g = e.g)"""


def _effects(grid):
    rows = grid.withColumn("g", F.col("seed") % 2).withColumn("metric", F.lit("value"))
    return R.grid_effects(rows, ["g"], "item", "p", "metric", "value", 0.02)


@register(_EFF + " SELECT g, item, ordered, clear, " + q6("low AS low", "high AS high", "effect AS effect", "seed_sd AS seed_sd", "ratio AS ratio") + " FROM z", "grid")
def a8_a9_w11_grid_effects(grid):
    return r6(_effects(grid).drop("metric"))


@register(_EFF + " SELECT g, count(*) AS n, count(*) FILTER (WHERE clear) AS n_clear, count(*) FILTER (WHERE clear AND ordered) AS n_clear_ordered, "
    "count(*) FILTER (WHERE clear AND NOT ordered) AS n_clear_unordered, round(quantile_cont(abs(ratio), 0.5), 6) + 0.0 AS median_ratio FROM z GROUP BY g", "grid")
def a10_effects_summary(grid):
    return r6(R.effects_summary(_effects(grid), ["g"]))


@register("SELECT item, " + q6(*(f"avg(value) FILTER (WHERE lev = {k}) AS l{k}" for k in range(3))) + " FROM grid GROUP BY item", "grid")
def a11_pivot_means(grid):
    p = grid.groupBy("item").pivot("lev", [0, 1, 2]).agg(F.avg("value"))
    return r6(p.select("item", *(F.col(f"`{k}`").alias(f"l{k}") for k in range(3))))


@register("SELECT masker_type, " + q6("sum(pl * qty) / sum(qty) FILTER (WHERE pl IS NOT NULL) AS wmean", "avg(pl) AS mean", "sum(qty) AS weight") + " FROM resp GROUP BY 1", "resp")
def a13_weighted_mean(resp):
    return r6(R.weighted_mean(resp, ["masker_type"], "pl", "qty").withColumn("weight", F.col("weight").cast("double")))


_AGREE = "count(*) AS files, sum(base % 4)::BIGINT AS entries, " + q6("sum(score * (base % 4)) / sum(base % 4) AS train_mean", "sum((score * 0.8 + dur / 200) * (base % 4)) / sum(base % 4) AS rated_mean",
    "sum((score * 0.8 + dur / 200 - score) * (base % 4)) / sum(base % 4) AS bias", "stddev_samp(score * 0.8 + dur / 200) AS rated_sd", "avg(dur / 1000) AS within_sd") + " FROM clips"


@register(f"SELECT bin, false AS overall, {_AGREE} GROUP BY bin UNION ALL SELECT NULL, true, {_AGREE}", "clips")
def a13_rating_agreement(clips):
    rows = clips.select("bin", "score", (F.col("base") % 4).alias("listed"), (F.col("score") * 0.8 + F.col("dur") / 200).alias("rated"), (F.col("dur") / 1000).alias("within"))
    return r6(R.rating_agreement(rows, "bin", "listed", "score", "rated", "within"))


@register("WITH a AS (SELECT clip, lev, avg(value) AS m, stddev_samp(value) AS s FROM grid GROUP BY ALL), b AS (SELECT clip, avg(s) AS sd_ckpt, stddev_samp(m) AS sd_level "
    "FROM a GROUP BY clip), c AS (SELECT clip, avg(value) AS mean, stddev_samp(value) AS sd, abs(avg(value) - avg(k)) AS gap FROM grid GROUP BY clip) "
    "SELECT c.clip, " + q6("mean AS mean", "sd AS sd", "sd_ckpt AS sd_ckpt", "sd_level AS sd_level", "gap AS gap") + " FROM c JOIN b ON b.clip = c.clip", "grid")
def a16_stability(grid):
    return r6(R.prediction_stability(grid, "clip", "lev", "ckpt", "value", "k"))


@register("SELECT user_id, " + q6("avg(value) AS mean", "CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS sd", "avg(k) AS k") + " FROM grid GROUP BY user_id", "grid")
def a16_prediction_spread(grid):
    return r6(R.prediction_spread(grid, "user_id", "value", ["k"]))


@register("WITH l AS (SELECT clip, item, max(value) AS p FROM grid GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY p DESC, item) AS r FROM l) "
    "SELECT clip, max(p) FILTER (WHERE item IN ('click', 'view')) AS browse, max(p) FILTER (WHERE item = 'purchase') AS buy, string_agg(item || ' ' || printf('%.2f', p), '; ' "
    "ORDER BY r) FILTER (WHERE r <= 3) AS top3 FROM r GROUP BY clip", "grid")
def a17_label_sets(grid):
    probs = grid.groupBy("clip", "item").agg(F.max("value").alias("p"))
    return R.label_set_scores(probs, "clip", "item", "p", {"browse": ["click", "view"], "buy": ["purchase"]})


@register("SELECT base, count(*) AS n, " + q6("quantile_cont(price, 0.5) AS price_median", "quantile_cont(price, 0.9) AS price_p90",
    "quantile_cont(score, 0.5) AS score_median", "quantile_cont(score, 0.9) AS score_p90") + " FROM clips GROUP BY base", "clips")
def a18_group_screen(clips):
    return r6(R.group_screen(clips, "base", ["price", "score"]))


@register("SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE score >= t) AS n, sum(CASE WHEN score >= t THEN dur ELSE 0 END)::BIGINT AS kept FROM clips, "
    "(VALUES (-0.5), (0.0), (0.5)) v(t) GROUP BY t", "clips")
def a19_thresholds(clips):
    return R.threshold_table(clips, "score", [-0.5, 0.0, 0.5], "dur")


@register("WITH l AS (SELECT min(price) AS lo, max(price) AS hi FROM clips) SELECT greatest(1, least(10, ceil((price - lo) / ((hi - lo) / 10))))::INT AS bin, "
    "count(*) AS n FROM clips, l GROUP BY 1", "clips")
def a20_histogram(clips):
    return R.histogram(clips, "price", 10)


@register("SELECT masker, prio, count(*) AS n FROM clips JOIN cust ON cust.id = clips.cust GROUP BY ALL ORDER BY n DESC, masker, prio LIMIT 15", "clips cust")
def a21_combinations(clips, cust):
    return R.combinations(clips.join(cust.select(F.col("id").alias("cust")), "cust"), ["masker", "prio"], 15)


@register("WITH g AS (SELECT text, count(*) AS n FROM docs GROUP BY text) SELECT sum(n)::BIGINT AS total, count(*) AS distinct_texts, "
    "count(*) FILTER (WHERE n > 1) AS repeated, max(n) AS most FROM g WHERE text IS NOT NULL", "docs")
def a22_text_diversity(docs):
    return R.text_diversity(docs, "text")


@register("WITH w AS (SELECT unnest(regexp_split_to_array(lower(split_part(text, '[ISOPleasant', 1)), '[ \\t-\\r]+')) AS word FROM docs WHERE text IS NOT NULL) SELECT word, count(*) AS n, "
    "round(100 * count(*) / (SELECT count(text) FROM docs), 6) + 0.0 AS pct FROM w WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 50", "docs")
def a22_top_words(docs):
    return r6(R.top_words(docs.select(F.concat("text", T.tag("s")).alias("text")), "text", 50))


@register("SELECT text, count(*) AS n FROM docs WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, encode(text) LIMIT 10", "docs")
def a22_repeated_texts(docs):
    return R.repeated_texts(docs, "text", 10)


@register("SELECT least(9, floor((score + 1) / 0.2))::INT AS bin, count(*) AS n, round(avg(price), 6) + 0.0 AS mean_y FROM clips WHERE score >= -1 AND score < 1 AND price IS NOT NULL GROUP BY 1 HAVING count(*) >= 5", "clips")
def a23_binned_mean(clips):
    return r6(R.binned_mean(clips, "score", "price", -1.0, 1.0, 10, 5))


@register("WITH m AS (SELECT id, CASE WHEN score > 0.5 THEN 'high' WHEN score < -0.5 THEN 'low' END AS cls FROM clips) SELECT cls, metric, round(avg(v), 6) + 0.0 AS mean "
    "FROM (SELECT cls, unnest(['dur', 'price']) AS metric, unnest([dur::DOUBLE, price]) AS v FROM clips JOIN m USING (id) WHERE cls IS NOT NULL) GROUP BY ALL", "clips")
def a24_class_means(clips):
    match = clips.select("id", F.when(F.col("score") > 0.5, "high").when(F.col("score") < -0.5, "low").alias("cls")).where("cls IS NOT NULL")
    return r6(R.class_means(clips.select("id", F.col("dur").cast("double").alias("dur"), "price"), match, "id", "cls", ["dur", "price"]).drop("n"))


@register("WITH e AS (SELECT item, min(event_id) AS a, max(event_id) AS b FROM grid GROUP BY item), g AS (SELECT grid.item, "
    "avg(value) FILTER (WHERE event_id < a + 500) AS head, avg(value) FILTER (WHERE event_id > b - 500) AS tail FROM grid JOIN e ON e.item = grid.item GROUP BY 1) "
    "SELECT item, " + q6("head AS head", "tail AS tail", "(tail - head) / head AS change") + " FROM g", "grid")
def a25_head_tail(grid):
    return r6(R.head_tail_mean(grid, ["item"], "event_id", "value", 500))


@register("SELECT item, count(value) AS n, " + q6("avg(value) AS mean", "1.96 * stddev_samp(value) / sqrt(count(value)) AS half") + ", 'n=' || count(value) AS label FROM grid GROUP BY item", "grid")
def a26_mean_ci(grid):
    return r6(R.mean_ci(grid, ["item"], "value"))


@register("WITH a AS (SELECT item, p, avg(value) AS m FROM grid WHERE seed != 0 GROUP BY ALL), b AS (SELECT p, avg(value) AS c FROM grid WHERE seed = 0 GROUP BY p) "
    "SELECT item, a.p, " + q6("m AS mean", "c AS control") + " FROM a LEFT JOIN b ON b.p = a.p", "grid")
def a27_control_means(grid):
    return r6(R.control_means(grid.where("seed != 0"), grid.where("seed = 0"), ["item"], "p", "value"))


# ---- windows, quotas, selection

_FILL = """f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cap, k) AS i, count(*) OVER (PARTITION BY g) AS m, coalesce(sum(cap) OVER (PARTITION BY g 
    ORDER BY cap, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM caps),
lv AS (SELECT *, arg_min(CASE WHEN before + (m - i + 1) * cap > quota THEN floor((quota - before) / (m - i + 1)) END, CASE 
    WHEN before + (m - i + 1) * cap > quota THEN (cap, k) END) FILTER (WHERE before + (m - i + 1) * cap > quota) OVER (PARTITION BY g) AS level FROM f),
bs AS (SELECT *, CASE WHEN level IS NULL THEN cap ELSE least(cap, level) END AS b0 FROM lv), rs AS (SELECT *, least(quota, sum(cap) OVER (PARTITION BY g)) - sum(b0) 
    OVER (PARTITION BY g) AS rest, row_number() OVER (PARTITION BY g ORDER BY cap - b0 DESC, k) AS more FROM bs),
tk AS (SELECT g, k, cap, (b0 + CASE WHEN more <= rest AND cap > b0 THEN 1 ELSE 0 END)::BIGINT AS take FROM rs)"""


@register(f"WITH caps AS (SELECT bin AS g, masker AS k, count(*) AS cap, 150 AS quota FROM clips GROUP BY ALL), {_FILL} SELECT g AS bin, k AS masker, cap, take FROM tk", "clips")
def w1_waterfill(clips):
    caps = clips.groupBy("bin", "masker").agg(F.count(F.lit(1)).alias("cap"))
    return L.waterfill(caps, 150, ["masker"], by=["bin"])


_RR = "row_number() OVER (PARTITION BY {by}{cell} ORDER BY " + HASH.format("id", 1) + ", id) AS r"


@register(f"WITH q AS (SELECT bin AS g, prio AS k, "
    f"count(*) AS cap, 100 AS quota FROM clips GROUP BY ALL), caps AS (SELECT * FROM q), {_FILL}, x AS (SELECT clips.*, "
    f"take, {_RR.format(by='bin, prio, ', cell='masker')} FROM clips JOIN tk ON g = bin "
    f"AND k = prio), y AS (SELECT *, row_number() OVER (PARTITION BY bin, prio ORDER BY r, md5(concat_ws('|', '1', masker, CAST(r AS VARCHAR))), id) AS kk FROM x) "
    f"SELECT id, bin, prio FROM y WHERE kk <= take", "clips")
def w2_w4_nested_balance(clips):
    """Quotas over inner keys in each outer one, cells dealt in an order that changes each round."""
    caps = clips.groupBy("bin", "prio").agg(F.count(F.lit(1)).alias("cap"))
    quota = L.waterfill(caps, 100, ["prio"], by=["bin"]).select("bin", "prio", "take")
    return L.round_robin(clips.join(quota, ["bin", "prio"]), ["bin", "prio"], ["masker"], F.col("take"), 1, ["id"], reshuffle=True).select("id", "bin", "prio")


@register(f"WITH x AS (SELECT *, {_RR.format(by='bin, ', cell='masker, side')} FROM clips), y AS (SELECT *, "
    f"row_number() OVER (PARTITION BY bin ORDER BY r, masker, side, id) AS k FROM x) SELECT id, bin FROM y WHERE k <= 200", "clips")
def w3_round_robin(clips):
    return L.round_robin(clips, ["bin"], ["masker", "side"], 200, 1, ["id"]).select("id", "bin")


_PROP = "WITH t AS (SELECT bin, count(*) AS s, (SELECT count(*) FROM clips) AS n FROM clips GROUP BY bin), x AS (SELECT clips.id, clips.bin, row_number() OVER (PARTITION BY clips.bin ORDER BY md5(concat_ws('|', '2', CAST(id AS VARCHAR))), id) AS r, s, n FROM clips JOIN t ON t.bin = clips.bin) SELECT id, bin FROM x WHERE r <= {0}"


@register(_PROP.format("least(greatest(1, floor(360 * s / n)), s)"), "clips")
def w5_proportional(clips):
    return L.proportional_select(clips, ["bin"], 360, 2, ["id"]).select("id", "bin")


@register(_PROP.format("least(round_even(360 * s / n, 0), s)"), "clips")
def w6_stratified(clips):
    return L.proportional_select(clips, ["bin"], 360, 2, ["id"], rounding="rint").select("id", "bin")


@register("WITH x AS (SELECT id, masker, row_number() OVER (PARTITION BY masker ORDER BY md5(concat_ws('|', '3', CAST(id AS VARCHAR))), id) AS r FROM clips) SELECT id, "
    "masker FROM x WHERE r <= 25", "clips")
def w7_sample_per_group(clips):
    return L.sample_per_group(clips, ["masker"], 25, 3, ["id"]).select("id", "masker")


@register("WITH x AS (SELECT id, coalesce(sum(dur) OVER (ORDER BY md5(concat_ws('|', '4', CAST(id AS VARCHAR))), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
    "0) AS before FROM clips) SELECT id FROM x WHERE before < 36000", "clips")
def w8_time_budget(clips):
    return L.take_budget(clips, "dur", 36000, 4, ["id"]).select("id")


@register("WITH r AS (SELECT *, md5(concat_ws('|', '4', CAST(id AS VARCHAR))) AS h, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', '4', "
    "CAST(id AS VARCHAR))), id) AS r FROM clips), x AS (SELECT id, coalesce(sum(dur) OVER (ORDER BY r, CASE bin WHEN 'very_unpleasant' THEN 1 WHEN 'unpleasant' THEN 2 WHEN 'neutral' THEN 3 WHEN 'pleasant' THEN 4 ELSE 5 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
    "0) AS before FROM r) SELECT id FROM x WHERE before < 36000", "clips")
def w8_time_budget_by_bin(clips):
    return L.take_budget(clips, "dur", 36000, 4, ["id"], by="bin", turn=S.bin_order("bin")).select("id")


@register("WITH x AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '6', CAST(id AS VARCHAR))), id) AS r, (SELECT least(500, floor(count(*) * 0.2)) "
    "FROM clips) AS k FROM clips) SELECT id, r <= k AS holdout FROM x", "clips")
def w9_holdout(clips):
    return L.holdout_split(clips, 500, 0.2, 6, ["id"]).select("id", "holdout")


_BANDS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(L.BANDS))


@register(f"""WITH r AS (SELECT id, masker, row_number() OVER (PARTITION BY masker ORDER BY score, id) - 1 AS place, count(*) OVER (PARTITION BY masker) AS n FROM clips),
b AS (SELECT id, masker, band FROM r, (VALUES {_BANDS}) v(band, lo, hi)
  WHERE place >= floor(lo::DOUBLE * n) AND place < greatest(floor(hi::DOUBLE * n), floor(lo::DOUBLE * n) + 1)),
x AS (SELECT *, row_number() OVER (PARTITION BY masker, band ORDER BY md5(concat_ws('|', '7', CAST(id AS VARCHAR))), id) AS r FROM b) SELECT id, masker, band FROM x WHERE r <= 4""", "clips")
def w10_quantile_bands(clips):
    return L.quantile_bands(clips, ["masker"], "score", 4, 7, ["id"]).select("id", "masker", "band")


_SPECTRUM = "spectrum AS (SELECT vec_id AS clip, (unnest(range(1, 65)) * 60)::BIGINT AS freq, unnest(embedding)::DOUBLE * unnest(embedding)::DOUBLE AS power FROM embeddings)"


def spectrum(emb: DataFrame) -> DataFrame:
    """Position in the vector as frequency (60 Hz apart), square as power."""
    p = emb.select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("i", "x"))
    return p.select("clip", ((F.col("i") + 1) * 60).cast("long").alias("freq"), (F.col("x").cast("double") * F.col("x").cast("double")).alias("power"))


@register(f"WITH {_SPECTRUM}, r AS (SELECT clip, freq, sum(power) "
    f"OVER (PARTITION BY clip ORDER BY freq) / sum(power) OVER (PARTITION BY clip) AS s FROM spectrum) SELECT clip, min(freq) FILTER (WHERE s >= 0.7) AS rolloff FROM r "
    f"GROUP BY clip", "embeddings")
def w12_cumulative_share(emb):
    return R.cumulative_threshold(spectrum(emb), ["clip"], "freq", "power", 0.7)


@register("SELECT event_id, coalesce(last_value(gappy IGNORE NULLS) OVER (PARTITION BY item ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(gappy IGNORE NULLS) OVER (PARTITION BY item ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM grid", "grid")
def w13_fill(grid):
    return R.fill(grid, ["item"], ["event_id"], "gappy").select("event_id", F.col("gappy").alias("filled"))


@register("WITH f AS (SELECT clip, event_id, (value > 50)::INT AS f FROM grid), o AS (SELECT *, (coalesce(lag(f) OVER w, 0) + f + coalesce(lead(f) OVER w, "
    "0) >= 2)::INT AS o FROM f WINDOW w AS (PARTITION BY clip ORDER BY event_id)), s AS (SELECT *, lag(o) OVER (PARTITION BY clip ORDER BY event_id) AS was FROM o) "
    "SELECT clip, round(avg(f), 6) + 0.0 AS on_share, count(*) FILTER (WHERE o != was) AS switches FROM s GROUP BY clip", "grid")
def w14_switches(grid):
    return r6(R.switch_count(grid, ["clip"], ["event_id"], F.col("value") > 50))


@register("SELECT id, rank() OVER (PARTITION BY masker ORDER BY dur) + (count(*) OVER (PARTITION BY masker, dur) - 1) / 2 AS rank FROM clips", "clips")
def w15_average_rank(clips):
    return clips.select("id", R.avg_rank("dur", ["masker"]).alias("rank"))


@register("WITH g AS (SELECT item, seed, avg(value) AS v FROM grid GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY v, seed) AS r, count(*) "
    "OVER (PARTITION BY item) AS n FROM g), m AS (SELECT item, median(v) AS med FROM g GROUP BY item) SELECT r.item, max(seed) FILTER (WHERE r = 1) AS low, "
    "max(seed) FILTER (WHERE r = n // 2 + 1) AS mid, max(seed) FILTER (WHERE r = n) AS high, arg_min(seed, (abs(v - med), seed)) AS nearest FROM r "
    "JOIN m ON m.item = r.item GROUP BY r.item", "grid")
def w17_w18_picks(grid):
    g = grid.groupBy("item", "seed").agg(F.avg("value").alias("v"))
    return R.pick_low_mid_high(g, ["item"], "seed", "v").join(R.closest_to_median(g, ["item"], "seed", "v").drop("median"), "item")


@register("SELECT id, price FROM clips ORDER BY price, id LIMIT 40", "clips")
def w19_w21_worst(clips):
    return clips.select("id", "price").orderBy("price", "id").limit(40)


@register("SELECT id, row_number() OVER (PARTITION BY masker ORDER BY md5(concat_ws('|', '9', CAST(id AS VARCHAR))), id)::INT AS place FROM clips", "clips")
def w20_seeded_order(clips):
    return clips.select("id", F.row_number().over(Window.partitionBy("masker").orderBy(S.order_key(9, "id"), "id")).alias("place"))


# ---- statistics


def _rank_sql(col: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"


@register(f"WITH r AS (SELECT clip, p, value, {_rank_sql('p', 'clip')} AS rx, {_rank_sql('value', 'clip')} AS ry FROM grid) SELECT clip, "
    f"round(corr(rx, ry), 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY clip HAVING count(DISTINCT p) > 2 AND count(DISTINCT value) > 1", "grid")
def t1_spearman(grid):
    return r6(ST.spearman_by(grid.where("p IS NOT NULL"), ["clip"], "p", "value", 3))


@register(f"WITH r AS (SELECT clip, lev, p, value, {_rank_sql('p', 'clip, lev')} AS rx, {_rank_sql('value', 'clip, lev')} AS ry FROM grid), c AS (SELECT clip, "
    f"lev, corr(rx, ry) AS rho FROM r GROUP BY ALL HAVING count(DISTINCT p) > 1 AND count(DISTINCT value) > 1) SELECT lev, count(*) FILTER (WHERE round(rho, "
    f"12) > 0) AS n_pos, count(*) FILTER (WHERE round(rho, 12) < 0) AS n_neg, round(avg(rho), 6) + 0.0 AS mean_rho FROM c GROUP BY lev", "grid")
def t1_sign_counts(grid):
    return r6(ST.sign_counts(ST.spearman_by(grid, ["clip", "lev"], "p", "value"), ["lev"]))


@register("SELECT seg, count(*) AS n, " + q6("avg(bal / 10001 - score) AS bias", "corr(score, bal / 10001 + nation) AS r",
    "stddev_samp(bal / 10001 + nation) / stddev_samp(score) AS spread").replace("avg(bal / 10001 - score)",
        "avg(bal / 10001 + nation - score)") + ", " + q6("1 - avg((score - bal / 10001 - nation) ** 2) / var_pop(score) AS r2",
            "1 - (avg((score - bal / 10001 - nation) ** 2) - avg(bal / 10001 + nation - score) ** 2) / var_pop(score) AS r2_centred",
                "sqrt(avg((score - bal / 10001 - nation) ** 2)) AS rmse") + " FROM cust GROUP BY seg", "cust")
def t2_t21_fit_quality(cust):
    return r6(ST.fit_quality(cust.withColumn("pred", F.col("bal") / 10001 + F.col("nation")), ["seg"], "score", "pred"))


@register("WITH v AS (SELECT nation, score AS o, score * 0.5 + bal % 7 AS p FROM cust), r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{c}" for c in "op")
    + " FROM v), l AS (SELECT avg(o) AS o, avg(p) AS p FROM v GROUP BY nation), one AS (SELECT count(*) AS n, corr(o, p) AS r, avg(p - o) AS bias, stddev_samp(p) / stddev_samp(o) AS spread FROM v) SELECT n, "
    + q6("r AS r", "(SELECT corr(ro, rp) FROM r) AS rho", "(SELECT corr(o, p) FROM l) AS r_place", "bias AS bias", "spread AS spread") + ", (SELECT count(*) FROM l) AS n_places FROM one", "cust")
def t2_agreement(cust):
    return r6(ST.agreement(cust.withColumn("pred", F.col("score") * 0.5 + F.col("bal") % 7), "score", "pred", "nation"))


_MATX, _MATY = ["qty", "la50"], ["disc", "price", "pl"]
_MAT = "WITH v AS (SELECT * FROM resp WHERE pl IS NOT NULL), r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) "
    f"OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in [*_MATX, *_MATY]) + " FROM v) "


@register(_MAT + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr(r_{x}, r_{y}), 6) + 0.0 AS rho, count(*) AS n FROM r" for x in _MATX for y in _MATY), "resp")
def t3_spearman_matrix(resp):
    return r6(ST.spearman_matrix(resp, _MATX, _MATY))


#: The fold as a recursive query: a row per cell and term, two steps of Lentz's method a term.
_BETA = f""", c AS (SELECT x, y, rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0::DOUBLE AS df FROM m),
i AS (SELECT *, df / (df + t * t) > (df / 2 + 1) / (df / 2 + 2.5) AS swap, df / (df + t * t) AS u0 FROM c),
s AS (SELECT *, CASE WHEN swap THEN t * t / (df + t * t) ELSE u0 END AS u, CASE WHEN swap THEN 0.5::DOUBLE ELSE df / 2 END AS a, CASE WHEN swap THEN df / 2 ELSE 0.5::DOUBLE END AS b FROM i),
f AS (SELECT x, y, u, a, b, 0 AS k, 1 / (1 - (a + b) * u / (a + 1)) AS h, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * u / (a + 1)) AS d FROM s
  UNION ALL SELECT x, y, u, a, b, k, h * c1 * d1 * (1 + o / c1) / (1 + o * d1), 1 + o / c1, 1 / (1 + o * d1) FROM (SELECT *, 1 + e / c AS c1, 1 / (1 + e * d) AS d1
    FROM (SELECT x, y, u, a, b, h, c, d, k + 1 AS k, (k + 1) * (b - k - 1) * u / ((a + 2 * k + 1) * (a + 2 * k + 2)) AS e,
      -(a + k + 1) * (a + b + k + 1) * u / ((a + 2 * k + 2) * (a + 2 * k + 3)) AS o FROM f WHERE k < {ST.TERMS}))),
g AS (SELECT x, y, h FROM f WHERE k = {ST.TERMS}),
p AS (SELECT s.x, s.y, rho, n, t, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(u) + b * ln(1 - u)) / a * h AS part, swap FROM s JOIN g ON g.x = s.x AND g.y = s.y),
w AS (SELECT *, greatest(0, least(1, CASE WHEN swap THEN 1 - part ELSE part END)) AS p FROM p),
q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, x, y) AS q FROM w),
j AS (SELECT *, least(1.0, min(q) OVER (ORDER BY p DESC, x DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM q)
SELECT x, y, round(rho, 6) + 0.0 AS rho, n, round(t, 6) + 0.0 AS t, round(p, 6) + 0.0 AS p, round(p_adj, 6) + 0.0 AS p_adj,
  CASE WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE '' END AS stars FROM j"""


@register(_MAT.replace("WITH ", "WITH RECURSIVE ", 1) + ", m AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, corr(r_{x}, r_{y}) AS rho, count(*) AS n FROM r" for x in _MATX for y in _MATY) + ")" + _BETA, "resp")
def t4_correlation_p(resp):
    return r6(ST.adjust_p(ST.correlation_p(ST.spearman_matrix(resp, _MATX, _MATY)), [], "p", "bh", ["x", "y"]))


@register("WITH p AS (SELECT id, masker, price / 1000000 AS p, count(*) OVER (PARTITION BY masker) AS m, row_number() OVER (PARTITION BY masker ORDER BY price / 1000000, "
    "id) AS k FROM clips), q AS (SELECT *, p * m / k AS q FROM p), a AS (SELECT *, least(1.0, min(q) OVER (PARTITION BY masker ORDER BY p DESC, "
    "id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM q) SELECT id, round(adj, 6) + 0.0 AS p_adj, CASE WHEN adj < 0.001 THEN '***' "
    "WHEN adj < 0.01 THEN '**' WHEN adj < 0.05 THEN '*' ELSE '' END AS stars FROM a", "clips")
def t4_benjamini_hochberg(clips):
    return r6(ST.adjust_p(clips.select("id", "masker", (F.col("price") / 1000000).alias("p")), ["masker"], "p", "bh", ["id"]).select("id", "p_adj", "stars"))


@register("WITH a AS (SELECT item, seed, avg(value) - 50 AS v FROM grid WHERE lev = 0 GROUP BY ALL), b AS (SELECT item, seed, avg(value) - 50 AS v FROM grid WHERE lev = 1 "
    "GROUP BY ALL), j AS (SELECT a.v AS x, b.v AS y FROM a JOIN b ON a.item = b.item AND a.seed = b.seed), r AS (SELECT x, y, rank() OVER (ORDER BY x) AS rx, rank() "
    "OVER (ORDER BY y) AS ry FROM j) SELECT count(*) AS n, " + q6("corr(rx, ry) AS rho", "avg((sign(x) = sign(y))::INT) AS same_sign",
        "regr_slope(y, x) AS slope", "avg(abs(x - y)) AS mad") + " FROM r", "grid")
def t5_matrix_similarity(grid):
    m = lambda k: grid.where(F.col("lev") == k).groupBy("item", "seed").agg((F.avg("value") - 50).alias("v"))
    return r6(ST.matrix_similarity(m(0), m(1), ["item", "seed"], "v"))


_BOOT = "WITH w AS (SELECT item, user_id, avg(value) AS v FROM grid GROUP BY ALL), "


@register(_BOOT + B.slot_sql("w", ["item"], {"s": "v"}, 2000, 11, "user_id") + ", ci AS (SELECT item, quantile_cont(s / _n, 0.025) AS lo, quantile_cont(s / _n, 0.975) AS hi FROM drawn "
    "GROUP BY item) SELECT w.item, count(*) AS n, " + q6("avg(v) AS mean", "any_value(lo) AS lo", "any_value(hi) AS hi") + " FROM w JOIN ci ON ci.item = w.item GROUP BY w.item", "grid")
def t6_bootstrap_mean(grid):
    """Resampling is over users; rows are averaged per user first."""
    c = grid.groupBy("item", "user_id").agg(F.avg("value").alias("v"))
    return r6(ST.bootstrap_mean(c, ["item"], "v", 2000, 11, ["user_id"]))


_CL = "WITH c AS (SELECT nation, count(*) AS n, sum(score) AS sx, sum(bal % 97) AS sy, sum(score * score) AS sxx, sum((bal % 97) * (bal % 97)) AS syy, sum(score * (bal % 97)) AS sxy FROM cust GROUP BY nation), "
_R = "(n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))"


@register(_CL + B.slot_sql("c", [], {k: k for k in ("n", "sx", "sy", "sxx", "syy", "sxy")}, 300, 12, "nation")
    + f", t AS (SELECT sum(n)::BIGINT AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM c) SELECT {q6(_R + ' AS r')}, "
    f"n, {q6(f'(SELECT quantile_cont({_R}, 0.025) FROM drawn) AS lo', f'(SELECT quantile_cont({_R}, 0.975) FROM drawn) AS hi')} FROM t", "cust")
def t7_cluster_bootstrap(cust):
    return r6(ST.cluster_bootstrap(cust.withColumn("y", F.col("bal") % 97), "nation", "score", "y", 300, 12))


_PSUMS = {
    "n": "count(*)", "so": "sum(score)", "soo": "sum(score * score)", "ea": "sum((score - a) ** 2)", "eb": "sum((score - b) ** 2)",
    "sa": "sum(a)", "saa": "sum(a * a)", "soa": "sum(score * a)", "sb": "sum(b)", "sbb": "sum(b * b)", "sob": "sum(score * b)",
}
_PAIR = "SELECT *, nation / 25 AS a, (nation * 7 % 25) / 24 + 0.01 AS b FROM cust"
_PD = "(eb - ea) / (soo - so * so / n)"
_PDR = " - ".join(f"(n * so{c} - so * s{c}) / sqrt((n * soo - so * so) * (n * s{c}{c} - s{c} * s{c}))" for c in "ab")


@register(f"WITH c AS (SELECT nation, {', '.join(f'{e} AS {k}' for k, e in _PSUMS.items())} FROM ({_PAIR}) GROUP BY nation), " + B.slot_sql("c", [], {k: k for k in _PSUMS}, 300, 13, "nation")
    + f", b AS (SELECT {_PD} AS d, {_PDR} AS dr FROM drawn), t AS (SELECT {_PD} AS diff, {_PDR} AS dr FROM (SELECT {', '.join(f'sum({k}) AS {k}' for k in _PSUMS)} FROM c)) SELECT "
    + q6("(SELECT diff FROM t) AS diff", "(SELECT dr FROM t) AS dr", *(f"{e} AS {n}" for c, p in (("d", ""), ("dr", "dr_")) for e, n in (
        (f"quantile_cont({c}, 0.025)", f"{p}lo"), (f"quantile_cont({c}, 0.975)", f"{p}hi"), (f"least(1.0, 2 * least(avg(({c} <= 0)::INT), avg(({c} >= 0)::INT)))", f"{p}p")))) + " FROM b", "cust")
def t8_paired_bootstrap(cust):
    rows = cust.withColumn("a", F.col("nation") / 25).withColumn("b", (F.col("nation") * 7 % 25) / 24 + 0.01)
    return r6(ST.paired_bootstrap(rows, "nation", "score", "a", "b", 300, 13))


def _renamed(sql: str, suffix: str) -> str:
    """slot_sql() under names of its own."""
    for name in ("placed", "sized", "slots", "drawn"):
        sql = re.sub(rf"\b{name}\b", name + suffix, sql)
    return sql


_GAP = "WITH c AS (SELECT item, user_id, avg(value) AS v FROM grid GROUP BY ALL), wa AS (SELECT * FROM c WHERE user_id % 2 = 0), wb AS (SELECT * FROM c WHERE user_id % 2 = 1), "


@register(_GAP + ", ".join(_renamed(B.slot_sql(f"w{x}", ["item"], {"s": "v"}, 2000, seed, "user_id"), f"_{x}") for x, seed in (("a", 14), ("b", 15))) + ", d AS (SELECT ra.item, "
    "quantile_cont(ra.s / ra._n - rb.s / rb._n, 0.025) AS lo, quantile_cont(ra.s / ra._n - rb.s / rb._n, 0.975) AS hi FROM drawn_a ra JOIN drawn_b rb ON ra.item = rb.item AND ra.rep = rb.rep "
    "GROUP BY ra.item) SELECT d.item, " + q6("(SELECT avg(v) "
    "FROM wa WHERE wa.item = d.item) - (SELECT avg(v) FROM wb WHERE wb.item = d.item) AS gap", "lo AS lo", "hi AS hi") + " FROM d", "grid")
def t9_gap_bootstrap(grid):
    """The two samples are the users with even and with odd ids."""
    c = grid.groupBy("item", "user_id").agg(F.avg("value").alias("v"))
    return r6(ST.gap_bootstrap(c.where("user_id % 2 = 0"), c.where("user_id % 2 = 1"), ["item"], "v", 2000, 14, ["user_id"]))


@register("SELECT masker, " + q6("regr_slope(price, score) AS slope", "regr_intercept(price, score) AS intercept", "regr_r2(price, score) AS r2",
    "regr_slope(price, score) * 1.5 AS expected") + " FROM clips GROUP BY masker", "clips")
def t10_line_fit(clips):
    return r6(ST.line_fit(clips, ["masker"], "score", "price", -0.75, 0.75))


@register("""WITH t AS (SELECT item, count(*) AS n_train, regr_slope(value, p) AS slope, regr_intercept(value, p) AS intercept, avg(value) 
    FILTER (WHERE p BETWEEN 0.5 AND 0.9) - avg(value) FILTER (WHERE p BETWEEN -0.9 AND -0.5) AS extreme_delta FROM grid WHERE lev = 0 GROUP BY item),
pr AS (SELECT item, clip, avg(value) FILTER (WHERE p = 0.5) - avg(value) FILTER (WHERE p = -0.5) AS d FROM grid WHERE lev = 1 GROUP BY ALL), g AS (SELECT item, 
    avg(d) AS generated, count(d) AS n_pairs FROM pr WHERE d IS NOT NULL GROUP BY item),
m AS (SELECT item, avg(value) FILTER (WHERE p = -0.5) AS a, avg(value) FILTER (WHERE p = 0) AS b, avg(value) FILTER (WHERE p = 0.5) AS c FROM grid WHERE lev = 1 GROUP BY item)
SELECT t.item, n_train, n_pairs, """ + q6("slope AS slope", "intercept AS intercept", "extreme_delta AS extreme_delta", "slope * 1.0 AS expected", "generated AS generated", "CASE "
    "WHEN abs(slope) > 1e-9 THEN generated / slope END AS ratio", "a - (intercept - 0.5 * slope) AS bias_lo", "b - intercept AS bias_mid",
        "c - (intercept + 0.5 * slope) AS bias_hi") + " FROM t JOIN g ON g.item = t.item JOIN m ON m.item = t.item", "grid")
def t10_effect_against_fit(grid):
    return r6(ST.effect_against_fit(grid.where("lev = 0"), grid.where("lev = 1"), ["item"], "p", "value", "p", "value", ["clip"], -0.5, 0.5))


@register(f"WITH r AS (SELECT clip, {_rank_sql('p', 'clip')} AS rx, {_rank_sql('value', 'clip')} AS ry, p, value FROM grid), "
    f"c AS (SELECT corr(rx, ry) AS rho FROM r GROUP BY clip HAVING count(*) >= 20 AND count(DISTINCT p) > 1 AND count(DISTINCT value) > 1) SELECT round(median(rho), "
    f"6) + 0.0 AS median_rho, count(*) AS groups FROM c", "grid")
def t11_within_group_rho(grid):
    return r6(ST.within_group_rho(grid, "clip", "p", "value", 20))


@register("WITH g AS (SELECT bin, count(*) AS n, sum(price) AS s, sum(price * price) AS ss FROM clips GROUP BY bin), t AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, "
    "sum(ss) - sum(s) * sum(s) / sum(n) AS tot, sum(ss) - sum(s * s / n) AS win FROM g) SELECT n, k, " + q6("1 - win / tot AS eta2",
        "1 - (win / tot) * (n - 1) / (n - k) AS eta2_adj", "sqrt(win / (n - k)) AS sd_within") + " FROM t", "clips")
def t12_eta_squared(clips):
    return r6(ST.eta_squared(clips, "bin", "price"))


@register("WITH c AS (SELECT corr(qty, price) AS a, corr(qty, la50) AS b, corr(price, la50) AS c FROM resp) SELECT round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), "
    "6) + 0.0 AS partial_r FROM c", "resp")
def t13_partial_corr(resp):
    return r6(ST.partial_corr(resp, "qty", "price", "la50"))


@register("WITH j AS (SELECT lang, quality AS q, n_chars FROM labels JOIN docs ON docs.doc_id = labels.doc_id), r AS (SELECT lang, q, rank() OVER (PARTITION BY lang "
    "ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM j) SELECT lang, count(*) FILTER (WHERE q = 1) AS n_pos, "
    "count(*) FILTER (WHERE q != 1) AS n_neg, "
    "round((sum(r) FILTER (WHERE q = 1) - count(*) FILTER (WHERE q = 1) * (count(*) FILTER (WHERE q = 1) + 1) / 2) / (count(*) FILTER (WHERE q = 1) * count(*) FILTER (WHERE q != 1)), "
    "6) + 0.0 AS auc FROM r GROUP BY lang HAVING count(*) FILTER (WHERE q = 1) > 0 AND count(*) FILTER (WHERE q != 1) > 0", "docs labels")
def t14_auc(docs, labels):
    return r6(ST.auc(labels.join(docs, "doc_id"), ["lang"], "quality", "n_chars"))


_REC = [("disc", "pl"), ("disc", "ca"), ("tax", "pl"), ("tax", "ca")]


@register(" UNION ALL ".join(f"SELECT '{a}' AS score, '{b}' AS item, round(corr({a}, {b}), 6) + 0.0 AS r FROM resp" for a, b in _REC), "resp")
def t15_recognition_matrix(resp):
    return r6(ST.recognition_matrix(resp, ["disc", "tax"], ["pl", "ca"]))


def _audio_captions(emb):
    """Even ids are clips; the ids around are captions, two a clip."""
    audio = emb.where("vec_id % 3 = 0").select(F.col("vec_id").alias("clip"), F.col("embedding").alias("vec"))
    caps = emb.where("vec_id % 3 != 0").select((F.col("vec_id") - F.col("vec_id") % 3).alias("clip"), (F.col("vec_id") % 3).alias("cap"), F.col("embedding").alias("vec"))
    return audio, caps


_ZSQL = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT vec_id AS clip, v FROM e WHERE vec_id % 3 = 0), c AS (SELECT vec_id - vec_id % 3 AS clip, vec_id % 3 AS cap, v FROM e WHERE vec_id % 3 != 0), s AS (SELECT a.clip, c.clip AS other, c.cap, list_dot_product(a.v, c.v) AS sim FROM a, c), m AS (SELECT clip, avg(sim) AS mu, stddev_pop(sim) AS sd FROM s WHERE clip != other GROUP BY clip) "


@register(_ZSQL + "SELECT s.clip, s.cap, " + q6("sim AS sim", "(sim - mu) / (sd + 1e-9) AS z") + " FROM s JOIN m ON m.clip = s.clip WHERE s.clip = other", "embeddings")
def j12_t16_caption_z(emb):
    return r6(E.caption_z(*_audio_captions(emb), "clip"))


@register(_ZSQL + "SELECT o.clip, o.cap, round(avg((round(s.sim, 12) < round(o.sim, 12))::INT), 6) + 0.0 AS pct FROM s o JOIN s ON s.clip = o.clip AND s.clip != s.other "
    "WHERE o.clip = o.other GROUP BY ALL", "embeddings")
def t16_caption_percentile(emb):
    return r6(E.caption_percentile(*_audio_captions(emb), "clip").select("clip", "cap", "pct"))


@register(_ZSQL + ", z AS (SELECT s.clip, s.cap, (sim - mu) / (sd + 1e-9) AS z FROM s JOIN m ON m.clip = s.clip WHERE s.clip = other) SELECT clip, arg_max(cap, (z, "
    "-cap)) AS best, round(max(z), 6) + 0.0 AS best_z, count(*) FILTER (WHERE z >= 0.1) AS n_over, coalesce(string_agg('text ' || cap, ' || ' ORDER BY "
    "cap) FILTER (WHERE z >= 0.1), '') AS texts FROM z GROUP BY clip", "embeddings")
def w16_best_caption(emb):
    audio, caps = _audio_captions(emb)
    texts = caps.select("clip", "cap", F.concat(F.lit("text "), F.col("cap").cast("string")).alias("text"))
    return r6(E.best_caption(E.caption_z(audio, caps, "clip"), "clip", texts, 0.1))


def prototypes(emb: DataFrame) -> DataFrame:
    """The mean vector of each label (a row a label)."""
    el = emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return el.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("proto"))


_PROTO = "WITH el AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), av AS (SELECT label, i, avg(x) AS x FROM el GROUP BY ALL), pr AS (SELECT label AS name, list(x ORDER BY i) AS proto FROM av GROUP BY label), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), cs AS (SELECT vec_id, name, list_dot_product(v, proto) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(proto, proto)) AS c FROM e, pr)"


_APART = "sqrt(list_sum(list_transform(list_zip(a.proto, b.proto), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"


@register(_PROTO + ", s AS (SELECT *, 5 * c - max(5 * c) OVER (PARTITION BY vec_id) AS d FROM cs) SELECT vec_id, name, round(exp(d) / sum(exp(d)) "
    "OVER (PARTITION BY vec_id), 6) + 0.0 AS p FROM s", "embeddings")
def j13_t17_prototype_softmax(emb):
    p = prototypes(emb).withColumnRenamed("label", "name")
    return r6(E.prototype_softmax(emb.select("vec_id", F.col("embedding").alias("vec")), p, ["vec_id"], temp=5.0))


@register(_PROTO + ", s AS (SELECT vec_id, 'set' || (name % 3) AS source, avg(c) AS raw FROM cs GROUP BY ALL) SELECT vec_id, source, round(raw - avg(raw) "
    "OVER (PARTITION BY vec_id), 6) + 0.0 AS score FROM s", "embeddings")
def t18_source_scores(emb):
    p = prototypes(emb).select(F.concat(F.lit("set"), (F.col("label") % 3).cast("string")).alias("source"), "proto")
    return r6(E.source_scores(emb.select("vec_id", F.col("embedding").alias("vec")), p, ["vec_id"]))


@register(_PROTO + ", d AS (SELECT vec_id, name, list_sum(list_transform(list_zip(v, proto), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM e, pr) SELECT vec_id, "
    "arg_min(name, (d, name)) AS name, round(min(d), 6) + 0.0 AS d2 FROM d GROUP BY vec_id", "embeddings")
def j14_nearest_centroid(emb):
    p = prototypes(emb).withColumnRenamed("label", "name")
    return r6(E.nearest_prototype(emb.select("vec_id", F.col("embedding").alias("vec")), p, ["vec_id"]))


@register(_PROTO + " SELECT a.name AS a_name, b.name AS b_name, round(" + _APART + ", 6) + 0.0 AS distance, abs(a.name - b.name) AS label_gap FROM pr a JOIN pr b ON a.name < b.name", "embeddings")
def t29_pairwise_distance(emb):
    return r6(E.pairwise_distance(prototypes(emb).withColumn("name", F.col("label")), "name", "proto", "label"))


@register(_PROTO + ", d AS (SELECT " + _APART + " AS distance, abs(a.name - b.name) AS label_gap FROM pr a JOIN pr b ON a.name < b.name), r AS (SELECT rank() OVER (ORDER BY distance) AS x, "
    "rank() OVER (ORDER BY label_gap) + (count(*) OVER (PARTITION BY label_gap) - 1) / 2 AS y FROM d) SELECT count(*) AS n, round(corr(x, y), 6) + 0.0 AS rho FROM r", "embeddings")
def t29_distance_trend(emb):
    pairs = E.pairwise_distance(prototypes(emb).withColumn("name", F.col("label")), "name", "proto", "label").withColumn("of", F.lit("labels"))
    return r6(ST.spearman_by(pairs, ["of"], "distance", "label_gap").select("n", "rho"))


@register("WITH el AS (SELECT vec_id % 40 AS clip, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT clip, i, avg(x) AS x FROM el "
    "GROUP BY ALL), n AS (SELECT clip, sqrt(sum(x * x)) AS n FROM a GROUP BY clip) SELECT a.clip, i, round(x / n, 6) + 0.0 AS x FROM a JOIN n ON n.clip = a.clip", "embeddings")
def a28_s8_mean_embedding(emb):
    m = R.mean_embedding(emb.select((F.col("vec_id") % 40).alias("clip"), "embedding"), ["clip"], "embedding")
    return r6(m.select("clip", F.posexplode("embedding").alias("i", "x")))


@register("WITH u AS (SELECT clip, false AS overall, value AS v, (item = 'click')::INT AS a FROM grid WHERE item IN ('click', 'view') UNION ALL SELECT NULL, true, value, (item = 'click')::INT "
    "FROM grid WHERE item IN ('click', 'view')), t AS (SELECT clip, overall, sum(a)::BIGINT AS n_a, sum(1 - a)::BIGINT AS n_b FROM u GROUP BY ALL), c AS (SELECT u.clip, u.overall, v, "
    "sum(sum(a)) OVER (PARTITION BY u.clip, u.overall ORDER BY v) / any_value(n_a) AS fa, sum(sum(1 - a)) OVER (PARTITION BY u.clip, u.overall ORDER BY v) / any_value(n_b) AS fb FROM u "
    "JOIN t ON t.clip IS NOT DISTINCT FROM u.clip AND t.overall = u.overall GROUP BY u.clip, u.overall, v) SELECT t.clip, t.overall, n_a, n_b, "
    "CASE WHEN n_a >= 5 AND n_b >= 5 THEN round(max(abs(fa - fb)), 6) + 0.0 END AS ks FROM t JOIN c ON t.clip IS NOT DISTINCT FROM c.clip AND t.overall = c.overall "
    "GROUP BY t.clip, t.overall, n_a, n_b", "grid")
def t19_ks(grid):
    return r6(ST.ks(grid.where("item IN ('click', 'view')"), ["clip"], F.col("item") == "click", "value"))


@register("WITH f AS (SELECT id, avg(score) AS p FROM clips GROUP BY id), o AS (SELECT id, prio AS cond, score * 0.9 + dur / 1000 AS p, price AS o FROM clips), "
    "g AS (SELECT cond, corr(o.p, f.p) AS rf, avg(o.p - f.p) AS sh, corr(o.p, o.o) - corr(f.p, o.o) AS dr FROM o JOIN f ON f.id = o.id GROUP BY cond) "
    "SELECT cond, " + q6("rf AS r_full", "sh AS shift", "dr AS dr") + ", rf >= 0.95 "
    "AND abs(sh) <= 0.05 AND dr >= -0.02 AS passed FROM g", "clips")
def t20_sensitivity_rule(clips):
    other = clips.select("id", F.col("prio").alias("cond"), (F.col("score") * 0.9 + F.col("dur") / 1000).alias("p"), F.col("price").alias("o"))
    return r6(ST.stability_rule(clips.select("id", F.col("score").alias("p")), other, ["cond"], "id", "p", "o", 0.95, 0.05, 0.02))


@register("WITH w AS (SELECT item, clip, avg(value) FILTER (WHERE lev = 0) AS b, avg(value) FILTER (WHERE lev = 1) AS o1, avg(value) FILTER (WHERE lev = 2) AS o2 "
    "FROM grid GROUP BY ALL), l AS (SELECT item, clip, unnest(['1', '2']) AS condition, unnest([o1 - b, o2 - b]) AS d FROM w), ld AS (SELECT * FROM l WHERE d IS NOT NULL), " + B.slot_sql("ld", ["item", "condition"], {"s": "d"}, 2000, 16, "clip") + ", "
    "ci AS (SELECT item, condition, quantile_cont(s / _n, 0.025) AS lo, quantile_cont(s / _n, 0.975) AS hi FROM drawn GROUP BY ALL) SELECT item, condition, "
    "count(d) AS n, " + q6("avg(d) AS mean_diff", "avg((d > 0)::INT) AS share_worse", "any_value(lo) AS lo", "any_value(hi) AS hi") + " FROM l "
    "JOIN ci USING (item, condition) WHERE d IS NOT NULL GROUP BY ALL", "grid")
def t28_paired_losses(grid):
    return r6(ST.paired_losses(grid.withColumn("cond", F.col("lev").cast("string")), "clip", "cond", "value", "0", ["item"], ["1", "2"], 2000, 16))


@register(f"WITH r AS (SELECT item, p, {_rank_sql('p', 'item')} AS rx, value, {_rank_sql('value', 'item')} AS ry FROM grid) SELECT item, "
    f"count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho, abs(corr(rx, ry)) < 0.3 AS independent FROM r GROUP BY item HAVING count(DISTINCT p) > 2", "grid")
def t30_level_trend(grid):
    return r6(ST.spearman_by(grid, ["item"], "p", "value", 3).withColumn("independent", F.abs("rho") < 0.3))


_EFFECT = f"""r AS (SELECT clip, p, value, {_rank_sql('p', 'clip')} AS rx, {_rank_sql('value', 'clip')} AS ry FROM grid), pe AS (SELECT clip, CASE WHEN count(DISTINCT p) > 1 
    AND count(DISTINCT value) > 1 THEN corr(rx, ry) ELSE 0 END AS rho, count(*) AS n_levels FROM r GROUP BY clip HAVING count(*) >= 3)"""


@register(f"WITH {_EFFECT} SELECT clip, round(rho, 6) + 0.0 AS rho, n_levels FROM pe", "grid")
def t30_prompt_effect(grid):
    return r6(ST.prompt_effect(grid, "clip", "p", "value").drop("p"))


@register(f"WITH {_EFFECT}, s AS (SELECT count(*) AS prompts, avg(rho) AS mean_r, stddev_samp(rho) / sqrt(count(*)) AS se_r FROM pe) SELECT prompts, " + q6("mean_r AS mean_r", "se_r AS se_r",
    "mean_r - 1.96 * se_r AS ci_lower", "mean_r + 1.96 * se_r AS ci_upper") + ", CASE WHEN abs(mean_r) > 0.5 THEN 'large' WHEN abs(mean_r) > 0.3 THEN 'medium' ELSE 'small' END AS effect_size FROM s", "grid")
def t30_effect_summary(grid):
    return r6(ST.effect_summary(ST.prompt_effect(grid, "clip", "p", "value")))


@register("WITH u AS (SELECT p, unnest(['value', 'k', 'clip']) AS source, unnest([value::DOUBLE, k::DOUBLE, clip::DOUBLE]) AS v FROM grid), r AS (SELECT source, " + _rank_sql("p", "source") + " AS rx, "
    + _rank_sql("v", "source") + " AS ry FROM u) SELECT source, round(corr(rx, ry), 6) + 0.0 AS rho, abs(corr(rx, ry)) < 0.3 AS independent FROM r GROUP BY source", "grid")
def t30_source_independence(grid):
    return r6(ST.source_independence(grid, "p", ["value", "k", "clip"]))


@register("SELECT " + q6("avg(value / 400) AS mean_similarity", "stddev_pop(value / 400) AS std_similarity") + ", CASE WHEN avg(value / 400) > 0.25 THEN 'good' WHEN avg(value / 400) > 0.15 THEN 'fair' ELSE 'poor' END AS quality FROM grid", "grid")
def t30_adherence(grid):
    return r6(ST.adherence(grid.withColumn("sim", F.col("value") / 400), "sim"))


# ---- frames and spectra


_A2 = "10 ** ((20 * log10((148693636.0 * (freq * 1.0) ** 4) / (((freq * 1.0) ** 2 + 424.36) * sqrt(((freq * 1.0) ** 2 + 11599.29) * ((freq * 1.0) ** 2 + 544496.41)) * ((freq * 1.0) ** 2 + 148693636.0))) + 2.0) / 10) * power"


@register(f"WITH {_SPECTRUM}, w AS (SELECT clip, freq, power, {_A2} AS a FROM spectrum) SELECT clip, " + q6("100 * sum(CASE WHEN freq < 200 THEN power "
    "ELSE 0 END) / sum(power) AS low_pct", "100 * sum(CASE "
    "WHEN freq >= 1000 THEN a ELSE 0 END) / sum(a) AS mid_pct", "100 * sum(CASE "
    "WHEN freq >= 3000 THEN a ELSE 0 END) / sum(a) AS high_pct") + " FROM w GROUP BY clip", "embeddings")
def g1_band_share(emb):
    return r6(G.band_share(spectrum(emb), "clip", (200.0, 1000.0, 3000.0)))


_FR = "fr AS (SELECT vec_id // 2 % 60 AS clip, vec_id % 2 AS channel, vec_id // 120 AS frame, embedding::DOUBLE[] AS samples FROM embeddings)"


def frames(emb):
    return emb.select((F.floor(F.col("vec_id") / 2) % 60).alias("clip"), (F.col("vec_id") % 2).alias("channel"), F.floor(F.col("vec_id") / 120).alias("frame"), F.col("embedding").alias("samples"))


@register(f"WITH {_FR}, s AS (SELECT clip, list_dot_product(samples, samples) AS sq, len(samples) AS n FROM fr) "
    f"SELECT clip, " + q6("stddev_pop(sqrt(sq / n)) / avg(sqrt(sq / n)) AS cv", "10 * log10(sum(sq) / sum(n)) AS rms_db") + " FROM s GROUP BY clip", "embeddings")
def g2_level_variation(emb):
    return r6(G.level_variation(frames(emb)))


@register(f"WITH {_FR}, p AS (SELECT l.clip, "
    f"unnest(l.samples) AS a, unnest(r.samples) AS b FROM fr l JOIN fr r ON l.clip = r.clip AND l.frame = r.frame AND l.channel = 0 AND r.channel = 1) SELECT clip, "
    f"round(corr(a, b), 6) + 0.0 AS stereo_r FROM p GROUP BY clip", "embeddings")
def g3_stereo_corr(emb):
    return r6(G.stereo_corr(frames(emb)))


@register(f"WITH {_SPECTRUM}, f AS (SELECT clip % 50 AS clip, "
    f"clip // 50 AS frame, power + 1e-20 AS p FROM spectrum WHERE freq BETWEEN 100 AND 3000), g AS (SELECT clip, frame, 10 * log10(exp(avg(ln(p))) / avg(p)) AS a, "
    f"10 * log10(max(p) / quantile_cont(p, 0.5)) AS b FROM f GROUP BY ALL) SELECT clip, " + q6("avg(a) AS flat_db", "avg(b) AS peak_db") + " FROM g GROUP BY clip", "embeddings")
def g4_tonality(emb):
    s = spectrum(emb).withColumn("frame", F.floor(F.col("clip") / 50)).withColumn("clip", F.col("clip") % 50)
    return r6(G.tonality(s, "clip", 100.0, 3000.0))


@register(f"""WITH {_SPECTRUM}, h AS (SELECT * FROM spectrum WHERE freq BETWEEN 20 AND 20000), c AS (SELECT clip, sum(freq * power) / sum(power) AS centroid FROM h GROUP BY clip),
r AS (SELECT clip, freq, sum(power) OVER (PARTITION BY clip ORDER BY freq) / sum(power) OVER (PARTITION BY clip) AS s FROM h),
ro AS (SELECT clip, min(freq) FILTER (WHERE s >= 0.85) AS rolloff FROM r GROUP BY clip),
b AS (SELECT clip, floor(log2(freq / 100.0) * 3 + 0.5) AS band, sum(power) AS p FROM spectrum GROUP BY ALL),
t AS (SELECT clip, CASE WHEN count(*) > 3 THEN regr_slope(10 * log10(p + 1e-30), band / 3) END AS tilt FROM b WHERE band BETWEEN 0 AND 19 GROUP BY clip)
SELECT c.clip, rolloff, """ + q6("centroid AS centroid", "tilt AS tilt") + " FROM c JOIN ro ON ro.clip = c.clip LEFT JOIN t ON t.clip = c.clip", "embeddings")
def g5_brightness(emb):
    return r6(G.brightness(spectrum(emb)))


@register(f"""WITH {_SPECTRUM}, s AS (SELECT clip % 50 AS clip, clip // 50 AS frame, freq, power FROM spectrum), m AS (SELECT clip, freq, avg(power) AS power FROM s GROUP BY ALL),
o AS (SELECT clip, arg_max(freq, (power, -freq)) FILTER (WHERE freq BETWEEN 60 AND 130) AS line_hz, max(power) FILTER (WHERE freq BETWEEN 60 AND 130) AS top, 
    quantile_cont(power, 0.5) FILTER (WHERE freq BETWEEN 200 AND 2000) AS med, coalesce(sum(power) FILTER (WHERE freq < 200), 0) AS low, coalesce(sum(power) 
    FILTER (WHERE freq >= 200 AND freq < 6000), 0) AS mid FROM m GROUP BY clip),
f AS (SELECT clip, frame, 10 * log10(sum(power) + 1e-20) AS lv FROM s WHERE freq BETWEEN 60 AND 130 GROUP BY ALL), k AS (SELECT clip, max(lv) AS mx, 
    quantile_cont(lv, 0.9) AS hi, quantile_cont(lv, 0.1) AS lw FROM f GROUP BY clip),
b AS (SELECT f.clip, frame, (lv > mx - 6)::INT AS near, (lv > (hi + lw) / 2)::INT AS st, hi - lw > 6 AS wide FROM f JOIN k ON k.clip = f.clip), d AS (SELECT *, 
    (coalesce(lag(st) OVER w, 0) + st + coalesce(lead(st) OVER w, 0) >= 2)::INT AS flt FROM b WINDOW w AS (PARTITION BY clip ORDER BY frame)),
e AS (SELECT *, lag(flt) OVER (PARTITION BY clip ORDER BY frame) AS was FROM d), g AS (SELECT clip, avg(near) AS on_share, CASE WHEN any_value(wide) THEN count(*) 
    FILTER (WHERE flt != was) ELSE 0 END AS switches FROM e GROUP BY clip)
SELECT o.clip, line_hz, switches, """ + q6("on_share AS on_share", "10 * log10(top + 1e-20) - 10 * log10(med + 1e-20) AS prominence_db",
    "10 * log10(low + 1e-20) - 10 * log10(mid + 1e-20) AS low_mid_db") + " FROM o JOIN g ON g.clip = o.clip", "embeddings")
def g6_hum(emb):
    s = spectrum(emb).withColumn("frame", F.floor(F.col("clip") / 50)).withColumn("clip", F.col("clip") % 50)
    return r6(G.hum(s, "clip", (60.0, 130.0)))


@register("SELECT masker_type, " + q6("avg(disc) AS disc_mean", "stddev_samp(disc) AS disc_sd", "avg(tax) AS tax_mean", "stddev_samp(tax) AS tax_sd") + " FROM resp GROUP BY 1", "resp")
def g7_label_summary(resp):
    return r6(G.label_summary(resp, "masker_type", ["disc", "tax"]))


@register("SELECT clip, " + q6("quantile_cont(value - 50, 0.95) AS n5", "quantile_cont(value - 50, 0.5) AS n50", "avg(value - 50) AS mean",
    "avg((value > 50)::INT) AS share_pos") + " FROM grid GROUP BY clip", "grid")
def g8_curve_percentiles(grid):
    return r6(G.curve_percentiles(grid.select("clip", (F.col("value") - 50).alias("value"))))


@register("SELECT clip, " + q6("avg(value) AS ch_value", "avg(p) AS ch_p") + " FROM grid GROUP BY clip", "grid")
def g9_channel_mean(grid):
    return r6(G.channel_mean(grid, "clip", ["value", "p"], "ch_"))


# ---- plans


@register("SELECT id, c::INT AS chunk, c * 10.0::DOUBLE AS start, least(dur, (c + 1) * 10.0)::DOUBLE AS \"end\", greatest(0.0, (c + 1) * 10.0 - dur)::DOUBLE AS pad "
    "FROM (SELECT id, dur, unnest(range(0, floor((dur + 1) / 10)::BIGINT)) AS c FROM clips)", "clips")
def c1_fixed_chunks(clips):
    return P.chunk_plan(clips, "dur", 10.0, 1.0).select("id", "chunk", "start", "end", "pad")


@register("WITH s AS (SELECT id, dur, ceil(dur / 22.0)::INT AS parts FROM clips), e AS (SELECT *, unnest(range(0, parts))::INT AS part FROM s WHERE dur >= 5) SELECT id, parts, part, "
    "round_even(part * dur / parts, 0)::DOUBLE AS start, round_even((part + 1) * dur / parts, 0)::DOUBLE AS \"end\" FROM e", "clips")
def c2_equal_split(clips):
    return P.split_plan(clips, "dur", 22.0, 5.0).select("id", "parts", "part", "start", "end")


@register("WITH s AS (SELECT id, dur, dur BETWEEN 12 AND 25 AS whole FROM clips), e AS (SELECT *, unnest(range(0, CASE WHEN whole THEN 1 ELSE dur // 10 END))::INT AS piece FROM s) SELECT id, piece, "
    "(piece * 10)::DOUBLE AS start, CASE WHEN whole THEN dur ELSE (piece + 1) * 10 END::DOUBLE AS \"end\" FROM e", "clips")
def c2_whole_or_chunks(clips):
    return P.whole_or_chunks(clips, "dur", 12.0, 25.0, 10.0).select("id", "piece", "start", "end")


_REPS = "CASE bin WHEN 'very_unpleasant' THEN 3 WHEN 'very_pleasant' THEN 2 ELSE 1 END + CASE WHEN score > 0.9 THEN 1 ELSE 0 END"


@register(f"WITH e AS (SELECT *, unnest(range(0, {_REPS}))::INT AS rep FROM clips) SELECT id, "
    f"rep, CASE WHEN rep = 0 THEN file ELSE replace(file, '.wav', '_r' || rep || '.wav') END AS file FROM e", "clips")
def c3_repeats(clips):
    return P.repeat_rows(clips.withColumnRenamed("file", "name"), "bin", {"very_unpleasant": 3, "very_pleasant": 2}, "name", F.col("score") > 0.9).select("id", "rep", "file")


@register(f"WITH e AS (SELECT *, unnest(range(0, {_REPS}))::INT AS rep FROM clips) SELECT bin, "
    f"count(DISTINCT base) AS recordings, count(*) FILTER (WHERE rep = 0) AS chunks, count(*) AS chunks_seen, sum(CASE WHEN rep = 0 THEN dur "
    f"ELSE 0 END)::DOUBLE AS seconds, sum(dur)::DOUBLE AS seconds_seen FROM e GROUP BY bin", "clips")
def a14_exposure(clips):
    plan = P.repeat_rows(clips.withColumnRenamed("file", "name"), "bin", {"very_unpleasant": 3, "very_pleasant": 2}, "name",
        F.col("score") > 0.9).withColumn("start", F.lit(0.0)).withColumn("end", F.col("dur").cast("double"))
    return P.exposure(plan, "bin", "base")


@register(f"SELECT file, concat(prio, ' [ISOPleasant: ', {FMT.format('score')}, ']') AS rated, prio AS plain FROM clips", "clips")
def c4_s12_twin_manifests(clips):
    a, b = P.twin_manifests(clips, "file", "prio", "score")
    return a.withColumnRenamed("caption", "rated").join(b.withColumnRenamed("caption", "plain"), "file")


@register("SELECT id, k::INT AS win, round_even(k * greatest(0.0, dur - 12.0) / 2, 0)::DOUBLE AS start FROM clips, (SELECT unnest(range(0, 3)) AS k)", "clips")
def c5_windows(clips):
    return P.window_starts(clips, "dur", 12.0).select("id", "win", "start")


@register("WITH s AS (SELECT DISTINCT seed FROM grid), i AS (SELECT DISTINCT item FROM grid), l AS (SELECT DISTINCT p FROM grid), g AS (SELECT seed, item, p, concat('s', "
    "seed, '_', item, '_p', printf('%.2f', p), '.wav') AS file, concat(item, ' [ISOPleasant: ', printf('%.2f', p), ']') AS prompt FROM s, i, l) SELECT * FROM g "
    "WHERE file NOT IN (SELECT DISTINCT concat('s', seed, '_', item, '_p', printf('%.2f', p), '.wav') FROM grid WHERE seed = 0 AND lev = 1 AND value > 60)", "grid")
def c6_j11_grid_plan(grid):
    d = lambda c: grid.select(c).distinct()
    done = grid.where("seed = 0 AND lev = 1 AND value > 60").select(F.concat(F.lit("s"), F.col("seed").cast("string"), F.lit("_"), "item",
        F.lit("_p"), T.fmt2("p"), F.lit(".wav")).alias("file")).distinct()
    return P.grid_plan(d("seed"), d("item"), d("p"), done)


@register("SELECT id, (masker = 'bird' OR prio LIKE '1%')::INT AS lab_bird, (masker = 'water')::INT AS lab_water FROM clips", "clips")
def c7_label_matrix(clips):
    labels = F.array_compact(F.array(F.col("masker"), F.when(F.col("prio").startswith("1"), "bird")))
    return P.label_matrix(clips, "id", labels, ["bird", "water"])


_BIT = "('0x' || substr(md5(concat_ws('|', '22', item, CAST(seed AS VARCHAR))), 1, 8))::BIGINT % 2 = 1"


@register(f"WITH d AS (SELECT item, seed, "
    f"avg(value) FILTER (WHERE p = -1) AS lo, avg(value) FILTER (WHERE p = 1) AS hi FROM grid GROUP BY ALL) SELECT item, seed, row_number() "
    f"OVER (ORDER BY md5(concat_ws('|', '21', item, CAST(seed AS VARCHAR))), item, "
    f"seed)::INT AS trial, {q6(f'CASE WHEN {_BIT} THEN hi ELSE lo END AS a', f'CASE WHEN {_BIT} THEN lo ELSE hi END AS b')}, CASE WHEN {_BIT} THEN 'a' "
    f"ELSE 'b' END AS answer FROM d WHERE lo IS NOT NULL AND hi IS NOT NULL", "grid")
def c8_blind_pairs(grid):
    return r6(P.blind_pairs(X.paired_delta(grid, ["item", "seed"], "p", -1.0, 1.0, "value"), ["item", "seed"], "lo", "hi", 21))


@register("WITH m AS (SELECT DISTINCT item, seed, lev FROM grid), s AS (SELECT item, seed, (row_number() OVER (PARTITION BY item, seed ORDER BY md5(concat_ws('|', '23', item, "
    "CAST(seed AS VARCHAR), CAST(lev AS VARCHAR))), lev))::INT AS slot, lev AS candidate FROM m QUALIFY count(*) OVER (PARTITION BY item, seed) = 3) SELECT *, dense_rank() OVER "
    "(ORDER BY md5(concat_ws('|', '24', item, CAST(seed AS VARCHAR))), item, seed)::INT AS trial FROM s", "grid")
def c9_blind_candidates(grid):
    return P.blind_candidates(X.complete_candidates(grid, ["item", "seed"], "lev", 3), ["item", "seed"], "members", 23)


@register("WITH g AS (SELECT DISTINCT ckpt, item, seed, p FROM grid WHERE p IN (-0.5, 0, 0.5)) SELECT ckpt, row_number() OVER (PARTITION BY ckpt ORDER BY item, seed, p)::INT AS place, "
    "ckpt || ' | s' || seed || ' p=' || printf('%+.1f', p) || ' | ' || item AS label, md5(concat_ws('|', item, CAST(seed AS VARCHAR), printf('%.1f', p))) AS path FROM g", "grid")
def c9_quality_order(grid):
    g = grid.select("ckpt", "item", "seed", "p").distinct().withColumn("path", F.md5(F.concat_ws("|", "item", F.col("seed").cast("string"), F.format_string("%.1f", F.col("p").cast("double")))))
    return P.quality_order(g, ["ckpt"], "seed", "item", "p", [-0.5, 0.0, 0.5], "path")


_CAP = "concat(prio, ' [ISOPleasant: ', CASE WHEN printf('%.2f', {0}) = '-0.00' THEN '0.00' ELSE printf('%.2f', {0}) END, ']')"


@register(f"WITH r AS (SELECT id, masker, prio, "
    f"score, row_number() OVER (PARTITION BY masker ORDER BY score, id) AS q, row_number() OVER (PARTITION BY masker ORDER BY md5(concat_ws('|', '24', "
    f"CAST(id AS VARCHAR))), id) - 1 AS h, count(*) OVER (PARTITION BY masker) AS n FROM clips), x AS (SELECT a.*, c.score AS nxt, abs(c.score - a.score) < 0.05 AS near "
    f"FROM r a JOIN r c ON c.masker = a.masker AND c.h = (a.h + 1) % a.n), j AS (SELECT a.*, b.score AS mirror, CASE "
    f"WHEN a.near OR d.near THEN d.nxt ELSE a.nxt END AS sh FROM x a JOIN x b ON a.masker = b.masker AND b.q = a.n + 1 - a.q "
    f"JOIN x d ON d.masker = a.masker AND d.h = CASE WHEN a.h < a.n // 2 THEN a.h + a.n // 2 WHEN a.h < 2 * (a.n // 2) THEN a.h - a.n // 2 ELSE a.h END) SELECT masker, "
    f"id, {_CAP.format('score')} AS correct, {_CAP.format('-score')} AS flip, {_CAP.format('mirror')} AS mirror, {_CAP.format('sh')} AS shuffle, prio AS \"none\" "
    f"FROM j", "clips")
def c10_counterfactuals(clips):
    return P.counterfactuals(clips, ["masker"], "id", "prio", "score", 24)


@register("SELECT source, bin, count(*) AS n FROM (SELECT 'existing' AS source, bin FROM clips WHERE side = 'F' UNION ALL SELECT 'chunks', bin FROM clips WHERE side = 'O' "
    "AND dur > 30) GROUP BY ALL", "clips")
def c11_u1_joint_manifest(clips):
    j = P.joint_manifest(clips.where("side = 'F'").select("file", "bin"), clips.where("side = 'O' AND dur > 30").select("file", "bin", "dur"), ("existing", "chunks"))
    return j.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT id, CASE WHEN masker = 'bird' THEN 'new' ELSE masker END AS masker FROM clips", "clips")
def c12_replace_rows(clips):
    one = clips.select("id", "masker")
    return P.replace_rows(one, one.where("masker = 'bird'").withColumn("masker", F.lit("new")), "bird")


@register("WITH n AS (SELECT cust, min('caption ' || id) AS c FROM clips WHERE id % 3 = 0 GROUP BY cust) SELECT clips.id, coalesce(c, prio) AS caption, "
    "c IS NOT NULL AS matched FROM clips LEFT JOIN n ON n.cust = clips.cust", "clips")
def c13_s7_refresh_captions(clips):
    new = clips.where("id % 3 = 0").select("cust", F.concat(F.lit("caption "), F.col("id").cast("string")).alias("new_caption"))
    return P.refresh_captions(clips.select("id", "cust", F.col("prio").alias("caption")), new, ["cust"]).select("id", "caption", "matched")


@register("WITH f AS (SELECT cust, min(id) AS id, arg_min(file, id) AS file FROM clips GROUP BY cust) SELECT c.id AS cust, CASE WHEN f.id IS NOT NULL THEN concat('by ', name) END AS caption, f.id, file "
    "FROM cust c LEFT JOIN f ON f.cust = c.id", "clips cust")
def c13_rebuild_records(clips, cust):
    """Customers stand for the subset with new captions; those without a stored clip are the report's unmatched rows."""
    found, missed = P.rebuild_records(cust.select(F.col("id").alias("cust"), F.concat(F.lit("by "), "name").alias("new_caption")), clips.select("cust", "id", "file", F.col("prio").alias("caption")), ["cust"], "id")
    return found.select("cust", "caption", "id", "file").unionByName(missed.select("cust"), allowMissingColumns=True)


@register("WITH s AS (SELECT id, row_number() OVER (PARTITION BY masker ORDER BY md5(concat_ws('|', '25', CAST(id AS VARCHAR))), id) AS r FROM clips) SELECT id, "
    "'full' AS condition FROM clips UNION ALL SELECT id, c FROM s, (VALUES ('gain'), ('cut')) v(c) WHERE r <= 30", "clips")
def c14_job_plan(clips):
    return P.job_plan(clips, ["id"], ["gain", "cut"], 30, 25, ["masker"])


# ---- model tables (fitted models: no SQL form)


def _ridge_sql(alphas) -> str:
    """Ridge on x1 and x2, standardised in each training set (folds 1-5 but one; tr 0: all), by the closed form of two
    normal equations, for every penalty."""
    return f"""WITH r AS (SELECT id, nation, id % 6 AS fold, bal % 97 AS x1, nation * 1.0 AS x2, score + (bal % 97) / 200 AS y FROM cust),
m AS (SELECT k AS tr, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
  FROM r, (SELECT unnest(range(0, 6)) AS k) WHERE fold != 0 AND fold != k GROUP BY k),
w AS (SELECT *, n + a AS d, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS b1, n * c2 / s2 AS b2 FROM m, (SELECT unnest([{', '.join(map(repr, alphas))}]::DOUBLE[]) AS a)),
v AS (SELECT *, (d * b1 - o * b2) / (d * d - o * o) / s1 AS w1, (d * b2 - o * b1) / (d * d - o * o) / s2 AS w2 FROM w),
p AS (SELECT r.*, a, tr, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS pred FROM r JOIN v ON fold = tr AND fold != 0),
f AS (SELECT fold, a AS alpha, count(*) AS n, 1 - avg((y - pred) ** 2) / var_pop(y) AS r2 FROM p GROUP BY ALL),
c AS (SELECT alpha, avg(r2) AS mean_r2 FROM f GROUP BY alpha ORDER BY mean_r2 DESC, alpha LIMIT 1) """


@register(_ridge_sql(LM.RIDGE_GRID) + "SELECT fold, alpha, n, round(r2, 6) + 0.0 AS r2 FROM f", "cust")
def t22_ridge_folds(cust):
    return r6(_ridge(cust).scores())


@register(_ridge_sql(LM.RIDGE_GRID) + "SELECT alpha, round(mean_r2, 6) + 0.0 AS mean_r2, CASE alpha WHEN 1000000 THEN 'top' WHEN 1 THEN 'bottom' END AS edge FROM c", "cust")
def t22_ridge_choice(cust):
    return r6(_ridge(cust).choice())


@register(_ridge_sql(LM.RIDGE_GRID) + "SELECT id, fold, alpha, round(pred, 6) + 0.0 AS pred FROM p JOIN c ON a = alpha", "cust")
def t22_ridge_oof(cust):
    return r6(_ridge(cust).oof().select("id", "fold", "alpha", "pred"))


@register(_ridge_sql(LM.RIDGE_GRID) + ", e AS (SELECT nation, y, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS pred FROM r JOIN v ON tr = 0 AND fold = 0 JOIN c ON a = alpha), s AS (SELECT avg(y) AS y, "
    "avg(pred) AS pred FROM e GROUP BY nation) " + " UNION ALL ".join(f"SELECT '{n}' AS level, count(*) AS n, round(1 - avg((y - pred) ** 2) / var_pop(y), 6) + 0.0 AS r2, "
    f"round(corr(y, pred), 6) + 0.0 AS r FROM {t}" for n, t in (("row", "e"), ("stimulus", "s"))), "cust")
def t22_ridge_external(cust):
    """Fold 0 is the external set, a nation its stimulus."""
    return r6(_ridge(cust).external(_ridge_rows(cust).where("fold = 0"), "nation"))


def _ridge_rows(cust):
    return cust.select("id", "nation", (F.col("id") % 6).alias("fold"), (F.col("bal") % 97).alias("x1"), F.col("nation").cast("double").alias("x2"), (F.col("score") + (F.col("bal") % 97) / 200).alias("y"))


def _ridge(cust):
    return LM.RidgeSearch(_ridge_rows(cust).where("fold != 0"), ["x1", "x2"], "y", "fold")


@register(None, "cust")
def t23_gbt_folds(cust):
    """The grid of eight settings over five folds, each model stopped by its own tenth; `chosen` marks the best settings."""
    b = BO.Boosting(_ridge_rows(cust).where("fold != 0"), ["x1", "x2"], "y", "fold", "id")
    best = b.choice().select("leaves", "least", "l2", F.lit(True).alias("chosen"))
    return r6(b.scores().join(F.broadcast(best), ["leaves", "least", "l2"], "left").fillna(False, ["chosen"]))


def _three(of: str) -> tuple[list[str], str]:
    """Weights of three features by Cramer's rule over the centred sums of `of`, and the determinant."""
    c = [[f"{of}.c{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(3)]
    det = lambda m: (
        f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    )
    with_y = lambda k: [[c[i][3] if j == k else c[i][j] for j in range(3)] for i in range(3)]
    return [f"{det(with_y(k))} / {det([r[:3] for r in c])}" for k in range(3)], det([r[:3] for r in c])


_V24 = ["x0", "x1", "x2", "y"]
_T24 = f"""WITH r AS (SELECT id, nation, bal % 97 AS x0, id % 13 * 1.0 AS x1, bal % 7 + (id % 13) / 3 AS x2, score + (bal % 97) / 300 AS y FROM cust),
s AS (SELECT nation, count(*) AS n, {', '.join(f'sum({v}) AS s{i}' for i, v in enumerate(_V24))}, {', '.join(f'sum({_V24[i]} * {_V24[j]}) AS p{i}{j}' for i in range(4) for j in range(i, 4))} FROM r GROUP BY nation),
t AS (SELECT {', '.join(f'sum({k}) AS {k}' for k in ['n', *(f's{i}' for i in range(4)), *(f'p{i}{j}' for i in range(4) for j in range(i, 4))])} FROM s),
d AS (SELECT s.nation, {', '.join(f't.{k} - s.{k} AS {k}' for k in ['n', *(f's{i}' for i in range(4)), *(f'p{i}{j}' for i in range(4) for j in range(i, 4))])} FROM s, t),
c AS (SELECT nation, n, s0, s1, s2, s3, {', '.join(f'p{i}{j} - s{i} * s{j} / n AS c{i}{j}' for i in range(4) for j in range(i, 4))} FROM d),
w AS (SELECT *, {', '.join(f'{e} AS w{k}' for k, e in enumerate(_three('c')[0]))} FROM c),
a AS (SELECT n, {', '.join(f'p{i}{j} - s{i} * s{j} / n AS c{i}{j}' for i in range(4) for j in range(i, 4))} FROM t) """


def _rows24(cust):
    return cust.select("id", "nation", (F.col("bal") % 97).alias("x0"), (F.col("id") % 13 * 1.0).alias("x1"), (F.col("bal") % 7 + F.col("id") % 13 / 3).alias("x2"), (F.col("score") + (F.col("bal") % 97) / 300).alias("y"))


@register(_T24 + "SELECT id, round(s3 / n + w0 * (x0 - s0 / n) + w1 * (x1 - s1 / n) + w2 * (x2 - s2 / n), 6) + 0.0 AS pred FROM r JOIN w ON w.nation = r.nation", "cust")
def t24_group_oof(cust):
    return r6(LM.group_oof(_rows24(cust), ["x0", "x1", "x2"], "y", "nation").select("id", "pred"))


@register(_T24 + " UNION ALL ".join(f"SELECT 'x{k}' AS feature, round({e} * sqrt(a.c{k}{k} / a.c33), 6) + 0.0 AS weight, n FROM a" for k, e in enumerate(_three("a")[0])), "cust")
def t24_standard_weights(cust):
    return r6(LM.standard_weights(_rows24(cust), ["x0", "x1", "x2"], "y"))


def _rated_texts(docs, labels):
    return labels.join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"]).withColumn("y", F.col("quality").cast("double"))


@register(None, "docs labels")
def t25_text_ridge(docs, labels):
    return r6(TR.text_ridge(_rated_texts(docs, labels), "text", "y", "doc_id"))


@register(None, "docs labels")
def t25_text_ridge_control(docs, labels):
    """The control: all texts dealt anew, five times, so they say nothing; then the mean."""
    by = TR.text_ridge(_rated_texts(docs, labels), "text", "y", "doc_id", permutations=5).select("permutation", "pooled_r2").distinct()
    return r6(by.unionByName(by.agg(F.lit(None).cast("int").alias("permutation"), F.avg("pooled_r2").alias("pooled_r2"))))


@register(None, "embeddings")
def t26_clusters(emb):
    c = emb.select("vec_id", "embedding")
    return r6(M.clusters(c.where("vec_id % 4 != 0"), c, "vec_id", "embedding", range(4, 17)))


@register("SELECT masker_type, count(*) AS n, " + q6("avg(qty) AS qty", "avg(la50) AS la50") + " FROM resp GROUP BY 1 HAVING count(*) >= 5", "resp")
def t27_cluster_profiles(resp):
    return r6(M.cluster_profiles(resp, "masker_type", ["qty", "la50"]))


@register("WITH a AS (SELECT part_group, avg(qty) AS q, avg(la50) AS l FROM resp WHERE fold % 2 = 0 GROUP BY 1), b AS (SELECT part_group, count(qty) AS n, avg(qty) AS q, "
    "avg(la50) AS l FROM resp WHERE fold % 2 = 1 GROUP BY 1 HAVING count(qty) >= 5), j AS (SELECT a.q AS aq, b.q AS bq, a.l AS al, b.l AS bl FROM a "
    "JOIN b ON a.part_group = b.part_group), o AS (SELECT count(*) AS clusters, corr(aq, bq) AS rq, corr(al, bl) AS rl FROM j) SELECT 'qty' AS target, clusters, "
    "round(rq, 6) + 0.0 AS r FROM o UNION ALL SELECT 'la50', clusters, round(rl, 6) + 0.0 FROM o", "resp")
def t27_cluster_agreement(resp):
    """Even and odd folds stand for the lab and the field set."""
    return r6(R.cluster_agreement(resp.where("fold % 2 = 0"), resp.where("fold % 2 = 1"), "part_group", ["qty", "la50"]))


@register(_PROTO + ", o AS (SELECT name, proto, lead(name) OVER (ORDER BY name) AS nxt FROM pr), d AS (SELECT a.name AS x, b.name AS y, " + _APART + " AS distance, a.name // 2 != b.name // 2 AS differs FROM o a "
    "JOIN pr b ON b.name = a.nxt), n AS (SELECT arg_min(name, (abs(name - 3), name)) AS label FROM pr) SELECT label, " + q6("CASE WHEN bool_and(differs) FILTER (WHERE label IN (x, y)) THEN "
    "avg(distance) FILTER (WHERE label IN (x, y)) END AS around", "quantile_cont(distance, 0.5) FILTER (WHERE differs) AS median", "CASE WHEN bool_and(differs) FILTER (WHERE label IN (x, y)) THEN "
    "avg(distance) FILTER (WHERE label IN (x, y)) / quantile_cont(distance, 0.5) FILTER (WHERE differs) END AS ratio") + " FROM d, n GROUP BY label", "embeddings")
def t29_jump_around(emb):
    p = prototypes(emb).withColumnRenamed("label", "name").withColumn("text", F.floor(F.col("name") / 2))
    return r6(E.jump_around(p, "name", "proto", "name", 3, "text"))


@register(_PROTO + ", o AS (SELECT name, proto, lead(name) OVER (ORDER BY name) AS nxt FROM pr), d AS (SELECT o.name AS before, o.nxt AS after, "
    "sqrt(list_sum(list_transform(list_zip(o.proto, pr.proto), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS distance FROM o JOIN pr ON pr.name = o.nxt) SELECT before, "
    "after, round(distance, 6) + 0.0 AS distance, round(distance / (SELECT quantile_cont(distance, 0.5) FROM d), 6) + 0.0 AS jump FROM d", "embeddings")
def t29_neighbour_jumps(emb):
    return r6(E.neighbour_jumps(prototypes(emb).withColumnRenamed("label", "name"), "name", "proto", "name"))


_SIDE = "SELECT part_group AS cluster, qty, la50, pl, masker_type, base FROM resp WHERE fold % 2 "
_TEXT = "(SELECT cluster, string_agg({1}, ', ' ORDER BY n DESC, {0}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, {0}) AS r, n / sum(n) OVER (PARTITION BY cluster) AS s FROM (SELECT cluster, {0}, count(*) AS n FROM {2} GROUP BY ALL)) WHERE r <= 3 GROUP BY cluster)"


@register(f"WITH a AS ({_SIDE}= 0), b AS ({_SIDE}!= 0), x AS (SELECT cluster, count(*) AS n_lab, avg(qty) AS lab_qty, avg(la50) AS lab_la50 FROM a GROUP BY 1), y AS (SELECT cluster, count(*) AS n_field, count(pl) AS n_rated, "
    f"avg(qty) FILTER (WHERE pl IS NOT NULL) AS field_qty, avg(la50) FILTER (WHERE pl IS NOT NULL) AS field_la50 FROM b GROUP BY 1) SELECT x.cluster, n_lab, n_field, n_rated, "
    + q6(*(f"{s}_{t} AS {s}_{t}" for s in ("lab", "field") for t in ("qty", "la50"))) + ", u.t AS lab_top, v.t AS field_top FROM x JOIN y ON y.cluster = x.cluster JOIN "
    + _TEXT.format("masker_type", "masker_type || ' ' || printf('%.0f', 100 * s) || '%'", "a") + " u ON u.cluster = x.cluster JOIN " + _TEXT.format("base", "base || ' (' || n || ')'", "b") + " v ON v.cluster = x.cluster", "resp")
def t27_paired_profiles(resp):
    """Even and odd folds stand for the lab and the field set, answered items for ratings."""
    p = R.paired_profiles(resp.where("fold % 2 = 0"), resp.where("fold % 2 != 0"), "part_group", ["qty", "la50"], "pl", "masker_type", "base")
    return r6(p)


# ---- end to end


_BIN_NO = "CASE bin " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(S.BINS)) + " END"
_MANIFEST = f"""WITH {STIM_SQL}, st AS (SELECT *, {_LADDER.format('score')} AS bin, CASE WHEN la50 < 60 THEN 'quiet' WHEN la50 < 70 THEN 'moderate' ELSE 'loud' END AS side FROM stim),
caps AS (SELECT 'all' AS g, bin AS k, count(*) AS cap, 600 AS quota FROM st GROUP BY ALL), {_FILL}"""
_INNER = _FILL.replace("f AS", "f2 AS").replace("FROM caps", "FROM caps2").replace("lv AS", "lv2 AS").replace("FROM f)", "FROM f2)").replace("bs AS",
    "bs2 AS").replace("FROM lv)", "FROM lv2)").replace("rs AS", "rs2 AS").replace("FROM bs)", "FROM bs2)").replace("tk AS", "tk2 AS").replace("FROM rs)", "FROM rs2)")


@register(_MANIFEST + f""", caps2 AS (SELECT bin AS g, masker_type AS k, count(*) AS cap, any_value(take) AS quota FROM st JOIN tk ON tk.k = bin GROUP BY ALL), {_INNER},
x AS (SELECT st.*, tk2.take, row_number() OVER (PARTITION BY bin, masker_type, side, base ORDER BY md5(concat_ws('|', '42', stimulus_id)), stimulus_id) AS r FROM st 
    JOIN tk2 ON tk2.g = bin AND tk2.k = masker_type),
y AS (SELECT *, row_number() OVER (PARTITION BY bin, masker_type ORDER BY r, md5(concat_ws('|', '42', side, base, CAST(r AS VARCHAR))), stimulus_id) AS kk FROM x),
z AS (SELECT *, concat('park soundscape with ', masker_type, CASE WHEN side = 'loud' THEN ' in the foreground' ELSE ' in the background' END, 
    ' [ISOPleasant: ', {FMT.format('score')}, ']') AS caption FROM y WHERE kk <= take)
SELECT stimulus_id, bin, md5(concat_ws('|', '42', stimulus_id)) || '.wav' AS file, caption, CAST(regexp_extract(caption, 'ISOPleasant: (-?[0-9.]+)', 1) AS DOUBLE) AS score FROM z""", "resp")
def manifest_end_to_end(resp):
    """Responses -> scores -> stimulus rollup -> bins -> nested balanced selection -> captioned manifest."""
    s = stimuli(resp).withColumn("bin", S.pleasantness_bin("score")).withColumn("side", S.loudness3("la50"))
    picked = L.balanced_select(s, 600, "bin", "masker_type", ["side", "base"], 42, ["stimulus_id"], ["bin"])
    rows = picked.select("stimulus_id", "bin", F.concat(S.order_key(42, "stimulus_id"), F.lit(".wav")).alias("file"), T.caption_short("masker_type", F.col("side") == "loud", "score").alias("caption"))
    return rows.withColumn("score", T.parse_tag("caption")["value"])
