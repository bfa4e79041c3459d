"""Captions, tags, names and text rules. Every function returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import _c, hash_int

# Wording of captions and rules.
SOURCE_WORDS = {"traffic": "traffic noise", "other_noise": "other noise", "human": "human sounds", "natural": "natural sounds"}
HARMONISE = {"bird": "natural sounds", "water": "natural sounds", "wind": "natural sounds", "traffic": "traffic noise", "construction": "other noise"}
SCENES = {
    ("bird", "quiet"): "quiet park with natural ambience and birdsong",
    ("bird", "moderate"): "urban park with birds and ambient activity",
    ("bird", "loud"): "busy park with intermittent birdsong",
    ("water", "quiet"): "peaceful waterside environment with flowing water",
    ("water", "moderate"): "waterfront location with water sounds and ambient activity",
    ("water", "loud"): "active waterfront or water treatment facility",
    ("traffic", "quiet"): "suburban street with occasional traffic",
    ("traffic", "moderate"): "busy urban street with steady traffic noise",
    ("traffic", "loud"): "highway or major intersection with heavy traffic",
    ("construction", "quiet"): "light construction activity",
    ("construction", "moderate"): "active construction site with machinery",
    ("construction", "loud"): "intense construction site with heavy equipment",
    ("wind", "quiet"): "outdoor environment with light wind",
    ("wind", "moderate"): "windy outdoor location",
    ("wind", "loud"): "highly exposed outdoor area with strong wind",
    ("silence", "quiet"): "quiet controlled environment",
    ("silence", "moderate"): "indoor or sheltered space",
    ("silence", "loud"): "indoor space with background noise",
}
LICENCES = [("publicdomain", "CC0"), ("by-nc", "BY-NC"), ("/by/", "BY"), ("sampling", "Sampling+")]
TAG = r"^(.*?)\s*\[ISOPleasant:\s*(-?\d+(?:\.\d+)?)\]\s*$"
TAG_LOOSE = r"ISOPleasant:\s*(-?\d+(?:\.\d+)?)\]?"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def fmt2(x) -> Column:
    """Two decimals, half-even on the double, minus zero as zero."""
    s = F.call_function("format_number", _c(x), F.lit("0.00"))
    return F.when(s == "-0.00", "0.00").otherwise(s)


def compound_key(base, masker, smr) -> Column:
    """base|masker|smr, with smr cut toward zero."""
    return F.concat_ws("|", _c(base), _c(masker), _c(smr).cast("int").cast("string"))


def split_key(key) -> list[Column]:
    parts = F.split(_c(key), r"\|", -1)
    return [parts[0].alias("base"), parts[1].alias("masker"), parts[2].try_cast("int").alias("smr")]


def masker_type(masker) -> Column:
    return F.split(_c(masker), "_", -1)[0]


def caption_short(word, foreground, score) -> Column:
    place = F.when(_c(foreground), "in the foreground").otherwise("in the background")
    return F.concat(F.lit("park soundscape with "), _c(word), F.lit(" "), place, tag(score))


def tag(score) -> Column:
    return F.concat(F.lit(" [ISOPleasant: "), fmt2(score), F.lit("]"))


def shortest(x, digits: int) -> Column:
    """A number rounded half-even as its shortest text with one decimal at least (0.3, not 0.30)."""
    return (F.rint(_c(x) * 10**digits) / 10**digits).cast("string")


def caption_long(scene, loudness, la50, label, score, source=None) -> Column:
    head = _c(scene) if source is None else F.concat(_c(scene), F.lit(" with "), _c(source))
    return F.concat(head, F.lit(". Loudness: "), _c(loudness), F.lit(" (LA50: "), shortest(la50, 1), F.lit(" dB). Pleasantness: "), _c(label),
        F.lit(" (ISOPleasant: "), shortest(score, 2), F.lit(")."))


def place_name(x) -> Column:
    """CamdenTown, Camden_Town and Camden-Town become Camden Town."""
    s = F.regexp_replace(_c(x), r"[_\-]+", " ")
    s = F.regexp_replace(s, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def top_sources(scores: dict[str, Column], threshold: float = 3.5, k: int = 2) -> Column:
    """Words of the strongest sources at or over the threshold; ties by key, descending; null and NaN out."""
    pairs = F.array(*(F.struct(c.cast("double").alias("v"), F.lit(n).alias("k"), F.lit(SOURCE_WORDS[n]).alias("w")) for n, c in scores.items()))
    good = F.filter(pairs, lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]) & (p["v"] >= threshold))
    return F.transform(F.slice(F.sort_array(good, asc=False), 1, k), lambda p: p["w"])


def caption_sources(words: Column, score, place=None, city=None) -> Column:
    what = F.when(F.size(words) > 0, F.array_join(words, " and ")).otherwise("no dominant sound source")
    part = lambda pre, x: F.lit("") if x is None else F.when(F.coalesce(_c(x), F.lit("")) != "", F.concat(F.lit(pre), x)).otherwise("")
    return F.concat(F.lit("soundscape with "), what, part(" at ", None if place is None else place_name(place)), part(" in ", None if city is None else _c(city)), tag(score))


def caption_harmonised(masker, foreground, score) -> Column:
    word, nat = _map(HARMONISE)[_c(masker)], F.lit("natural sounds")
    what = F.when(word == nat, nat).when(_c(foreground), F.concat(word, F.lit(" and "), nat)).otherwise(F.concat(nat, F.lit(" and "), word))
    return F.concat(F.lit("soundscape with "), what, tag(score))


def scene_of(masker, level) -> Column:
    """Scene phrase and confidence 0.9; an unknown masker gets a phrase by level only, at 0.5. Maskers are looked up
    trimmed and in lower case; a level other than the three is taken as moderate."""
    key = F.lower(F.trim(_c(masker)))
    scenes = _map({f"{m}|{lv}": s for (m, lv), s in SCENES.items()})
    found = F.coalesce(scenes[F.concat_ws("|", key, _c(level))], scenes[F.concat_ws("|", key, F.lit("moderate"))])
    generic = F.when(_c(level) == "quiet", "quiet environment").when(_c(level) == "loud", "loud environment").otherwise("moderate activity environment")
    return F.struct(F.coalesce(found, generic).alias("scene"), F.when(found.isNotNull(), 0.9).otherwise(0.5).alias("confidence"))


def parse_tag(caption, pattern: str = TAG) -> Column:
    """text and value of a tagged caption; both null where there is no tag."""
    c = _c(caption)
    text, value = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.struct(F.when(value != "", text).alias("text"), value.try_cast("double").alias("value"))


def parse_tag_loose(caption) -> Column:
    return F.regexp_extract(_c(caption), TAG_LOOSE, 1).try_cast("double")


def after_last_colon(caption) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(_c(caption), ":", -1), r"\]", "")).try_cast("double")


def retag(caption, word: Column) -> Column:
    """The caption with its number replaced by a label."""
    p = parse_tag(caption)
    return F.when(p["value"].isNotNull(), F.concat(p["text"], F.lit(" [pleasantness: "), word, F.lit("]")))


def strip_repeat(name) -> Column:
    """x_r3.wav -> x.wav"""
    return F.regexp_replace(_c(name), r"_r\d+(\.wav)$", "$1")


def is_repeat(name) -> Column:
    return _c(name).rlike(r"_r\d+\.wav$")


def source_group(phrase) -> Column:
    s = F.lower(_c(phrase))
    hits = [(s.contains("natural"), "natural"), (s.contains("traffic"), "traffic"), (s.contains("human"), "human"), (s.contains("other noise"), "other_noise")]
    n = sum((h.cast("int") for h, _ in hits), F.lit(0))
    out = F.when(s.contains("no dominant"), "none").when(n != 1, "mixed")
    for h, name in hits:
        out = out.when(h, name)
    return out


def city_of(path, location, cities: dict[str, str]) -> Column:
    """A city named in the path, else the location's, else unknown."""
    names = "|".join(sorted({c for c in cities.values()}))
    hit = F.regexp_extract(_c(path), f"(?i)({names})", 1)
    return F.when(hit != "", F.initcap(hit)).otherwise(F.coalesce(_map(cities)[_c(location)], F.lit("unknown")))


def licence_class(url) -> Column:
    out = F.when(_c(url).isNull(), None)
    for part, name in LICENCES:
        out = out.when(_c(url).contains(part), name)
    return out.otherwise(_c(url))


def keyword_hits(captions: list[str], patterns: dict[str, str]) -> dict[str, Column]:
    """Per pattern, and for any of them (n_any): how many of the caption columns match, without case."""
    arr = F.array(*(F.lower(F.col(c)) for c in captions))
    count = lambda p: F.size(F.filter(arr, lambda x: x.rlike(p)))
    return {**{k: count(p) for k, p in patterns.items()}, "n_any": count("|".join(patterns.values()))}


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def zero_pad(x, n: int) -> Column:
    return F.lpad(_c(x).cast("string"), n, "0")


def parse_name(name, pattern: str = r"^s(\d+)_(.+)_p(-?\d+(?:\.\d+)?)\.wav$") -> Column:
    n = _c(name)
    return F.struct(F.regexp_extract(n, pattern, 1).try_cast("int").alias("seed"), F.regexp_extract(n, pattern, 2).alias("item"), F.regexp_extract(n, pattern, 3).try_cast("double").alias("p"))


def first_sentence(caption) -> Column:
    """The part before '. Loudness:', without white space around it."""
    return F.trim(F.substring_index(_c(caption), ". Loudness:", 1))


def _number(x) -> Column:
    """A number or its text as a double; null where it is none."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def caption_rated(caption, score) -> Column:
    """The first sentence with the rating in two decimals; the sentence alone without one."""
    text, v = first_sentence(F.coalesce(_c(caption), F.lit(""))), _number(score)
    rated = F.concat(text, F.lit(". [ISOPleasant: "), F.call_function("format_number", v, F.lit("0.00")), F.lit("]"))
    return F.when(v.isNotNull(), rated).otherwise(text)


def caption_binned(caption, label, score) -> Column:
    """The caption, its bin in brackets and its rating without decimals; an empty or missing one is left out."""
    text, b, v = F.coalesce(_c(caption), F.lit("")), F.coalesce(_c(label), F.lit("")), _number(score)
    named = F.when((b != "") & (F.lower(b) != "nan"), F.concat(F.lit(" [pleasantness: "), b, F.lit("]"))).otherwise("")
    rated = F.when(v.isNotNull(), F.concat(F.lit(" (iso_pleasantness: "), F.call_function("format_number", v, F.lit("0")), F.lit(")"))).otherwise("")
    return F.concat(text, named, rated)


def strip_end(x) -> Column:
    return F.regexp_replace(F.trim(_c(x)), r"[ .]+$", "")


def pick_phrase(phrases: list[str], seed: int, *key) -> Column:
    """One of the phrases, by the hash of the key."""
    return F.element_at(F.array(*map(F.lit, phrases)), (hash_int(seed, *key) % len(phrases) + 1).cast("int"))


# Concepts with their conditions over five features, confidence, and wording alone and together.
CONCEPTS = [
    ("birdsong", "sc > 3000 AND sc < 8000 AND zcr > 0.1 AND onset > 0.05", 0.85, "natural soundscape with birdsong", "birds singing"),
    ("water", "sc < 2000 AND zcr < 0.05 AND rms > 0.01", 0.8, "waterside environment with flowing water", "flowing water"),
    ("traffic", "sc > 500 AND sc < 4000 AND rms > 0.02 AND bandwidth > 2000", 0.8, "urban area with traffic noise", "traffic noise"),
    ("wind", "sc < 1000 AND zcr < 0.03 AND rms < 0.01", 0.75, "outdoor environment with wind", "wind"),
    ("construction", "rms > 0.03 AND onset > 0.1 AND bandwidth > 3000", 0.8, "construction site with heavy machinery", "construction machinery"),
    ("speech", "zcr > 0.08 AND zcr < 0.15 AND sc > 1500 AND sc < 4000", 0.75, "public space with human voices and activity", "human voices"),
    ("music", "sc > 1000 AND sc < 5000 AND onset > 0.05 AND onset < 0.2", 0.7, "environment with musical sounds", "musical sounds"),
]


#: What is listed where no concept's condition holds, by the centroid, each with confidence 0.6.
GENERIC = [("low_frequency_ambience", "sc < 2000"), ("midrange_sounds", "sc >= 2000 AND sc < 4000"), ("high_frequency_ambience", "sc >= 4000")]
SURE = 0.6


def rule_labels(rules=CONCEPTS, generic=GENERIC) -> Column:
    """Concepts whose condition holds, by falling confidence, then in rule order; where none does, one of the generic
    ones (none without a centroid)."""
    listed = [*rules, *((name, cond, SURE, "", "") for name, cond in generic)]
    concept = lambda i: F.struct(F.lit(-listed[i][2]).alias("neg"), F.lit(i).alias("i"), *(F.lit(listed[i][k]).alias(n) for k, n in ((0, "name"), (3, "alone"), (4, "many"))))
    which = lambda at: F.array_compact(F.array(*(F.when(F.expr(listed[i][1]), concept(i)) for i in at)))
    hits = which(range(len(rules)))
    return F.when(F.size(hits) > 0, F.sort_array(hits)).otherwise(which(range(len(rules), len(listed))))


def rule_caption(hits: Column) -> Column:
    """Wording of the concepts that are surer than the generic ones."""
    sure = F.filter(hits, lambda h: h["neg"] < -SURE)
    return F.when(F.size(sure) == 0, "environment with ambient sounds").when(F.size(sure) == 1,
        F.get(sure, 0)["alone"]).otherwise(F.concat(F.lit("soundscape with "), F.array_join(F.transform(F.slice(sure, 1, 3), lambda h: h["many"]), " and ")))


def rule_concepts(hits: Column) -> Column:
    """The concepts' names, the surest first."""
    return F.array_join(F.transform(hits, lambda h: h["name"]), ", ")


def rule_confidence(hits: Column) -> Column:
    return F.when(F.size(hits) == 0, 0.6).otherwise(F.aggregate(hits, F.lit(0.0), lambda a, h: a - h["neg"]) / F.size(hits))
